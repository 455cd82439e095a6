"""Command line: predict, train, validate."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 0: done (or valid); 1: the result isn't valid; 2: the call failed."""
    parser = argparse.ArgumentParser(prog="tarn")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("predict")
    for name in ("input", "output", "bundle"):
        p.add_argument(name)
    p.add_argument("--report")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--folder", action="store_true", help="write a CSV folder by the executors, on any store")
    p = commands.add_parser("train")
    for name in ("train", "validation", "bundle"):
        p.add_argument(name)
    p.add_argument("--limit-rows", type=int)
    p.add_argument("--sequence", action="store_true", help="also fit the sequence model")
    p.add_argument("--unsupported", choices=("error", "router"), default="error")
    p = commands.add_parser("validate")
    for name in ("input", "submission"):
        p.add_argument(name)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tarn").getOrCreate()
    try:
        if a.command == "predict":
            from tarn.plans.predict import predict_file, predict_table
            from tarn.plans.train import load_bundle

            model = load_bundle(a.bundle)
            out = predict_table(spark, a.input, a.output, model, a.strict) if a.folder else predict_file(spark, a.input, a.output, model, a.strict, a.report)
        elif a.command == "train":
            from tarn.operators.neural_fit import SequenceConfig
            from tarn.plans.train import read_training, train_bundle

            sets = [read_training(spark, path, a.limit_rows, a.unsupported) for path in (a.train, a.validation)]
            out = train_bundle(spark, *sets, a.bundle, sequence=SequenceConfig() if a.sequence else None)
        else:
            from tarn.plans.validate import validate_submission

            out = validate_submission(spark, a.input, a.submission)
    except Exception as error:  # the boundary of the command
        print(json.dumps({"error": f"{type(error).__name__}: {error}"[:2000]}), file=sys.stderr)
        return 2
    print(json.dumps(out, indent=2, default=str))
    return 0 if out.get("passed", True) else 1


if __name__ == "__main__":
    sys.exit(main())
