"""Results on a file system: one CSV, published whole or not at all, and reports."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame


def file_sha256(path: str | os.PathLike) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as data:
        while block := data.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def publish_csv(rows: Iterable, path: str | os.PathLike, columns: tuple[str, ...] = ("event_id", "pred_label")) -> int:
    """Write rows in their order as one CSV, ``\\n`` at line ends; the number of rows.

    The file appears under its name only when it is complete; an existing file is never replaced; the partial file is always
    removed. ``rows`` is read as a stream, so the driver holds a partition at most (``DataFrame.toLocalIterator``).
    """
    import csv

    target = Path(path)
    if target.exists():
        raise FileExistsError(target)
    handle, partial = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    try:
        n = 0
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(columns)
            for row in rows:
                writer.writerow([row[c] for c in columns])
                n += 1
            out.flush()
            os.fsync(out.fileno())
        os.link(partial, target)  # fails if the name has been taken meanwhile
        return n
    finally:
        os.unlink(partial)


def publish_table(rows: DataFrame, path: str) -> None:
    """The same rows as a CSV folder, written by the executors; an existing folder is an error."""
    rows.write.mode("errorifexists").option("header", True).csv(path)


def write_report(report: dict, path: str | os.PathLike) -> None:
    """A JSON report beside its result; an existing file is an error."""
    with open(path, "x", encoding="utf-8") as out:
        json.dump(report, out, indent=2, sort_keys=True)
        out.write("\n")


def counts(rows: DataFrame, column: str) -> dict[str, int]:
    """How often each value of a column of few values occurs."""
    return {str(r[0]): r[1] for r in rows.groupBy(column).count().collect()}
