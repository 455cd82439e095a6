import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.contract import LABELS, MAX_BODY_BYTES, WIDTH
from tarn.operators import metrics, neural_fit, scoring
from tarn.operators.neural import Base, EnsembleLayer, Residual, SequenceModel, erf
from tarn.operators.prepare import UnsupportedRecord, port_summary, prepare, refuse_errors
from tarn.operators.scoring import Router
from tarn.plans import cli
from tarn.plans.predict import Ensemble, Fold, predict, predict_file, predict_table
from tarn.plans.publish import publish_csv
from tarn.plans.train import RouterConfig, TrainingError, dataset_digest, evaluate, fit_router, fit_sequence_model, load_bundle, save_bundle, train_bundle
from tarn.plans.validate import validate_submission
from tarn.sources.raw import ContractError, read_ids, read_labelled, read_raw

ASA = '<166>Jan 02 USER-0021 11:22:33: USER-0010-0324 Deny tcp src outside:1.2.3.4/9936 dst dmz-1:10.0.0.1/55000 by access-group "acl_in" [0x0, 0x0]'


def records(spark, rows):
    return spark.createDataFrame([(str(k), m, p) for k, (m, p) in enumerate(rows)], "event_id string, message_sanitized string, src_port string")


def vector(entries):
    return {e["i"]: e["v"] for e in entries}


def by_id(df):
    return {int(r["event_id"]): r for r in df.collect()}


# --- sources ------------------------------------------------------------------------------------------------------


def test_csv_source(spark, tmp_path):
    at = tmp_path / "in.csv"
    at.write_text('\ufeffevent_id,message_sanitized,label_binary,extra\n001,"a, ""b""\nc",nonsense,1\n002,,benign,2\n', encoding="utf-8")
    rows = read_raw(spark, str(at)).orderBy("event_id").collect()
    assert [(r["event_id"], r["message_sanitized"], r["src_port"]) for r in rows] == [("001", 'a, "b"\nc', None), ("002", "", None)]
    with pytest.raises(Exception, match="label_binary"):
        read_raw(spark, str(at), labels=True).collect()
    at.write_text("event_id,message_sanitized\n ,x\n")
    with pytest.raises(Exception, match="blank"):
        read_raw(spark, str(at)).collect()
    for bad in ("event_id,event_id\n1,2\n", "id,message_sanitized\n1,2\n", ""):
        at.write_text(bad)
        with pytest.raises(ContractError):
            read_raw(spark, str(at))
    at.write_text('event_id,message_sanitized,"two\nlines"\n1,2,3\n')
    assert read_raw(spark, str(at)).first()["message_sanitized"] == "2"
    at.write_text("event_id,message_sanitized\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017  Spark's own error for a row that is too long
        read_raw(spark, str(at)).collect()
    with pytest.raises(ContractError):
        read_raw(spark, str(tmp_path / "in.txt"))


def test_parquet_source(spark, tmp_path):
    at = str(tmp_path / "in.parquet")
    spark.createDataFrame([("007", None, 80, "malicious")], "event_id string, message_sanitized string, src_port int, label_binary string").write.parquet(at)
    plan = read_raw(spark, at)._jdf.queryExecution().toString()
    assert "label_binary" not in plan.split("ReadSchema")[-1]
    assert read_raw(spark, at, labels=True).first().asDict() == {"event_id": "007", "message_sanitized": None, "src_port": "80", "label": 1}
    assert read_ids(spark, at).first()["event_id"] == "007"
    spark.createDataFrame([(7, "x")], "event_id long, message_sanitized string").write.parquet(f"{at}2.parquet")
    with pytest.raises(ContractError):
        read_raw(spark, f"{at}2.parquet")


# --- preparation --------------------------------------------------------------------------------------------------


def test_prepared_rows(spark):
    long_body = ASA.replace("acl_in", "a" * 240)
    rows = [(ASA, None), (ASA, "9936"), (ASA, "65535"), ("", None), (None, None), (ASA.replace("USER-0010-0324", "%ASA-4-106023:"), None), (long_body, None), (ASA.replace("1.2.3.4", "5.6.7.8"), None), ("USER-0010-0324 Deny gre", None), ("2 - eni-1 - - 80 443 6 1 1 1 1 ACCEPT OK", "81")]
    got = by_id(prepare(records(spark, rows)))
    first = got[0]
    assert (first["route"], first["is_asa_source"], first["error"]) == ("asa", True, None)
    assert 0 < first["length"] <= MAX_BODY_BYTES and bytes(first["body"]).startswith(b" <IDENTITY> Deny tcp src outside:")
    low, high = vector(first["full"]), vector(first["header"])
    assert {k: v for k, v in low.items() if k >= 65792} == {k: v for k, v in high.items() if k >= 65792}
    assert math.isclose(sum(v * v for k, v in low.items() if k < 65792), 1, rel_tol=1e-5)
    ports = lambda r: {k - 66269: v for k, v in vector(r["full"]).items() if k >= 66269}
    assert ports(first) == {} and set(ports(got[1])) == {4, 5, 6, 7, 9, 10, 13, 16} - {4, 5, 7, 9, 10, 13} | {k for k in range(16) if 9936 >> k & 1}
    assert 17 in ports(got[2]) and math.isclose(ports(got[2])[17], 1 / math.sqrt(18), rel_tol=1e-6)
    assert {k: v for k, v in vector(got[2]["full"]).items() if k < 66269} == {k: v for k, v in low.items() if k < 66269}
    assert got[3]["full"] == got[4]["full"] and got[3]["route"] == "empty" and len(got[3]["full"]) == 17
    assert got[5]["error"] == "asa_grammar_unsupported" and got[5]["header"] is None
    assert got[6]["error"].startswith("asa_body_too_long:") and got[6]["body"] is None
    assert got[7]["full"] == first["full"] and got[7]["body"] == first["body"]
    assert got[8]["error"] == "asa_parser_unsupported" and got[8]["route"] == "unsupported"
    assert got[9]["port_conflict"] and not got[9]["is_asa_source"]
    assert max(e["i"] for r in got.values() for e in r["full"]) < WIDTH
    summary = port_summary(prepare(records(spark, rows))).first()
    assert (summary["observed"], summary["conflicting_observations"]) == (3, 2)
    with pytest.raises(Exception, match="asa_grammar_unsupported"):
        refuse_errors(prepare(records(spark, rows))).select("event_id", "error").collect()
    with pytest.raises(UnsupportedRecord, match="record 5: asa_grammar_unsupported"):
        refuse_errors(prepare(records(spark, rows).repartition(7)))
    assert refuse_errors(prepare(records(spark, rows[:5]))).count() == 5
    assert sorted(r["event_id"] for r in prepare(records(spark, rows)).where("error is not null and route <> 'empty'").collect()) == ["5", "6", "8"]


# --- scoring ------------------------------------------------------------------------------------------------------


def test_softmax_and_classes(spark):
    rows = spark.createDataFrame([([1000.0, 1000.0, -1000.0],), ([0.0, 1.0, 2.0],)], "s array<double>")
    got = rows.select(scoring.softmax(F.col("s")).alias("p"), scoring.log_softmax(F.col("s")).alias("l"), scoring.argmax(F.col("s")).alias("c"), scoring.sigmoid(F.col("s")[0]).alias("g")).collect()
    assert got[0]["p"][:2] == [0.5, 0.5] and got[0]["c"] == 0 and got[0]["g"] == 1.0
    assert math.isclose(sum(got[1]["p"]), 1) and got[1]["c"] == 2 and math.isclose(math.exp(got[1]["l"][2]), got[1]["p"][2])
    with pytest.raises(Exception, match="finite"):
        scoring.decide(spark.createDataFrame([([float("nan"), 0.0, 0.0],)], "probabilities array<double>")).collect()


def layer(g, outputs, inputs, members=16):
    return EnsembleLayer(g.normal(size=(outputs, inputs)), g.normal(1, 0.2, (members, inputs)), g.normal(1, 0.2, (members, outputs)), g.normal(size=(members, outputs)))


def test_sparse_layer_is_the_full_equation():
    g = np.random.default_rng(3)
    one = layer(g, 8, 500)
    rows = [(np.array([17, 0, 17, 499]), np.array([1.0, 2.0, 3.0, 4.0])), (np.array([], dtype=int), np.array([]))]
    x = np.zeros((2, 500))
    np.add.at(x, (0, rows[0][0]), rows[0][1])
    want = np.stack([(x * one.r[m]) @ one.weight.T * one.s[m] + one.b[m] for m in range(16)], axis=1)
    assert np.allclose(one.sparse(rows), want, rtol=1e-5, atol=1e-6) and np.allclose(one.sparse(rows)[1], one.b)
    assert np.allclose(one.dense(np.repeat(x[:, None], 16, axis=1)), want)


def test_transformer_padding_and_zero_head():
    own = Residual.initial(5)
    assert not own.logits([b"ab", b"c" * 176]).any()
    own.weights["head.weight"] = np.random.default_rng(1).normal(size=(3, 64))
    alone, padded = own.logits([b"\x00\x0c"]), own.logits([b"\x00\x0c", b"x" * 50])
    assert np.allclose(alone[0], padded[0]) and not np.allclose(own.logits([b"\x00\x0c\x00"]), alone)
    assert np.allclose(erf(np.array([0.0, 0.5, -2.0])), [math.erf(v) for v in (0.0, 0.5, -2.0)], atol=2e-7)


def test_gradients_are_those_of_the_loss():
    """Each array's gradient against differences of the loss."""
    g = np.random.default_rng(7)
    base = Base(layer(g, 5, 40, 3), layer(g, 5, 5, 3), layer(g, 3, 5, 3), layer(g, 3, 10, 3), 30)
    rows = [(np.array([1, 7, 7, 33]), g.normal(size=4)), (np.array([2, 39]), g.normal(size=2)), (np.array([], dtype=int), np.array([]))]
    labels = np.array([0, 2, 1])
    _, grads = neural_fit.base_gradients(base, rows, labels)
    arrays = {f"{n}.{k}": getattr(getattr(base, n), k) for n in ("first", "second", "head", "direct") for k in ("weight", "r", "s", "b")}
    assert set(arrays) == set(grads)
    residual, fixed, bodies = Residual.initial(3), g.normal(size=(3, 3, 3)), [b"abca", b"x", b"\x00yz"]
    residual.weights["head.weight"] = g.normal(size=(3, 64))

    def slope_of(logits):
        loss, slope = neural_fit.loss_and_slope(fixed + logits[:, None, :], labels)
        return loss, slope.sum(axis=1)

    _, more = neural_fit.residual_gradients(residual, bodies, slope_of)
    assert set(more) == set(residual.weights)
    for some, own, loss in ((arrays, grads, lambda: neural_fit.base_gradients(base, rows, labels)[0]), (residual.weights, more, lambda: slope_of(residual.logits(bodies))[0])):
        for name, a in some.items():
            columns, got = own[name]
            full = np.zeros_like(a)
            full[slice(None) if columns is None else (slice(None), columns)] = got
            for at in {tuple(int(g.integers(n)) for n in a.shape) for _ in range(4)} | {np.unravel_index(np.abs(full).argmax(), a.shape)}:
                before, step = a[at], 1e-4
                a[at] = before + step
                high = loss()
                a[at] = before - step
                low = loss()
                a[at] = before
                assert math.isclose((high - low) / (2 * step), full[at], rel_tol=2e-3, abs_tol=2e-6), (name, at)


def test_sequence_model_learns(spark, tmp_path):
    """The base learns from headers, the residual from bodies what headers don't tell."""
    r = np.random.default_rng(5)
    labels = r.integers(0, 3, 120)
    rows = [(np.array([10 + 3 * int(min(y, 1)), 45]), np.array([1.0, 0.5])) for y in labels]
    bodies = [bytes(r.integers(97, 105, 6).tolist()) + b"XYZ"[y : y + 1] for y in labels]
    config, history = neural_fit.SequenceConfig(base_epochs=15, residual_epochs=25, base_rate=0.02, residual_rate=4e-3, batch=32, members=4, hidden=8), []
    model = neural_fit.fit_sequence(rows, bodies, labels, 60, 40, config, history)
    alone = SequenceModel(model.base).probabilities(rows, bodies).argmax(axis=1)
    assert (alone[labels == 0] == 0).all() and (alone == labels).mean() < 0.9
    assert (model.probabilities(rows, bodies).argmax(axis=1) == labels).mean() > 0.95
    assert [h["stage"] for h in history] == ["base"] * 15 + ["residual"] * 25 and history[-1]["loss"] < history[15]["loss"] < history[0]["loss"]


def test_train_with_a_sequence_model(spark, tmp_path):
    made = [(f"t{k}", k % 3, [(100 + 3 * (k % 3), 1.0)], [(100 + 3 * (k % 3), 1.0)] if k < 9 else None, bytes([97 + k % 3]) * 2 if k < 9 else None) for k in range(12)]
    schema = "event_id string, label int, full array<struct<i:int,v:float>>, header array<struct<i:int,v:float>>, body binary"
    train = spark.createDataFrame(made, schema)
    config = neural_fit.SequenceConfig(base_epochs=1, residual_epochs=1, members=2, hidden=4)
    result = train_bundle(spark, train, train.withColumn("event_id", F.concat(F.lit("v"), "event_id")), str(tmp_path / "b"), RouterConfig(iterations=10), config)
    assert result["rows"] == 12 and load_bundle(str(tmp_path / "b")).folds[0].sequence.residual is not None
    assert [json.loads(x)["stage"] for x in (tmp_path / "b" / "history.jsonl").read_text().splitlines()[-2:]] == ["base", "residual"]
    assert fit_sequence_model(train.where("event_id > 't9'").withColumn("body", F.lit(None).cast("binary")), config) is None


def constant(p):
    return Ensemble([Fold(Router(np.zeros((WIDTH, 3)), np.log(np.array(p))))])


def test_predict_routes_and_folds(spark):
    g = np.random.default_rng(2)
    small = Base(layer(g, 4, WIDTH, 2), layer(g, 4, 4, 2), layer(g, 3, 4, 2), layer(g, 3, WIDTH - 65792, 2), 65792)
    model = Ensemble([Fold(Router(np.zeros((WIDTH, 3)), np.log([0.2, 0.7, 0.1])), SequenceModel(small)), constant([0.5, 0.25, 0.25]).folds[0]])
    got = by_id(predict(records(spark, [(ASA, None), ("x", None)]), model))
    assert np.allclose(got[1]["probabilities"], [0.35, 0.475, 0.175]) and got[1]["pred_label"] == "malicious"
    assert not np.allclose(got[0]["probabilities"], got[1]["probabilities"]) and math.isclose(sum(got[0]["probabilities"]), 1)


def test_evaluation_is_prediction(spark):
    """Metrics of an ensemble with a sequence model are those of its predictions."""
    g = np.random.default_rng(2)
    small = Base(layer(g, 4, WIDTH, 2), layer(g, 4, 4, 2), layer(g, 3, 4, 2), layer(g, 3, WIDTH - 65792, 2), 65792)
    model = Ensemble([Fold(Router(np.zeros((WIDTH, 3)), np.log([0.2, 0.7, 0.1])), SequenceModel(small))])
    rows = records(spark, [(ASA, None), ("x", None), (ASA.replace("tcp", "udp"), "80")]).withColumn("label", F.lit(0))
    done = predict(rows, model)
    want = sorted((r["label"], r["pred_class"]) for r in done.collect())
    got = evaluate(prepare(rows), model)["confusion"]
    assert sorted((r["label"], r["predicted"]) for r in got for _ in range(r["n"])) == want and {p for _, p in want} != {1}


# --- files --------------------------------------------------------------------------------------------------------


def test_predict_file(spark, tmp_path):
    source, out, report = tmp_path / "in.csv", tmp_path / "res.csv", tmp_path / "report.json"
    source.write_text("event_id,message_sanitized,src_port\n001,a,\n003,b,1\n002,c,2\n")
    made = predict_file(spark, str(source), str(out), constant([0.2, 0.7, 0.1]), report=str(report))
    assert out.read_text() == "event_id,pred_label\n001,malicious\n003,malicious\n002,malicious\n"
    assert made["rows"] == 3 and json.loads(report.read_text())["counts_by_label"] == {"malicious": 3}
    with pytest.raises(FileExistsError):
        predict_file(spark, str(source), str(out), constant([0.2, 0.7, 0.1]))
    assert predict_table(spark, str(source), str(tmp_path / "folder"), constant([0.2, 0.7, 0.1])) == {"counts_by_label": {"malicious": 3}, "rows": 3, "folds": 1}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        predict_table(spark, str(source), str(tmp_path / "folder"), constant([0.2, 0.7, 0.1]))
    source.write_text("event_id,message_sanitized\n001,a\n001,b\n")
    with pytest.raises(ContractError):
        predict_file(spark, str(source), str(tmp_path / "two.csv"), constant([0.2, 0.7, 0.1]))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["folder", "in.csv", "report.json", "res.csv"]


def test_order_of_the_source(spark, tmp_path):
    """Rows come in the order of file names and of rows in them, however large the files are and however they are read."""
    at = tmp_path / "in.parquet"
    for k, n in enumerate((3, 400, 50)):
        spark.createDataFrame([(f"{k}-{i}", "x" * i, "benign") for i in range(n)], "event_id string, message_sanitized string, label_binary string").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        at.mkdir(exist_ok=True)
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(at / f"{k}.parquet")
    want = [f"{k}-{i}" for k, n in enumerate((3, 400, 50)) for i in range(n)]
    assert [r["event_id"] for r in read_labelled(spark, str(at), 300).collect()] == want[:300]
    predict_file(spark, str(at), str(tmp_path / "out.csv"), constant([0.2, 0.7, 0.1]))
    assert (tmp_path / "out.csv").read_text().split("\n")[1:-1] == [f"{i},malicious" for i in want]


def test_publish_leaves_nothing_behind(tmp_path):
    def rows():
        yield {"event_id": "1", "pred_label": "benign"}
        raise RuntimeError

    with pytest.raises(RuntimeError):
        publish_csv(rows(), tmp_path / "x.csv")
    assert not list(tmp_path.iterdir())


def test_validate(spark, tmp_path, capsys):
    source, out = str(tmp_path / "in.parquet"), tmp_path / "res.csv"
    spark.createDataFrame([("001", "x"), ("002", "y"), ("003", "z")], "event_id string, label string").write.parquet(source)
    out.write_text("event_id,pred_label\n003,benign\n001,malicious\n002,suspicious\n")
    assert validate_submission(spark, source, str(out))["passed"]
    assert cli.main(["validate", source, str(out)], spark) == 0
    out.write_text("event_id,pred_label\n003,benign\n003,other\n004,benign\n ,benign\n001,benign,1\n")
    got = validate_submission(spark, source, str(out))
    assert not got["passed"]
    assert {k: got[k] for k in ("missing_ids", "extra_ids", "duplicate_output_ids", "invalid_labels", "invalid_output_ids", "malformed_rows")} == {"missing_ids": 2, "extra_ids": 1, "duplicate_output_ids": 1, "invalid_labels": 1, "invalid_output_ids": 1, "malformed_rows": 1}
    assert cli.main(["validate", source, str(out)], spark) == 1
    out.write_text("id,label\n1,2\n")
    with pytest.raises(ContractError):
        validate_submission(spark, source, str(out))
    assert cli.main(["validate", source, str(out)], spark) == 2
    capsys.readouterr()


# --- training -----------------------------------------------------------------------------------------------------


def labelled(spark, rows):
    made = [(i, y, [(100 + 3 * y, 1.0), (7, 0.5)]) for i, y in rows]
    return spark.createDataFrame(made, "event_id string, label int, full array<struct<i:int,v:float>>")


def test_router_fit_reaches_the_optimum(spark):
    r = np.random.default_rng(4)
    rows = [(str(k), int(y)) for k, y in enumerate(r.integers(0, 3, 90))]
    made = [(i, y, [(k, float(v)) for k, v in enumerate(r.normal(size=4) + np.eye(4)[y])]) for i, y in rows]
    data = spark.createDataFrame(made, "event_id string, label int, full array<struct<i:int,v:float>>")
    router = fit_router(data, RouterConfig(penalty=0.01, iterations=100), width=4)
    x, y = np.array([[v for _, v in m[2]] for m in made]), np.array([m[1] for m in made])[:, None] == np.arange(3)
    error = 1 / (1 + np.exp(-(x @ router.weights + router.intercept))) - y
    assert np.abs(x.T @ error / 90 + 0.01 * router.weights).max() < 1e-4 and np.abs(error.mean(axis=0)).max() < 1e-4


def test_train_save_load(spark, tmp_path):
    train, validation = labelled(spark, [(f"t{k}", k % 3) for k in range(9)]), labelled(spark, [(f"v{k}", k % 3) for k in range(6)])
    at = tmp_path / "bundle"
    result = train_bundle(spark, train, validation, str(at), RouterConfig(iterations=15))
    assert dataset_digest(train) == dataset_digest(train.repartition(3)) != dataset_digest(train.union(train.limit(1)).union(train.limit(1)))
    assert result["macro_f1"] == 1.0 and result["errors"] == 0 and json.loads((at / "plan.json").read_text())["checks"]["shared_inputs"] == 6
    load_bundle(str(at))
    steps = [json.loads(x) for x in (at / "history.jsonl").read_text().splitlines()]
    assert len(steps) > 2 and steps[-1]["objective"] < steps[0]["objective"] and not (at / "failure.json").exists()
    with open(at / "fold0.npz", "r+b") as f:
        f.seek(100)
        f.write(b"??")
    with pytest.raises(TrainingError):
        load_bundle(str(at))
    for bad in (train, labelled(spark, [("v1", 0), ("v1", 1)])):
        with pytest.raises(TrainingError):
            train_bundle(spark, train, bad, str(tmp_path / "no"))
    with pytest.raises(TrainingError):
        train_bundle(spark, labelled(spark, [("a", 0)]), validation, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_bundle_of_a_sequence_model(tmp_path):
    g = np.random.default_rng(2)
    base = Base(layer(g, 4, 50, 2), layer(g, 4, 4, 2), layer(g, 3, 4, 2), layer(g, 3, 10, 2), 40)
    save_bundle(Ensemble([Fold(Router(np.zeros((WIDTH, 3)), np.zeros(3)), SequenceModel(base, Residual.initial(1)))]), str(tmp_path / "b"))
    back = load_bundle(str(tmp_path / "b")).folds[0].sequence
    rows, bodies = [(np.array([1, 45]), np.array([1.0, 2.0]))], [b"x"]
    assert np.allclose(back.probabilities(rows, bodies), SequenceModel(base, Residual.initial(1)).probabilities(rows, bodies))
    with pytest.raises(FileExistsError):
        save_bundle(Ensemble([]), str(tmp_path / "b"))


def test_metrics_with_a_class_missing(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1)], "label int, predicted int")
    matrix = metrics.confusion(rows)
    assert matrix.count() == len(LABELS) ** 2
    assert [r["f1"] for r in metrics.class_metrics(matrix).orderBy("label").collect()] == [1.0, 1.0, None]
    assert metrics.macro(matrix).first()["macro_f1"] is None


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from tarn.sources import scratch

    assert scratch.new_path(spark, "x.csv").endswith(".csv")

    class Cluster:
        """A session of a cluster without a checkpoint folder."""

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://driver:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("Context", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.shared_dir(Cluster)


def test_small_inputs_use_all_cores(spark, tmp_path):
    """A file of one row group is dealt over all cores; as many files as cores, unknown sizes and streams stay."""
    from tarn.sources.spread import spread

    at = str(tmp_path / "one.parquet")
    spark.range(1000).coalesce(1).write.parquet(at)
    cores = spark.sparkContext.defaultParallelism
    one = spark.read.parquet(at)
    assert spread(one).rdd.getNumPartitions() == cores and sorted(r[0] for r in spread(one).collect()) == list(range(1000))
    spark.range(1000).repartition(cores).write.parquet(f"{at}2")
    for rows in (spark.read.parquet(f"{at}2"), spark.createDataFrame([(1,)], "a int"), spark.readStream.schema("id long").parquet(at)):
        assert spread(rows) is rows


# --- streams ------------------------------------------------------------------------------------------------------


def test_stream(spark, tmp_path):
    from tarn.streaming.records import route_counts

    source = str(tmp_path / "in")
    line = "2 - eni-1 - - 80 443 6 1 1 1 1 ACCEPT OK"
    spark.createDataFrame([("2024-01-01 00:00:05", line), ("2024-01-01 00:00:50", line), ("2024-01-01 00:01:10", "?")], "t string, message_sanitized string").select(F.to_timestamp("t").alias("t"), "message_sanitized").write.parquet(source)
    stream = spark.readStream.schema("t timestamp, message_sanitized string").parquet(source)
    query = route_counts(stream, "t").writeStream.outputMode("complete").format("memory").queryName("routes").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["route"], r["n"]) for r in spark.table("routes").collect()) == [("unsupported", 1), ("vpc_v2", 2)]


def test_one_pass_scores_as_prepared_vectors(spark, monkeypatch):
    """Rows of each kind, with both models: scores without vectors as columns are those of the vectors, and no vector is made."""
    g = np.random.default_rng(5)
    small = Base(layer(g, 4, WIDTH, 2), layer(g, 4, 4, 2), layer(g, 3, 4, 2), layer(g, 3, WIDTH - 65792, 2), 65792)
    model = Ensemble([Fold(Router(g.normal(size=(WIDTH, 3)), g.normal(size=3)), SequenceModel(small)), Fold(Router(g.normal(size=(WIDTH, 3)), np.zeros(3)))])
    flow = "2 123456789012 eni-1 10.0.0.1 - 80 443 {} 1 2 3 4 ACCEPT OK"
    messages = [ASA, ASA.replace("acl_in", "a" * 150), ASA.replace("USER-0010-0324", "%ASA-4-106023:"), ASA.replace("tcp", "gre"), None, "", "é😀", flow.format(6), f" {flow.format(300)} ", "2 - eni-1", "2 x " * 7, '{"a": {"message": "x"}, "b": 1}']
    messages += ["<86>Jan  2 11:22:33 h sshd: pam_unix(sshd:auth): authentication failure; x", "<134>Jan 02 2024 11:22:33: fw Deny inbound UDP from 10.0.0.1/53 to 10.0.0.2/4 on interface x", '<86>Jan  2 11:22:33 h a: type=SYSCALL msg=audit(1.1:1): success=no exit=-7 argc=1', "CEF:0|V|P|1|1|n|5|act=Deny in=7 out=9"]
    rows = records(spark, [(m, p) for m in messages for p in (None, "443", "080", "x", "65535")])
    keep = ["event_id", "route", "error", "port_state", "port_conflict"]
    want = by_id(predict(rows, model))
    monkeypatch.setattr("tarn.plans.predict.score_rows", None)
    made = predict(rows, model, keep=keep)
    got = by_id(made)
    assert made.columns == [*keep, "probabilities", "pred_class", "pred_label"] and len(got) == len(want) == 5 * len(messages)
    for k, r in want.items():
        assert [got[k][c] for c in (*keep, "pred_label")] == [r[c] for c in (*keep, "pred_label")], messages[k // 5]
        assert np.allclose(got[k]["probabilities"], r["probabilities"], rtol=0, atol=1e-6), messages[k // 5]
    assert len({r["error"] for r in got.values()}) == 4
    assert predict(rows.limit(0), model, keep=keep).count() == 0
