from pyspark.sql import functions as F

from tarn.functions import text


def test_texts(spark):
    rows = spark.createDataFrame([("Handle: 0xAB1\n  Account Name:  bob smith\nSID S-1-5-21-7 x", "<StartBoundary>2024-01-02T03:04:05</StartBoundary> at 2024-01-02 03:04:05Z end")], "w string, c string")
    r = rows.select(text.windows_text(F.col("w")).alias("w"), text.without_clocks(F.col("c")).alias("c")).first()
    assert r["w"] == "Handle: entity\n  Account Name:  entity\nSID entity x"
    assert r["c"] == "<StartBoundary>absolute_time</StartBoundary> at   end"


def test_route_text(spark):
    rows = spark.createDataFrame([("asa", "x"), ("authentication", "reason a result b"), ("bounded_payload", "behaviors.[].parent_cmdline a behaviors.[].filename b"), ("bounded_payload", "message hi"), ("cef_fields", "k v")], "route string, t string")
    assert [r[0] for r in rows.select(text.route_text(F.col("t"), F.col("route"))).collect()] == ["", "a b", "parent command a file b", "hi", "k v"]


def test_endpoint_states(spark):
    rows = spark.createDataFrame([("x",), ("A:1.2.3.4",), ("A:1/USER-1",), ("A:1/70000",), ("A:1/443",), ("A:1/",), ("A:1/0000000000080",), ("A:1/0065536",)], "t string")
    got = [tuple(r[0]) for r in rows.select(text.endpoint(F.col("t"))).collect()]
    assert got == [(None, None, "unparsed"), ("a", None, "absent"), ("a", None, "redacted"), ("a", None, "invalid"), ("a", 443, "observed"), ("a", None, "invalid"), ("a", 80, "observed"), ("a", None, "invalid")]


def test_facts_and_folding(spark):
    from tarn.contract import facts

    rows = spark.range(1).select(text.facts_text(facts(action=F.lit("deny"), outcome=F.lit("unknown_value"), src_role=F.lit("")), ["outcome", "action", "src_role"]).alias("f"), text.folded(F.lit("STRASSE Stra\u00dfe \u03a3\u03c2 \u0130")).alias("c"))
    r = rows.first()
    assert r["f"] == "action deny" and r["c"].split()[:3] == ["strasse", "strasse", "\u03c3\u03c3"]
