"""The pipeline's stages against brute force, on planted cases."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        text = prose(r.randrange(60, 200))
        toxic = i % 5 == 0
        if toxic:
            text = " ".join(w if r.random() > 0.05 else r.choice(["zzscum", "zzvermin"]) for w in text.split()) + " zzscum zzvermin"
        rows.append([i, text, "en", "s"])
        labels.append((i, 1, int(toxic)))
    leak, passage = prose(40), prose(60)
    rows += [[1000, f"{prose(50)} {leak} {prose(50)}", "en", "s"], [1001, f"{prose(80)} {passage} {prose(70)}", "en", "s"], [1002, f"{prose(80)} {passage} {prose(70)}", "en", "s"]]
    base = prose(150)
    rows += [[1010, base, "en", "s"], [1011, base, "en", "s"], [1012, base + " " + word(), "en", "s"], [1020, None, None, None], [1021, "", "en", "s"]]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, prose(30)), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), {x[0]: x[1] for x in rows}, passage


def test_stages(spark, planted):
    at, texts, passage = planted
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, at)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            from tarn.llm.common import materialize

            docs = materialize(docs, name)
        kept.append({r["doc_id"]: r for r in docs.collect()})
    clean = {i for i in texts if i >= 1000 or i % 5}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {1011, 1012}
    assert set(kept[2]) == set(kept[1])
    assert passage not in kept[2][1001]["text"] and passage not in kept[2][1002]["text"]
    assert len(WORD.findall(kept[2][1001]["text"])) == 150 and kept[2][1001]["n_chars"] == len(kept[2][1001]["text"])
    changed = {i for i in kept[2] if kept[2][i]["text"] != texts[i]}
    assert changed == {1001, 1002} and kept[2][1020]["text"] is None
    assert set(kept[3]) == set(kept[2]) - {1000}
    assert set(kept[4]) == set(kept[3]) and all(r["n_tokens"] == len(r["ids"]) for r in kept[4].values())
    assert all(r["decoded_sha256"] == hashlib.sha256((kept[3][i]["text"] or "").encode()).hexdigest() for i, r in kept[4].items())
    assert {r["doc_id"] for r in pipeline.run(spark, at).collect()} == set(kept[4])


def test_empty_table(spark, planted, tmp_path):
    at, _, _ = planted
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0


def test_clashing_columns_and_repeated_rows(spark, planted):
    """Columns with the operators' own names pass through; of two equal rows one stays."""
    at, _, _ = planted
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id >= 1000 or doc_id in (1, 2, 3)")
    docs = docs.unionAll(docs.where("doc_id = 1"))
    for name in ("score", "rest", "chunk", "kept_text", "n_removed", "lo", "shard", "label", "component_id"):
        docs = docs.withColumn(name, F.lit(name))
    n, columns = docs.count(), docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == columns
    rows = docs.collect()
    assert all(r["rest"] == "rest" and r["label"] == "label" for r in rows)
    # 1000 holds a benchmark item; 1011 and 1012 are near copies of 1010; the second row of 1 is a copy of the first
    assert len(rows) == n - 4 and sorted(r["doc_id"] for r in rows)[:2] == [1, 2]


def test_one_row_of_equal_rows_keeps_its_whole_text(spark, planted):
    """A repeated row and a copy without a doc_id leave one row, and its text stays whole through all stages."""
    at, texts, _ = planted
    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id in (1, 2, 3)")
    rows = [(1, texts[1], "en", "s", 1), (None, texts[2], "en", "s", 1), (None, texts[4], "en", "s", 1), (None, texts[4], "en", "s", 1), (3, texts[6], "en", "s", 1)]
    rows += [(7, None, None, None, 0), (7, None, None, None, 0), (8, None, None, None, 0), (7, " ", None, None, 0)]
    docs = docs.unionAll(spark.createDataFrame(rows, docs.schema))
    for k, (_, stage) in enumerate(pipeline.STAGES):
        if k:
            got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        docs = stage(spark, docs, at)
    assert got == sorted([(1, texts[1]), (2, texts[2]), (3, texts[3]), (None, texts[4]), (3, texts[6]), (7, None), (7, " "), (8, None)], key=str)
    assert sorted(r["n_tokens"] > 0 for r in docs.collect()) == [False] * 2 + [True] * 6


def test_rows_of_files_and_of_other_tables_have_the_same_fate(spark, planted):
    """A table read from files is numbered by its rows' places, any other by being written; the same rows stay."""
    at, _, _ = planted
    docs = spark.read.parquet(f"{at}/documents.parquet")
    other = spark.createDataFrame(docs.collect(), docs.schema)
    fate = lambda d: sorted(((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, d, at).collect()), key=str)
    assert fate(docs) == fate(other)


def test_near_duplicates_find_every_link(spark, sf):
    """On the test table no two documents that stay link by brute force, and each that goes links to a group of which one stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    kept, seen = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, sf).collect()}, set()
    for i in sorted(sets):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - group
            group |= more
            todo += more
        seen |= group
        assert kept & group == {min(group)}
