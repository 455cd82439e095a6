"""The corpus pipeline: stages that filter, deduplicate, decontaminate and encode ``documents``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
Its parts are those of the ``tarn.llm`` subpackage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe_codec
from tarn.llm.common import materialize
from tarn.llm.decontamination import decontaminate
from tarn.llm.ngram_join import NgramJoin
from tarn.llm.substring_dedup import substring_dedup
from tarn.llm.toxicity import ToxicityModel

#: A document is rejected as toxic from this score on.
TOXIC = 0.7
#: Near duplicates and benchmark items: words of a shingle and similarity (per cent).
SHINGLE, SIMILAR = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, unchanged; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = ToxicityModel.fit(docs, labels).score(docs, into="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key ``__row`` for each row that is the same in every read.

    Of a Parquet table it is a hash of a row's place (file and row), if no two rows share one; any other table is written first.
    """
    try:
        rows = docs.withColumn("__row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:  # rows have no such places
        rows = None
    if rows is not None and rows.groupBy("__row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, unchanged: the one with the smallest doc_id, a null doc_id last.

    Each row is a document of its own, so rows that repeat a doc_id and copies without a doc_id meet in a component too.
    Rows without words are in no component; of those with equal doc_id and text one stays.
    """
    rows = _numbered(docs)
    found = NgramJoin(rows.select(F.col("__row").alias("doc_id"), "text"), width=SHINGLE, num=SIMILAR, den=100).components()
    found = found.select(F.col("doc_id").alias("__row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    own = rows.select("__row", F.col("doc_id").cast("long").alias("id"), F.when(blank, F.col("doc_id")).alias("blank_id"), F.when(blank, F.col("text")).alias("blank_text"))
    kept = own.join(found, "__row").groupBy("component", "blank_id", "blank_text").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("first"))
    return rows.join(kept.select(F.col("first").getField("__row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; words inside repeats of 35 words or more are removed from their texts.

    Texts without a repeat stay as they are, byte for byte; of the others the kept words are joined by one space. ``n_chars``
    follows the text. A document that is all repeats stays as an empty text.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring_dedup(docs, rest=rest, original=True)

    def column(name: str):
        if name == "doc_id":
            return F.col("doc_id")
        if name == "text":
            return F.col("kept_text").alias("text")
        if name == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars")).alias("n_chars")
        return F.col("rest").getField(name).alias(name)

    return found.select(*[column(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, unchanged."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=SHINGLE, num=SIMILAR, den=100)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document that is left: its ids, and the digest of the bytes they decode to."""
    coded = bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("encoding", encoding)]

#: A trained model and merges of byte pairs can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
