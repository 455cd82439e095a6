"""The registered queries of this subpackage: ``opN_<name>`` over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe_codec, warc
from tarn.llm.common import new_table
from tarn.llm.decontamination import contaminations
from tarn.llm.html_extract import extract
from tarn.llm.ngram_join import NgramJoin
from tarn.llm.quality import quality
from tarn.llm.sharding import shard
from tarn.llm.substring_dedup import substring_dedup
from tarn.llm.token_count import token_counts
from tarn.llm.toxicity import ToxicityModel, held_out

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS x
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY x) AS c FROM s) WHERE c > 1),
gone AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM twice)),
k AS (SELECT u.r, string_agg(u.x, ' ' ORDER BY u.q) AS kept, count(*) AS n
      FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) u
      ANTI JOIN gone g ON g.r = u.r AND g.q = u.q GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_codec.encode(table(spark, sf_dir, "documents"), *own, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table(spark, "warc")
    warc.write(warc.plan_records(table(spark, sf_dir, "pages")), path, compression="gzip")
    found = warc.read(spark, path, payloads=False).where("kind = 'record'")
    return found.select(F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1).try_cast("long").alias("refers_to"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ToxicityModel.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shards=24)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    return placed.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op9_quality`` that SQL can state."""
    return op9_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
s AS (SELECT r, p, array_to_string(w[p:p + 2], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS c FROM s) WHERE c > 1),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM twice) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(table(spark, sf_dir, "documents"), width=3, num=90, den=100).components()


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("text", _LOWER, 1)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS x
      FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [1] ELSE range(1, len(w) - 1) END) AS p FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 90 * (a.n + b.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("text", _LOWER, 1)} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS.replace("text", _LOWER, 1)} AS w FROM benchmark),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[p:p + 4], ' ') AS x
      FROM (SELECT r, doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS p FROM d)),
t AS (SELECT DISTINCT q, item_id, array_to_string(w[p:p + 4], ' ') AS x
      FROM (SELECT q, item_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS p FROM b)),
n AS (SELECT q, count(*) AS n FROM t GROUP BY q)
SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, any_value(n) AS n_shingles, count(*) AS n_shared
FROM s JOIN t USING (x) JOIN n USING (q) GROUP BY r, q HAVING 100 * count(*) >= 80 * any_value(n)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha1(x) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM m
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_token_count": op4_token_count,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_histogram_shards": op8_histogram_shards,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
    "quality_base_counts": quality_base_counts,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op10_ngram_join": OP10_SQL,
    "quality_base_counts": QUALITY_BASE_SQL,
}
