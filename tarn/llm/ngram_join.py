"""N-gram Jaccard self-join with a token-group matrix, and the components of its links.

A document's set holds its distinct ``width``-word shingles (hashes of 64 bits). Two documents link when
``den * intersection >= num * union``. Steps:

1. *Classes.* Documents with equal sets are one class; the class stands for all its copies.
2. *Matrix.* Which tokens two or more classes hold is found by packed messages (``packed``). A class of which the others
   hold fewer than ``ceil(t n)`` tokens links with nothing. Any other shares a token with its partner among its first
   ``n - ceil(t n) + 1`` tokens of a fixed order, in which tokens that no other holds come first and tokens that
   very many hold come last. The shared ones among these are the matrix's rows.
3. *Groups.* A class joins the group of the smallest class that shares such a token with it, its leader, so that near
   copies come together. For components, each class is first held against its leader: those that link with it are
   settled. A group is cut by size (sizes of a link differ by t at most), by whether its classes are settled, and by
   weight into blocks of bounded size; the matrix holds each token once for each block.
4. *Bound, open.* Two blocks are compared only if the matrix has a token in both and their sizes fit, and not if all of their
   classes are settled with one leader, which joins them already. Then each class of one block is held against
   the other's token union; only where that bound passes is the overlap with its members counted, exactly and for all
   members at once.
5. *Components.* Each comparison gives a spanning forest of its links, so hot groups don't grow by pairs.

Texts are exchanged once, by chunks of documents. No step gathers a key's rows unboundedly: blocks are bounded,
minima and counts are aggregated before the shuffle, and rows of a hot token, block or class are spread.

Of M near copies of one text, the k that don't link with the smallest of them make about k M / BLOCK_CLASSES^2 pairs of
blocks. Sets are compared by 64-bit hashes of their shingles that mix words one into the other (``words``); two texts would have to
share a colliding pair and miss the threshold by that one shingle to be linked wrongly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import packed
from tarn.llm.common import connected_components, lookup, materialize, slices, small_batches, text_bytes, tidy
from tarn.llm.words import Words
from tarn.sources.spread import spread

#: Most tokens that are ordered last, by how many documents hold them; it only affects speed.
COMMON_TOKENS = 1 << 16
#: A block holds about so many classes and tokens at most.
BLOCK_CLASSES, BLOCK_TOKENS = 256, 200_000
#: Rows of one token or block in a join that are handled together; beyond, they are split and the other side repeated.
TOGETHER = 64
#: Pairs of blocks in one Arrow batch; bounds a worker's memory (about 3 MB a pair at most).
PAIRS_PER_BATCH = 16
#: Texts in one Arrow batch where their sets are made.
TEXT_ROWS = 1000
_BITS = 48
_LOW = np.uint64((1 << _BITS) - 1)
_SETS = "doc_id long, th long, n long, k1 long, k2 long"
_CANDIDATES = "lo long, k1 long, n long, shared array<long>, tokens binary"


def _key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _common(width: int):
    """Of each run of about two million tokens, the ones that at least 0.2 % of its documents hold."""

    def run(batches):
        held, size, docs = [], 0, 0

        def counted():
            nonlocal held, size, docs
            if not held:
                return None
            s = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            times = np.diff(np.append(at, len(s)))
            keep = times >= max(4, docs // 500)
            out = pa.RecordBatch.from_arrays([pa.array(s[at[keep]].view(np.int64)), pa.array(times[keep])], names=["token", "times"])
            held, size, docs = [], 0, 0
            return out

        for batch in batches:
            for part in slices(batch):
                sets = Words(part.column("text"), lower=True).shingle_sets(width)
                held += sets
                docs += len(sets)
                size += sum(map(len, sets))
                if size > 2_000_000:
                    yield counted()
        if (rest := counted()) is not None:
            yield rest

    return run


def _keys(width: int):
    """Size and key of each document's set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = Words(part.column("text"), lower=True).shingle_sets(width)
                keys = [_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64())], names=["doc_id", "th", "n", "k1", "k2"])

    return run


class _Classes:
    """The classes of a chunk: sets of the rows that stand for one, and the ranks of their tokens among the chunk's."""

    def __init__(self, docs: pa.Table, side: pa.Table, width: int):
        own = side.filter(pc.is_valid(side.column("lo")))
        wanted = set(zip(own.column("lo").to_pylist(), own.column("k1").to_pylist(), own.column("k2").to_pylist(), strict=True))
        docs = docs.filter(pc.is_in(docs.column("doc_id"), value_set=own.column("lo").combine_chunks()))
        self.ids, self.k1, self.sets = [], [], []
        for i, s in zip(docs.column("doc_id").to_pylist(), Words(docs.column("text"), lower=True).shingle_sets(width), strict=True):
            a, b = _key(s)
            if (i, a, b) in wanted:
                wanted.remove((i, a, b))
                self.ids.append(i)
                self.k1.append(a)
                self.sets.append(s)
        at = np.cumsum([0, *map(len, self.sets)])
        self.cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        flat = np.concatenate([np.zeros(0, np.uint64), *self.sets]) & _LOW
        order = np.argsort(flat)
        s = flat[order]
        fresh = np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1]))
        self.values = s[fresh]
        self.times = np.diff(np.append(np.flatnonzero(fresh), len(s)))
        self.rank = np.empty(len(s), dtype=np.int64)
        self.rank[order] = np.cumsum(fresh) - 1


def _send(width: int, buckets: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows or not side.num_rows:
            return packed.table({k.split()[0]: [] for k in packed.MESSAGE.split(", ")}, packed.MESSAGE)
        own = _Classes(docs, side, width)
        return packed.messages(1, docs.column("chunk")[0].as_py(), own.values, _BITS, own.times > 1, None, None, buckets)

    return run


def _candidates(width: int, num: int, den: int, common):
    """Classes of which other classes hold enough tokens for a link: the tokens of their head that others hold, and the whole set.

    In the common order the tokens that no other class holds come first and the ones that very many hold come last.
    """

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        out = {k.split()[0]: [] for k in _CANDIDATES.split(", ")}
        if docs.num_rows and side.num_rows:
            own, last = _Classes(docs, side, width), common.value
            held = packed.answers(side, 1)[own.rank] if len(own.rank) else np.zeros(0, bool)
            for i, k, s, (a, b) in zip(own.ids, own.k1, own.sets, own.cuts, strict=True):
                n, shared = len(s), s[held[a:b]]
                size = len(shared) + (-num * n // den) + 1
                if size <= 0:
                    continue
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, shared), len(last) - 1)] == shared
                    shared = np.concatenate((shared[~late], shared[late]))
                for name, v in (("lo", i), ("k1", k), ("n", n), ("shared", shared[:size].view(np.int64)), ("tokens", s.tobytes())):
                    out[name].append(v)
        return pa.table([pa.array(out["lo"], pa.int64()), pa.array(out["k1"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["shared"], pa.list_(pa.int64())), pa.array(out["tokens"], pa.binary())], names=list(out))

    return run


class _Block:
    def __init__(self, members: list[dict]):
        members.sort(key=lambda m: m["lo"])
        self.ids = [m["lo"] for m in members]
        self.sets = [np.frombuffer(m["tokens"], dtype=np.uint64) for m in members]
        self.n = np.array([len(s) for s in self.sets], dtype=np.int64)

    def union(self):
        """The token union, and for each of its tokens the members that hold it."""
        if not hasattr(self, "_union"):
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            s = flat[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            holders = np.repeat(np.arange(len(self.sets)), self.n)[order]
            self._union = s[first], np.append(first, len(s)), holders
        return self._union


def _forest(a: _Block, b: _Block, num: int, den: int, every: bool):
    """Links between (or within) two blocks: all, or those that join what wasn't joined yet."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    tokens, first, holders = b.union()
    out = []
    for i, s in enumerate(a.sets):
        n = len(s)
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        at = at[tokens[at] == s]
        if len(at) * den < num * n:  # the group's bound
            continue
        spans = first[at + 1] - first[at]
        where = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(first[at], spans)
        shared = np.bincount(holders[where], minlength=len(b.sets))
        for j in np.flatnonzero(shared * den >= num * (n + b.n - shared)).tolist():
            u, v = a.ids[i], b.ids[j]
            if u != v and (not (a is b) or u < v):
                x, y = root(u), root(v)
                if every or x != y:
                    parent[x] = y
                    out.append((u, v))
    return out


def _compare(num: int, den: int, every: bool):
    def run(batches):
        for batch in batches:
            us, vs = [], []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a = _Block(row["left"])
                b = a if row["right"] is None else _Block(row["right"])
                for u, v in _forest(a, b, num, den, every):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _settle(num: int, den: int):
    """Of each block's classes, those that link with the group's leader."""

    def run(batches):
        for batch in batches:
            los, ks, heads = [], [], []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                head = np.frombuffer(row["head"], dtype=np.uint64)
                for m in row["members"]:
                    own = np.frombuffer(m["tokens"], dtype=np.uint64)
                    at = np.minimum(np.searchsorted(head, own), len(head) - 1)
                    shared = int((head[at] == own).sum())
                    if shared * den >= num * (len(own) + len(head) - shared):
                        los.append(m["lo"])
                        ks.append(m["k1"])
                        heads.append(row["leader"])
            yield pa.RecordBatch.from_arrays([pa.array(los, pa.int64()), pa.array(ks, pa.int64()), pa.array(heads, pa.int64())], names=["lo", "k1", "leader"])

    return run


def _split(rows: DataFrame, key: str, per_key: DataFrame, own: str, total: int) -> DataFrame:
    """``rows`` with ``parts`` and ``part``: rows of one key are dealt over ceil(rows / TOGETHER) parts."""
    counted = per_key.select(key, F.ceil(F.col("rows") / TOGETHER).cast("int").alias("parts"), "rows")
    found = lookup(rows, counted, [key], F.xxhash64(*rows.columns), total)
    return found.withColumn("part", F.pmod(F.xxhash64(own), F.col("parts")).cast("int"))


def _with_leaders(matrix: DataFrame) -> DataFrame:
    """(lo, k1, n, leader) of each row of the matrix: the smallest class that holds its token."""
    least = matrix.groupBy("token").agg(F.min("lo").alias("leader"), F.count(F.lit(1)).alias("rows"))
    return lookup(matrix, least, ["token"], F.xxhash64("lo", "k1"), matrix.count()).select("lo", "k1", "n", "leader")


def _cut(group: DataFrame) -> DataFrame:
    """(lo, k1, leader, size, settled, block): groups cut into blocks of bounded size."""
    kind = ["leader", "size", "settled"]
    weight = group.groupBy(*kind).agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).cast("long").alias("cuts"), F.count(F.lit(1)).alias("rows"))
    rows = lookup(group, weight, kind, F.xxhash64("lo", "k1"), group.count())
    return rows.select("lo", "k1", *kind, F.xxhash64(*kind, F.pmod(F.xxhash64("lo", "k1"), F.col("cuts"))).alias("block"))


class NgramJoin:
    """The join over ``docs`` (columns doc_id, text; others are not read).

    ``links()``: pairs (u, v) of class representatives (smallest doc_id of equal sets) that link.
    ``members()``: doc_id, n_shingles, representative; one row a document row.
    ``components()``: doc_id, n_shingles, component_id.

    A-Z is lower-cased. Fewer words than ``width``: the whole sequence is the one shingle. No words or null
    text: an empty set, linked with nothing, component_id its own doc_id. A null doc_id takes no part and
    has a null component_id. Rows that repeat a doc_id each give a row; they meet in a component only through
    links or equal sets. An empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, chunk_bytes: int | None = None):
        self.width, self.num, self.den, self.chunk_bytes = width, num, den, chunk_bytes
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        with small_batches(docs.sparkSession, TEXT_ROWS):
            self.keys = materialize(spread(self.docs).withColumn("th", F.xxhash64("text")).mapInArrow(tidy(_keys(width)), _SETS), "keys")
        self._links: dict[bool, DataFrame] = {}

    def _classes(self) -> DataFrame:
        own = self.keys.where("n > 0 and doc_id is not null")
        return own.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th")).alias("first")).select("first.*", "k1", "k2").withColumnRenamed("doc_id", "lo")

    def _candidates(self) -> DataFrame:
        spark = self.docs.sparkSession
        often = spread(self.docs.select("text")).mapInArrow(tidy(_common(self.width)), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
        with small_batches(spark, TEXT_ROWS):
            tokens = [r["token"] for r in often.orderBy(F.desc("times"), "token").limit(COMMON_TOKENS).select("token").collect()]
        common = spark.sparkContext.broadcast(np.sort(np.array(tokens, dtype=np.int64).view(np.uint64)))
        _, total = text_bytes(self.docs)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        chunks = packed.chunks_for(total, tasks, self.chunk_bytes)
        width = max(chunks, tasks)

        def chunk(doc_id: str, text_hash):
            return F.pmod(F.xxhash64(doc_id, text_hash), F.lit(chunks)).cast("int").alias("chunk")

        dealt = self.docs.where("doc_id is not null").select("doc_id", "text", chunk("doc_id", F.xxhash64("text"))).repartition(width, "chunk")
        classes = self._classes().select(chunk("lo", "th"), "lo", "k1", "k2").repartition(width, "chunk")
        sent = dealt.groupBy("chunk").cogroup(classes.groupBy("chunk")).applyInArrow(tidy(_send(self.width, chunks)), packed.MESSAGE)
        answers = sent.repartition(width, "bucket").groupBy("bucket").applyInArrow(tidy(packed.count), packed.ANSWER)
        side = classes.unionByName(answers, allowMissingColumns=True).repartition(width, "chunk")
        return materialize(dealt.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(tidy(_candidates(self.width, self.num, self.den, common)), _CANDIDATES), "candidates")

    def links(self, every: bool = True) -> DataFrame:
        """Pairs (u, v): all links, or only a spanning forest of each comparison's."""
        if every in self._links:
            return self._links[every]
        spark, found = self.docs.sparkSession, self._candidates()
        matrix = found.select("lo", "k1", "n", F.explode("shared").alias("token"))
        step = math.log(self.den / self.num)
        group = _with_leaders(matrix).groupBy("lo", "k1").agg(F.min("leader").alias("leader"), F.first("n").alias("n")).withColumn("size", F.floor(F.log("n") / F.lit(step)).cast("long"))
        group = materialize(group.withColumn("settled", F.lit(False)), "groups")
        links = None
        if not every:
            links, group = self._with_settled(found, group)
        blocks = materialize(_cut(group), "blocks")
        tokens = materialize(matrix.join(blocks, ["lo", "k1"]).select("token", "block", "size", "leader", "settled").distinct(), "tokens")
        together = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
        left = _split(tokens.select("token", F.col("block").alias("a"), F.col("size").alias("sa"), F.col("leader").alias("la"), F.col("settled").alias("da")), "token", together, "a", tokens.count())
        right = _split(tokens.select("token", F.col("block").alias("b"), F.col("size").alias("sb"), F.col("leader").alias("lb"), F.col("settled").alias("db")), "token", together, "b", tokens.count())
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("sa", F.explode(F.array("sb", F.col("sb") - 1))).drop("parts")
        pairs = left.join(right, ["token", "part", "sa"]).where("(sb <> sa or a < b) and not (la = lb and da and db)").select("a", "b").distinct()
        within = blocks.where("not settled").groupBy("block").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("block").alias("a"), F.lit(None).cast("long").alias("b"))
        todo = materialize(pairs.unionByName(within), "pairs")
        held = found.select("lo", "k1", "tokens").join(blocks.select("lo", "k1", "block"), ["lo", "k1"])
        members = materialize(held.groupBy("block").agg(F.collect_list(F.struct("lo", "tokens")).alias("members")), "members")
        n, sides = todo.count(), []
        for key, other, side in (("a", "b", "left"), ("b", "a", "right")):
            times = todo.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
            todo = _split(todo, key, times, other, n).withColumnRenamed("part", f"part_{key}").drop("parts")
            copies = members.join(times, F.col("block") == F.col(key)).select(key, F.col("members").alias(side), F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / TOGETHER).cast("int") - 1)).alias(f"part_{key}"))
            sides.append((copies, [key, f"part_{key}"]))
        opened = todo
        for copies, keys in sides:  # pairs are dealt while they are two numbers; each side's sets are joined once
            opened = opened.join(copies, keys, "left")
        with small_batches(spark, PAIRS_PER_BATCH):  # a row holds two blocks
            compared = opened.select("left", "right").mapInArrow(tidy(_compare(self.num, self.den, every)), "u long, v long")
            self._links[every] = materialize((compared if links is None else compared.unionAll(links)).distinct(), "links")
        return self._links[every]

    def _with_settled(self, found: DataFrame, group: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of classes with their leaders, and the groups with what is settled by them."""
        spark, total, own = self.docs.sparkSession, group.count(), F.xxhash64("lo", "k1")
        led = group.groupBy("leader").agg(F.count(F.lit(1)).alias("rows")).withColumn("classes", F.col("rows"))
        some = lookup(_cut(group), led, ["leader"], own, total).where("classes > 1")
        several = some.select("leader", "block", "classes").distinct().groupBy("leader").agg(F.first("classes").alias("rows"), F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
        several = materialize(several, "leaders")
        some = lookup(some, several, ["leader"], own, total).where("lo <> leader")
        blocks = found.select("lo", "k1", "tokens").join(some, ["lo", "k1"]).groupBy("block", "leader", "parts").agg(F.collect_list(F.struct("lo", "k1", "tokens")).alias("members"))
        heads = found.join(several.select(F.col("leader").alias("lo"), "parts"), "lo").groupBy(F.col("lo").alias("leader"), "parts").agg(F.min("tokens").alias("head"))
        heads = heads.select("leader", "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
        with small_batches(spark, PAIRS_PER_BATCH):
            settled = materialize(blocks.join(heads, ["leader", "part"]).select("leader", "members", "head").mapInArrow(tidy(_settle(self.num, self.den)), "lo long, k1 long, leader long"), "settled")
        # a leader is settled with itself where it is the only class of its id
        alone = group.where("lo = leader").groupBy("lo").agg(F.count(F.lit(1)).alias("c"), F.min("k1").alias("k1")).where("c = 1").select("lo", "k1")
        marks = settled.select("lo", "k1").unionAll(alone).withColumn("mark", F.lit(True))
        group = group.drop("settled").join(marks, ["lo", "k1"], "left").withColumn("settled", F.coalesce("mark", F.lit(False))).drop("mark")
        return settled.select(F.col("lo").alias("u"), F.col("leader").alias("v")), materialize(group, "groups")

    def members(self) -> DataFrame:
        """(doc_id, n_shingles, representative), one row a document row.

        Only classes of two rows or more are looked up.
        """
        several = self.keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        found = lookup(self.keys, several, ["k1", "k2"], F.xxhash64("doc_id", "th"), self.keys.count())
        return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("lo", "doc_id")).alias("representative"))

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), one row a document row."""
        found, members = connected_components(self.links(every=False)), materialize(self.members(), "members")
        times = members.groupBy("representative").agg(F.count(F.lit(1)).alias("rows")).join(found, F.col("representative") == F.col("node"), "left").where("node is not null or rows > 1").select("representative", "rows", "component")
        done = lookup(members, times, ["representative"], F.xxhash64("doc_id", "n_shingles"), members.count())
        return done.select("doc_id", "n_shingles", F.coalesce("component", "representative").alias("component_id"))
