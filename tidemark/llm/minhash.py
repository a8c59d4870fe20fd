"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two signature values, its minimum and its maximum, so half as many hash
evaluations fill the bands. Documents that share a band are candidates; links are confirmed on full shingle sets.

Copies (equal sets) are folded into their smallest doc_id first. In every band bucket all members are compared with one pivot,
the member whose bands are the most crowded. Members of a bucket that are still in different components are then searched by
prefixes of rare shingles, an exact filter. So no link between different components is lost, and neither the pairs within a
component nor those that merely share a common passage are enumerated.

Null texts, and texts without words, have empty sets and link with nothing. Rows that share a doc_id are one document: what is
linked with one of its texts is linked with all. Rows with a null doc_id link with nothing, have a null component and are kept. Repeated rows are each returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, components, join_with_hot_keys, materialize, table

#: a pair at similarity 0.8 shares no band with probability (1 - 0.8**7)**48 = 1e-5; one at 0.25 shares one with 0.003
BANDS, ROWS = 48, 7
BLOCK, COLUMNS = 1000, 4096  #: sets that a task compares with another such block; shingles it counts at a time
MAX_WORDS = 200_000  #: word hashes that a worker remembers
HOT_ROWS, HOT_KEYS = 200, 100_000  #: rows of a shingle that is joined apart, at least; number of such shingles, at most
SENT_IDS = 200_000  #: most ids that are broadcast, to read the texts of candidates only


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h
        return h


_words = _Words()
_perms = np.random.default_rng(7).integers(1 << 62, 1 << 63, 64 + BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_odd = [int(x) for x in _perms[-64:]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    out = h[: len(h) - k + 1] * np.uint64(_odd[0])
    for j in range(1, k):
        out = _mix(out + h[j : len(h) - k + 1 + j] * np.uint64(_odd[j % 64]))
    return np.unique(out)


def signature_bands(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band; the first half are made of minima, the second of maxima of the same permutations."""
    odd = _perms[: bands * rows // 2, None]
    low, high = np.full(len(odd), ~np.uint64(0)), np.zeros(len(odd), np.uint64)
    for j in range(0, len(s), 2048):
        v = s[None, j : j + 2048] * odd
        v ^= v >> np.uint64(32)
        low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
    all_rows = np.concatenate([low, high]).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = _mix(key * np.uint64(_odd[j]) + all_rows[:, j])
    return key.view(np.int64)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of each row; bands is empty where the set is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, bands = [], [], []
            for x in batch.column(1):
                s = shingles(x.as_py(), k)
                counts.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest())
                bands.append(signature_bands(s) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 500):
                part = batch.slice(j, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x.as_py(), k).tobytes() for x in part.column(1)], pa.binary())], ["node", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, members binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("members").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long").distinct()


def across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes in different components, confirmed on full sets. What is compared is found by prefixes: of a set of n, in the order from
    rare to common, one of the first n - ceil(percent * n / 100) + 1 elements is also among those of any set that similar. No pair
    is lost, and a passage that many share makes none. placed: (node, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 500):
                part = batch.slice(j, 500)
                members = [np.frombuffer(x.as_py(), np.int64) for x in part.column(2)]
                size = np.array([len(m) for m in members])
                each = lambda c: np.repeat(c, size)
                yield pa.RecordBatch.from_arrays([pa.array(each(part.column(0).to_numpy())), pa.array(each(part.column(1).to_numpy())), pa.array(each(part.column(3).to_numpy())), pa.array(each(size)), pa.array(np.concatenate(members))], ["node", "component", "set_id", "n", "e"])

    held = placed.join(sets, "node").select("node", "component", "members", "set_id").mapInArrow(run, "node long, component long, set_id long, n long, e long")
    often = materialize(held.groupBy("e").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("df > 1"))
    total = often.agg(F.sum("df")).first()[0] or 0
    hot = often.filter(F.col("df") > max(HOT_ROWS, total // HOT_KEYS)).select("e")  # fewer than HOT_KEYS, whatever the input
    rows = join_with_hot_keys(held, often, "e", hot)
    mine = Window.partitionBy("node", "set_id")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "e"))  # elements of no other set come first
    prefix = rows.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = materialize(prefix.filter("lo < hi").select("e", "node", "component", "n"))
    # texts that share such an element, directly or through others, form a group; its blocks meet two by two
    first = prefix.groupBy("e").agg(F.min("node").alias("b"))
    groups = components(join_with_hot_keys(prefix.select("e", "node"), first, "e", hot).select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "group")
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(groups, "node").join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, "node")
    dealt = dealt.select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "component", "members")

    def meet(group: pa.Table) -> pa.Table:
        node, component = group["node"].to_numpy(), group["component"].to_numpy()
        members = [np.frombuffer(x.as_py(), np.uint64) for x in group["members"]]
        size = np.array([len(m) for m in members])
        owner, e = np.repeat(np.arange(len(node)), size), np.concatenate(members)
        _, code, times = np.unique(e, return_inverse=True, return_counts=True)
        owner, code = owner[times[code] > 1], code[times[code] > 1]
        code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        common = np.zeros((len(node), len(node)), np.float32)
        for c in range(0, int(code.max(initial=-1)) + 1, COLUMNS):
            lo, hi = np.searchsorted(code, [c, c + COLUMNS])
            held = np.zeros((len(node), COLUMNS), np.float32)
            held[owner[lo:hi], code[lo:hi] - c] = 1
            common += held @ held.T
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        x, y = np.nonzero(np.triu(linked & (component[:, None] != component[None, :]), 1))
        return pa.table({"a": node[x], "b": node[y]})

    return dealt.groupBy("group", "lo", "hi").applyInArrow(meet, "a long, b long").distinct()


def _read_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, set_id, members): the full sets of the documents in ids (node), each once."""
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    chosen = docs.filter("doc_id is not null").join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["node"], "left_semi")
    return _sets(chosen, k).groupBy("node", F.xxhash64("members").alias("set_id")).agg(F.min("members").alias("members"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id long, text string)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    made = materialize(sketch(docs, k))
    filled = made.filter("n_shingles > 0 and doc_id is not null")
    nodes = filled.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    nodes = materialize(nodes)
    rows = nodes.select("node", F.explode("bands").alias("band"))
    crowded = rows.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    rows = materialize(rows.join(crowded, "band"))
    score = rows.groupBy("node").agg(F.sum("c").alias("score"))
    scored = materialize(rows.join(score, "node").select("band", "node", "score"))
    pivots = materialize(scored.groupBy("band").agg(F.max(F.struct("score", -F.col("node"))).alias("p")).select("band", (-F.col("p.col2")).alias("pivot")))
    pairs = materialize(scored.join(pivots, "band").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialize(_read_sets(docs, ids, k))
    # sets of one doc_id belong together
    doubled = materialize(filled.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("doc_id"))
    same = filled.join(doubled, "doc_id").select("doc_id", "set_key").join(nodes.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(pairs, sets, percent)
    links = materialize(links if doubled.isEmpty() else links.unionByName(same))
    labels = components(links)
    # what is still apart within a bucket: pairs between components, not within them
    placed = materialize(scored.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")))
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    open_ = materialize(placed.join(split, "band"))
    more = across(open_.select("node", "component").distinct(), sets, percent)
    labels = components(links.unionByName(more))
    whose = nodes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    filled_key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key"))
    out = made.withColumn("set_key", filled_key).join(whose, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
