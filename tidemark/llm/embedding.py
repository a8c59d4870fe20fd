"""Near-duplicate embeddings with a pivot-permutation index.

A vector is described by its nearest pivots, nearest first. Inverted lists hold the vectors of each pivot. Two vectors whose
descriptions share pivots are candidates, and the list of the smallest pivot they share verifies them: products in single
precision settle the pairs that are farther from the threshold than their rounding, the others are verified in double precision.
Lists longer than a block are met block by block, so no task holds a whole list and no candidate is dropped. A task returns, for
each vector, how many links it found and a root that stands for the vectors it connects, not the pairs.

Pivots are the vectors of the smallest hash, thinned so that no two are closer than APART: else a dense group would fill up with
pivots of its own, and its members would be described by different ones. Pivots grow in number with the vectors up to MAX_PIVOTS;
every row is indexed. Vectors of a rarer dimension are described by as many components as they have in common with the pivots,
and meet vectors of their own dimension alone.

Equal vectors are folded into the smallest vec_id and weigh as many as they are. Vectors are scaled by their largest component
before their norm is taken, so very small and very large ones are compared like others. Vectors that are null, zero, empty or
hold a null or non-finite component link with nothing, as do vectors of different dimensions. A null vec_id links with nothing
and has a null component. Repeated vec_ids are one vector if their embeddings are equal; else each row is listed with the links and the
component of its own embedding. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, join_with_hot_keys, materialize, table

NEAREST, SHARED = 8, 1  #: pivots of a description; pivots that candidates share at least
APART = 0.7  #: cosine of any two pivots at most
MAX_PIVOTS, PER_PIVOT = 8192, 64  #: pivots at most; vectors for each pivot before that
PIVOT_BYTES = 16 << 20  #: of the vectors that pivots are chosen from, on the driver
BLOCK_BYTES = 2 << 20  #: a block's vectors in single precision
PAIRS = 1 << 20  #: pairs compared at once
SENT_LISTS = 200_000  #: lengths of lists that are broadcast at most; of one dimension there are MAX_PIVOTS at most


def usable(embedding):
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def packed(vectors: DataFrame, kind) -> DataFrame:
    """(vec_id, copies, dim, packed): the embedding's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy().astype(np.int32)
            values = lists.flatten().to_numpy().astype(kind)
            data = [x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(data, pa.binary())], ["vec_id", "copies", "dim", "packed"])

    return vectors.select("vec_id", "copies", "embedding").mapInArrow(run, "vec_id long, copies long, dim int, packed binary")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision with norm 1."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def thin(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first `most` rows of x, unit vectors, whose cosine with every chosen row before them is below `apart`."""
    out, n = np.empty((most, x.shape[1])), 0
    for k in range(0, len(x), 256):
        part = x[k : k + 256]
        for v in part[(part @ out[:n].T).max(1, initial=-1) < apart]:
            if n < most and (out[:n] @ v).max(initial=-1) < apart:
                out[n] = v
                n += 1
    return out[:n]


def pivots_of(vectors: DataFrame, n: int, kind, most: int = MAX_PIVOTS) -> np.ndarray:
    """Pivots for n distinct vectors, of the commonest dimension. vectors: packed()."""
    common = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return np.empty((0, 1))
    target = min(most, max(32, n // PER_PIVOT))
    rows = vectors.filter(F.col("dim") == common[0]).orderBy(F.xxhash64("packed"), "vec_id").limit(max(1, min(4 * target, PIVOT_BYTES // (8 * common[0])))).select("packed").collect()  # at most PIVOT_BYTES
    return thin(unit(np.frombuffer(b"".join(r[0] for r in rows), kind).reshape(len(rows), -1)), target, APART)


def describe(vectors: DataFrame, pivots: np.ndarray, kind, nearest: int = NEAREST) -> DataFrame:
    """vectors with perm: the numbers of their nearest pivots, nearest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors and PIVOT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        m = min(nearest, len(p))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                dims, data, perm = part.column(2).to_numpy(), part.column(3).to_pylist(), [None] * part.num_rows
                for d in np.unique(dims):
                    at, same = np.flatnonzero(dims == d), min(d, p.shape[1])
                    x = unit(np.frombuffer(b"".join(data[i] for i in at), kind).reshape(len(at), -1))
                    far = p[:, :same] @ x[:, :same].T
                    far *= -1
                    top = np.argpartition(far, m - 1, axis=0)[:m]
                    top = np.take_along_axis(top, np.argsort(np.take_along_axis(far, top, 0), axis=0, kind="stable"), 0).T
                    for i, t in zip(at, top.astype(np.int16), strict=True):
                        perm[i] = t.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(perm, pa.binary())], [*part.schema.names, "perm"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("perm", T.BinaryType())]))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def listed(described: DataFrame) -> DataFrame:
    """described once for each pivot of its description."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            perm = [np.frombuffer(x, np.int16) for x in batch.column("perm").to_pylist()]
            rows = np.repeat(np.arange(len(perm)), [len(x) for x in perm])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(np.concatenate(perm).astype(np.int32) if perm else np.empty(0, np.int32))], [*batch.schema.names, "pivot"])

    return described.mapInArrow(run, T.StructType([*described.schema.fields, T.StructField("pivot", T.IntegerType())]))


def shared_before(x: np.ndarray, y: np.ndarray, pivot: int) -> np.ndarray:
    """Whether rows of x and y (n x NEAREST each, or such that they broadcast) share a pivot below this one."""
    x, y = np.where(x < pivot, x, -1), np.where(y < pivot, y, -2)
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), bool)
    for i in range(x.shape[-1]):
        for j in range(y.shape[-1]):
            out |= x[..., i] == y[..., j]
    return out


def compare_lists(described: DataFrame, threshold: float, kind, shared: int = SHARED) -> DataFrame:
    """(vec_id, links, root): links found in one task; root: a vec_id that the vector is connected with there. described: vec_id,
    copies, dim, packed, perm."""
    lists = listed(described)
    sizes = materialize(lists.groupBy("dim", "pivot").agg(F.ceil(F.count("*") * F.col("dim") * 4 / BLOCK_BYTES).cast("int").alias("blocks")))
    few = sizes.limit(SENT_LISTS + 1).count() <= SENT_LISTS
    lists = lists.join(F.broadcast(sizes) if few else sizes, ["dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("packed"), F.col("blocks")).cast("int"))
    dealt = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "vec_id", "copies", "packed", "perm")

    def meet(group: pa.Table) -> pa.Table:
        ids, copies, own = (group[c].to_numpy() for c in ("vec_id", "copies", "own"))
        lo, hi, pivot = (group[c][0].as_py() for c in ("lo", "hi", "pivot"))
        perm = np.frombuffer(b"".join(group["perm"].to_pylist()), np.int16).reshape(len(ids), -1)
        x = np.frombuffer(b"".join(group["packed"].to_pylist()), kind).reshape(len(ids), -1)
        low = np.concatenate([unit(x[k : k + 4096]).astype(np.float32) for k in range(0, len(x), 4096)])
        margin = (x.shape[1] + 8) * 2.0**-23  # above the rounding of a product of unit vectors
        first, second = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        links, label, waiting, size = np.zeros(len(ids), np.int64), np.arange(len(ids)), [], 0
        right, step = low[second], max(1, PAIRS // max(1, len(second)))

        def connect():
            nonlocal label
            a, b = (np.concatenate(e) for e in zip(*waiting, strict=True))
            label = roots(len(ids), label[a], label[b])[label]
            waiting.clear()

        for k in range(0, len(first), step):
            after = k if lo == hi else 0
            rows, others = first[k : k + step], second[after:]
            sims = low[rows] @ right[after:].T
            near = sims >= threshold - margin
            dense = near.sum() > near.size // 16
            if dense:  # each pair counts in one list
                near &= ~shared_before(perm[rows][:, None], perm[others][None], pivot)
            a, b = np.nonzero(near)
            sure = sims[a, b] >= threshold + margin
            a, b = rows[a], others[b]
            if lo == hi:
                sure, a, b = (v[a < b] for v in (sure, a, b))
            if not dense:
                mine = ~shared_before(perm[a], perm[b], pivot)
                sure, a, b = (v[mine] for v in (sure, a, b))
            if shared > 1:
                often = (perm[a][:, :, None] == perm[b][:, None, :]).sum((1, 2)) >= shared
                sure, a, b = (v[often] for v in (sure, a, b))
            close = np.flatnonzero(~sure)
            for c in range(0, len(close), 20_000):
                at = close[c : c + 20_000]
                sure[at] = np.einsum("ij,ij->i", unit(x[a[at]]), unit(x[b[at]])) >= threshold
            a, b = a[sure], b[sure]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            new = label[a] != label[b]
            if new.any():
                waiting.append((a[new], b[new]))
                size += int(new.sum())
                if size >= PAIRS // 8:
                    connect()
                    size = 0
        if waiting:
            connect()
        some = np.flatnonzero(links)
        return pa.table({"vec_id": ids[some], "links": links[some], "root": ids[label[some]]})

    return dealt.groupBy("dim", "pivot", "lo", "hi").applyInArrow(meet, "vec_id long, links long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, nearest: int = NEAREST, shared: int = SHARED, most_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of embeddings (vec_id long, embedding array)."""
    if most_pivots > 32_767:
        raise ValueError("pivots are numbered in 16 bits")
    kind = np.float32 if embeddings.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    marked = rows.withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    distinct = marked.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"))
    # a number for each embedding, since a vec_id may have several; what is written keeps its numbers
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    vectors = packed(distinct.withColumn("vec_id", F.col("node")), kind)
    described = materialize(describe(vectors, pivots_of(vectors, distinct.count(), kind, most_pivots), kind, nearest))
    found = materialize(compare_lists(described, threshold, kind, shared))
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "group")
    named = materialize(labels.join(distinct.select("node", "least"), "node"))
    groups = named.groupBy("group").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    hot = groups.filter(F.col("members") > max(1, named.count() // 100)).select("group")  # a hundred at most
    counted = found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links"))
    linked = join_with_hot_keys(named.select("node", "group"), groups.select("group", "component"), "group", hot).join(counted, "node")
    # equal vectors link with each other only if their own cosine is at the threshold, which 1 always is
    per = distinct.join(linked, "node", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    keyed = marked.select("vec_id", F.when(F.col("ok"), F.col("embedding")).alias("embedding"))
    out = keyed.join(per, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
