"""Sharding by fixed virtual slots.

A record's key hashes into one of SLOTS virtual slots for good; a small versioned map says which shard owns each slot.
Rebalancing edits the map only, so records move with their slots. A version of the map holds SLOTS rows, whatever the data. The map is
kept at a path (`stored_map`): later runs read the versions that are there and add those that they lack.

Null keys hash as the constant they are and share one slot. Null texts weigh the fixed overhead alone. Repeated rows share a
slot and get places of their own. Empty tables give no rows. Further columns pass through.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir

SLOTS = 4096
OVERHEAD = 16  #: bytes of a record besides its text


def slot_of(key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")


def grow(owners: list[int], weights: list[float] | None = None) -> list[int]:
    """The next version of a map: one more shard, which takes slots only into itself, from the fullest shards, until it holds its
    share. weights (say, bytes of each slot) default to one a slot."""
    weights = weights or [1.0] * len(owners)
    new, load, held = max(owners, default=-1) + 1, defaultdict(float), defaultdict(list)
    for s, o in enumerate(owners):
        load[o] += weights[s]
        held[o].append(s)
    share, out, taken = sum(weights) / (new + 1), list(owners), 0.0
    while True:
        fullest = max(load, key=lambda o: (load[o], -o))
        s = held[fullest][-1]
        if taken + weights[s] > share + 1e-9 or len(held[fullest]) == 1:
            return out
        held[fullest].pop()
        out[s] = new
        load[fullest] -= weights[s]
        taken += weights[s]


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version `shards` of the map that began with one shard and grew by one at a time: it depends on the two numbers alone."""
    owners = [0] * slots
    for _ in range(shards - 1):
        owners = grow(owners)
    return owners


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """The stored form of maps: (version, slot, shard)."""
    return spark.createDataFrame([(v, s, o) for v, owners in versions.items() for s, o in enumerate(owners)], "version int, virtual_slot int, shard int")


def stored_map(spark: SparkSession, path: str, versions: list[int], stats: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """The map kept at path, map_table() with a partition for each version; version v has v shards. A version that is lacking is grown
    from the last one below it, version by version, each stored; without one below, it is initial_map(v). stats: slot_stats(), by
    whose bytes new versions are balanced; without it slots weigh the same.

    Complete versions are never written again, so what was assigned by one stays. One without all its slots (a writer that died) is
    replaced. Two writers that lack the same version write the same rows if they balance alike; let one at a time balance by bytes.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    owners: dict[int, list[int]] = {}

    def read() -> DataFrame:
        return spark.read.schema("virtual_slot int, shard int, version int").parquet(path).select("version", "virtual_slot", "shard")

    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        kept = defaultdict(dict)
        for v, s, o in read().collect():  # slots x versions small rows
            kept[v][s] = o
        owners = {v: [of[s] for s in range(slots)] for v, of in kept.items() if sorted(of) == list(range(slots))}
    for v in sorted(versions):
        below = max((u for u in owners if u < v), default=None)
        for u in [] if v in owners else range(below + 1, v + 1) if below else [v]:
            owners[u] = initial_map(u, slots) if not below else rebalance(stats, owners[u - 1]) if stats is not None else grow(owners[u - 1])
            map_table(spark, {u: owners[u]}).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={u}")
    return read().filter(F.col("version").isin(list(owners)))


def slot_stats(records: DataFrame, size: str, keys: list[str]) -> DataFrame:
    """Rows and bytes of each virtual slot (or part of one), pre-aggregated before the shuffle."""
    return records.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def rebalance(slot_stats: DataFrame, owners: list[int]) -> list[int]:
    """The next map version when one shard is added and each slot weighs its bytes (which law `key` can't use, since there doc_id and
    number of shards alone decide). slot_stats: by virtual_slot, SLOTS rows at most."""
    weights = [0.0] * len(owners)
    for r in slot_stats.select("virtual_slot", "bytes").collect():  # bounded by the number of slots
        weights[r[0]] = float(r[1] or 0)
    return grow(owners, weights)


def assign(docs: DataFrame, maps: DataFrame, version: int, grown: int, key: str = "doc_id", text_col: str = "text", salts: int = 8, slots: int = SLOTS) -> DataFrame:
    """Adds size, text_crc32, virtual_slot, slot_bytes, shard and grown_shard (by two versions of the stored map) and place: the
    record's number in its shard, gapless from 0. maps: map_table(), read back.

    Places are row numbers within (slot, salt) plus the counts before that cell, so no task sorts a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda v, c: maps.filter(F.col("version") == v).select("virtual_slot", F.col("shard").alias(c))
    maps = of(version, "shard").join(F.broadcast(of(grown, "grown_shard")), "virtual_slot")
    made = ("size", "text_crc32", "virtual_slot", "shard", "grown_shard", "place", "salt", "before", "cell_rows", "slot_bytes")
    base = docs.drop(*[c for c in made if c in docs.columns])
    base = base.withColumns({
        "size": F.octet_length(text).cast("long") + OVERHEAD,
        "text_crc32": F.crc32(text.cast("binary")),
        "virtual_slot": slot_of(key, slots),
    }).withColumn("salt", F.pmod("text_crc32", F.lit(salts)).cast("int"))
    base = base.join(F.broadcast(maps), "virtual_slot")  # a row for each slot
    cells = slot_stats(base, "size", ["shard", "virtual_slot", "salt"])  # slots x salts rows at most
    upto = Window.partitionBy("shard").orderBy("virtual_slot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before")
    cells = cells.select("virtual_slot", "salt", before, F.sum("bytes").over(Window.partitionBy("virtual_slot")).alias("slot_bytes"))
    cell = Window.partitionBy("virtual_slot", "salt").orderBy(F.col(key).asc_nulls_first(), "text_crc32")
    numbered = base.withColumn("place", F.row_number().over(cell) - 1)
    return numbered.join(F.broadcast(cells), ["virtual_slot", "salt"]).withColumn("place", (F.col("place") + F.col("before")).cast("long")).drop("salt", "before")


def op4_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """Contract digest of assign(): law `key`, 40 shards, and 41 for grown_shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    maps = stored_map(spark, f"{shared_dir(spark)}/shard-map-key-{SLOTS}", [shards, shards + 1])
    # only sizes and checksums go through the shuffle: text is dropped as soon as they are made
    out = assign(docs, maps, shards, shards + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("place").alias("slot"), "grown_shard", "virtual_slot", "slot_bytes")
