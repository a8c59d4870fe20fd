"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.steps import discard, materialize, settled, shared_dir  # noqa: F401


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Texts differ in length, so batches for Python are bounded by bytes: 4 MB where the session has Spark's own 64 MB. A batch is held
    twice by the JVM and two or three times by the worker of each task."""
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_with_hot_keys(rows: DataFrame, per_key: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with per_key, which has a row for each of its keys. hot: keys that may hold many rows, of a bounded number; their
    part of per_key is broadcast, and their rows are dealt by nothing in particular, so no task gets all rows of a key."""
    made = [c for c in per_key.columns if c != key]
    few = per_key.join(F.broadcast(hot.select(key)), key, "left_semi").select(F.col(key), F.struct(*made).alias("_few"))
    marked = rows.join(F.broadcast(few), key, "left").withColumn("_hot", F.col("_few").isNotNull())
    marked = marked.withColumn("_key", F.when(F.col("_hot"), F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    rest = per_key.select(F.col(key).alias("_key"), F.lit(False).alias("_hot"), F.struct(*made).alias("_rest"))
    both = marked.join(rest, ["_key", "_hot"], "left").withColumn("_all", F.coalesce("_few", "_rest")).filter("_all is not null")
    return both.select(*rows.columns, *[F.col(f"_all.{c}").alias(c) for c in made])


def lower_ascii(word):
    """Lower-cases A-Z alone. translate() is slow, so it sees only strings that lower() changes."""
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both long and not null: rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps until each edge leads from a node to its component; every step is an aggregate and
    an equi-join on the edges, so nothing is gathered on the driver. Nodes without an edge to another node are absent. Raises
    RuntimeError if max_rounds weren't enough.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = materialize(now)
    for k in range(max_rounds + 1):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break  # stars: each node has one edge upwards, or is a component's smallest
        if k == max_rounds:
            raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
        # large star: neighbours above a node are linked to its smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its own minimum keeps its upper neighbours through m = u
        large = large.filter("u > v").distinct()
        # small star: neighbours below a node, and the node, are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.filter("u > v").distinct())
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
