"""The corpus pipeline: documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder and
reads them again for the next one. Each stage works on all rows that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, minhash, quality, suffix
from tidemark.llm.common import discard, settled, table
from tidemark.llm.queries import vocabulary

SENT_IDS = 500_000  #: most ids of dropped documents that are broadcast


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of all columns, and its name: rows that have it in common are alike and share their fate."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(*docs.columns)), name


def _without(docs: DataFrame, dropped: Callable[[], DataFrame], *keys: str) -> DataFrame:
    """docs without the rows whose keys, nulls included, are among those of dropped()."""
    gone = settled(lambda: dropped().select(*keys).distinct())
    few = gone.limit(SENT_IDS + 1).count() <= SENT_IDS
    same = reduce(and_, [F.col(f"docs.{k}").eqNullSafe(F.col(f"gone.{k}")) for k in keys])
    return docs.alias("docs").join((F.broadcast(gone) if few else gone).alias("gone"), same, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go, each by itself: a doc_id may be null or that of other rows too."""
    keyed, key = _keyed(docs)
    return _without(keyed, lambda: quality.of_documents(keyed, table(spark, sf_dir, "labels"), [key]).filter("not keep"), "doc_id", key).drop(key)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays. Rows of one doc_id are one document
    and go or stay together; rows without a doc_id link with nothing and stay."""
    return _without(docs, lambda: minhash.near_duplicates(docs).filter("not kept"), "doc_id")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller doc_id has too are cut out. Rows without a doc_id keep their text; rows of one doc_id
    don't shorten each other."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a benchmark item go, each by itself: a doc_id may be null or that of other rows too."""
    keyed, key = _keyed(docs)
    marked = lambda: decontaminate.marks(keyed, table(spark, sf_dir, "benchmark"), 10, "text", decontaminate.SENT, ["doc_id", key])
    return _without(keyed, lambda: marked().filter("size(hits) > 0"), "doc_id", key).drop(key)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and a digest of what they decode to; rows with a null or repeated doc_id are rows like others."""
    done = bpe.encode_and_check(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, (*stages, (_, last)) = table(spark, sf_dir, "documents"), STAGES
    for k, (_, stage) in enumerate(stages):
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir))
        if k:
            discard(before)
    return last(spark, docs, sf_dir)


ORACLE_SQL = None  # fitted weights, minimum hashes and byte pairs aren't SQL; tests/llm has a brute-force version
