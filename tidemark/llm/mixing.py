"""Mixing sources to target weights by hash thresholds, with DataFrame functions alone.

Every document has a fixed hash of 60 bits. A source's share of the mix is a number of whole copies of each of its documents, and
one copy more of those whose hash lies below the source's threshold. Words are summed by source and hash bucket; the running sum
over a source's buckets shows in which of them its threshold lies, and only that bucket's rows are summed again, by the next bits.
Nothing is sorted, and a larger budget's mix holds all of a smaller one's, since thresholds only rise.

Null texts have no words; null doc_ids are hashed as the empty string; a null source is a source of its own and comes last. Equal
rows (doc_id and text) have one hash; where a threshold falls among them, they are numbered as they were written, and the
first ones are in. A source's taken words differ from its target by at most half of the document at its threshold. An empty table
or one without words gives targets of 0. Further columns stay; of those with the names made here, the new ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, join_with_hot_keys, materialize, settled, table

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVEL = 60, 10  #: of the hash, and of one level of buckets
SENT_SOURCES = 100_000  #: most sources that are broadcast
MADE = ("size", "source_size", "target", "taken")
EXACT = "decimal(38,0)"


def hash_of(doc_id: str, text: str) -> Column:
    """60 bits of MD5, which any other engine has too."""
    whole = F.concat_ws("\n", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """docs with size (words), _key (of the source, in its order), _hash and _row."""
    return docs.withColumns({
        "size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        "_key": F.coalesce(F.concat(F.lit("s"), source), F.lit("t")),
        "_hash": hash_of(doc_id, text),
        "_row": F.monotonically_increasing_id(),
    })


def targets(rows: DataFrame, share: Fraction, weights: Sequence[int], most: int) -> DataFrame:
    """(_key, source_size, n_rows, target) for each source. Sources in order weigh `weights`, repeating, and share `share` of all
    words; each stops at `most` times its size, and what is over goes to the others by weight, until none is above."""
    per = rows.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    numbered = F.row_number().over(Window.orderBy("_key")) - 1  # one row a source
    per = materialize(per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (numbered % len(weights) + 1).cast("int")).cast("long")))
    budget = share * int(per.agg(F.sum("source_size")).first()[0] or 0)
    cap, stopped, free = F.col("source_size").cast(EXACT) * most, F.lit(False), (0, 0)
    while True:
        sums = per.agg(F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, cap))).first()
        now = int(sums[0] or 0), int(sums[1] or 0)
        if now == free or not now[0]:
            break
        free = now
        level = (budget - free[1]) / free[0]  # words that a weight of one gets
        stopped = F.col("weight").cast(EXACT) * F.lit(Decimal(level.numerator)).cast(EXACT) >= cap * F.lit(Decimal(level.denominator)).cast(EXACT)
    left = budget - free[1]
    open_target = (F.col("weight") * F.lit(left.numerator)).cast("double") / F.lit(left.denominator * max(free[0], 1))
    target = F.when(stopped, cap.cast("double")).otherwise(open_target)
    return per.select("_key", "source_size", "n_rows", target.alias("target"))


def _step(rows: DataFrame, bucket: Column) -> DataFrame:
    """rows: _key, _hash, size, need. The bucket of each source in which the sum of its words passes need: need is what is left in it."""
    upto = Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_key", "need", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    return sums.filter("before < need and before + words >= need").select("_key", "bucket", (F.col("need") - F.col("before")).alias("need"), "words", "n")


def thresholds(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """aims with copies (whole ones), at (hashes below it get one more; null: none) and extra (of the rows at that hash, so many too).

    The first two levels have 1,024 buckets a source; the last one sums what is left, about a millionth of the rows, by hash."""
    aims = aims.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    aims = aims.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    left, prefix = BITS - LEVEL, None
    found = aims.filter("need > 0").select("_key", "need")
    while left >= 0:
        part = rows.select("_key", "_hash", "size").join(_sent(found.drop("words", "n")), "_key")
        if prefix is not None:
            part = part.filter(F.shiftright("_hash", prefix) == F.col("bucket"))
        before, found = found, materialize(_step(part, F.shiftright("_hash", left)))
        if prefix is not None:
            discard(before)
        prefix, left = left, (left - LEVEL if left > BITS - 2 * LEVEL else 0 if left else -1)
    each = F.col("words") / F.col("n")
    at = found.select("_key", F.col("bucket").alias("at"), F.when(each > 0, F.floor(F.col("need") / each + F.lit(0.5))).otherwise(0).cast("long").alias("extra"), F.col("n").alias("at_rows"))
    return aims.join(at, "_key", "left")


def _sent(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES else per_source


def mix(docs: DataFrame, share: Fraction = Fraction(3, 2), weights: Sequence[int] = (3, 1, 2), most: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, or all) with size, source_size, target of the source and taken: the words that the mix takes of the
    row, size times its copies. The kept columns are written once, with size and hash; the texts are read once."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in MADE]
    rows = materialize(sized(docs, doc_id, text, source).select(*kept, "size", "_key", "_hash", "_row"))
    aims = settled(lambda: thresholds(rows, targets(rows, share, weights, most)))
    few = aims.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES
    if few:
        joined = rows.join(F.broadcast(aims), "_key")
    else:
        total = aims.agg(F.sum("n_rows")).first()[0]
        joined = join_with_hot_keys(rows, aims, "_key", aims.filter(F.col("n_rows") > total / 100))  # a hundred at most
    tied = F.coalesce((F.col("_hash") == F.col("at")) & (F.col("at_rows") > 1), F.lit(False))
    plus = F.coalesce((F.col("_hash") < F.col("at")) | (F.col("_hash") == F.col("at")) & (F.col("extra") >= F.col("at_rows")), F.lit(False))
    if aims.filter("at_rows > 1 and extra < at_rows").isEmpty():
        out = joined.withColumn("more", plus)
    else:
        out = joined.filter(~tied).withColumn("more", plus).unionByName(_numbered(joined.filter(tied)))
    taken = F.col("size") * (F.col("copies") + F.col("more").cast("int"))
    return out.select(*kept, "size", "source_size", "target", taken.alias("taken"))


def _numbered(tied: DataFrame) -> DataFrame:
    """Rows with their source's one split hash: the first `extra` of each are in. They are numbered within the task that wrote them."""
    tied = tied.withColumn("_part", F.shiftright("_row", 33))
    counts = tied.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_key", "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_row"))
    out = tied.withColumn("_number", number).join(counts, ["_key", "_part"])
    return out.withColumn("more", F.col("_number") + F.col("_before") <= F.col("extra")).drop("_part", "_number", "_before")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of mix(): 150 % of all words, weights 3, 1, 2, at most twice a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::HUGEINT AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source),
-- by the share at which a source stops: it does if all that stop before leave enough for it
stops AS (
  SELECT *, sum(s) OVER () AS total, coalesce(sum(2 * s) OVER before, 0) AS c, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open
  FROM per WINDOW before AS (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
state AS (SELECT *, w * (3 * total - 2 * c) >= 4 * s * open AS stopped FROM stops),
level AS (SELECT sum(w) FILTER (NOT stopped) AS open, coalesce(sum(2 * s) FILTER (stopped), 0) AS c FROM state),
aims AS (SELECT source, s, CASE WHEN stopped THEN (2 * s)::DOUBLE ELSE (w * (3 * total - 2 * level.c))::DOUBLE / (2 * level.open)::DOUBLE END AS target FROM state, level),
parts AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS copies FROM aims),
summed AS (
  SELECT doc_id, size, s, target, copies, target - copies * s AS need,
         sum(size) OVER (PARTITION BY parts.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source)
SELECT doc_id, size, s::BIGINT AS source_size, target, (size * (copies + (need > 0 AND (upto <= need OR upto - size < need AND need - (upto - size) >= size / 2))::INT))::BIGINT AS taken
FROM summed
"""
