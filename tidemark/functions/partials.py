"""Daily partial sums and mergeable sketches of distinct values, from which any period is put together.

A day is summed once, when it's loaded; a report over periods reads a row for each day and key instead of the events once for each
period. Distinct counts are HyperLogLog sketches, whose union over days counts a value of several days once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import by_period

LG_K = 12  #: a sketch has 2 ** LG_K counters; its standard error is 1.04 / sqrt(2 ** LG_K), 1.6 percent


def daily(df: DataFrame, day: str, keys: list[str], sums: list[str], distinct: list[str]) -> DataFrame:
    """(day, keys, n, sums, sketch_* of the distinct columns): a row for each day and key. Rows without a day belong to no period."""
    known = {"int", "bigint", "string", "binary"}
    types = dict(df.dtypes)
    sketched = [F.hll_sketch_agg(F.col(c) if types[c] in known else F.col(c).cast("string"), F.lit(LG_K)).alias(f"sketch_{c}") for c in distinct]
    per = df.filter(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("day"), *keys)
    return per.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums], *sketched)


def over_periods(partials: DataFrame, as_of: date, names: list[str], keys: list[str]) -> DataFrame:
    """(time_period, keys, n, sums, count_* of the distinct columns) of daily() rows."""
    sketches = [c for c in partials.columns if c.startswith("sketch_")]
    sums = [c for c in partials.columns if c not in ("day", *keys, *sketches)]
    counts = [F.hll_sketch_estimate(F.hll_union_agg(c, F.lit(True))).alias(c.replace("sketch_", "count_", 1)) for c in sketches]
    return by_period(partials, "day", as_of, names).groupBy("time_period", *keys).agg(*[F.sum(c).alias(c) for c in sums], *counts)
