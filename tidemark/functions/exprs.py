"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column | str, den: Column | str, default: float | None = None, scale: float = 1.0) -> Column:
    """scale * num / den where den > 0, else default."""
    return F.when(c(den) > 0, c(num) / c(den) * scale).otherwise(F.lit(default).cast("double"))


def rounded(x: Column | str, digits: int) -> Column:
    """Half-up at `digits`, by way of nine decimals, so that the last bits of a double don't decide ties."""
    return F.round(c(x).cast("decimal(28,9)"), digits).cast("double")


def ladder(arms: list[tuple[Column, str]], otherwise: str | Column) -> Column:
    """First match wins."""
    out = None
    for test, label in arms:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def bands(x: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first cut that x reaches."""
    return ladder([(x >= cut, label) for cut, label in cuts], otherwise)


def change_percent(now: Column | str, before: Column | str) -> Column:
    """Growth in percent; 100 for what is new, 0 for what is absent in both."""
    return F.when(c(before) > 0, (c(now) - c(before)) / c(before) * 100).when(c(now) > 0, 100.0).otherwise(0.0)


def trend_label(growth: Column) -> Column:
    return bands(growth, [(20, "Strong Growth"), (5, "Growth"), (-5, "Stable"), (-20, "Decline")], "Strong Decline")


def mapped(key: Column, table: dict, default: str | Column | None = None) -> Column:
    """Lookup in a small literal table."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by order; rows with a null key are dropped."""
    from pyspark.sql import Window

    ranked = df.dropna(subset=keys).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


MONTHS = dict(enumerate("January February March April May June July August September October November December".split(), 1))
DAYS = dict(enumerate("Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split(), 1))
