"""Named reporting periods relative to a date, both ends included."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: days before the date at which a period begins and ends
SPANS = {"daily": (0, 0), "weekly": (6, 0), "monthly": (29, 0), "quarterly": (89, 0), "prev_month": (394, 365), "yearly": (364, 0), "historical": (365, 0)}
ALL_DAYS = "all"  #: for periods_of(): the period of every row
BEFORE = {"weekly": 7, "monthly": 30}  #: days by which the adjacent earlier period lies back


def parse_date(text: str | None) -> date:
    """A process date: the text's, or else yesterday."""
    return date.fromisoformat(text) if text else date.today() - timedelta(days=1)


def spans(as_of: date, names: list[str]) -> list[tuple[str, date, date]]:
    out = []
    for n in names:
        if n == "ytd":
            out.append((n, as_of.replace(month=1, day=1), as_of))
        else:
            a, b = SPANS[n]
            out.append((n, as_of - timedelta(days=a), as_of - timedelta(days=b)))
    return out


def periods(spark: SparkSession, as_of: date, names: list[str]) -> DataFrame:
    return spark.createDataFrame(spans(as_of, names), "time_period string, period_start date, period_end date")


def within(df: DataFrame, day: str, as_of: date, names: list[str]) -> DataFrame:
    """df's rows from the first day of any of the periods to the last of any."""
    first, last = min(s for _, s, _ in spans(as_of, names)), max(e for _, _, e in spans(as_of, names))
    return df.filter(F.to_date(day).between(F.lit(first), F.lit(last)))


def periods_of(day: str, as_of: date, names: list[str]) -> Column:
    """The names of the periods that hold a day, as a list. Days of equal lists can be summed before the lists are exploded, so that
    rows needn't be multiplied by the number of periods."""
    d, real = F.to_date(day), [n for n in names if n != ALL_DAYS]
    held = [F.when(d.between(F.lit(a), F.lit(b)), F.lit(n)) for n, a, b in spans(as_of, real)]
    return F.array_compact(F.array(*held, *[F.lit(n) for n in names if n == ALL_DAYS]))


def by_period(df: DataFrame, day: str, as_of: date, names: list[str]) -> DataFrame:
    """df's rows once for each period that holds their day: one scan for all periods, and rows outside the longest are filtered
    before. The periods are a handful of literal rows."""
    near = within(df, day, as_of, names)
    return near.join(F.broadcast(periods(df.sparkSession, as_of, names)), F.to_date(near[day]).between(F.col("period_start"), F.col("period_end")))


def adjacent(as_of: date, name: str) -> tuple[tuple[date, date], tuple[date, date]]:
    """(this period, the one before it)."""
    (_, a, b), back = spans(as_of, [name])[0], timedelta(days=BEFORE[name])
    return (a, b), (a - back, b - back)
