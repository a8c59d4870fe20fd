"""Ranks and tiles over whole tables, without sorting a table in one task or writing it anew.

Rows are counted by value first. These histograms are dealt to ranges of their order and written to the shared folder, so that every
later step sees the same ranges; a value's place is its place within the range plus what the ranges before it add up to. Histograms of at
most LOCAL values need no ranges. Tiles need
no more than the values at their edges, which become part of the plan; where an edge falls among equal values, a second histogram, of
the ids of those rows alone, says at which id. Dense ranks are joined back by value.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from functools import reduce
from itertools import accumulate, groupby
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.steps import discard, materialize

LOCAL = 20_000  #: most values whose places are found on the driver, and most ranks that become part of the plan
SENT = 500_000  #: most ranks that are broadcast


def _exploded(df: DataFrame, columns: list[tuple[list[str], str]]) -> DataFrame:
    """A row for each row of df and each of columns (by, value): its number `which`, the by columns and the value, in a column of
    its own and of its own type; what belongs to another of the columns is null."""
    by = list(dict.fromkeys(c for b, _ in columns for c in b))
    types = {f.name: f.dataType for f in df.schema.fields}
    held = lambda on, c: (F.col(c) if on else F.lit(None)).cast(types[c])
    each = [F.struct(F.lit(k).alias("which"), *[held(c in b, c).alias(f"_by_{c}") for c in by], *[held(j == k, v).alias(f"_value_{j}") for j, (_, v) in enumerate(columns)]) for k, (b, _) in enumerate(columns)]
    return df.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def _ranges(histogram: DataFrame, keys: list[Column]) -> DataFrame:
    """The histogram with the number of each row's range, of as many as shuffles have partitions."""
    n = int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(histogram.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))


def _if_few(df: DataFrame, keys: list[Column]) -> list | None:
    """The rows of df in order, if they are at most LOCAL."""
    first = df.orderBy(*keys).limit(LOCAL + 1).collect()  # bounded by LOCAL
    return first if len(first) <= LOCAL else None


def _at_few(histogram: list, wanted) -> Iterable[dict]:
    """_at() of a histogram that is here, in order."""
    for which, rows in groupby(histogram, lambda r: r["which"]):
        rows = list(rows)
        ends = list(accumulate(r["n"] for r in rows))
        for place in wanted(which, ends[-1]):
            k = bisect_left(ends, place)
            yield rows[k].asDict() | {"place": place, "upto": ends[k]}


def _at(rows: DataFrame, keys: list[Column], wanted) -> list:
    """Of rows with a column `which`, those at certain places of the order of each `which`: Rows with place, upto (rows to the last equal
    one) and n (equal ones). wanted(which, rows in all): the places, counted from 1."""
    columns = [c for c in rows.columns if c != "which"]
    histogram = materialize(rows.groupBy("which", *columns).agg(F.count("*").alias("n")))
    few = _if_few(histogram, [F.col("which"), *keys])
    if few is not None:
        discard(histogram)
        return list(_at_few(few, wanted))
    held = _ranges(histogram, [F.col("which"), *keys])
    discard(histogram)
    sums = held.groupBy("which", "_range").agg(F.sum("n").alias("_n"))  # a row for each range
    before = sums.select("which", "_range", (F.sum("_n").over(Window.partitionBy("which").orderBy("_range")) - F.col("_n")).alias("_before"))
    totals = {r[0]: r[1] for r in sums.groupBy("which").agg(F.sum("_n")).collect()}
    places = [(k, p) for k, total in totals.items() for p in wanted(k, total)]
    out = []
    if places:
        upto = F.sum("n").over(Window.partitionBy("which", "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
        placed = held.withColumn("upto", upto).join(F.broadcast(before), ["which", "_range"]).withColumn("upto", F.col("upto") + F.col("_before"))
        asked = held.sparkSession.createDataFrame(places, "which int, place long")
        out = placed.join(F.broadcast(asked), "which").filter("place <= upto and place > upto - n").collect()  # a row for each place
    discard(held)
    return out


def _beyond(column: str, value, descending: bool) -> Column:
    """Whether a row's value comes after `value`; nulls come first, or last if descending."""
    c = F.col(column)
    if value is None:
        return F.lit(False) if descending else c.isNotNull()
    return (c.isNull() | (c < F.lit(value))) if descending else F.coalesce(c > F.lit(value), F.lit(False))


def ntiles_of_all(df: DataFrame, n: int, tiles: dict[str, tuple[str, bool]], by_id: str) -> DataFrame:
    """df with ntile(n) over the order of a column, and then of by_id, for each of tiles: alias -> (column, descending). df is read
    once for all histograms, once more where an edge falls among equal values, and its rows aren't moved."""
    columns = [([], c) for c, _ in tiles.values()]
    order = lambda c, down: F.col(c).desc() if down else F.col(c).asc()
    keys = [order(f"_value_{k}", down) for k, (_, down) in enumerate(tiles.values())]
    ends = lambda total: [k * (total // n) + min(k, total % n) for k in range(1, n)]
    edges = _at(_exploded(df, columns), keys, lambda _, total: sorted({p for p in ends(total) if p}))
    values = {(r["which"], r["place"]): r[f"_value_{r['which']}"] for r in edges}
    among = [r for r in edges if r["place"] < r["upto"]]  # the edge falls among equal values
    ids: dict[tuple[int, int], object] = {}
    if among:
        groups = {k: (r["which"], r["place"], r["place"] - r["upto"] + r["n"]) for k, r in enumerate(among)}
        names = [c for c, _ in tiles.values()]
        ties = [F.when(F.col(names[w]).eqNullSafe(F.lit(values[w, p])), F.struct(F.lit(k).alias("which"), F.col(by_id).alias("id"))) for k, (w, p, _) in groups.items()]
        rows = df.select(F.explode(F.filter(F.array(*ties), lambda x: x.isNotNull())).alias("x")).select("x.*")
        for r in _at(rows, [F.col("id").asc()], lambda k, _: [groups[k][2]]):
            ids[groups[r["which"]][:2]] = r["id"]
    out = {}
    for k, (alias, (column, down)) in enumerate(tiles.items()):
        total_edges = [p for w, p in values if w == k]
        after = []
        for p in sorted(total_edges):
            v, past = values[k, p], _beyond(column, values[k, p], down)
            after.append(past | (F.col(column).eqNullSafe(F.lit(v)) & _beyond(by_id, ids[k, p], False)) if (k, p) in ids else past)
        out[alias] = reduce(add, [x.cast("int") for x in after], F.lit(1)).cast("int")
    return df.withColumns(out)


def dense_ranks_of_all(df: DataFrame, ranks: Iterable[tuple[list[str], str, str]]) -> DataFrame:
    """df with dense ranks: (by, value, alias), the largest value first and nulls last, within by, whose groups may be as large as the
    table. df is read once for all histograms."""
    ranks = list(ranks)
    columns = [(by, value) for by, value, _ in ranks]
    by_all = [f"_by_{c}" for c in dict.fromkeys(c for by, _ in columns for c in by)]
    values = [f"_value_{k}" for k in range(len(ranks))]
    keys = [F.col("which"), *map(F.col, by_all), *[F.desc_nulls_last(v) for v in values]]
    distinct, group = materialize(_exploded(df, columns).distinct()), ["which", *by_all]
    few = _if_few(distinct, keys)
    if few is not None:
        ranked = [(*r, k) for _, rows in groupby(few, lambda r: [r[c] for c in group]) for k, r in enumerate(rows, 1)]
        placed = df.sparkSession.createDataFrame(ranked, T.StructType([*distinct.schema.fields, T.StructField("_rank", T.IntegerType())]))
        discard(distinct)
        return _ranked(df, ranks, placed, True)
    held = _ranges(distinct, keys)
    discard(distinct)
    sums = held.groupBy("_range", *group).agg(F.count("*").alias("_n"))  # a row for each range and group in it
    before = sums.select("_range", *group, (F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*[F.desc_nulls_last(v) for v in values]))
    placed = held.withColumn("_number", number).alias("h").join(before.alias("b"), _same("h", "b", ["_range", *group])).select("h.*", (F.col("_number") + F.col("_before")).cast("int").alias("_rank")).drop("_range", "_number")
    return _ranked(df, ranks, placed, held.count() <= SENT)


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])


def _ranked(df: DataFrame, ranks: list[tuple[list[str], str, str]], placed: DataFrame, send: bool) -> DataFrame:
    """df joined with the ranks of its values."""
    for k, (by, value, alias) in enumerate(ranks):
        mine = placed.filter(F.col("which") == k).select(*[F.col(f"_by_{c}").alias(c) for c in by], F.col(f"_value_{k}").alias(value), F.col("_rank").alias(alias))
        df = df.alias("o").join((F.broadcast(mine) if send else mine).alias("r"), _same("o", "r", [*by, value]), "left").select("o.*", f"r.{alias}")
    return df
