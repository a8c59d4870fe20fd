"""Data-quality checks as metric rows, one aggregation for each dataset and kind."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import ladder, mapped
from tidemark.functions.steps import materialize
from tidemark.sources import lake


def completeness(df: DataFrame, name: str) -> DataFrame:
    """(dataset, column_name, total, missing, completeness): nulls, and NaN of float columns."""
    bad = lambda f: F.count_if(F.col(f"`{f.name}`").isNull() | (F.isnan(f"`{f.name}`") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(False)))
    one = df.agg(F.count("*").alias("total"), *[bad(f).alias(f.name) for f in df.schema.fields])
    long_ = one.unpivot(["total"], df.columns, "column_name", "missing")
    return long_.select(F.lit(name).alias("dataset"), "column_name", "total", "missing", F.when(F.col("total") > 0, 1 - F.col("missing") / F.col("total")).otherwise(1.0).alias("completeness"))


def validity(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """(dataset, rule, total, valid, validity); a rule that is null for a row isn't met."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])
    return one.unpivot(["total"], list(rules), "rule", "valid").select(F.lit(name).alias("dataset"), "rule", "total", "valid", F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(1.0).alias("validity"))


def referential_integrity(source: DataFrame, target: DataFrame, source_key: str, target_key: str, name: str) -> DataFrame:
    keys = source.select(F.col(source_key).alias("k")).filter("k is not null").distinct()
    known = target.select(F.col(target_key).alias("k"), F.lit(1).alias("hit")).filter("k is not null").distinct()
    one = keys.join(known, "k", "left").agg(F.count("*").alias("keys"), F.count_if(F.col("hit").isNull()).alias("orphans"))
    score = F.when(F.col("keys") > 0, 1 - F.col("orphans") / F.col("keys")).otherwise(1.0)
    return one.select(F.lit(name).alias("relation"), "keys", "orphans", score.alias("score"), ladder([(score >= 0.98, "PASSED"), (score >= 0.9, "WARNING")], "FAILED").alias("status"))


def _status(share: Column) -> Column:
    return ladder([(share < 1, "PASSED"), (share < 5, "WARNING")], "FAILED")


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    share = F.when(F.col("total") > 0, F.col("duplicates") / F.col("total") * 100).otherwise(0.0)
    return one.select(F.lit(name).alias("dataset"), "total", "duplicates", share.alias("percent"), _status(share).alias("status"))


def outliers(df: DataFrame, column: str, name: str, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """zscore: above the mean by more than `threshold` deviations; iqr: outside 1.5 ranges from the quartiles."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    if method == "zscore":
        stats = x.agg(F.avg("x").alias("m"), F.stddev("x").alias("s"))
        odd = (F.col("s") > 0) & ((F.col("x") - F.col("m")) / F.col("s") > threshold)
    else:
        stats = x.agg(F.percentile_approx("x", 0.25, 10_000).alias("q1"), F.percentile_approx("x", 0.75, 10_000).alias("q3"))  # sketches
        odd = (F.col("x") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("x") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    one = x.join(F.broadcast(stats)).agg(F.count("*").alias("total"), F.count_if(odd).alias("outliers"))  # stats: one row
    share = F.when(F.col("total") > 0, F.col("outliers") / F.col("total") * 100).otherwise(0.0)
    return one.select(F.lit(name).alias("dataset"), F.lit(column).alias("column_name"), F.lit(method).alias("method"), "total", "outliers", share.alias("percent"), _status(share).alias("status"))


def freshness(df: DataFrame, column: str, name: str, as_of: date, max_days: int = 1) -> DataFrame:
    age = F.date_diff(F.lit(as_of), F.to_date(F.max(column)))
    one = df.agg(F.max(column).alias("latest"), age.alias("age_days"))
    return one.select(F.lit(name).alias("dataset"), F.to_date("latest").alias("latest"), "age_days", ladder([(F.col("age_days").isNull(), "FAILED"), (F.col("age_days") <= max_days, "PASSED"), (F.col("age_days") <= 3, "WARNING")], "FAILED").alias("status"))


def distribution(df: DataFrame, column: str, name: str, most: int = 100) -> DataFrame:
    """Counts and percentages of a column of at most `most` distinct values; no rows for one with more."""
    per = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("all_rows"), F.count("*").alias("values"))
    return per.join(F.broadcast(whole)).filter(F.col("values") <= most).select(F.lit(name).alias("dataset"), F.lit(column).alias("column_name"), "value", "n", (F.col("n") / F.col("all_rows") * 100).alias("percent"))


def issues(metrics: DataFrame) -> DataFrame:
    """What of the metrics is an issue, and how severe. metrics: (dataset, kind, value), where it exists also allowed: the days that
    age_days may reach (1). Kinds: completeness, validity, duplicate_percent, integrity, age_days; null value: the dataset is missing."""
    k, v = F.col("kind"), F.col("value")
    days = F.coalesce(F.col("allowed"), F.lit(1.0)) if "allowed" in metrics.columns else F.lit(1.0)
    low = k.isin("completeness", "validity")
    severity = ladder([
        ((k == "missing") | v.isNull(), "HIGH"), (low & (v < 0.9), "HIGH"), (low & (v < 0.95), "MEDIUM"), ((k == "duplicate_percent") & (v > 5), "HIGH"), ((k == "duplicate_percent") & (v > 1), "MEDIUM"),
        ((k == "integrity") & (v < 0.9), "HIGH"), ((k == "age_days") & (v > days) & (v > 3), "HIGH"), ((k == "age_days") & (v > days), "MEDIUM"),
    ], "NONE")
    return metrics.withColumn("severity", severity).filter("severity <> 'NONE'").withColumn("issue_type", mapped(k, ISSUE_TYPES))


# fixed values: names of issues in the reports
ISSUE_TYPES = {
    "completeness": "LOW_COMPLETENESS", "validity": "LOW_VALIDITY", "duplicate_percent": "DUPLICATES", "integrity": "REFERENTIAL_INTEGRITY",
    "age_days": "DATA_STALENESS", "missing": "DATASET_NOT_FOUND",
}


def volume_anomalies(df: DataFrame, column: str, days: int = 7, k: float = 3.0) -> DataFrame:
    """Daily row counts against mean and deviation of the trailing days."""
    per = df.groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("n")).filter("day is not null")
    w = Window.orderBy("day").rowsBetween(-days, -1)  # a row for each day
    out = per.withColumns({"mean": F.avg("n").over(w), "sd": F.stddev("n").over(w)})
    return out.withColumn("is_anomaly", F.coalesce(F.abs(F.col("n") - F.col("mean")) > k * F.col("sd"), F.lit(False)))


def schema_drift(actual: T.StructType, expected: T.StructType) -> list[tuple[str, str]]:
    """(column, added | missing | type a -> b)."""
    a, e = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (actual, expected))
    return [(c, "added" if c not in e else "missing" if c not in a else f"type {e[c]} -> {a[c]}") for c in sorted(a | e) if a.get(c) != e.get(c)]


@dataclass(frozen=True)
class Checks:
    """What is checked of a dataset. A rule that names a column the dataset lacks is left out, as is a date column."""

    rules: dict[str, str]
    keys: tuple[str, ...] = ()
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)  #: own column -> (dataset, its column)
    dates: tuple[str, ...] = ()  #: the first of them that exists is when the dataset was last updated
    days: int = 1  #: age in days that it may reach
    outliers: tuple[str, ...] = ()
    values: tuple[str, ...] = ()  #: columns whose distribution is reported


def _known(*columns: str) -> dict[str, str]:
    return {f"valid_{c}": f"{c} is not null" for c in columns}


def _amount(*columns: str) -> dict[str, str]:
    return {f"valid_{c}": f"{c} >= 0" for c in columns}


EMAIL = {"valid_email": "length(email) > 5 and contains(email, '@')"}
SUITE = {
    "web_logs": Checks(_known("event_id", "session_id", "event_timestamp", "event_type"), ("event_id",), {}, ("event_timestamp",), 2, (), ("event_type",)),
    "customers": Checks(_known("customer_id", "registration_date") | EMAIL, ("customer_id",), {}, ("silver_updated_at", "registration_date"), 1, (), ("gender", "skin_type")),
    "orders": Checks(_known("order_id", "customer_id", "order_date") | _amount("final_total"), ("order_id",), {"customer_id": ("customers", "customer_id")}, ("silver_updated_at", "order_date"), 1, ("final_total",)),
    "order_items": Checks(_known("order_id", "product_name") | {"valid_price": "price > 0", "valid_quantity": "quantity > 0"}, (), {"order_id": ("orders", "order_id")}, (), 1, (), ("category",)),
    "google_ads": Checks(_known("campaign_id", "ad_date") | _amount("cost", "impressions"), (), {}, ("silver_updated_at", "ad_date"), 1, ("cost",)),
    "social_ads": Checks(_known("campaign_id", "ad_date", "platform") | _amount("cost"), (), {}, ("silver_updated_at", "ad_date"), 1, (), ("platform",)),
    "web_sessions": Checks(_known("session_id", "session_start") | _amount("session_duration_seconds"), ("session_id",), {}, ("silver_updated_at", "session_start"), 1, ("session_duration_seconds",)),
    "customer_sessions": Checks(_known("session_id", "user_id", "session_start"), (), {"user_id": ("customers", "customer_id")}, ("silver_updated_at", "session_start")),
    "customer_profiles": Checks(_known("customer_id", "profile_lifecycle_stage") | EMAIL, (), {"customer_id": ("customers", "customer_id")}, ("profile_updated_at",), 1, (), ("profile_lifecycle_stage",)),
    "marketing_attribution": Checks(_known("order_id", "user_id", "attribution_model") | _amount("attributed_revenue"), (), {"order_id": ("web_orders", "order_id")}, ("order_date",), 1, (), ("attribution_model",)),
    "channel_performance": Checks(_known("attribution_model", "utm_source") | _amount("attributed_revenue"), (), {}, ("attribution_date",)),
}


def _facts(name: str, df: DataFrame, checks: Checks) -> DataFrame:
    """One row: everything about a dataset that a single aggregation gives."""
    rules = [F.expr(r) for r in checks.rules.values() if set(df.columns) & set(re.findall(r"\w+", r))]
    updated = next((c for c in checks.dates if c in df.columns), None)
    bad = lambda f: F.col(f"`{f.name}`").isNull() | (F.isnan(f"`{f.name}`") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(False))
    total = lambda xs: reduce(Column.__add__, xs, F.lit(0).cast("long"))
    x = [F.col(c).cast("double") for c in checks.outliers]
    return df.agg(
        F.count("*").alias("rows"), total([F.count_if(bad(f)) for f in df.schema.fields]).alias("missing"), total([F.count_if(F.coalesce(r, F.lit(False))) for r in rules]).alias("valid"),
        (F.to_date(F.max(updated)) if updated else F.lit(None).cast("date")).alias("latest"), F.array(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("sd")) for c in x]).cast("array<struct<n:bigint,mean:double,sd:double>>").alias("moments"),
    ).select(F.lit(name).alias("dataset"), "*", F.lit(len(df.columns)).alias("columns"), F.lit(len(rules)).alias("rules"), F.lit(updated).cast("string").alias("updated"))


def _values(name: str, df: DataFrame, checks: Checks, moments: list, keys: list[str], owns: dict[tuple[str, str], int], number: Callable[[str, str, str], int]) -> DataFrame:
    """(check, value, flag) for each row and each check that counts values: of what is repeated ('repeated'), of
    distributions ('value'), and values that stand out ('odd'). 'key' are values that others refer to, with flag 1, and those that
    refer to them, with a flag of each of the owns (2, 4, ...): both under the dataset and column that is referred to. check: the
    number of dataset, what and item."""
    text = lambda c: F.col(c).cast("string")
    one = lambda d, w, i, v, flag=1: F.struct(F.lit(number(d, w, i)).alias("check"), v.alias("value"), F.lit(flag).cast("long").alias("flag"))
    shown = [one(name, "value", c, text(c)) for c in checks.values if c in df.columns]
    if checks.keys and not (len(checks.keys) == 1 and checks.keys[0] in keys):
        shown.append(one(name, "repeated", ",".join(checks.keys), text(checks.keys[0]) if len(checks.keys) == 1 else F.to_json(F.struct(*checks.keys))))
    for k in keys:  # its own repetitions, nulls included, are counted here too
        shown.append(one(name, "key", k, text(k)) if checks.keys == (k,) else F.when(F.col(k).isNotNull(), one(name, "key", k, text(k))))
    shown += [F.when(F.col(c).isNotNull(), one(parent, "key", key, text(c), owns[name, c])) for c, (parent, key) in checks.parents.items()]
    for c, m in zip(checks.outliers, moments, strict=True):
        if m.sd:
            shown.append(F.when((F.col(c).cast("double") - F.lit(m.mean)) / F.lit(m.sd) > 3.0, one(name, "odd", c, F.lit("yes"))))
    if not shown:
        shown = [F.when(F.lit(False), one(name, "odd", "", F.lit(None).cast("string")))]
    return df.select(F.explode(F.array(*shown)).alias("x")).filter("x is not null").select("x.*")


def suite_metrics(datasets: dict[str, DataFrame | None], as_of: date, suite: dict[str, Checks] | None = None, most_values: int = 100) -> DataFrame:
    """(dataset, kind, item, value, allowed) of all checks. item: the column, parent or value that a row is about. Kinds:
    completeness and validity of the dataset, duplicate_percent, integrity, age_days, outlier_percent, value_percent, missing.

    The rules are compiled to two scans of each dataset, whatever their number: one aggregation, of which the driver gets a row a
    dataset, and one count of the values that any check needs (outliers as flags, by the first one's moments). A value that refers to
    another dataset is counted together with those referred to, so that one grouping by value says what is repeated, referred to and
    found. Of all that, only sums by check are written to the shared folder. Datasets should be tables: one that is derived is derived
    for either scan.
    """
    suite = SUITE if suite is None else suite
    held = {name: df for name, df in datasets.items() if df is not None and (name in suite or any(p == name for c in suite.values() for p, _ in c.parents.values()))}
    checked = {name: checks for name, checks in suite.items() if name in held}
    spark = next(iter(held.values())).sparkSession
    facts = {r.dataset: r for r in reduce(DataFrame.unionByName, [_facts(name, held[name], c) for name, c in checked.items()]).collect()}  # a row a dataset

    share = lambda part, whole, scale=1.0: part / whole * scale if whole else None
    rows = [(name, "missing", None, None, None) for name in suite if name not in held]
    for name, f in facts.items():
        full = share(f.missing, f.rows * f.columns)
        rows.append((name, "completeness", None, 1.0 - full if full is not None else 1.0, None))
        if f.rules:
            valid = share(f.valid, f.rows * f.rules)
            rows.append((name, "validity", None, valid if valid is not None else 1.0, None))
        if f.updated:
            rows.append((name, "age_days", f.updated, float((as_of - f.latest).days) if f.latest else None, float(checked[name].days)))
    schema = "dataset string, kind string, item string, value double, allowed double"
    out = [spark.createDataFrame(rows, schema)]

    parents = {(p, k) for c in checked.values() for p, k in c.parents.values() if p in held}
    kept = {n: Checks({}, c.keys, {own: x for own, x in c.parents.items() if x in parents}, (), 1, c.outliers, c.values) for n, c in checked.items()}
    owns = {x: 2 << k for k, x in enumerate((n, own) for n, c in kept.items() for own in c.parents)}
    numbers: dict[tuple[str, str, str], int] = {}
    number = lambda *names: numbers.setdefault(names, len(numbers))
    scans = [_values(n, df, kept.get(n, Checks({})), facts[n].moments if n in facts else [], sorted(k for p, k in parents if p == n), owns, number) for n, df in held.items()]
    values = reduce(DataFrame.unionByName, scans).groupBy("check", "value").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == 1).alias("keys"), F.bit_or("flag").alias("flags"))
    # values of distributions, as far as they may be few, and one row for all others of a check and its flags
    distribution = F.col("check").isin([k for (_, what, _), k in numbers.items() if what == "value"])
    shown = values.groupBy("check", F.when(distribution, F.col("value")).alias("value"), "flags").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.count("*").alias("values"))
    table = spark.createDataFrame([(k, *names) for names, k in numbers.items()], "check int, dataset string, what string, item string")
    counts = materialize(shown).join(F.broadcast(table), "check")
    of = lambda what: counts.filter(F.col("what") == what)
    metric = lambda df, kind, item, value: df.select("dataset", F.lit(kind).alias("kind"), item.cast("string").alias("item"), value.cast("double").alias("value"), F.lit(None).cast("double").alias("allowed"))

    wanted = spark.createDataFrame([(n, ",".join(c.keys)) for n, c in kept.items() if c.keys], "dataset string, item string")
    hit = F.col("what").isin("repeated", "key") & (F.col("flags").bitwiseAND(1) == 1)
    repeated = counts.filter(hit).groupBy("dataset", "item").agg(F.sum("keys").alias("total"), F.sum(F.col("keys") - F.col("values")).alias("again"))
    out.append(metric(F.broadcast(wanted).join(repeated, ["dataset", "item"], "left"), "duplicate_percent", F.col("item"), F.when(F.col("total") > 0, F.col("again") / F.col("total") * 100).otherwise(0.0)))

    relations = spark.createDataFrame([(n, p, k, owns[n, own]) for n, c in kept.items() for own, (p, k) in c.parents.items()], "dataset string, parent string, item string, own long")
    referred = of("key").select(F.col("dataset").alias("parent"), "item", "flags", "values")
    joined = F.broadcast(relations).join(referred, ["parent", "item"], "left").groupBy("dataset", "parent", "own").agg(
        F.sum(F.when(F.col("flags").bitwiseAND(F.col("own")) != 0, F.col("values"))).alias("keys"), F.sum(F.when((F.col("flags").bitwiseAND(F.col("own")) != 0) & (F.col("flags").bitwiseAND(1) == 1), F.col("values"))).alias("hits"))
    out.append(metric(joined, "integrity", F.col("parent"), F.when(F.col("keys") > 0, 1 - (F.col("keys") - F.coalesce("hits", F.lit(0))) / F.col("keys")).otherwise(1.0)))

    moments = [(n, c, m.n) for n, k in kept.items() for c, m in zip(k.outliers, facts[n].moments, strict=True)]
    odd = F.broadcast(spark.createDataFrame(moments, "dataset string, item string, total long")).join(of("odd").select("dataset", "item", "n"), ["dataset", "item"], "left")
    out.append(metric(odd, "outlier_percent", F.col("item"), F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total") * 100).otherwise(0.0)))

    whole = of("value").groupBy("dataset", "item").agg(F.sum("n").alias("rows"), F.count("*").alias("values")).filter(F.col("values") <= most_values)
    out.append(metric(of("value").join(F.broadcast(whole), ["dataset", "item"]), "value_percent", F.concat_ws("=", "item", F.coalesce("value", F.lit("null"))), F.col("n") / F.col("rows") * 100))
    return reduce(DataFrame.unionByName, out)


def silver_suite(datasets: dict[str, DataFrame | None], as_of: date, suite: dict[str, Checks] | None = None) -> DataFrame:
    """Issues of all datasets; a missing dataset is a HIGH issue. Passes if no issue is HIGH."""
    return issues(suite_metrics(datasets, as_of, suite))


def write_report(metrics: DataFrame, path: str, as_of: date, fmt: str = "json") -> None:
    """The metrics, the issues and their number by severity under path, by report date."""
    found = issues(metrics)
    counts = found.agg(*[F.count_if(F.col("severity") == x).alias(f"{x.lower()}_issues") for x in ("HIGH", "MEDIUM")]).withColumn("passed", F.col("high_issues") == 0)
    for name, df in (("metrics", metrics), ("issues", found), ("summary", counts)):
        lake.write(df.withColumn("report_date", F.lit(as_of)), f"{path.rstrip('/')}/{name}", ["report_date"], fmt=fmt)
