"""Gold sales series, seasonality and forecasts. A month is an integer, year * 12 + month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import bands, ladder

MEASURES = ["revenue", "orders", "quantity"]


def delivered(items: DataFrame, orders: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """Items of delivered orders of the last `days`; year-on-year growth needs more than the default."""
    recent = orders.filter("order_status = 'Livré'").filter(F.col("order_date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    return items.join(recent.select("order_id", "customer_id", "order_date"), "order_id")


def sales(base: DataFrame, grain: str, by_category: bool) -> DataFrame:
    keys = (["order_date"] if grain == "day" else [(F.year("order_date") * 12 + F.month("order_date")).alias("month_idx")]) + (["category"] if by_category else [])
    out = base.groupBy(*keys).agg(F.sum("item_total").alias("revenue"), F.count_distinct("order_id").alias("orders"), F.sum("quantity").alias("quantity"), F.count_distinct("customer_id").alias("customers"))
    return out.withColumn("month_year", F.format_string("%d-%02d", F.floor((F.col("month_idx") - 1) / 12), (F.col("month_idx") - 1) % 12 + 1)) if grain == "month" else out


def _series(monthly: DataFrame) -> Window:
    return Window.partitionBy(*(["category"] if "category" in monthly.columns else [])).orderBy("month_idx")  # months are few


def growth(monthly: DataFrame) -> DataFrame:
    """Mean of three months, growth on the month and the year before by month, not by row, so gaps give null."""
    w = _series(monthly)
    at = lambda k: F.max("revenue").over(w.rangeBetween(-k, -k))
    out = monthly.withColumns({"moving_average": F.avg("revenue").over(w.rowsBetween(-2, 0)), "_1": at(1), "_12": at(12)})
    pct = lambda c: F.when(F.col(c) > 0, (F.col("revenue") - F.col(c)) / F.col(c) * 100)
    return out.withColumns({"mom_growth": pct("_1"), "yoy_growth": pct("_12")}).drop("_1", "_12")


def growth_trends(monthly: DataFrame, months: int = 6) -> DataFrame:
    """Mean, least and most growth of the last months with a label for the year's growth, over all ('Overall', its last rows, nulls
    as 0) and by category (the last months of the table). monthly: by category."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("mom_growth", "yoy_growth") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    total = growth(monthly.groupBy("month_idx").agg(F.sum("revenue").alias("revenue")))
    overall = total.orderBy(F.desc("month_idx")).limit(months).agg(F.count("*").alias("months"), *stats).filter("months > 0").withColumn("segment", F.lit("Overall")).na.fill(0.0)
    last = monthly.agg(F.max("month_idx").alias("last"))  # one row
    recent = growth(monthly.select("month_idx", "category", "revenue")).join(F.broadcast(last), F.col("month_idx") > F.col("last") - months)
    out = overall.unionByName(recent.groupBy(F.col("category").alias("segment")).agg(F.count("*").alias("months"), *stats))
    mom, yoy = F.col("avg_mom_growth"), F.col("avg_yoy_growth")
    # fixed values: labels of the reports
    label = bands(yoy, [(20, "Strong Growth"), (10, "Healthy Growth"), (0, "Stable Growth"), (-10, "Slight Decline")], "Significant Decline")
    momentum = ladder([(mom > yoy, "Accelerating"), (mom > 0, "Continuing"), ((mom < 0) & (yoy > 0), "Slowing")], "Declining")
    return out.withColumns({"growth_trend": label, "momentum": momentum})


def seasonal_index(monthly: DataFrame) -> DataFrame:
    """Month's mean revenue over the mean of all months, overall and by category."""
    total = monthly.groupBy("month_idx").agg(F.sum("revenue").alias("revenue")).withColumn("category", F.lit("ALL"))
    both = total.unionByName(monthly.select("month_idx", "revenue", "category")).withColumn("month", (F.col("month_idx") - 1) % 12 + 1)
    per = both.groupBy("category", "month").agg(F.avg("revenue").alias("month_mean"), F.sum("revenue").alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy("category")
    return per.withColumn("overall_mean", F.sum("_s").over(w) / F.sum("_n").over(w)).withColumn("seasonal_index", F.col("month_mean") / F.col("overall_mean")).drop("_s", "_n")


def ols_forecast(monthly: DataFrame, horizon: int = 3) -> DataFrame:
    """Straight lines through revenue, orders and quantity; the next months with 10 % bounds. By category if there is one. A
    single month has slope 0."""
    keys = ["category"] if "category" in monthly.columns else []
    fits = [x for m in MEASURES for x in (F.coalesce(F.regr_slope(m, "month_idx"), F.lit(0.0)).alias(f"{m}_slope"), F.coalesce(F.regr_intercept(m, "month_idx"), F.avg(m)).alias(f"{m}_intercept"))]
    lines = monthly.groupBy(*keys).agg(*fits, F.max("month_idx").alias("last_month"), F.count("*").alias("months"))
    out = lines.filter("last_month is not null").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("month_idx", F.col("last_month") + F.col("step"))
    for m in MEASURES:
        out = out.withColumn(f"forecast_{m}", F.greatest(F.col(f"{m}_slope") * F.col("month_idx") + F.col(f"{m}_intercept"), F.lit(0.0)))
    return out.withColumns({"lower_bound": F.col("forecast_revenue") * 0.9, "upper_bound": F.col("forecast_revenue") * 1.1, "confidence": F.lit("Medium")}).drop("step", "last_month", *[f"{m}_{p}" for m in MEASURES for p in ("slope", "intercept")])


def ml_forecast(monthly: DataFrame, measure: str = "revenue", horizon: int = 3) -> DataFrame:
    """The same line by pyspark.ml, for one series."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    made = VectorAssembler(inputCols=["month_idx"], outputCol="x")
    model = LinearRegression(featuresCol="x", labelCol=measure, predictionCol=f"forecast_{measure}").fit(made.transform(monthly))
    ahead = monthly.agg(F.max("month_idx").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + horizon)).alias("month_idx"))
    return model.transform(made.transform(ahead)).drop("x")
