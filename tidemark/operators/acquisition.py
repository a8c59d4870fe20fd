"""Gold acquisition tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import MONTHS, mapped, ratio
from tidemark.functions.periods import by_period
from tidemark.operators.segments import TENURES, tenure_bucket


def source_metrics(customers: DataFrame, orders: DataFrame, ads: DataFrame) -> DataFrame:
    """By acquisition source: customers, conversion, order averages, revenue, spend of the platform of that name, CAC, CLV/CAC."""
    per = orders.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("final_total").alias("spent"))
    by = customers.select("customer_id", "acquisition_source").join(per, "customer_id", "left").groupBy("acquisition_source").agg(
        F.count("*").alias("total_customers"), F.count("n").alias("converting_customers"), F.avg("n").alias("avg_orders"), F.avg("spent").alias("avg_customer_value"), F.coalesce(F.sum("spent"), F.lit(0.0)).alias("total_revenue"))
    name = F.regexp_replace(F.lower("platform"), "_.*$", "")
    spend = ads.groupBy(name.alias("p")).agg(F.sum("cost").alias("ad_cost"))
    out = by.join(spend, F.lower("acquisition_source") == F.col("p"), "left").drop("p").withColumn("conversion_rate", ratio("converting_customers", "total_customers", 0.0, 100))
    out = out.withColumn("cac", ratio("ad_cost", "total_customers"))
    return out.withColumn("clv_cac_ratio", ratio("avg_customer_value", "cac"))


def new_customers(customers: DataFrame, metrics: DataFrame, as_of: date, names: list[str]) -> DataFrame:
    per = by_period(customers, "registration_date", as_of, names).groupBy("time_period", "acquisition_source").agg(F.count("*").alias("new_customers"))
    share = F.col("new_customers") / F.sum("new_customers").over(Window.partitionBy("time_period")) * 100
    return per.withColumn("acquisition_share", share).join(metrics.select("acquisition_source", "conversion_rate", "cac"), "acquisition_source", "left")


def cohorts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Retention by months since registration; months before it don't count."""
    month = F.trunc("registration_date", "month")
    base = customers.filter("registration_date is not null").select("customer_id", month.alias("cohort"))
    sizes = base.groupBy("cohort").agg(F.count("*").alias("cohort_size"))
    since = F.months_between(F.trunc("order_date", "month"), F.col("cohort")).cast("int")
    act = orders.join(base, "customer_id").withColumn("months_since", since).filter("months_since >= 0").groupBy("cohort", "months_since").agg(F.count_distinct("customer_id").alias("active_customers"), F.sum("final_total").alias("revenue"))
    out = act.join(sizes, "cohort")
    return out.withColumns({"retention_rate": F.col("active_customers") / F.col("cohort_size") * 100, "revenue_per_active": F.col("revenue") / F.col("active_customers"), "cohort_label": F.concat(mapped(F.month("cohort"), MONTHS), F.lit(" "), F.year("cohort").cast("string"))})


def first_purchase_cohorts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    first = orders.groupBy("customer_id").agg(F.min("order_date").alias("first_date"), F.min_by("final_total", F.struct("order_date", "order_id")).alias("first_value"))
    rows = customers.filter("registration_date is not null").select("customer_id", "registration_date").join(first, "customer_id", "left")
    per = rows.groupBy(F.trunc("registration_date", "month").alias("cohort")).agg(
        F.count("*").alias("customers"), F.count("first_date").alias("buyers"), F.avg(F.date_diff("first_date", "registration_date")).alias("avg_days_to_first"), F.avg("first_value").alias("avg_first_value"))
    return per.withColumn("conversion_rate", F.col("buyers") / F.col("customers") * 100)


def ltv_by_tenure(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders by source and by how long their customer had been one."""
    rows = orders.filter("customer_id is not null").join(customers.select("customer_id", "acquisition_source", "registration_date"), "customer_id")
    rows = rows.withColumn("tenure_bucket", tenure_bucket(F.date_diff("order_date", "registration_date")))
    out = rows.groupBy("acquisition_source", "tenure_bucket").agg(F.count_distinct("customer_id").alias("customer_count"), F.sum("final_total").alias("total_revenue"), F.avg("final_total").alias("avg_order_value"), F.count("order_id").alias("order_count"))
    place = mapped(F.col("tenure_bucket"), {label: k for k, (_, label) in enumerate(TENURES, 1)}, F.lit(len(TENURES) + 1))
    return out.withColumns({"orders_per_customer": ratio("order_count", "customer_count", 0.0), "revenue_per_customer": ratio("total_revenue", "customer_count", 0.0), "tenure_order": place})


def channel_effectiveness(attributed: DataFrame, sessions: DataFrame, ads: DataFrame) -> DataFrame:
    """Web, attribution and paid media in one table, scored before nulls are filled, ranked over all (a row for each channel)."""
    web = sessions.groupBy(F.col("session_source").alias("channel")).agg(F.count("*").alias("sessions"), F.count_if("conversion_session").alias("conversions")).withColumns({"source_type": F.lit("web"), "conversion_rate": F.col("conversions") / F.col("sessions") * 100})
    web = web.withColumn("score", F.col("conversion_rate") / 10)
    first = attributed.filter("attribution_model = 'first_touch'").groupBy(F.coalesce("utm_source", F.lit("direct")).alias("channel")).agg(F.count("*").alias("conversions"), F.sum("attributed_revenue").alias("revenue"))
    first = first.withColumns({"source_type": F.lit("attribution"), "score": F.col("revenue") / F.col("conversions") / 1000})
    paid = ads.groupBy(F.lower("platform").alias("channel")).agg(F.sum("cost").alias("cost"), F.sum("conversions").alias("conversions")).withColumn("source_type", F.lit("paid")).withColumn("cost_per_conversion", ratio("cost", "conversions"))
    paid = paid.withColumn("score", F.when(F.col("cost_per_conversion") > 0, 1000 / F.col("cost_per_conversion")))
    all_ = web.unionByName(first, allowMissingColumns=True).unionByName(paid, allowMissingColumns=True)
    return all_.withColumn("effectiveness_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("score", 9)), "source_type", "channel"))).na.fill(0)
