"""Web sessions, customer sessions, profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ladder, latest, ratio
from tidemark.operators.cleaning import frequency_band, monetary_band, recency_band

FIRST = ["user_id", "is_authenticated", "user_email", "user_segment", "device_type", "browser", "is_mobile", "country", "city", "region", "utm_source", "utm_medium", "utm_campaign", "campaign_id", "referrer"]


def web_sessions(logs: DataFrame) -> DataFrame:
    """One row for each session_id; attributes are the first event's, by time and then event_id. A session's events are listed in its
    row, so they meet in one task."""
    at = F.struct("event_timestamp", "event_id")
    count = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    events = F.array_sort(F.collect_list(F.struct("event_timestamp", "event_id", "event_type", "page_url")))
    per = logs.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.min("event_timestamp").alias("session_start"), F.max("event_timestamp").alias("session_end"),
        *[F.min_by(c, at).alias(c) for c in FIRST if c in logs.columns],
        events.alias("events"), F.count("*").alias("event_count"),
        count("page_view").alias("page_view_count"), count("product_view").alias("product_view_count"), count("add_to_cart").alias("add_to_cart_count"), count("begin_checkout").alias("checkout_count"), count("purchase").alias("purchase_count"),
    )
    listed = ["event_count", "page_view_count", "product_view_count", "add_to_cart_count", "checkout_count", "purchase_count"]
    lists = [F.col("events.event_type").alias("event_types"), F.filter("events.page_url", lambda x: x.isNotNull()).alias("pages_viewed")]
    per = per.select(*[c for c in per.columns if c not in ("events", *listed)], *lists, *listed)
    return per.withColumns({
        "date": F.to_date("session_start"), "session_duration_seconds": F.unix_timestamp("session_end") - F.unix_timestamp("session_start"), "is_bounce": F.col("event_count") == 1,
        "conversion_session": F.col("purchase_count") > 0, "session_source": F.coalesce("utm_source", "utm_medium", "utm_campaign", F.lit("direct")),
        "session_year": F.year("session_start"), "session_month": F.month("session_start"), "session_day": F.dayofmonth("session_start"),
    })


def inactivity_sessions(logs: DataFrame, key: str = "user_id", minutes: int = 30) -> DataFrame:
    """Sessions of logs without a session_id: a gap of `minutes` or more begins a new one."""
    w = Window.partitionBy(key).orderBy("event_timestamp", "event_id")
    gap = F.unix_micros("event_timestamp") - F.unix_micros(F.lag("event_timestamp").over(w))
    numbered = logs.withColumn("new", F.when(gap.isNull() | (gap >= minutes * 60_000_000), 1).otherwise(0)).withColumn("session_no", F.sum("new").over(w))
    return numbered.groupBy(key, "session_no").agg(F.min("event_timestamp").alias("session_start"), F.max("event_timestamp").alias("session_end"), F.count("*").alias("event_count"))


def event_counts(logs: DataFrame, window: str = "1 day") -> DataFrame:
    """Tumbling-window counts by event type, for batch and stream."""
    return logs.groupBy(F.window("event_timestamp", window), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "events")


def customer_sessions(sessions: DataFrame, customers: DataFrame) -> DataFrame:
    """Authenticated sessions with their customer by normalised email; one customer for each email, the one with most orders."""
    email = F.lower(F.trim("email"))
    keyed = latest(customers.withColumn("normalized_email", email), ["normalized_email"], F.desc_nulls_last("total_orders"), F.asc("customer_id"))
    crm = keyed.select("normalized_email", "customer_id", F.col("first_name").alias("crm_first_name"), F.col("email").alias("crm_email"), "total_orders", "lifetime_value")
    known = sessions.filter(F.col("is_authenticated") & F.col("user_id").isNotNull()).withColumn("normalized_email", F.lower(F.trim("user_email")))
    return known.join(crm, "normalized_email", "left").withColumn("customer_match", F.col("crm_email").isNotNull())


def order_metrics(orders: DataFrame, as_of: date) -> DataFrame:
    per = orders.groupBy("customer_id").agg(
        F.count("*").alias("order_count"), F.sum("final_total").alias("total_spent"), F.avg("final_total").alias("avg_order_value"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"),
        F.count_if("has_promotion").alias("promo_orders"), F.count_if(F.col("utm_source").isNotNull()).alias("attributed_orders"), F.array_sort(F.collect_set("payment_method")).alias("payment_methods"),
    )
    since = lambda c: F.date_diff(F.lit(as_of), c)
    per = per.withColumns({"days_since_first_order": since("first_order_date"), "days_since_last_order": since("last_order_date"), "promo_sensitivity": F.col("promo_orders") / F.col("order_count")})
    return per.withColumn("avg_order_frequency_days", ratio("days_since_first_order", F.col("order_count") - 1))


def category_preference(items: DataFrame, orders: DataFrame) -> DataFrame:
    """(customer_id, primary_category, primary_percent, secondary_category, secondary_percent) by spend; ties by category."""
    per = items.select("order_id", "category", "item_total").join(orders.select("order_id", "customer_id"), "order_id").groupBy("customer_id", "category").agg(F.sum("item_total").alias("spend"))
    w = Window.partitionBy("customer_id")
    ranked = per.withColumns({"percent": F.col("spend") / F.sum("spend").over(w) * 100, "rank": F.row_number().over(w.orderBy(F.desc("spend"), "category"))}).filter("rank <= 2")
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return ranked.groupBy("customer_id").agg(at(1, "category").alias("primary_category"), at(1, "percent").alias("primary_percent"), at(2, "category").alias("secondary_category"), at(2, "percent").alias("secondary_percent"))


def threshold_segments(metrics: DataFrame) -> DataFrame:
    """Recency, frequency, monetary and combined segments, and the profile's lifecycle stage."""
    days, n = F.col("days_since_last_order"), F.coalesce("order_count", F.lit(0))
    out = metrics.withColumns({"order_count": n, "recency_segment": recency_band(days), "frequency_segment": frequency_band(n), "monetary_segment": monetary_band(F.coalesce("total_spent", F.lit(0.0)))})
    r, f, m = F.col("recency_segment"), F.col("frequency_segment"), F.col("monetary_segment")
    active, recent, n = r.startswith("Active"), r.startswith("Recent"), F.col("order_count")
    combined = ladder([
        (active & (n >= 5) & (m.startswith("High") | m.startswith("Mid")), "Champions"), ((active | recent) & (n >= 5), "Loyal Customers"), (active & (f == "One-time"), "New Customers"),
        (r.startswith("At Risk") & (n >= 5), "At Risk"), (r.startswith("Inactive"), "Lost Customers"), ((active | recent) & f.startswith("Repeat"), "Potential Loyalists"),
    ], "Customers Needing Attention")
    stage = ladder([
        (n == 0, "Lead"), ((n == 1) & (F.col("days_since_last_order") <= 30), "New Customer"), ((active | recent) & (n > 1), "Active Customer"), (r.startswith("Engaged"), "At-Risk Customer"),
        (r.startswith("At Risk"), "Lapsed Customer"), (r.startswith("Inactive"), "Lost Customer"),
    ], "Unknown")
    return out.withColumns({"customer_segment": combined, "profile_lifecycle_stage": stage})


def enriched_profiles(customers: DataFrame, orders: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    joined = customers.join(order_metrics(orders, as_of), "customer_id", "left").join(category_preference(items, orders), "customer_id", "left")
    return threshold_segments(joined)
