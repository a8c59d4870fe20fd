"""Bronze to silver: web logs, customers, orders and advertising."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import bands, ladder, latest, ratio, rounded
from tidemark.sources.schemas import ITEMS

SKIN_TYPES = ["Normal", "Sec", "Mixte", "Gras", "Sensible", "Mature"]
CATEGORY_OF_EVENT = {"navigation": ["page_view", "scroll", "exit"], "product": ["product_view", "add_to_cart", "remove_from_cart"], "conversion": ["begin_checkout", "purchase"], "search": ["search", "filter_products"]}


def event_category(event_type):
    return ladder([(event_type.isin(v), k) for k, v in CATEGORY_OF_EVENT.items()], "other")


def clean_web_logs(raw: DataFrame) -> DataFrame:
    """Flat silver rows of parsed web logs; the same for batch and stream. Rows without a required field go."""
    ts = F.coalesce(F.try_to_timestamp("timestamp"), F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    rows = raw.dropna(subset=["event_id", "event_type", "timestamp", "session_id"]).withColumn("event_timestamp", ts)
    url = F.coalesce(F.col("product.url"), F.col("page.url"))
    return rows.select(
        "event_id", "event_type", event_category(F.col("event_type")).alias("event_category"), "event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd").alias("date"), "session_id",
        F.col("user.user_id").alias("user_id"), F.coalesce("user.authenticated", F.lit(False)).alias("is_authenticated"), F.col("user.email").alias("user_email"), F.col("user.user_segment").alias("user_segment"),
        F.col("device.type").alias("device_type"), F.col("device.browser").alias("browser"), F.col("device.is_mobile").alias("is_mobile"), F.col("location.country").alias("country"), F.col("location.city").alias("city"),
        F.col("location.region").alias("region"), F.col("marketing.source").alias("utm_source"), F.col("marketing.medium").alias("utm_medium"), F.col("marketing.campaign").alias("utm_campaign"),
        F.col("marketing.campaign_id").alias("campaign_id"), url.alias("page_url"), F.col("page.referrer").alias("referrer"), F.col("page.visit_duration").alias("visit_duration"),
        F.year("event_timestamp").alias("year"), F.month("event_timestamp").alias("month"), F.dayofmonth("event_timestamp").alias("day"),
    )


def pipe_list(column: str):
    """The non-empty parts of a pipe-separated list; null stays null."""
    return F.filter(F.split(F.col(column), r"\|"), lambda x: F.trim(x) != "")


def customer_stage(orders):
    return ladder([(orders.isNull() | (orders == 0), "Prospect"), (orders == 1, "Nouveau client"), (orders <= 5, "Client régulier")], "Client fidèle")


def value_segment(value):
    return ladder([(value > 150000, "Premium"), (value >= 50000, "High"), (value >= 10000, "Medium"), (value > 0, "Low")], "No purchase")


def clean_customers(raw: DataFrame, as_of: date, order: list | None = None) -> DataFrame:
    """One row for each customer_id, the latest; order: what makes a row later, by default the name of the source file, which holds
    its date, where it is known, then more orders."""
    by_file = [F.desc_nulls_last("source_file")] if "source_file" in raw.columns else []
    one = latest(raw, ["customer_id"], *(order or [*by_file, F.desc_nulls_last("total_orders"), F.desc_nulls_last("lifetime_value")]))
    out = one.withColumns({"email": F.lower(F.trim("email")), "customer_tenure_days": F.coalesce(F.date_diff(F.lit(as_of), "registration_date"), F.lit(0)), "lifecycle_stage": customer_stage(F.col("total_orders")), "value_segment": value_segment(F.col("lifetime_value")), "year": F.year("registration_date"), "month": F.month("registration_date"), "day": F.dayofmonth("registration_date")})
    for c in ("skin_concerns", "preferred_ingredients", "allergies"):
        if c in raw.columns:
            out = out.withColumn(f"{c}_array", pipe_list(c))
    return out.withColumn("skin_type", F.when(F.col("skin_type").isin(SKIN_TYPES), F.col("skin_type")).otherwise("Non spécifié")) if "skin_type" in raw.columns else out


def clean_orders(raw: DataFrame) -> DataFrame:
    one = latest(raw.dropna(subset=["order_id", "customer_id"]), ["order_id"], F.desc_nulls_last("order_date"), F.desc_nulls_last("final_total"))
    items = F.from_json("items", ITEMS, {"allowSingleQuotes": "true"})
    return one.withColumns({
        "items_array": items, "item_count": F.coalesce(F.size(items), F.lit(0)), "estimated_margin": F.col("final_total") * 0.5,
        "has_marketing_attribution": F.col("utm_source").isNotNull() | F.col("utm_medium").isNotNull() | F.col("utm_campaign").isNotNull(),
        "has_promotion": F.col("discount_code").isNotNull() & (F.coalesce("discount_amount", F.lit(0.0)) > 0),
        "order_year": F.year("order_date"), "order_month": F.month("order_date"), "order_day": F.dayofmonth("order_date"),
    })


def explode_items(orders: DataFrame) -> DataFrame:
    keep = [c for c in ("order_id", "customer_id", "order_date", "order_status", "utm_source", "utm_medium", "utm_campaign", "season", "order_year", "order_month", "order_day") if c in orders.columns]
    return orders.filter(F.size("items_array") > 0).select(*keep, F.inline("items_array"))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({"ad_date": F.to_date("date"), "ad_year": F.year(F.to_date("date")), "ad_month": F.month(F.to_date("date"))})


def clean_google_ads(raw: DataFrame) -> DataFrame:
    one = latest(_dated(raw), ["date", "campaign_id", "ad_type"], F.desc_nulls_last("impressions"), F.desc_nulls_last("cost"))
    cpc = F.coalesce(ratio("cost", "clicks"), F.col("avg_cpc"))
    return one.withColumns({"roas": rounded(ratio("conversion_value", "cost", 0.0), 2), "cpa": rounded(ratio("cost", "conversions"), 2), "cpc": rounded(cpc, 2)})


def clean_social_ads(raw: DataFrame) -> DataFrame:
    return clean_google_ads(raw).withColumn("engagement_rate", rounded(ratio("engagements", "impressions"), 4))


def clean_influencer(raw: DataFrame) -> DataFrame:
    one = latest(_dated(raw), ["date", "campaign_id", "influencer_id"], F.desc_nulls_last("impressions"), F.desc_nulls_last("fee"))
    one = one.withColumn("daily_cost", ratio("fee", "duration"))
    return one.withColumns({"roi": F.when(F.col("fee") > 0, (F.col("conversion_value") - F.col("fee")) / F.col("fee")).otherwise(0.0), "cpa": ratio("daily_cost", "conversions"), "cpc": ratio("daily_cost", "clicks")})


def platform_category(p):
    return ladder([(p.isin("Facebook", "Instagram", "TikTok", "WhatsApp"), "Social Media"), (p == "Google", "Search"), (p.startswith("Influencer"), "Influencer")], "Other")


def clean_all_platforms(raw: DataFrame) -> DataFrame:
    """raw has ad_date. ad_type, where it exists, is part of the key, so no spend is lost."""
    keys = ["ad_date", "platform", "campaign_id"] + (["ad_type"] if "ad_type" in raw.columns else [])
    one = latest(raw, keys, F.desc_nulls_last("impressions"), F.desc_nulls_last("cost"))
    return one.withColumns({"roas": rounded(ratio("conversion_value", "cost", 0.0), 2), "cpa": rounded(ratio("cost", "conversions"), 2), "cpc": rounded(ratio("cost", "clicks"), 2), "ctr": rounded(ratio("clicks", "impressions"), 4), "platform_category": platform_category(F.col("platform")), "ad_year": F.year("ad_date"), "ad_month": F.month("ad_date")})


def cross_platform_metrics(ads: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(f"total_{c}") for c in ("impressions", "clicks", "cost", "conversions", "conversion_value")]
    per = ads.groupBy("platform").agg(*sums, *[F.avg(c).alias(f"avg_{c}") for c in ("ctr", "cpc", "cpa")])
    return per.withColumns({"roi": F.when(F.col("total_cost") > 0, (F.col("total_conversion_value") - F.col("total_cost")) / F.col("total_cost")).otherwise(0.0), "conversion_rate": ratio("total_conversions", "total_clicks", 0.0)})


def recency_band(days):
    return ladder([(days <= 30, "Active (< 30 days)"), (days <= 90, "Recent (30-90 days)"), (days <= 180, "Engaged (90-180 days)"), (days <= 365, "At Risk (180-365 days)")], "Inactive (> 365 days)")


def frequency_band(n):
    return bands(n, [(10, "Very Frequent (10+ orders)"), (5, "Frequent (5-9 orders)"), (2, "Repeat (2-4 orders)"), (1, "One-time")], "No Purchase")


def monetary_band(x):
    return ladder([(x >= 150000, "High Value (150K+ CFA)"), (x >= 50000, "Mid Value (50K-150K CFA)"), (x > 0, "Low Value (< 50K CFA)")], "No Spend")
