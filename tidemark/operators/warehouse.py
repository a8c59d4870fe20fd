"""Star-schema tables shaped from gold tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import ladder, mapped

# fixed values: names and groups of the reports
CATEGORY_NAMES = {"soin_visage": "Facial Care", "soin_corps": "Body Care", "soin_cheveux": "Hair Care", "maquillage": "Make-up", "parfum": "Fragrance"}
CATEGORY_GROUPS = {"soin_visage": "Skin", "soin_corps": "Skin", "soin_cheveux": "Hair", "maquillage": "Color", "parfum": "Scent"}
MEDIUM_GROUPS = {"cpc": "Paid Search", "social": "Social Media", "email": "Email", "organic": "Organic", "referral": "Referral", "affiliate": "Affiliate"}
DEFAULTS = {"time_period": "monthly", "attribution_model": "last_touch"}

#: fact -> (surrogate key's parts, columns)
FACTS = {
    "FACT_CHANNEL_PERFORMANCE": (["time_period", "attribution_model", "utm_source", "utm_medium", "utm_campaign"], "conversions revenue unique_orders unique_users cost impressions clicks roas roi cpa cpc conversion_rate roi_rank roas_rank revenue_rank conversion_rank performance_score performance_tier"),
    "FACT_MARKETING_TRENDS": (["trend_period", "attribution_model", "utm_source", "utm_medium", "utm_campaign"], "current_start current_end previous_start previous_end current_conversions current_revenue previous_conversions previous_revenue conversions_change conversions_growth revenue_change revenue_growth trend"),
    "FACT_CHANNEL_COMPARISON": (["attribution_model", "utm_source", "utm_medium"], "conversions revenue cost revenue_share conversions_share cost_share efficiency_index"),
    "FACT_PRODUCT_PERFORMANCE": (["time_period", "category", "product_name"], "total_revenue total_quantity order_count customer_count category_revenue_rank category_quantity_rank overall_revenue_rank overall_quantity_rank is_top_revenue is_top_quantity is_overall_top"),
    "FACT_PRODUCT_TRENDS": (["category", "product_name"], "current_revenue current_quantity current_orders previous_revenue previous_quantity previous_orders revenue_change revenue_growth quantity_change quantity_growth orders_change orders_growth trend"),
    "FACT_CATEGORY_PERFORMANCE": (["time_period", "category"], "category_orders category_quantity category_revenue product_count revenue_percent quantity_percent category_rank"),
    "FACT_PRODUCT_CONVERSION": (["product"], "category total_views total_purchases order_count view_to_purchase_rate view_to_order_rate category_avg_purchase_rate category_avg_order_rate purchase_rate_vs_category relative_performance"),
    "FACT_CUSTOMER_SEGMENTS": (["customer_id"], "rfm_score rfm_segment primary_category product_affinity_segment lifecycle_stage purchase_frequency_segment customer_value_segment marketing_recommendation preferred_channel_recommendation"),
    "FACT_RFM_SEGMENTS": (["customer_id"], "recency_days frequency monetary recency_score frequency_score monetary_score rfm_score rfm_segment"),
    "FACT_LIFECYCLE_SEGMENTS": (["customer_id"], "recency_days days_since_first frequency monetary lifecycle_stage purchase_frequency_segment value_quartile customer_value_segment"),
    "FACT_CAMPAIGN_PERFORMANCE": (["campaign_name", "platform", "attribution_model", "time_period"], "period_start period_end period_revenue period_cost period_orders period_customers period_impressions period_clicks period_tracked_conversions period_roas period_roi roi_rank revenue_rank roi_class"),
    "FACT_CAMPAIGN_CHANNEL_COMPARISON": (["platform", "time_period", "attribution_model"], "period_start period_end channel_cost channel_revenue channel_impressions channel_clicks channel_orders campaign_count avg_campaign_roi channel_roi channel_ctr channel_cpa channel_conversion_rate roi_rank"),
    "FACT_CAMPAIGN_ROI_TRENDS": (["campaign_name", "platform", "attribution_model"], "period_roi period_revenue period_cost time_period period_start period_end roi_rank_in_channel roi_quality"),
    "FACT_CAMPAIGN_BUDGET_ALLOCATION": (["campaign_name", "platform", "attribution_model"], "period_cost period_revenue period_roi current_budget_share revenue_contribution roi_rank budget_reallocation_factor adjusted_budget suggested_budget_share suggested_budget_change allocation_recommendation"),
}


def fact(df: DataFrame, name: str, as_of: date | None = None) -> DataFrame:
    """The columns of the fact that df has, defaults for a missing period or model, and a key of its parts joined by '_'. as_of: the
    day of the load, written as load and update date."""
    parts, columns = FACTS[name]
    for c in parts:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(DEFAULTS.get(c)).cast("string"))
    if "processing_date" in df.columns:
        df = df.withColumnRenamed("processing_date", "etl_date")
    for c in ("period_start", "period_end", "current_start", "current_end", "previous_start", "previous_end"):
        if c in df.columns:
            df = df.withColumn(c, F.to_date(c))
    key = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in parts])
    have = [c for c in [*parts, *columns.split(), "etl_date"] if c in df.columns]
    out = df.select(key.alias(f"{name.removeprefix('FACT_').lower()}_key"), *have)
    return out if as_of is None else out.withColumns({"dw_load_ts": F.lit(as_of), "dw_update_ts": F.lit(as_of)})


def date_dimension(df: DataFrame, column: str) -> DataFrame:
    d = F.col("date")
    return df.select(F.to_date(column).alias("date")).filter("date is not null").distinct().select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.dayofweek(d).alias("day_of_week"), F.weekofyear(d).alias("week_of_year"))


def channel_dimension(df: DataFrame) -> DataFrame:
    s, m = F.col("utm_source"), F.col("utm_medium")
    name = F.when(s.isNull() & m.isNull(), "Unknown").otherwise(F.concat_ws(" - ", s, m))
    return df.select("utm_source", "utm_medium").distinct().select(F.concat_ws("_", F.coalesce(s, F.lit("unknown")), F.coalesce(m, F.lit("unknown"))).alias("channel_key"), "utm_source", "utm_medium", name.alias("channel_name"), mapped(m, MEDIUM_GROUPS, "Other").alias("channel_group"))


def _kind(name, arms: list[tuple[str, str]]):
    return ladder([(name.like(f"%{part}%"), label) for part, label in arms], "General")


def marketing_campaign_dimension(df: DataFrame) -> DataFrame:
    kind = _kind(F.col("utm_campaign"), [("promo", "Promotional"), ("launch", "Product Launch"), ("brand", "Branding"), ("retarg", "Retargeting")])
    return df.select("utm_campaign").filter("utm_campaign is not null").distinct().select(F.col("utm_campaign").alias("campaign_key"), "utm_campaign", kind.alias("campaign_type"))


def campaign_dimension(df: DataFrame) -> DataFrame:
    kind = _kind(F.col("campaign_name"), [("promo", "Promotional"), ("launch", "Product Launch"), ("season", "Seasonal"), ("retarg", "Retargeting"), ("brand", "Branding")])
    return df.select("campaign_name").filter("campaign_name is not null").distinct().select(F.col("campaign_name").alias("campaign_key"), "campaign_name", kind.alias("campaign_type"))


def product_dimension(df: DataFrame) -> DataFrame:
    n = F.col("product_name")
    kind = ladder([(n.like(f"%{k.lower()}%"), k) for k in ("Cleanser", "Cream", "Serum", "Lotion", "Shampoo", "Conditioner")], "Other")
    organic = n.like("%bio%") | n.like("%natural%") | n.like("%organic%")
    return df.select("product_name", "category").distinct().select(F.concat_ws("_", n, "category").alias("product_key"), n, "category", kind.alias("product_type"), organic.alias("is_organic"), mapped(F.col("category"), CATEGORY_NAMES, F.col("category")).alias("category_display"))


def category_dimension(df: DataFrame) -> DataFrame:
    c = F.col("category")
    return df.select(c).distinct().select(c.alias("category_key"), c, mapped(c, CATEGORY_NAMES, c).alias("category_display"), mapped(c, CATEGORY_GROUPS, "Other").alias("category_group"))


def customer_dimension(df: DataFrame) -> DataFrame:
    for c in ("city", "region"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(F.col("customer_id").alias("customer_key"), "customer_id", "city", "region", F.coalesce("region", F.lit("Unknown")).alias("location_group")).distinct()


def platform_dimension(df: DataFrame) -> DataFrame:
    p = F.lower(F.regexp_replace("platform", "_.*$", ""))
    social = p.isin("facebook", "instagram", "tiktok")
    kind = ladder([(p == "google", "Search"), (social | (p == "influencer"), "Social"), (p == "email", "Direct")], "Other")
    group = ladder([(p == "google", "Paid Search"), (social, "Paid Social"), (p == "email", "Email Marketing"), (p == "influencer", "Influencer Marketing")], "Other")
    return df.select("platform").filter("platform is not null").distinct().select(F.col("platform").alias("platform_key"), "platform", kind.alias("platform_type"), group.alias("channel_group"))


# fixed values: the segments of the reports (name, type, description, churn risk, upsell potential)
SEGMENTS = [
    ("Champions", "RFM", "High value customers who bought recently", "High", "High"),
    ("Loyal Customers", "RFM", "Bought recently and regularly", "Medium", "High"),
    ("Potential Loyalists", "RFM", "Recent customers with average frequency", "Medium", "Medium"),
    ("Recent Customers", "RFM", "Bought most recently, but not often", "Low", "Medium"),
    ("Promising", "RFM", "Recent customers with low spend", "Low", "Low"),
    ("Customers Needing Attention", "RFM", "Above average recency and frequency, low spend", "Medium", "Medium"),
    ("At Risk", "RFM", "Below average recency and frequency, any spend", "High", "Low"),
    ("Can't Lose Them", "RFM", "Haven't purchased for some time, but high overall spend", "High", "Low"),
    ("Hibernating", "RFM", "Last purchase was long time ago, low spend", "Medium", "Low"),
    ("Lost", "RFM", "Lowest recency, frequency and value", "Low", "Low"),
    ("New Customer", "Lifecycle", "First purchase within 30 days", "Medium", "High"),
    ("Active Customer", "Lifecycle", "Purchased within 90 days", "Low", "High"),
    ("At-Risk Customer", "Lifecycle", "Not purchased in 91-180 days", "Medium", "Medium"),
    ("Lapsed Customer", "Lifecycle", "Not purchased in 181-365 days", "High", "Medium"),
    ("Lost Customer", "Lifecycle", "Not purchased in >365 days", "High", "Low"),
    ("Facial Care Enthusiast", "Product", "Primary purchases are facial care products", "Low", "Medium"),
    ("Body Care Focused", "Product", "Primary purchases are body care products", "Low", "Medium"),
    ("Hair Care Passionate", "Product", "Primary purchases are hair care products", "Low", "Medium"),
    ("Makeup Aficionado", "Product", "Primary purchases are makeup products", "Low", "Medium"),
    ("Fragrance Collector", "Product", "Primary purchases are fragrance products", "Low", "Medium"),
    ("Mixed Category Shopper", "Product", "No dominant product category preference", "Low", "Low"),
    ("One-Time Buyer", "Frequency", "Made only one purchase", "High", "Medium"),
    ("Occasional Buyer", "Frequency", "Made 2-3 purchases", "Medium", "Medium"),
    ("Regular Buyer", "Frequency", "Made 4-6 purchases", "Low", "Medium"),
    ("Frequent Buyer", "Frequency", "Made more than 6 purchases", "Low", "High"),
    ("Premium Value", "Value", "Top 25% in customer lifetime value", "Low", "High"),
    ("High Value", "Value", "Top 25-50% in customer lifetime value", "Low", "High"),
    ("Medium Value", "Value", "Middle 25-50% in customer lifetime value", "Medium", "Medium"),
    ("Low Value", "Value", "Bottom 25% in customer lifetime value", "High", "Low"),
]


def segment_dimension(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SEGMENTS, "segment_name string, segment_type string, segment_description string, churn_risk string, upsell_potential string")
    return rows.withColumn("segment_key", F.concat_ws("_", "segment_type", "segment_name"))
