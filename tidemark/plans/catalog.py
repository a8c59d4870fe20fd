"""Registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.functions.steps import materialize, settled
from tidemark.operators import acquisition, attribution, cleaning, data_quality, forecast, marketing, products, segments, sessions, warehouse
from tidemark.plans import gold
from tidemark.plans.gold import Silver
from tidemark.plans.oracles import spans, with_tables
from tidemark.sources import adapters

ORDERS_AS_OF, EVENTS_AS_OF = date(2001, 7, 15), date(2024, 1, 28)
O, E = f"{ORDERS_AS_OF}", f"{EVENTS_AS_OF}"
PERIODS = ["weekly", "monthly", "quarterly", "yearly"]
P = " ".join(PERIODS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select([exprs.rounded(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, tables: str = "", sql: str = "", doubles: str = "", digits: int = 4):
    def register(f: Callable[[Silver], DataFrame]):
        QUERIES[name] = lambda spark, d: rounded(f(Silver.of_tables(spark, d)), digits)
        if sql:
            ORACLES[name] = with_tables(tables, sql, doubles, digits)
        return f

    return register


def trips(s: Silver) -> DataFrame:
    return attribution.journeys(s.web, s.web_orders)


def attributed(s: Silver) -> DataFrame:
    return attribution.attribution_models(trips(s))


STAGE = "CASE WHEN total_orders = 0 THEN 'Prospect' WHEN total_orders = 1 THEN 'Nouveau client' WHEN total_orders <= 5 THEN 'Client régulier' ELSE 'Client fidèle' END"
VALUE = "CASE WHEN lifetime_value > 150000 THEN 'Premium' WHEN lifetime_value >= 50000 THEN 'High' WHEN lifetime_value >= 10000 THEN 'Medium' WHEN lifetime_value > 0 THEN 'Low' ELSE 'No purchase' END"


@query("sv1_clean_customers", "cust", f"SELECT *, year(registration_date)::INT AS year, month(registration_date)::INT AS month, day(registration_date)::INT AS day, coalesce(date_diff('day', registration_date, DATE '{O}'), 0) AS customer_tenure_days, {STAGE} AS lifecycle_stage, {VALUE} AS value_segment FROM cust", "lifetime_value", 2)
def _(s):
    return cleaning.clean_customers(s.customers, ORDERS_AS_OF)


def raw_query(name: str, tables: str, sql: str, doubles: str = "", digits: int = 3):
    """A query over a raw dataset: the function gets the session and the folder of the tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        ORACLES[name] = with_tables(tables, sql, doubles, digits)
        return f

    return register


RAW_CAMPAIGN = "(['ramadan_2025', 'tabaski_promo', 'beaute_naturelle', 'lancement_produit'])[order_id % 20 % 4 + 1] || '_' || (['google', 'facebook', 'instagram', 'tiktok', 'influencer'])[order_id % 20 % 5 + 1]"


@raw_query("sv2_clean_orders", "ord items", f"""SELECT * EXCLUDE (has_promotion, n), CASE WHEN order_id % 5 < 2 THEN 'PROMO' END AS discount_code, (order_id % 3)::DOUBLE AS discount_amount, NULL::VARCHAR AS utm_medium, CASE WHEN order_id % 11 = 0 THEN {RAW_CAMPAIGN} END AS utm_campaign,
  coalesce(n, 0)::INT AS item_count, final_total * 0.5 AS estimated_margin, utm_source IS NOT NULL OR order_id % 11 = 0 AS has_marketing_attribution, order_id % 5 < 2 AND order_id % 3 > 0 AS has_promotion, year(order_date)::INT AS order_year, month(order_date)::INT AS order_month, day(order_date)::INT AS order_day
  FROM ord LEFT JOIN (SELECT order_id, count(*) AS n FROM items GROUP BY 1) USING (order_id)""", "final_total estimated_margin", 2)
def _(spark, d):
    return cleaning.clean_orders(adapters.raw_orders(spark, d)).drop("items", "items_array")  # lists without an order


@raw_query("sv3_order_items", "ord items", f"""SELECT order_id, customer_id, order_date, order_status, utm_source, NULL::VARCHAR AS utm_medium, CASE WHEN order_id % 11 = 0 THEN {RAW_CAMPAIGN} END AS utm_campaign, season, year(order_date)::INT AS order_year, month(order_date)::INT AS order_month, day(order_date)::INT AS order_day,
  product_name, category, item_total / quantity AS price, quantity::INT AS quantity, item_total FROM items JOIN ord USING (order_id)""", "price item_total", 2)
def _(spark, d):
    return cleaning.explode_items(cleaning.clean_orders(adapters.raw_orders(spark, d)))


def ads_sql(places: str) -> str:
    return f"""SELECT ts::DATE::VARCHAR AS date, (['Google', 'Facebook', 'Instagram', 'TikTok', 'Influencer_YouTube'])[k % 5 + 1] AS platform, 'C' || (k % 20) AS campaign_id, 'I' || (k % 20 % 3) AS influencer_id, CASE WHEN hour(ts) < 12 THEN 'Search' ELSE 'Display' END AS ad_type, 100 * count(*) AS impressions,
  10 * count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS conversions, 3 * count(*) FILTER (event_type = 'view') AS engagements, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS cost, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS conversion_value,
  0.7::DOUBLE AS avg_cpc, ts::DATE AS ad_date, year(ts::DATE)::INT AS ad_year, month(ts::DATE)::INT AS ad_month FROM ev WHERE k % 5 IN ({places}) GROUP BY ALL"""


RATES = "round((CASE WHEN cost > 0 THEN conversion_value / cost ELSE 0 END)::DECIMAL(28, 9), 2)::DOUBLE AS roas, round((CASE WHEN conversions > 0 THEN cost / conversions END)::DECIMAL(28, 9), 2)::DOUBLE AS cpa, round((CASE WHEN clicks > 0 THEN cost / clicks ELSE avg_cpc END)::DECIMAL(28, 9), 2)::DOUBLE AS cpc"


@raw_query("sv4_clean_google_ads", "ev", f"SELECT *, {RATES} FROM ({ads_sql('0')})", "cost conversion_value roas cpa cpc avg_cpc", 2)
def _(spark, d):
    return cleaning.clean_google_ads(adapters.raw_ads(spark, d, [0]))


@raw_query("sv5_clean_social_ads", "ev", f"SELECT *, {RATES}, round((engagements / impressions)::DECIMAL(28, 9), 4)::DOUBLE AS engagement_rate FROM ({ads_sql('1, 2, 3')})", "cost conversion_value roas cpa cpc avg_cpc engagement_rate", 4)
def _(spark, d):
    return cleaning.clean_social_ads(adapters.raw_ads(spark, d, [1, 2, 3]))


@raw_query("sv6_clean_influencer", "ev", f"""SELECT * EXCLUDE (ad_type, avg_cpc, cost), cost AS fee, 5 AS duration, cost / 5 AS daily_cost, CASE WHEN cost > 0 THEN (conversion_value - cost) / cost ELSE 0 END AS roi, CASE WHEN conversions > 0 THEN cost / 5 / conversions END AS cpa, CASE WHEN clicks > 0 THEN cost / 5 / clicks END AS cpc
  FROM ({ads_sql('4')}) WHERE ad_type = 'Search'""", "conversion_value fee daily_cost roi cpa cpc", 3)
def _(spark, d):
    return cleaning.clean_influencer(adapters.raw_influencer(spark, d))


@query("sv4_event_categories", "logs", """SELECT CASE WHEN event_type IN ('page_view', 'scroll', 'exit') THEN 'navigation' WHEN event_type IN ('product_view', 'add_to_cart', 'remove_from_cart') THEN 'product' WHEN event_type IN ('begin_checkout', 'purchase') THEN 'conversion' WHEN event_type IN ('search', 'filter_products') THEN 'search' ELSE 'other' END AS event_category, date, count(*) AS events FROM logs GROUP BY 1, 2""")
def _(s):
    return s.logs.groupBy(cleaning.event_category(F.col("event_type")).alias("event_category"), "date").agg(F.count("*").alias("events"))


@query("sv7_clean_all_platforms", "ads", """SELECT *, year(ad_date)::INT AS ad_year, month(ad_date)::INT AS ad_month, CASE WHEN cost > 0 THEN conversion_value / cost ELSE 0 END AS roas, CASE WHEN conversions > 0 THEN cost / conversions END AS cpa, CASE WHEN clicks > 0 THEN cost / clicks END AS cpc, round((clicks / impressions)::DECIMAL(28, 9), 4)::DECIMAL(10, 4) AS ctr,
  CASE WHEN platform IN ('Facebook', 'Instagram', 'TikTok', 'WhatsApp') THEN 'Social Media' WHEN platform = 'Google' THEN 'Search' WHEN platform LIKE 'Influencer%' THEN 'Influencer' ELSE 'Other' END AS platform_category FROM ads""", "cost conversion_value roas cpa cpc", 2)
def _(s):
    return cleaning.clean_all_platforms(s.ads).withColumn("ctr", F.col("ctr").cast("string").cast("decimal(10,4)"))


@query("sv8_cross_platform", "ads", """SELECT platform, sum(impressions)::BIGINT AS total_impressions, sum(clicks)::BIGINT AS total_clicks, sum(cost) AS total_cost, sum(conversions)::BIGINT AS total_conversions, sum(conversion_value) AS total_conversion_value,
  avg(round((clicks / impressions)::DECIMAL(28, 9), 4)::DOUBLE) AS avg_ctr, avg(CASE WHEN clicks > 0 THEN round((cost / clicks)::DECIMAL(28, 9), 2)::DOUBLE END) AS avg_cpc, avg(CASE WHEN conversions > 0 THEN round((cost / conversions)::DECIMAL(28, 9), 2)::DOUBLE END) AS avg_cpa,
  CASE WHEN sum(cost) > 0 THEN (sum(conversion_value) - sum(cost)) / sum(cost) ELSE 0 END AS roi, CASE WHEN sum(clicks) > 0 THEN sum(conversions) / sum(clicks) ELSE 0 END AS conversion_rate FROM ads GROUP BY platform""", "total_cost total_conversion_value avg_ctr avg_cpc avg_cpa roi conversion_rate")
def _(s):
    return cleaning.cross_platform_metrics(cleaning.clean_all_platforms(s.ads))


@query("sv9_web_sessions", "sess", """SELECT *, session_start::DATE AS date, year(session_start)::INT AS session_year, month(session_start)::INT AS session_month, day(session_start)::INT AS session_day,
  epoch(date_trunc('second', session_end))::BIGINT - epoch(date_trunc('second', session_start))::BIGINT AS session_duration_seconds, event_count = 1 AS is_bounce, purchase_count > 0 AS conversion_session, coalesce(utm_source, utm_medium, utm_campaign, 'direct') AS session_source FROM sess""")
def _(s):
    return s.web.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")} | {c: F.array_join(c, ",") for c in ("event_types", "pages_viewed")})


@query("sv10_customer_sessions", "sess cust", "SELECT s.*, lower(trim(user_email)) AS normalized_email, customer_id, first_name AS crm_first_name, email AS crm_email, total_orders, lifetime_value, customer_id IS NOT NULL AS customer_match, coalesce(utm_source, utm_medium, utm_campaign, 'direct') AS session_source, event_count = 1 AS is_bounce, purchase_count > 0 AS conversion_session FROM sess s LEFT JOIN cust ON lower(trim(email)) = lower(trim(user_email)) WHERE is_authenticated AND s.user_id IS NOT NULL", "lifetime_value", 2)
def _(s):
    joined = sessions.customer_sessions(s.web, s.customers).withColumns({"session_start": F.col("session_start").cast("timestamp_ntz"), "session_end": F.col("session_end").cast("timestamp_ntz"), "event_types": F.array_join("event_types", ","), "pages_viewed": F.array_join("pages_viewed", ",")})
    return joined.drop("date", "session_duration_seconds", "session_year", "session_month", "session_day")  # sv9 has them


ORDER_METRICS = f"""SELECT customer_id, count(*) AS order_count, sum(final_total) AS total_spent, avg(final_total) AS avg_order_value, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) FILTER (has_promotion) AS promo_orders,
  count(utm_source) AS attributed_orders, string_agg(DISTINCT payment_method, ',' ORDER BY payment_method) AS payment_methods, date_diff('day', min(order_date), DATE '{O}') AS days_since_first_order, date_diff('day', max(order_date), DATE '{O}') AS days_since_last_order,
  count(*) FILTER (has_promotion) / count(*) AS promo_sensitivity, CASE WHEN count(*) > 1 THEN date_diff('day', min(order_date), DATE '{O}') / (count(*) - 1) END AS avg_order_frequency_days FROM ord GROUP BY customer_id"""


@query("sv12_order_metrics", "ord", ORDER_METRICS, "total_spent avg_order_value promo_sensitivity avg_order_frequency_days", 2)
def _(s):
    return sessions.order_metrics(s.orders, ORDERS_AS_OF).withColumn("payment_methods", F.array_join("payment_methods", ","))


PREF = """pref AS (SELECT customer_id, max(category) FILTER (r = 1) AS primary_category, max(pc) FILTER (r = 1) AS primary_percent, max(category) FILTER (r = 2) AS secondary_category, max(pc) FILTER (r = 2) AS secondary_percent FROM
  (SELECT customer_id, category, sp / sum(sp) OVER (PARTITION BY customer_id) * 100 AS pc, row_number() OVER (PARTITION BY customer_id ORDER BY sp DESC, category) AS r FROM (SELECT customer_id, category, sum(item_total) AS sp FROM items JOIN ord USING (order_id) GROUP BY 1, 2)) GROUP BY customer_id)"""


@query("sv13_category_preference", "items ord", f"WITH {PREF}\nMAIN SELECT * FROM pref", "primary_percent secondary_percent")
def _(s):
    return sessions.category_preference(s.items, s.orders)


PROFILES = f"""m AS (SELECT customer_id, count(*) AS n, sum(final_total) AS spent, date_diff('day', max(order_date), DATE '{O}') AS days FROM ord GROUP BY 1),
x AS (SELECT c.customer_id, primary_category, secondary_category, coalesce(n, 0) AS order_count, days,
  CASE WHEN days <= 30 THEN 'Active (< 30 days)' WHEN days <= 90 THEN 'Recent (30-90 days)' WHEN days <= 180 THEN 'Engaged (90-180 days)' WHEN days <= 365 THEN 'At Risk (180-365 days)' ELSE 'Inactive (> 365 days)' END AS recency_segment,
  CASE WHEN coalesce(n, 0) >= 10 THEN 'Very Frequent (10+ orders)' WHEN n >= 5 THEN 'Frequent (5-9 orders)' WHEN n >= 2 THEN 'Repeat (2-4 orders)' WHEN n = 1 THEN 'One-time' ELSE 'No Purchase' END AS frequency_segment,
  CASE WHEN spent >= 150000 THEN 'High Value (150K+ CFA)' WHEN spent >= 50000 THEN 'Mid Value (50K-150K CFA)' WHEN spent > 0 THEN 'Low Value (< 50K CFA)' ELSE 'No Spend' END AS monetary_segment FROM cust c LEFT JOIN m USING (customer_id) LEFT JOIN pref USING (customer_id))"""
STAGES_SQL = f"""WITH {PROFILES} SELECT CASE WHEN order_count = 0 THEN 'Lead' WHEN order_count = 1 AND days <= 30 THEN 'New Customer' WHEN (recency_segment LIKE 'Active%' OR recency_segment LIKE 'Recent%') AND order_count > 1 THEN 'Active Customer' WHEN recency_segment LIKE 'Engaged%' THEN 'At-Risk Customer' WHEN recency_segment LIKE 'At Risk%' THEN 'Lapsed Customer' WHEN recency_segment LIKE 'Inactive%' THEN 'Lost Customer' ELSE 'Unknown' END AS profile_lifecycle_stage FROM x"""


@query("sv16_enriched_profiles", "cust ord items", f"""WITH {PREF}, m AS (SELECT customer_id, count(*) AS n, sum(final_total) AS spent, date_diff('day', max(order_date), DATE '{O}') AS days FROM ord GROUP BY 1),
x AS (SELECT c.customer_id, primary_category, secondary_category, coalesce(n, 0) AS order_count, days,
  CASE WHEN days <= 30 THEN 'Active (< 30 days)' WHEN days <= 90 THEN 'Recent (30-90 days)' WHEN days <= 180 THEN 'Engaged (90-180 days)' WHEN days <= 365 THEN 'At Risk (180-365 days)' ELSE 'Inactive (> 365 days)' END AS recency_segment,
  CASE WHEN coalesce(n, 0) >= 10 THEN 'Very Frequent (10+ orders)' WHEN n >= 5 THEN 'Frequent (5-9 orders)' WHEN n >= 2 THEN 'Repeat (2-4 orders)' WHEN n = 1 THEN 'One-time' ELSE 'No Purchase' END AS frequency_segment,
  CASE WHEN spent >= 150000 THEN 'High Value (150K+ CFA)' WHEN spent >= 50000 THEN 'Mid Value (50K-150K CFA)' WHEN spent > 0 THEN 'Low Value (< 50K CFA)' ELSE 'No Spend' END AS monetary_segment FROM cust c LEFT JOIN m USING (customer_id) LEFT JOIN pref USING (customer_id)),
y AS (SELECT * EXCLUDE (days), CASE WHEN recency_segment LIKE 'Active%' AND order_count >= 5 AND (monetary_segment LIKE 'High%' OR monetary_segment LIKE 'Mid%') THEN 'Champions' WHEN (recency_segment LIKE 'Active%' OR recency_segment LIKE 'Recent%') AND order_count >= 5 THEN 'Loyal Customers'
  WHEN recency_segment LIKE 'Active%' AND frequency_segment = 'One-time' THEN 'New Customers' WHEN recency_segment LIKE 'At Risk%' AND order_count >= 5 THEN 'At Risk' WHEN recency_segment LIKE 'Inactive%' THEN 'Lost Customers' WHEN (recency_segment LIKE 'Active%' OR recency_segment LIKE 'Recent%') AND frequency_segment LIKE 'Repeat%' THEN 'Potential Loyalists' ELSE 'Customers Needing Attention' END AS customer_segment,
  CASE WHEN order_count = 0 THEN 'Lead' WHEN order_count = 1 AND days <= 30 THEN 'New Customer' WHEN (recency_segment LIKE 'Active%' OR recency_segment LIKE 'Recent%') AND order_count > 1 THEN 'Active Customer' WHEN recency_segment LIKE 'Engaged%' THEN 'At-Risk Customer' WHEN recency_segment LIKE 'At Risk%' THEN 'Lapsed Customer' WHEN recency_segment LIKE 'Inactive%' THEN 'Lost Customer' ELSE 'Unknown' END AS profile_lifecycle_stage FROM x)
MAIN SELECT y.*, c.* EXCLUDE (customer_id), o.* EXCLUDE (customer_id, order_count), primary_percent, secondary_percent FROM y JOIN cust c USING (customer_id) LEFT JOIN ({ORDER_METRICS}) o USING (customer_id) LEFT JOIN pref USING (customer_id)""", "lifetime_value total_spent avg_order_value promo_sensitivity avg_order_frequency_days primary_percent secondary_percent", 2)
def _(s):
    return sessions.enriched_profiles(s.customers, s.orders, s.items, ORDERS_AS_OF).withColumn("payment_methods", F.array_join("payment_methods", ","))


@query("sv17_journeys", "pairs", "SELECT order_id, user_id, order_date, order_value, min(session_start) AS first_touch, max(session_start) AS last_touch, count(*) AS touchpoint_count, min(d)::INT AS min_days, max(d)::INT AS max_days, string_agg(session_id, ',' ORDER BY session_start, session_id) AS touchpoints FROM pairs GROUP BY 1, 2, 3, 4", "order_value", 2)
def _(s):
    j = trips(s)
    return j.select("order_id", "user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("order_date", "first_touch", "last_touch")], "order_value", "touchpoint_count", "min_days", "max_days", F.array_join(F.transform("touchpoints", lambda t: t["session_id"]), ",").alias("touchpoints"))


@query("sv22_attribution_models", "att", "SELECT * FROM att", "order_value touchpoint_weight attributed_revenue", 3)
def _(s):
    return attributed(s).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


CHANNEL_PERFORMANCE = """WITH per AS (SELECT attribution_model, utm_source, utm_medium, utm_campaign, campaign_id, count(*) AS conversions, sum(attributed_revenue) AS attributed_revenue, avg(touchpoint_weight) AS avg_touchpoint_weight, count(DISTINCT order_id) AS unique_orders, count(DISTINCT user_id) AS unique_users FROM att GROUP BY ALL),
sp AS (SELECT campaign_id, min(platform) AS platform, min(campaign_name) AS campaign_name, sum(cost) AS total_cost, sum(impressions)::BIGINT AS total_impressions, sum(clicks)::BIGINT AS total_clicks, sum(conversions)::BIGINT AS tracked_conversions FROM ads GROUP BY 1)
SELECT *, CASE WHEN total_cost > 0 THEN (attributed_revenue - total_cost) / total_cost END AS roi, total_cost / conversions AS cpa, CASE WHEN total_clicks > 0 THEN total_cost / total_clicks END AS cost_per_click, CASE WHEN total_clicks > 0 THEN conversions / total_clicks END AS conversion_rate FROM per LEFT JOIN sp USING (campaign_id)"""


@query("sv23_channel_performance", "att ads", f"SELECT * FROM ({CHANNEL_PERFORMANCE})", "attributed_revenue avg_touchpoint_weight total_cost roi cpa cost_per_click conversion_rate", 3)
def _(s):
    return attribution.channel_performance(trips(s), s.ads)


PM = f"""pm AS (SELECT time_period, product_name, category, count(DISTINCT order_id) AS order_count, sum(quantity) AS total_quantity, sum(item_total) AS total_revenue, count(DISTINCT customer_id) AS customer_count
  FROM items JOIN ord USING (order_id), {spans(O, P)} WHERE order_date BETWEEN a AND b GROUP BY 1, 2, 3)"""


def metrics(s: Silver) -> DataFrame:
    return products.product_metrics(s.items, s.orders, ORDERS_AS_OF, PERIODS)


@query("gp1_product_metrics", "items ord", f"WITH {PM}\nMAIN SELECT * FROM pm", "total_quantity total_revenue", 2)
def _(s):
    return metrics(s)


CA = """ca AS (SELECT *, category_revenue / sum(category_revenue) OVER w * 100 AS revenue_percent, category_quantity / sum(category_quantity) OVER w * 100 AS quantity_percent, dense_rank() OVER (PARTITION BY time_period ORDER BY round(category_revenue, 2) DESC)::INT AS category_rank
  FROM (SELECT time_period, category, sum(total_revenue) AS category_revenue, sum(total_quantity) AS category_quantity, sum(order_count)::BIGINT AS category_orders, count(DISTINCT product_name) AS product_count FROM pm GROUP BY 1, 2) WINDOW w AS (PARTITION BY time_period))"""
CA_DOUBLES = "category_revenue category_quantity revenue_percent quantity_percent"


@query("gp2_category_analysis", "items ord", f"WITH {PM}, {CA}\nMAIN SELECT * FROM ca", CA_DOUBLES, 2)
def _(s):
    return products.category_analysis(metrics(s))


PR = """pr AS (SELECT *, category_revenue_rank <= 3 AS is_top_revenue, category_quantity_rank <= 3 AS is_top_quantity, overall_revenue_rank <= 10 AS is_overall_top FROM (SELECT * REPLACE (round(total_revenue, 2) AS total_revenue),
  dense_rank() OVER (PARTITION BY time_period, category ORDER BY round(total_revenue, 2) DESC)::INT AS category_revenue_rank, dense_rank() OVER (PARTITION BY time_period, category ORDER BY total_quantity DESC)::INT AS category_quantity_rank,
  dense_rank() OVER (PARTITION BY time_period ORDER BY round(total_revenue, 2) DESC)::INT AS overall_revenue_rank, dense_rank() OVER (PARTITION BY time_period ORDER BY total_quantity DESC)::INT AS overall_quantity_rank FROM pm))"""


@query("gp3_product_rankings", "items ord", f"WITH {PM}, {PR}\nMAIN SELECT * FROM pr", "total_quantity total_revenue", 2)
def _(s):
    return products.product_rankings(metrics(s))


def grown(label: str) -> str:
    return f"current_{label} - previous_{label} AS {label}_change, CASE WHEN previous_{label} > 0 THEN (current_{label} - previous_{label}) / previous_{label} * 100 WHEN current_{label} > 0 THEN 100 ELSE 0 END AS {label}_growth"


TREND = "CASE WHEN round(revenue_growth, 9) >= 20 THEN 'Strong Growth' WHEN round(revenue_growth, 9) >= 5 THEN 'Growth' WHEN round(revenue_growth, 9) >= -5 THEN 'Stable' WHEN round(revenue_growth, 9) >= -20 THEN 'Decline' ELSE 'Strong Decline' END AS trend"
PT = f"""pt AS (SELECT *, {TREND} FROM (SELECT *, {grown("revenue")}, {grown("quantity")}, {grown("orders")} FROM (SELECT product_name, category,
  coalesce(sum(item_total) FILTER (now), 0) AS current_revenue, coalesce(sum(item_total) FILTER (NOT now), 0) AS previous_revenue, coalesce(sum(quantity) FILTER (now), 0) AS current_quantity, coalesce(sum(quantity) FILTER (NOT now), 0) AS previous_quantity,
  count(DISTINCT order_id) FILTER (now) AS current_orders, count(DISTINCT order_id) FILTER (NOT now) AS previous_orders
  FROM (SELECT *, time_period = 'monthly' AS now FROM items JOIN ord USING (order_id), {spans(O, "monthly prev_month")} WHERE order_date BETWEEN a AND b) GROUP BY 1, 2)))"""
PT_DOUBLES = "current_revenue previous_revenue current_quantity previous_quantity revenue_change revenue_growth quantity_change quantity_growth orders_growth"


@query("gp4_product_trend", "items ord", f"WITH {PT}\nMAIN SELECT * FROM pt", PT_DOUBLES, 2)
def _(s):
    return products.product_trend(s.items, s.orders, ORDERS_AS_OF)


MONTH_NAMES = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
DAY_NAMES = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"
for _id, _by, _part, _name in (
    ("gp5_seasonality_season", "season", "season", ""), ("gp6_seasonality_month", "month", "month(order_date)::INT", f", ({MONTH_NAMES})[month] AS part_name"), ("gp7_seasonality_weekday", "weekday", "(dayofweek(order_date) + 1)::INT", f", ({DAY_NAMES})[weekday] AS part_name"),
):

    @query(_id, "items ord", f"""WITH g AS (SELECT product_name, category, {_part} AS {_by}, sum(item_total) AS revenue, sum(quantity) AS quantity, count(DISTINCT order_id) AS orders FROM items JOIN ord USING (order_id) GROUP BY 1, 2, 3),
h AS (SELECT *, revenue / sum(revenue) OVER w * 100 AS revenue_percent, quantity / sum(quantity) OVER w * 100 AS quantity_percent, orders / sum(orders) OVER w * 100 AS orders_percent, row_number() OVER (PARTITION BY product_name, category ORDER BY round(revenue, 2) DESC, {_by})::INT AS part_rank FROM g WINDOW w AS (PARTITION BY product_name, category))
MAIN SELECT *, part_rank = 1 AS is_peak{_name} FROM h""", "revenue quantity revenue_percent quantity_percent orders_percent", 2)
    def _(s, by=_by):
        return products.seasonality(s.items, s.orders, by)


@query("gp8_product_pairs", "items", """WITH b AS (SELECT DISTINCT order_id, product_name FROM items), n AS (SELECT product_name, count(*) AS n FROM b GROUP BY 1),
q AS (SELECT x.product_name AS product_a, y.product_name AS product_b, count(*) AS pair_orders FROM b x JOIN b y ON x.order_id = y.order_id AND x.product_name <> y.product_name GROUP BY 1, 2),
l AS (SELECT q.*, pair_orders / na.n AS confidence_ab, pair_orders / nb.n AS confidence_ba, pair_orders * (SELECT count(DISTINCT order_id) FROM b) / (na.n * nb.n) AS lift FROM q JOIN n na ON na.product_name = product_a JOIN n nb ON nb.product_name = product_b)
MAIN SELECT *, row_number() OVER (PARTITION BY product_a ORDER BY round(lift, 9) DESC, product_b) AS lift_rank, lift > 2 AS is_strong, row_number() OVER (PARTITION BY product_a ORDER BY round(lift, 9) DESC, product_b) <= 3 AS is_top FROM l""", "confidence_ab confidence_ba lift", 6)
def _(s):
    return products.product_pairs(s.items)


VC = """vc AS (SELECT *, CASE WHEN round(purchase_rate_vs_category, 9) > 0.2 THEN 'Above Average' WHEN round(purchase_rate_vs_category, 9) >= -0.2 THEN 'Average' ELSE 'Below Average' END AS relative_performance FROM
 (SELECT *, CASE WHEN category_avg_purchase_rate > 0 THEN (view_to_purchase_rate - category_avg_purchase_rate) / category_avg_purchase_rate ELSE 0 END AS purchase_rate_vs_category FROM
  (SELECT *, CASE WHEN total_views > 0 THEN total_purchases / total_views ELSE 0 END AS view_to_purchase_rate, CASE WHEN total_views > 0 THEN order_count / total_views ELSE 0 END AS view_to_order_rate FROM
   (SELECT product, category, coalesce(total_views, 0) AS total_views, coalesce(total_purchases, 0) AS total_purchases, coalesce(order_count, 0) AS order_count
    FROM (SELECT regexp_extract(page_url, '/(?:products|produits)/([^/?#]+)', 1) AS product, count(*) AS total_views FROM logs WHERE event_type = 'product_view' GROUP BY 1)
    FULL JOIN (SELECT 'p' || (product_id % 30) AS product, min(category) AS category, sum(quantity) AS total_purchases, count(DISTINCT order_id) AS order_count FROM items GROUP BY 1) USING (product)))
  LEFT JOIN (SELECT category, avg(view_to_purchase_rate) AS category_avg_purchase_rate, avg(view_to_order_rate) AS category_avg_order_rate FROM (SELECT category, CASE WHEN total_views > 0 THEN total_purchases / total_views ELSE 0 END AS view_to_purchase_rate, CASE WHEN total_views > 0 THEN order_count / total_views ELSE 0 END AS view_to_order_rate FROM
   (SELECT product, min(category) AS category, sum(quantity) AS total_purchases, count(DISTINCT order_id) AS order_count FROM (SELECT 'p' || (product_id % 30) AS product, * FROM items) GROUP BY 1) LEFT JOIN (SELECT regexp_extract(page_url, '/products/([^/]+)', 1) AS product, count(*) AS total_views FROM logs WHERE event_type = 'product_view' GROUP BY 1) USING (product)) GROUP BY 1) USING (category)))"""
VC_DOUBLES = "total_purchases view_to_purchase_rate view_to_order_rate category_avg_purchase_rate category_avg_order_rate purchase_rate_vs_category"


def conversion(s: Silver) -> DataFrame:
    """The views' URLs name 20 products p0 to p19; sold products are told by their number modulo 30, so some are never viewed."""
    return products.view_conversion(s.items.withColumn("product", F.concat(F.lit("p"), (F.col("product_id") % 30).cast("string"))), s.logs)


@query("gp9_view_conversion", "items logs", f"WITH {VC}\nMAIN SELECT * FROM vc", VC_DOUBLES, 3)
def _(s):
    return conversion(s)


TOT = f"t AS (SELECT customer_id, date_diff('day', max(order_date), DATE '{O}') AS recency_days, count(*) AS frequency, round(sum(final_total), 2) AS monetary, date_diff('day', min(order_date), DATE '{O}') AS first_days FROM ord GROUP BY 1)"
RFM = f"""{TOT}, q AS (SELECT *, ntile(5) OVER (ORDER BY recency_days, customer_id) AS r, ntile(5) OVER (ORDER BY frequency DESC, customer_id) AS f, ntile(5) OVER (ORDER BY monetary DESC, customer_id) AS m FROM t),
rfm AS (SELECT customer_id, recency_days, frequency, monetary, r AS recency_score, f AS frequency_score, m AS monetary_score, r + f + m AS rfm_score, CASE WHEN r <= 2 AND f <= 2 AND m <= 2 THEN 'Champions' WHEN r <= 2 AND f <= 3 AND m <= 3 THEN 'Loyal Customers' WHEN r <= 3 AND f <= 1 AND m <= 2 THEN 'Potential Loyalists'
 WHEN r <= 2 AND f >= 4 AND m <= 2 THEN 'Recent Customers' WHEN r <= 3 AND f >= 4 AND m >= 4 THEN 'Promising' WHEN r >= 4 AND f <= 2 AND m <= 2 THEN 'Customers Needing Attention' WHEN r >= 4 AND f <= 2 AND m >= 3 THEN 'At Risk' WHEN r >= 4 AND f >= 3 AND m <= 3 THEN 'Can''t Lose Them'
 WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Lost' WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Hibernating' ELSE 'Unknown' END AS rfm_segment FROM q)"""
LIFE = f"""{TOT}, life AS (SELECT customer_id, CASE WHEN frequency = 1 AND first_days <= 30 THEN 'New Customer' WHEN recency_days <= 90 AND frequency > 1 THEN 'Active Customer' WHEN recency_days BETWEEN 91 AND 180 THEN 'At-Risk Customer' WHEN recency_days BETWEEN 181 AND 365 THEN 'Lapsed Customer' WHEN recency_days > 365 THEN 'Lost Customer' ELSE 'Unknown' END AS lifecycle_stage,
 CASE WHEN frequency = 1 THEN 'One-Time Buyer' WHEN frequency <= 3 THEN 'Occasional Buyer' WHEN frequency <= 6 THEN 'Regular Buyer' ELSE 'Frequent Buyer' END AS purchase_frequency_segment, ntile(4) OVER (ORDER BY monetary DESC, customer_id)::INT AS value_quartile, monetary FROM t)"""


@query("gc1_rfm", "ord", f"WITH {RFM}\nMAIN SELECT customer_id, rfm.recency_days, rfm.frequency, rfm.monetary, first_days AS days_since_first, recency_score::INT AS recency_score, frequency_score::INT AS frequency_score, monetary_score::INT AS monetary_score, rfm_score::INT AS rfm_score, rfm_segment FROM rfm JOIN t USING (customer_id)", "monetary", 2)
def _(s):
    return segments.rfm(s.orders, ORDERS_AS_OF)


@query("gc2_product_affinity", "items ord", f"WITH {PREF}\nMAIN SELECT *, CASE primary_category WHEN 'soin_visage' THEN 'Facial Care Enthusiast' WHEN 'soin_corps' THEN 'Body Care Focused' WHEN 'soin_cheveux' THEN 'Hair Care Passionate' WHEN 'maquillage' THEN 'Makeup Aficionado' WHEN 'parfum' THEN 'Fragrance Collector' ELSE 'Mixed Category Shopper' END AS product_affinity_segment FROM pref", "primary_percent secondary_percent")
def _(s):
    return segments.product_affinity(sessions.category_preference(s.items, s.orders))


@query("gc3_lifecycle", "ord", f"WITH {LIFE}\nMAIN SELECT life.*, recency_days, frequency, first_days AS days_since_first, (['Premium Value', 'High Value', 'Medium Value', 'Low Value'])[value_quartile] AS customer_value_segment FROM life JOIN t USING (customer_id)", "monetary", 2)
def _(s):
    return segments.lifecycle(s.orders, ORDERS_AS_OF)


@query("gc4_lifecycle_threshold", "ord", f"WITH {LIFE}\nMAIN SELECT life.* EXCLUDE (value_quartile), recency_days, frequency, first_days AS days_since_first, CASE WHEN life.monetary <= 10000 THEN 'Low Value' WHEN life.monetary <= 50000 THEN 'Medium Value' WHEN life.monetary <= 150000 THEN 'High Value' ELSE 'Premium Value' END AS customer_value_segment FROM life JOIN t USING (customer_id)", "monetary", 2)
def _(s):
    return segments.lifecycle_by_threshold(s.orders, ORDERS_AS_OF)


def kmeans_sql(k: int = 5, rounds: int = 10) -> str:
    """CTEs up to `clustered` (customer_id, cluster): whole numbers all the way, a step a CTE."""
    fs = ["a", "b", "c", "d"]
    total = ", ".join(f"sum({f}::HUGEINT) AS s{f}, sqrt((count(*)::HUGEINT * sum({f}::HUGEINT * {f}) - sum({f}::HUGEINT) * sum({f}::HUGEINT))::DOUBLE / (count(*)::HUGEINT * count(*))::DOUBLE) AS d{f}" for f in fs)
    z = ", ".join(f"floor(({f}::HUGEINT * n - s{f})::DOUBLE / (n * d{f}) * 1000 + 0.5)::BIGINT AS {f}" for f in fs)
    gap = " + ".join(f"(z.{f} - x.{f}) * (z.{f} - x.{f})" for f in fs)
    out = [TOT, "w AS (SELECT customer_id, recency_days * 100 AS a, frequency * 100 AS b, round(monetary * 100)::BIGINT AS c, first_days * 100 AS d FROM t)", f"mo AS (SELECT count(*) AS n, {total} FROM w)",
           f"z AS MATERIALIZED (SELECT customer_id, md5(customer_id::VARCHAR) AS h, {z} FROM w, mo)", f"p0 AS MATERIALIZED (SELECT 0 AS j, {', '.join(fs)} FROM z ORDER BY h, customer_id LIMIT 1)"]
    for j in range(1, k):
        out.append(f"p{j} AS MATERIALIZED (SELECT * FROM p{j - 1} UNION ALL SELECT * FROM (SELECT {j}, {', '.join('z.' + f for f in fs)} FROM z, p{j - 1} x GROUP BY z.customer_id, z.h, {', '.join('z.' + f for f in fs)} ORDER BY min({gap}) DESC, z.h, z.customer_id LIMIT 1))")
    near = lambda centres: f"SELECT z.customer_id, {', '.join(f'any_value(z.{f}) AS {f}' for f in fs)}, arg_min(x.j, ({gap}) * {k} + x.j) AS j FROM z, {centres} x GROUP BY z.customer_id"
    out.append(f"c0 AS MATERIALIZED (SELECT * FROM p{k - 1})")
    for i in range(1, rounds + 1):
        # floor of the mean, also of negative sums
        mean = ", ".join(f"coalesce(m.{f}, c.{f}) AS {f}" for f in fs)
        floors = ", ".join(f"((sum({f}) - ((sum({f}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS {f}" for f in fs)
        out.append(f"c{i} AS MATERIALIZED (SELECT c.j, {mean} FROM c{i - 1} c LEFT JOIN (SELECT j, {floors} FROM ({near(f'c{i - 1}')}) GROUP BY j) m USING (j))")
    return ", ".join([*out, f"clustered AS MATERIALIZED ({near(f'c{rounds}')})"])


@query("gc5_kmeans", "ord", f"""WITH {kmeans_sql()}, stats AS (SELECT j, count(*) AS n, avg(recency_days) AS r, avg(frequency) AS f, avg(monetary) AS m, avg(first_days) AS fd FROM clustered JOIN t USING (customer_id) GROUP BY j)
MAIN SELECT customer_id, recency_days, frequency, monetary, first_days AS days_since_first, j AS cluster, n AS cluster_size, r AS mean_recency_days, f AS mean_frequency, m AS mean_monetary, fd AS mean_days_since_first,
  CASE WHEN r < 30 AND f > 5 AND m > 100000 THEN 'High Value Active' WHEN r < 30 AND f > 3 THEN 'Active Regular' WHEN r > 90 AND f > 3 THEN 'Lapsed High Potential' WHEN f <= 2 THEN 'New or Occasional' ELSE 'Medium Value' END AS cluster_label
FROM clustered JOIN t USING (customer_id) JOIN stats USING (j)""", "monetary mean_recency_days mean_frequency mean_monetary mean_days_since_first", 2)
def _(s):
    return segments.kmeans_clusters(segments.customer_totals(s.orders, ORDERS_AS_OF))


AFFINITY = "CASE WHEN primary_category IS NULL THEN NULL ELSE coalesce(map {'soin_visage': 'Facial Care Enthusiast', 'soin_corps': 'Body Care Focused', 'soin_cheveux': 'Hair Care Passionate', 'maquillage': 'Makeup Aficionado', 'parfum': 'Fragrance Collector'}[primary_category], 'Mixed Category Shopper') END"
COMBINED = f"""combined AS (SELECT c.customer_id, rfm_score::INT AS rfm_score, rfm_segment, primary_category, {AFFINITY} AS product_affinity_segment, lifecycle_stage, purchase_frequency_segment, (['Premium Value', 'High Value', 'Medium Value', 'Low Value'])[value_quartile] AS customer_value_segment, CASE WHEN lifecycle_stage = 'New Customer' THEN 'Welcome Series + Cross-Sell Related Products' WHEN lifecycle_stage = 'Active Customer' AND rfm_segment = 'Champions' THEN 'VIP Program + Early Access to New Products' WHEN lifecycle_stage = 'Active Customer' AND rfm_segment = 'Loyal Customers' THEN 'Loyalty Rewards + Personalized Recommendations'
 WHEN lifecycle_stage = 'At-Risk Customer' THEN 'Re-engagement Campaign + Special Offer' WHEN lifecycle_stage = 'Lapsed Customer' THEN 'Win-Back Campaign + Discount' WHEN lifecycle_stage = 'Lost Customer' THEN 'Reactivation Campaign + Survey' WHEN rfm_segment = 'Potential Loyalists' THEN 'Nurture Campaign + Second Purchase Incentive' WHEN rfm_segment = 'Customers Needing Attention' THEN 'Targeted Content + Product Education'
 WHEN rfm_segment = 'At Risk' THEN 'Special Offer + Personalized Communication' WHEN rfm_segment = 'Can''t Lose Them' THEN 'Deep Discount + Personal Outreach' ELSE 'Standard Marketing Communications' END AS marketing_recommendation,
 CASE WHEN rfm_segment IN ('Champions', 'Loyal Customers', 'Potential Loyalists') THEN 'Direct Email + SMS' WHEN lifecycle_stage IN ('At-Risk Customer', 'Lapsed Customer') THEN 'Retargeting Ads + Email' WHEN value_quartile = 1 THEN 'Personal Outreach + Direct Mail' WHEN value_quartile = 2 THEN 'Email + Social Media Ads' ELSE 'Email + General Advertising' END AS preferred_channel_recommendation
 FROM cust c LEFT JOIN rfm USING (customer_id) LEFT JOIN life USING (customer_id) LEFT JOIN pref USING (customer_id))"""


@query("gc6_combined_segments", "cust ord items", f"WITH {RFM}, {LIFE[len(TOT) + 2:]}, {PREF}, {COMBINED}\nMAIN SELECT * FROM combined")
def _(s):
    return gold.customer_segments(s, ORDERS_AS_OF)["combined_segments"]


GA = """per AS (SELECT customer_id, count(*) AS n, sum(final_total) AS spent FROM ord GROUP BY 1), sp AS (SELECT lower(regexp_replace(platform, '_.*$', '')) AS p, sum(cost) AS ad_cost FROM ads GROUP BY 1),
sm AS (SELECT acquisition_source, count(*) AS total_customers, count(n) AS converting_customers, avg(n) AS avg_orders, avg(spent) AS avg_customer_value, coalesce(sum(spent), 0) AS total_revenue, any_value(ad_cost) AS ad_cost FROM cust LEFT JOIN per USING (customer_id) LEFT JOIN sp ON lower(acquisition_source) = p GROUP BY 1)"""


@query("ga1_source_metrics", "cust ord ads", f"WITH {GA}\nMAIN SELECT *, converting_customers / total_customers * 100 AS conversion_rate, ad_cost / total_customers AS cac, avg_customer_value / (ad_cost / total_customers) AS clv_cac_ratio FROM sm", "avg_orders avg_customer_value total_revenue ad_cost conversion_rate cac clv_cac_ratio", 2)
def _(s):
    return acquisition.source_metrics(s.customers, s.orders, s.ads)


@query("ga3_new_customers", "cust ord ads", f"WITH {GA}, g AS (SELECT time_period, acquisition_source, count(*) AS new_customers FROM cust, {spans(O, P)} WHERE registration_date BETWEEN a AND b GROUP BY 1, 2)\nMAIN SELECT time_period, acquisition_source, new_customers, new_customers / sum(new_customers) OVER (PARTITION BY time_period) * 100 AS acquisition_share, converting_customers / total_customers * 100 AS conversion_rate, ad_cost / total_customers AS cac FROM g LEFT JOIN sm USING (acquisition_source)", "acquisition_share conversion_rate cac", 3)
def _(s):
    return acquisition.new_customers(s.customers, acquisition.source_metrics(s.customers, s.orders, s.ads), ORDERS_AS_OF, PERIODS)


@query("ga4_cohorts", "cust ord", """WITH b AS (SELECT customer_id, date_trunc('month', registration_date)::DATE AS cohort FROM cust WHERE registration_date IS NOT NULL), z AS (SELECT cohort, count(*) AS cohort_size FROM b GROUP BY 1),
a AS (SELECT cohort, date_diff('month', cohort, date_trunc('month', order_date)::DATE)::INT AS months_since, count(DISTINCT customer_id) AS active_customers, sum(final_total) AS revenue FROM ord JOIN b USING (customer_id) WHERE date_trunc('month', order_date) >= cohort GROUP BY 1, 2)
MAIN SELECT *, active_customers / cohort_size * 100 AS retention_rate, revenue / active_customers AS revenue_per_active, monthname(cohort) || ' ' || year(cohort) AS cohort_label FROM a JOIN z USING (cohort)""", "revenue retention_rate revenue_per_active", 2)
def _(s):
    return acquisition.cohorts(s.customers, s.orders)


@query("ga5_first_purchase", "cust ord", """WITH f AS (SELECT customer_id, min(order_date) AS first_date, first(final_total ORDER BY order_date, order_id) AS first_value FROM ord GROUP BY 1)
MAIN SELECT date_trunc('month', registration_date)::DATE AS cohort, count(*) AS customers, count(first_date) AS buyers, avg(date_diff('day', registration_date, first_date)) AS avg_days_to_first, avg(first_value) AS avg_first_value, count(first_date) / count(*) * 100 AS conversion_rate FROM cust LEFT JOIN f USING (customer_id) WHERE registration_date IS NOT NULL GROUP BY 1""", "avg_days_to_first avg_first_value conversion_rate", 3)
def _(s):
    return acquisition.first_purchase_cohorts(s.customers, s.orders)


@query("ga6_ltv", "cust ord", """WITH x AS (SELECT *, date_diff('day', registration_date, order_date) AS d FROM ord JOIN cust USING (customer_id)),
g AS (SELECT acquisition_source, CASE WHEN d < 30 THEN '0-30 days' WHEN d < 90 THEN '31-90 days' WHEN d < 180 THEN '91-180 days' WHEN d < 365 THEN '181-365 days' ELSE '365+ days' END AS tenure_bucket,
  count(DISTINCT customer_id) AS customer_count, sum(final_total) AS total_revenue, avg(final_total) AS avg_order_value, count(order_id) AS order_count FROM x GROUP BY 1, 2)
MAIN SELECT *, order_count / customer_count AS orders_per_customer, total_revenue / customer_count AS revenue_per_customer, list_position(['0-30 days', '31-90 days', '91-180 days', '181-365 days', '365+ days'], tenure_bucket)::INT AS tenure_order FROM g""", "total_revenue avg_order_value orders_per_customer revenue_per_customer", 2)
def _(s):
    return acquisition.ltv_by_tenure(s.customers, s.orders)


@query("ga7_channel_effectiveness", "att ads", """WITH u AS (SELECT 'web' AS source_type, coalesce(utm_source, utm_medium, utm_campaign, 'direct') AS channel, count(*) FILTER (purchase_count > 0) / count(*) * 100 / 10 AS score FROM sess GROUP BY 2
 UNION ALL SELECT 'attribution', coalesce(utm_source, 'direct'), sum(attributed_revenue) / count(*) / 1000 FROM att WHERE attribution_model = 'first_touch' GROUP BY 2 UNION ALL SELECT 'paid', lower(platform), CASE WHEN sum(cost) > 0 AND sum(conversions) > 0 THEN 1000 / (sum(cost) / sum(conversions)) END FROM ads GROUP BY 2)
MAIN SELECT source_type, channel, coalesce(score, 0) AS score, row_number() OVER (ORDER BY round(score, 9) DESC NULLS LAST, source_type, channel)::INT AS effectiveness_rank FROM u""", "score")
def _(s):
    return acquisition.channel_effectiveness(attributed(s), s.web, s.ads).select("source_type", "channel", "score", "effectiveness_rank")


EP = "daily weekly monthly"
CHANNEL = "time_period, attribution_model, utm_source, utm_medium, utm_campaign"
CM = f"""by_c AS (SELECT {CHANNEL}, campaign_id, count(*) AS conversions, sum(attributed_revenue) AS revenue FROM att, {spans(E, EP)} WHERE order_date::DATE BETWEEN a AND b GROUP BY ALL),
uo AS (SELECT {CHANNEL}, count(DISTINCT order_id) AS unique_orders, count(DISTINCT user_id) AS unique_users FROM att, {spans(E, EP)} WHERE order_date::DATE BETWEEN a AND b GROUP BY ALL),
sp AS (SELECT time_period, campaign_id, sum(cost) AS cost, sum(impressions) AS impressions, sum(clicks) AS clicks FROM ads, {spans(E, EP)} WHERE ad_date BETWEEN a AND b GROUP BY 1, 2),
cs AS (SELECT {CHANNEL}, sum(conversions)::BIGINT AS conversions, sum(revenue) AS revenue, sum(cost) AS cost, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks FROM by_c LEFT JOIN sp USING (time_period, campaign_id) GROUP BY ALL),
cm AS (SELECT cs.*, unique_orders, unique_users, CASE WHEN cost > 0 THEN revenue / cost END AS roas, CASE WHEN cost > 0 THEN (revenue - cost) / cost END AS roi, cost / conversions AS cpa, CASE WHEN clicks > 0 THEN cost / clicks END AS cpc, CASE WHEN clicks > 0 THEN conversions / clicks END AS conversion_rate
  FROM cs JOIN uo ON ({", ".join("cs." + x for x in CHANNEL.split(", "))}) IS NOT DISTINCT FROM ({", ".join("uo." + x for x in CHANNEL.split(", "))}))"""
CM_DOUBLES = "revenue cost roas roi cpa cpc conversion_rate"
_w = "OVER (PARTITION BY time_period, attribution_model ORDER BY"
CR = f"""cr AS (SELECT *, CASE WHEN performance_score <= 3 THEN 'Top Performer' WHEN performance_score <= 7 THEN 'Strong Performer' WHEN performance_score <= 12 THEN 'Average Performer' ELSE 'Under Performer' END AS performance_tier FROM
  (SELECT *, (roi_rank + roas_rank + revenue_rank + conversion_rank) / 4 AS performance_score FROM (SELECT *, dense_rank() {_w} round(roi, 6) DESC NULLS LAST)::INT AS roi_rank, dense_rank() {_w} round(roas, 6) DESC NULLS LAST)::INT AS roas_rank,
  dense_rank() {_w} round(revenue, 6) DESC NULLS LAST)::INT AS revenue_rank, dense_rank() {_w} conversions DESC)::INT AS conversion_rank FROM cm)))"""


def channels(s: Silver) -> DataFrame:
    return marketing.channel_metrics(trips(s), s.ads, EVENTS_AS_OF, EP.split())


@query("gm1_channel_metrics", "att ads", f"WITH {CM}\nMAIN SELECT * FROM cm", CM_DOUBLES, 4)
def _(s):
    return channels(s)


@query("gm1_channel_orders", "att", f"SELECT time_period, attribution_model, utm_source, utm_medium, utm_campaign, count(*) AS conversions, count(DISTINCT order_id) AS unique_orders FROM att, {spans(E, EP)} WHERE order_date::DATE BETWEEN a AND b GROUP BY ALL")
def _(s):
    return channels(s).select("time_period", "attribution_model", "utm_source", "utm_medium", "utm_campaign", "conversions", "unique_orders")


@query("gm2_channel_rankings", "att ads", f"WITH {CM}, {CR}\nMAIN SELECT * FROM cr", CM_DOUBLES + " performance_score", 4)
def _(s):
    return marketing.channel_rankings(channels(s))


def trend_sql(name: str, days: int) -> str:
    now, before = f"order_date::DATE BETWEEN DATE '{E}' - {days - 1} AND DATE '{E}'", f"order_date::DATE BETWEEN DATE '{E}' - {2 * days - 1} AND DATE '{E}' - {days}"
    return f"""SELECT *, {TREND} FROM (SELECT *, {grown("revenue")}, {grown("conversions")} FROM (SELECT '{name}' AS trend_period, (DATE '{E}' - {days - 1})::DATE AS current_start, DATE '{E}' AS current_end, (DATE '{E}' - {2 * days - 1})::DATE AS previous_start, (DATE '{E}' - {days})::DATE AS previous_end,
  attribution_model, utm_source, utm_medium, utm_campaign, coalesce(sum(attributed_revenue) FILTER ({now}), 0) AS current_revenue, coalesce(sum(attributed_revenue) FILTER ({before}), 0) AS previous_revenue, count(*) FILTER ({now}) AS current_conversions, count(*) FILTER ({before}) AS previous_conversions
  FROM att WHERE {now} OR {before} GROUP BY ALL))"""


TREND_DOUBLES = "current_revenue previous_revenue revenue_change revenue_growth conversions_growth"


@query("gm3_channel_trend", "att", trend_sql("weekly", 7), TREND_DOUBLES, 2)
def _(s):
    return marketing.channel_trend(attributed(s), EVENTS_AS_OF, "weekly")


CC = """b AS (SELECT attribution_model, utm_source, utm_medium, campaign_id, count(*) AS conversions, sum(attributed_revenue) AS revenue FROM att GROUP BY ALL), sp AS (SELECT campaign_id, sum(cost) AS cost FROM ads GROUP BY 1),
g AS (SELECT attribution_model, utm_source, utm_medium, sum(conversions)::BIGINT AS conversions, sum(revenue) AS revenue, coalesce(sum(cost), 0) AS cost FROM b LEFT JOIN sp USING (campaign_id) GROUP BY ALL),
h AS (SELECT *, revenue / sum(revenue) OVER w * 100 AS revenue_share, conversions / sum(conversions) OVER w * 100 AS conversions_share, cost / sum(cost) OVER w * 100 AS cost_share FROM g WINDOW w AS (PARTITION BY attribution_model)),
cc AS (SELECT *, CASE WHEN cost_share > 0 THEN revenue_share / cost_share WHEN revenue_share > 0 THEN 999 ELSE 0 END AS efficiency_index FROM h)"""
CC_DOUBLES = "revenue cost revenue_share conversions_share cost_share efficiency_index"


@query("gm4_channel_comparison", "att ads", f"WITH {CC}\nMAIN SELECT * FROM cc", CC_DOUBLES, 2)
def _(s):
    return marketing.channel_comparison(trips(s), s.ads)


CP = """pc AS (SELECT utm_campaign AS campaign_name, attribution_model, count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS customers, sum(attributed_revenue) AS revenue, avg(attributed_revenue) AS avg_order_value FROM att WHERE utm_campaign IS NOT NULL GROUP BY 1, 2),
cs AS (SELECT campaign_name, min(platform) AS platform, sum(cost) AS cost, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, sum(conversions)::BIGINT AS tracked_conversions FROM ads GROUP BY 1),
cp AS (SELECT *, CASE WHEN cost > 0 THEN revenue / cost END AS roas, CASE WHEN cost > 0 THEN (revenue - cost) / cost END AS roi, CASE WHEN impressions > 0 THEN clicks / impressions * 100 END AS ctr_percent, CASE WHEN clicks > 0 THEN cost / clicks END AS cpc,
  CASE WHEN orders > 0 THEN cost / orders WHEN tracked_conversions > 0 THEN cost / tracked_conversions END AS cpa, CASE WHEN clicks > 0 AND orders > 0 THEN orders / clicks * 100 WHEN clicks > 0 THEN tracked_conversions / clicks * 100 END AS conversion_percent FROM pc FULL JOIN cs USING (campaign_name))"""
CP_DOUBLES = "revenue cost avg_order_value roas roi ctr_percent cpc cpa conversion_percent"


def overall(s: Silver) -> DataFrame:
    return marketing.campaign_performance(trips(s), s.ads)


@query("gr1_campaign_performance", "att ads", f"WITH {CP}\nMAIN SELECT * FROM cp", CP_DOUBLES, 2)
def _(s):
    return overall(s)


CT = f"""pt AS (SELECT time_period, utm_campaign AS campaign_name, attribution_model, count(DISTINCT order_id) AS period_orders, count(DISTINCT user_id) AS period_customers, sum(attributed_revenue) AS period_revenue, avg(attributed_revenue) AS period_aov FROM att, {spans(E, EP + " ytd")} WHERE order_date::DATE BETWEEN a AND b AND utm_campaign IS NOT NULL GROUP BY 1, 2, 3),
ps AS (SELECT time_period, campaign_name, sum(cost) AS period_cost, sum(impressions)::BIGINT AS period_impressions, sum(clicks)::BIGINT AS period_clicks, sum(conversions)::BIGINT AS period_tracked_conversions FROM ads, {spans(E, EP + " ytd")} WHERE ad_date BETWEEN a AND b GROUP BY 1, 2),
ct AS (SELECT x.*, p.a AS period_start, p.b AS period_end, CASE WHEN period_cost > 0 THEN period_revenue / period_cost END AS period_roas, CASE WHEN period_cost > 0 THEN (period_revenue - period_cost) / period_cost END AS period_roi FROM (FROM pt FULL JOIN ps USING (time_period, campaign_name)) x JOIN {spans(E, EP + " ytd")} USING (time_period))"""
CT_DOUBLES = "period_revenue period_aov period_cost period_roas period_roi"


def by_time(s: Silver) -> DataFrame:
    return marketing.campaign_periods(trips(s), s.ads, EVENTS_AS_OF, [*EP.split(), "ytd"])


@query("gr2_campaign_periods", "att ads", f"WITH {CT}\nMAIN SELECT * FROM ct", CT_DOUBLES, 3)
def _(s):
    return by_time(s)


RC = """rc AS (SELECT *, CASE WHEN period_roi IS NULL THEN 'Unknown' WHEN period_roi >= 2 THEN 'Excellent (200%+ ROI)' WHEN period_roi >= 1 THEN 'Very Good (100-200% ROI)' WHEN period_roi >= 0.5 THEN 'Good (50-100% ROI)' WHEN period_roi >= 0 THEN 'Break-even (0-50% ROI)' WHEN period_roi >= -0.5 THEN 'Poor (-50-0% ROI)' ELSE 'Very Poor (< -50% ROI)' END AS roi_class,
  dense_rank() OVER (PARTITION BY time_period, attribution_model ORDER BY round(period_roi, 6) DESC NULLS LAST)::INT AS roi_rank, dense_rank() OVER (PARTITION BY time_period, attribution_model ORDER BY round(period_revenue, 2) DESC NULLS LAST)::INT AS revenue_rank
  FROM (SELECT cp.*, ct.* EXCLUDE (campaign_name, attribution_model) FROM cp LEFT JOIN ct ON cp.campaign_name = ct.campaign_name AND cp.attribution_model IS NOT DISTINCT FROM ct.attribution_model))"""
RC_DOUBLES = f"{CP_DOUBLES} {CT_DOUBLES}"


def roi_table(s: Silver) -> DataFrame:
    return marketing.campaign_table(trips(s), s.ads, EVENTS_AS_OF, [*EP.split(), "ytd"])


@query("gr3_campaign_roi", "att ads", f"WITH {CP}, {CT}, {RC}\nMAIN SELECT * FROM rc", RC_DOUBLES, 2)
def _(s):
    return roi_table(s)


PC = """pl AS (SELECT *, dense_rank() OVER (PARTITION BY time_period, attribution_model ORDER BY round(channel_roi, 6) DESC NULLS LAST)::INT AS roi_rank FROM (SELECT *, CASE WHEN channel_cost > 0 THEN (channel_revenue - channel_cost) / channel_cost END AS channel_roi,
  CASE WHEN channel_impressions > 0 THEN channel_clicks / channel_impressions * 100 END AS channel_ctr, CASE WHEN channel_orders > 0 THEN channel_cost / channel_orders END AS channel_cpa, CASE WHEN channel_clicks > 0 THEN channel_orders / channel_clicks * 100 END AS channel_conversion_rate
  FROM (SELECT platform, time_period, period_start, period_end, attribution_model, sum(period_cost) AS channel_cost, sum(period_revenue) AS channel_revenue, sum(period_impressions)::BIGINT AS channel_impressions, sum(period_clicks)::BIGINT AS channel_clicks, sum(period_orders)::BIGINT AS channel_orders, count(campaign_name) AS campaign_count, avg(period_roi) AS avg_campaign_roi
    FROM rc WHERE platform IS NOT NULL AND time_period IS NOT NULL GROUP BY ALL)))"""
PC_DOUBLES = "channel_cost channel_revenue avg_campaign_roi channel_roi channel_ctr channel_cpa channel_conversion_rate"


@query("gr4_platform_comparison", "att ads", f"WITH {CP}, {CT}, {RC}, {PC}\nMAIN SELECT * FROM pl", PC_DOUBLES, 2)
def _(s):
    return marketing.platform_comparison(roi_table(s))


MONTH_COLUMNS = "platform, attribution_model, campaign_name, period_cost, period_revenue, period_roi, time_period, period_start, period_end"
RT = f"""rt AS (SELECT {MONTH_COLUMNS}, dense_rank() OVER (PARTITION BY platform ORDER BY round(period_roi, 6) DESC)::INT AS roi_rank_in_channel, CASE WHEN period_roi >= 1 THEN 'High ROI' WHEN period_roi >= 0 THEN 'Positive ROI' WHEN period_roi >= -0.5 THEN 'Negative ROI' ELSE 'Poor ROI' END AS roi_quality
  FROM rc WHERE time_period = 'monthly' AND period_roi IS NOT NULL)"""


@query("gr5_roi_trends", "att ads", f"WITH {CP}, {CT}, {RC}, {RT}\nMAIN SELECT * FROM rt", "period_cost period_revenue period_roi", 3)
def _(s):
    return marketing.roi_trends(roi_table(s))


@query("gr6_roi_distribution", "att ads", f"""WITH {CP}, {CT}, {RC}, {RT}, d AS (SELECT platform, time_period, period_start, period_end, count(*) AS campaign_count, count(*) FILTER (period_roi >= 1) AS high_roi_campaigns, count(*) FILTER (period_roi < 1 AND period_roi >= 0) AS positive_roi_campaigns,
  count(*) FILTER (period_roi < 0 AND period_roi >= -0.5) AS negative_roi_campaigns, count(*) FILTER (period_roi < -0.5) AS poor_roi_campaigns FROM rt GROUP BY ALL), h AS (SELECT *, high_roi_campaigns / campaign_count * 100 AS high_roi_percentage, positive_roi_campaigns / campaign_count * 100 AS positive_roi_percentage FROM d)
MAIN SELECT *, CASE WHEN high_roi_percentage >= 50 THEN 'Excellent' WHEN high_roi_percentage >= 30 THEN 'Good' WHEN high_roi_percentage + positive_roi_percentage >= 50 THEN 'Average' ELSE 'Poor' END AS platform_health FROM h""", "high_roi_percentage positive_roi_percentage", 2)
def _(s):
    return marketing.roi_distribution(marketing.roi_trends(roi_table(s)))


@query("gr7_campaign_efficiency", "att ads", f"""WITH {CP}, {CT}, {RC}, e AS (SELECT {MONTH_COLUMNS}, period_impressions, period_clicks, period_orders, period_customers, CASE WHEN period_impressions > 0 THEN period_cost / period_impressions * 1000 END AS cost_per_impression, CASE WHEN period_clicks > 0 THEN period_cost / period_clicks END AS cost_per_click,
  CASE WHEN period_orders > 0 THEN period_cost / period_orders END AS cost_per_order, CASE WHEN period_customers > 0 THEN period_cost / period_customers END AS cost_per_customer, CASE WHEN period_clicks > 0 THEN period_orders / period_clicks * 100 END AS conversion_rate,
  CASE WHEN period_clicks > 0 THEN period_revenue / period_clicks END AS revenue_per_click, CASE WHEN period_customers > 0 THEN period_revenue / period_customers END AS revenue_per_customer FROM rc WHERE time_period = 'monthly'),
v AS (SELECT platform, avg(cost_per_impression) AS avg_cpm, avg(cost_per_click) AS avg_cpc, avg(cost_per_order) AS avg_cpo, avg(conversion_rate) AS avg_cvr, avg(revenue_per_customer) AS avg_rpc FROM e WHERE cost_per_impression IS NOT NULL AND cost_per_click IS NOT NULL AND cost_per_order IS NOT NULL AND conversion_rate IS NOT NULL GROUP BY 1),
w AS (SELECT *, CASE WHEN avg_cpm > 0 THEN avg_cpm / nullif(cost_per_impression, 0) END AS cpm_score, CASE WHEN avg_cpc > 0 THEN avg_cpc / nullif(cost_per_click, 0) END AS cpc_score, CASE WHEN avg_cpo > 0 THEN avg_cpo / nullif(cost_per_order, 0) END AS cpo_score, CASE WHEN avg_cvr > 0 THEN conversion_rate / avg_cvr END AS cvr_score, CASE WHEN avg_rpc > 0 THEN revenue_per_customer / avg_rpc END AS rpc_score FROM e LEFT JOIN v USING (platform)),
x AS (SELECT *, (coalesce(cpm_score, 1) + coalesce(cpc_score, 1) + coalesce(cpo_score, 1) + coalesce(cvr_score, 1) + coalesce(rpc_score, 1)) / 5 AS efficiency_score FROM w)
MAIN SELECT *, CASE WHEN efficiency_score >= 1.5 THEN 'Excellent' WHEN efficiency_score >= 1.2 THEN 'Good' WHEN efficiency_score >= 0.8 THEN 'Average' WHEN efficiency_score >= 0.5 THEN 'Below Average' ELSE 'Poor' END AS efficiency_rating,
 CASE WHEN cpc_score < 0.8 THEN 'Optimize for lower CPC' WHEN cvr_score < 0.8 THEN 'Improve conversion rate' WHEN cpm_score < 0.8 THEN 'Refine targeting for better CPM' WHEN cpo_score < 0.8 THEN 'Reduce cost per order' WHEN rpc_score < 0.8 THEN 'Increase revenue per customer' ELSE 'Maintain current performance' END AS efficiency_focus_area FROM x""",
 "period_cost period_revenue period_roi cost_per_impression cost_per_click cost_per_order cost_per_customer conversion_rate revenue_per_click revenue_per_customer avg_cpm avg_cpc avg_cpo avg_cvr avg_rpc cpm_score cpc_score cpo_score cvr_score rpc_score efficiency_score", 3)
def _(s):
    return marketing.campaign_efficiency(roi_table(s))


BA = f"""ba AS (SELECT *, CASE WHEN round(suggested_budget_change, 6) > 5 THEN 'Significantly Increase Budget' WHEN round(suggested_budget_change, 6) > 2 THEN 'Increase Budget' WHEN round(suggested_budget_change, 6) < -5 THEN 'Significantly Decrease Budget' WHEN round(suggested_budget_change, 6) < -2 THEN 'Decrease Budget' ELSE 'Maintain Current Budget' END AS allocation_recommendation
  FROM (SELECT *, suggested_budget_share - current_budget_share AS suggested_budget_change FROM (SELECT *, adjusted_budget / sum(adjusted_budget) OVER () * 100 AS suggested_budget_share FROM (SELECT *, period_cost * budget_reallocation_factor AS adjusted_budget FROM (SELECT {MONTH_COLUMNS}, period_cost / sum(period_cost) OVER () * 100 AS current_budget_share, period_revenue / sum(period_revenue) OVER () * 100 AS revenue_contribution,
    dense_rank() OVER (ORDER BY round(period_roi, 6) DESC)::INT AS roi_rank, CASE WHEN period_roi > 2 THEN 1.5 WHEN period_roi > 1 THEN 1.25 WHEN period_roi > 0.5 THEN 1.1 WHEN period_roi > 0 THEN 1 WHEN period_roi > -0.5 THEN 0.75 ELSE 0.5 END::DOUBLE AS budget_reallocation_factor FROM rc WHERE time_period = 'monthly' AND period_roi IS NOT NULL AND period_cost IS NOT NULL)))))"""
BA_DOUBLES = "period_cost period_revenue period_roi current_budget_share revenue_contribution budget_reallocation_factor adjusted_budget suggested_budget_share suggested_budget_change"


@query("gr8_budget_allocation", "att ads", f"WITH {CP}, {CT}, {RC}, {BA}\nMAIN SELECT * FROM ba", BA_DOUBLES, 3)
def _(s):
    return marketing.budget_allocation(roi_table(s))


DEL = f"del AS (SELECT *, year(order_date) * 12 + month(order_date) AS month_idx FROM items JOIN ord USING (order_id) WHERE order_status = 'Livré' AND order_date BETWEEN DATE '{O}' - 1460 AND DATE '{O}')"
MON = "mon AS (SELECT month_idx, category, sum(item_total) AS revenue, count(DISTINCT order_id) AS orders, sum(quantity) AS quantity, count(DISTINCT customer_id) AS customers FROM del GROUP BY 1, 2)"


def base(s: Silver) -> DataFrame:
    return forecast.delivered(s.items, s.orders, ORDERS_AS_OF, 1460)


@query("gs2_daily_sales", "items ord", f"WITH {DEL}\nMAIN SELECT order_date, sum(item_total) AS revenue, count(DISTINCT order_id) AS orders, sum(quantity) AS quantity, count(DISTINCT customer_id) AS customers FROM del GROUP BY 1", "revenue quantity", 2)
def _(s):
    return forecast.sales(base(s), "day", False)


@query("gs2_daily_category_sales", "items ord", f"WITH {DEL}\nMAIN SELECT order_date, category, sum(item_total) AS revenue, count(DISTINCT order_id) AS orders, sum(quantity) AS quantity, count(DISTINCT customer_id) AS customers FROM del GROUP BY 1, 2", "revenue quantity", 2)
def _(s):
    return forecast.sales(base(s), "day", True)


MON_ALL = "mall AS (SELECT month_idx, sum(item_total) AS revenue, count(DISTINCT order_id) AS orders, sum(quantity) AS quantity, count(DISTINCT customer_id) AS customers FROM del GROUP BY 1)"
YEAR_MONTH = "((month_idx - 1) // 12)::VARCHAR || '-' || lpad(((month_idx - 1) % 12 + 1)::VARCHAR, 2, '0') AS month_year"


@query("gs3_monthly_sales", "items ord", f"WITH {DEL}, {MON_ALL}\nMAIN SELECT month_idx::INT AS month_idx, {YEAR_MONTH}, revenue, orders, quantity, customers FROM mall", "revenue quantity", 2)
def _(s):
    return forecast.sales(base(s), "month", False)


@query("gs4_monthly_growth", "items ord", f"WITH {DEL}, {MON}\nMAIN SELECT m.month_idx::INT AS month_idx, {YEAR_MONTH.replace('month_idx', 'm.month_idx')}, m.category, m.revenue, m.orders, m.quantity, m.customers, avg(m.revenue) OVER (PARTITION BY m.category ORDER BY m.month_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_average, (m.revenue - p.revenue) / p.revenue * 100 AS mom_growth, (m.revenue - y.revenue) / y.revenue * 100 AS yoy_growth FROM mon m LEFT JOIN mon p ON p.category = m.category AND p.month_idx = m.month_idx - 1 LEFT JOIN mon y ON y.category = m.category AND y.month_idx = m.month_idx - 12", "revenue quantity moving_average mom_growth yoy_growth", 2)
def _(s):
    return forecast.growth(forecast.sales(base(s), "month", True))


@query("gs5_growth_trends", "items ord", f"""WITH {DEL}, {MON}, u AS (SELECT month_idx, category, revenue FROM mon UNION ALL SELECT month_idx, 'Overall', sum(revenue) FROM mon GROUP BY 1),
g AS (SELECT m.category, m.month_idx, (m.revenue - p.revenue) / p.revenue * 100 AS mom, (m.revenue - y.revenue) / y.revenue * 100 AS yoy, row_number() OVER (PARTITION BY m.category ORDER BY m.month_idx DESC) AS r FROM u m LEFT JOIN u p ON p.category = m.category AND p.month_idx = m.month_idx - 1 LEFT JOIN u y ON y.category = m.category AND y.month_idx = m.month_idx - 12),
c AS (SELECT category AS segment, count(*) AS months, avg(mom) AS avg_mom_growth, min(mom) AS min_mom_growth, max(mom) AS max_mom_growth, avg(yoy) AS avg_yoy_growth, min(yoy) AS min_yoy_growth, max(yoy) AS max_yoy_growth FROM g
  WHERE category <> 'Overall' AND month_idx > (SELECT max(month_idx) FROM mon) - 6 OR category = 'Overall' AND r <= 6 GROUP BY 1),
z AS (SELECT segment, months, {", ".join(f"CASE WHEN segment = 'Overall' THEN coalesce({x}, 0) ELSE {x} END AS {x}" for x in ("avg_mom_growth", "min_mom_growth", "max_mom_growth", "avg_yoy_growth", "min_yoy_growth", "max_yoy_growth"))} FROM c)
MAIN SELECT *, CASE WHEN avg_yoy_growth >= 20 THEN 'Strong Growth' WHEN avg_yoy_growth >= 10 THEN 'Healthy Growth' WHEN avg_yoy_growth >= 0 THEN 'Stable Growth' WHEN avg_yoy_growth >= -10 THEN 'Slight Decline' ELSE 'Significant Decline' END AS growth_trend,
 CASE WHEN avg_mom_growth > avg_yoy_growth THEN 'Accelerating' WHEN avg_mom_growth > 0 THEN 'Continuing' WHEN avg_mom_growth < 0 AND avg_yoy_growth > 0 THEN 'Slowing' ELSE 'Declining' END AS momentum FROM z""", "avg_mom_growth min_mom_growth max_mom_growth avg_yoy_growth min_yoy_growth max_yoy_growth", 3)
def _(s):
    return forecast.growth_trends(forecast.sales(base(s), "month", True))


@query("gs6_seasonal_index", "items ord", f"""WITH {DEL}, {MON}, u AS (SELECT month_idx, category, revenue FROM mon UNION ALL SELECT month_idx, 'ALL', sum(revenue) FROM mon GROUP BY 1), a AS (SELECT category, avg(revenue) AS overall_mean FROM u GROUP BY 1)
MAIN SELECT u.category, ((month_idx - 1) % 12 + 1)::INT AS month, avg(revenue) AS month_mean, any_value(overall_mean) AS overall_mean, avg(revenue) / any_value(overall_mean) AS seasonal_index FROM u JOIN a USING (category) GROUP BY 1, 2""", "month_mean overall_mean seasonal_index", 5)
def _(s):
    return forecast.seasonal_index(forecast.sales(base(s), "month", True))


def fit_sql(rows: str, keys: str) -> str:
    lines = ", ".join(f"coalesce(regr_slope({m}, month_idx), 0) AS s_{m}, coalesce(regr_intercept({m}, month_idx), avg({m})) AS i_{m}" for m in ("revenue", "orders", "quantity"))
    ahead = ", ".join(f"greatest(s_{m} * (l + k) + i_{m}, 0) AS forecast_{m}" for m in ("revenue", "orders", "quantity"))
    return f"f AS (SELECT {keys} {lines}, max(month_idx) AS l, count(*) AS months FROM {rows} GROUP BY ALL), h AS (SELECT {keys} (l + k)::INT AS month_idx, months, {ahead} FROM f, (VALUES (1), (2), (3)) v(k)), o AS (SELECT *, forecast_revenue * 0.9 AS lower_bound, forecast_revenue * 1.1 AS upper_bound, 'Medium' AS confidence FROM h)"


FIT_DOUBLES = "forecast_revenue forecast_orders forecast_quantity lower_bound upper_bound"


@query("gs7_forecast", "items ord", f"WITH {DEL}, {MON_ALL}, {fit_sql('mall', '')}\nMAIN SELECT * FROM o", FIT_DOUBLES, 1)
def _(s):
    return forecast.ols_forecast(forecast.sales(base(s), "month", False))


@query("gs8_category_forecast", "items ord", f"WITH {DEL}, {MON}, {fit_sql('mon', 'category,')}\nMAIN SELECT * FROM o", FIT_DOUBLES, 1)
def _(s):
    return forecast.ols_forecast(forecast.sales(base(s), "month", True))


@query("st6_inactivity_sessions", "logs", """WITH g AS (SELECT *, CASE WHEN lag(event_timestamp) OVER w IS NULL OR event_timestamp - lag(event_timestamp) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY event_timestamp, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id) AS session_no FROM g)
MAIN SELECT user_id, session_no::BIGINT AS session_no, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end, count(*) AS event_count FROM n GROUP BY 1, 2""")
def _(s):
    return sessions.inactivity_sessions(s.logs).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("st7_event_counts", "logs", "SELECT date_trunc('day', event_timestamp)::TIMESTAMP AS window_start, event_type, count(*) AS events FROM logs GROUP BY 1, 2")
def _(s):
    return sessions.event_counts(s.logs).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


def fact_query(name: str, fact: str, tables: str, sql: str, base: str, doubles: str, digits: int = 3):
    """A fact of a gold table: its SQL is that of the gold table with the key put together here."""
    parts, columns = warehouse.FACTS[fact]
    key = "concat_ws('_', " + ", ".join(f"coalesce({c}::VARCHAR, 'unknown')" for c in parts) + ")"
    names = [*parts, *columns.split()]
    return query(name, tables, f"{sql}\nMAIN SELECT {key} AS {fact.removeprefix('FACT_').lower()}_key, {', '.join(names)} FROM {base}", " ".join(c for c in doubles.split() if c in names), digits)


@fact_query("wh1_fact_channel_performance", "FACT_CHANNEL_PERFORMANCE", "att ads", f"WITH {CM}, {CR}", "cr", CM_DOUBLES + " performance_score")
def _(s):
    return warehouse.fact(marketing.channel_rankings(channels(s)), "FACT_CHANNEL_PERFORMANCE")


@fact_query("wh2_fact_marketing_trends", "FACT_MARKETING_TRENDS", "att", f"WITH tr AS ({trend_sql('weekly', 7)} UNION ALL BY NAME {trend_sql('monthly', 30)})", "tr", TREND_DOUBLES, 2)
def _(s):
    held = attributed(s)
    return warehouse.fact(marketing.channel_trend(held, EVENTS_AS_OF, "weekly").unionByName(marketing.channel_trend(held, EVENTS_AS_OF, "monthly")), "FACT_MARKETING_TRENDS")


@fact_query("wh3_fact_channel_comparison", "FACT_CHANNEL_COMPARISON", "att ads", f"WITH {CC}", "cc", CC_DOUBLES, 2)
def _(s):
    return warehouse.fact(marketing.channel_comparison(trips(s), s.ads), "FACT_CHANNEL_COMPARISON")


@fact_query("wh7_fact_product_performance", "FACT_PRODUCT_PERFORMANCE", "items ord", f"WITH {PM}, {PR}", "pr", "total_quantity total_revenue", 2)
def _(s):
    return warehouse.fact(products.product_rankings(metrics(s)), "FACT_PRODUCT_PERFORMANCE")


@fact_query("wh8_fact_product_trends", "FACT_PRODUCT_TRENDS", "items ord", f"WITH {PT}", "pt", PT_DOUBLES, 2)
def _(s):
    return warehouse.fact(products.product_trend(s.items, s.orders, ORDERS_AS_OF), "FACT_PRODUCT_TRENDS")


@fact_query("wh9_fact_category_performance", "FACT_CATEGORY_PERFORMANCE", "items ord", f"WITH {PM}, {CA}", "ca", CA_DOUBLES, 2)
def _(s):
    return warehouse.fact(products.category_analysis(metrics(s)), "FACT_CATEGORY_PERFORMANCE")


@fact_query("wh10_fact_product_conversion", "FACT_PRODUCT_CONVERSION", "items logs", f"WITH {VC}", "vc", VC_DOUBLES)
def _(s):
    return warehouse.fact(conversion(s), "FACT_PRODUCT_CONVERSION")


@fact_query("wh13_fact_customer_segments", "FACT_CUSTOMER_SEGMENTS", "cust ord items", f"WITH {RFM}, {LIFE[len(TOT) + 2:]}, {PREF}, {COMBINED}", "combined", "")
def _(s):
    return warehouse.fact(gold.customer_segments(s, ORDERS_AS_OF)["combined_segments"], "FACT_CUSTOMER_SEGMENTS")


@fact_query("wh14_fact_rfm_segments", "FACT_RFM_SEGMENTS", "ord", f"WITH {RFM}, rf AS (SELECT * REPLACE (recency_days::INT AS recency_days, recency_score::INT AS recency_score, frequency_score::INT AS frequency_score, monetary_score::INT AS monetary_score, rfm_score::INT AS rfm_score) FROM rfm)", "rf", "monetary", 2)
def _(s):
    return warehouse.fact(segments.rfm(s.orders, ORDERS_AS_OF), "FACT_RFM_SEGMENTS")


@fact_query("wh15_fact_lifecycle_segments", "FACT_LIFECYCLE_SEGMENTS", "ord", f"WITH {LIFE}, lf AS (SELECT customer_id, recency_days::INT AS recency_days, first_days::INT AS days_since_first, frequency, life.monetary, lifecycle_stage, purchase_frequency_segment, value_quartile, (['Premium Value', 'High Value', 'Medium Value', 'Low Value'])[value_quartile] AS customer_value_segment FROM life JOIN t USING (customer_id))", "lf", "monetary", 2)
def _(s):
    return warehouse.fact(segments.lifecycle(s.orders, ORDERS_AS_OF), "FACT_LIFECYCLE_SEGMENTS")


@fact_query("wh18_fact_campaign_performance", "FACT_CAMPAIGN_PERFORMANCE", "att ads", f"WITH {CP}, {CT}, {RC}", "rc", RC_DOUBLES, 2)
def _(s):
    return warehouse.fact(roi_table(s), "FACT_CAMPAIGN_PERFORMANCE")


@fact_query("wh19_fact_campaign_channel_comparison", "FACT_CAMPAIGN_CHANNEL_COMPARISON", "att ads", f"WITH {CP}, {CT}, {RC}, {PC}", "pl", PC_DOUBLES, 2)
def _(s):
    return warehouse.fact(marketing.platform_comparison(roi_table(s)), "FACT_CAMPAIGN_CHANNEL_COMPARISON")


@fact_query("wh20_fact_campaign_roi_trends", "FACT_CAMPAIGN_ROI_TRENDS", "att ads", f"WITH {CP}, {CT}, {RC}, {RT}", "rt", "period_cost period_revenue period_roi")
def _(s):
    return warehouse.fact(marketing.roi_trends(roi_table(s)), "FACT_CAMPAIGN_ROI_TRENDS")


@fact_query("wh21_fact_campaign_budget_allocation", "FACT_CAMPAIGN_BUDGET_ALLOCATION", "att ads", f"WITH {CP}, {CT}, {RC}, {BA}", "ba", BA_DOUBLES)
def _(s):
    return warehouse.fact(marketing.budget_allocation(roi_table(s)), "FACT_CAMPAIGN_BUDGET_ALLOCATION")


@query("wh22_dim_campaign", "ads", "SELECT DISTINCT campaign_name AS campaign_key, campaign_name, CASE WHEN campaign_name LIKE '%promo%' THEN 'Promotional' WHEN campaign_name LIKE '%launch%' THEN 'Product Launch' WHEN campaign_name LIKE '%season%' THEN 'Seasonal' WHEN campaign_name LIKE '%retarg%' THEN 'Retargeting' WHEN campaign_name LIKE '%brand%' THEN 'Branding' ELSE 'General' END AS campaign_type FROM ads")
def _(s):
    return warehouse.campaign_dimension(s.ads)


@query("wh4_dim_date", "ads", "SELECT DISTINCT strftime(ad_date, '%Y%m%d')::INT AS date_key, ad_date AS date, year(ad_date)::INT AS year, quarter(ad_date)::INT AS quarter, month(ad_date)::INT AS month, day(ad_date)::INT AS day, (dayofweek(ad_date) + 1)::INT AS day_of_week, weekofyear(ad_date)::INT AS week_of_year FROM ads")
def _(s):
    return warehouse.date_dimension(s.ads, "ad_date")


@query("wh5_dim_channel", "logs", "SELECT DISTINCT coalesce(utm_source, 'unknown') || '_' || coalesce(utm_medium, 'unknown') AS channel_key, utm_source, utm_medium, CASE WHEN utm_source IS NULL THEN coalesce(utm_medium, 'Unknown') ELSE utm_source || coalesce(' - ' || utm_medium, '') END AS channel_name, CASE utm_medium WHEN 'cpc' THEN 'Paid Search' WHEN 'social' THEN 'Social Media' WHEN 'email' THEN 'Email' WHEN 'organic' THEN 'Organic' WHEN 'referral' THEN 'Referral' WHEN 'affiliate' THEN 'Affiliate' ELSE 'Other' END AS channel_group FROM logs")
def _(s):
    return warehouse.channel_dimension(s.logs)


@query("wh6_dim_marketing_campaign", "logs", "SELECT DISTINCT utm_campaign AS campaign_key, utm_campaign, CASE WHEN utm_campaign LIKE '%promo%' THEN 'Promotional' WHEN utm_campaign LIKE '%launch%' THEN 'Product Launch' WHEN utm_campaign LIKE '%brand%' THEN 'Branding' WHEN utm_campaign LIKE '%retarg%' THEN 'Retargeting' ELSE 'General' END AS campaign_type FROM logs WHERE utm_campaign IS NOT NULL")
def _(s):
    return warehouse.marketing_campaign_dimension(s.logs)


@query("wh11_dim_product", "items", "SELECT DISTINCT product_name || '_' || category AS product_key, product_name, category, CASE WHEN product_name LIKE '%cleanser%' THEN 'Cleanser' WHEN product_name LIKE '%cream%' THEN 'Cream' WHEN product_name LIKE '%serum%' THEN 'Serum' WHEN product_name LIKE '%lotion%' THEN 'Lotion' WHEN product_name LIKE '%shampoo%' THEN 'Shampoo' WHEN product_name LIKE '%conditioner%' THEN 'Conditioner' ELSE 'Other' END AS product_type, product_name LIKE '%bio%' OR product_name LIKE '%natural%' OR product_name LIKE '%organic%' AS is_organic, CASE category WHEN 'soin_visage' THEN 'Facial Care' WHEN 'soin_corps' THEN 'Body Care' WHEN 'soin_cheveux' THEN 'Hair Care' WHEN 'maquillage' THEN 'Make-up' WHEN 'parfum' THEN 'Fragrance' ELSE category END AS category_display FROM items")
def _(s):
    return warehouse.product_dimension(s.items)


@query("wh12_dim_category", "items", "SELECT DISTINCT category AS category_key, category, CASE category WHEN 'soin_visage' THEN 'Facial Care' WHEN 'soin_corps' THEN 'Body Care' WHEN 'soin_cheveux' THEN 'Hair Care' WHEN 'maquillage' THEN 'Make-up' WHEN 'parfum' THEN 'Fragrance' ELSE category END AS category_display, CASE WHEN category IN ('soin_visage', 'soin_corps') THEN 'Skin' WHEN category = 'soin_cheveux' THEN 'Hair' WHEN category = 'maquillage' THEN 'Color' WHEN category = 'parfum' THEN 'Scent' ELSE 'Other' END AS category_group FROM items")
def _(s):
    return warehouse.category_dimension(s.items)


@query("wh16_dim_customer", "cust", "SELECT customer_id AS customer_key, customer_id, city, region, coalesce(region, 'Unknown') AS location_group FROM cust")
def _(s):
    return warehouse.customer_dimension(s.customers)


@query("wh23_dim_platform", "ads", "SELECT DISTINCT platform AS platform_key, platform, CASE WHEN platform = 'Google' THEN 'Search' ELSE 'Social' END AS platform_type, CASE WHEN platform = 'Google' THEN 'Paid Search' WHEN platform LIKE 'Influencer%' THEN 'Influencer Marketing' ELSE 'Paid Social' END AS channel_group FROM ads")
def _(s):
    return warehouse.platform_dimension(s.ads)


@query("dq1_completeness", "logs", "SELECT 'web_logs' AS dataset, column_name, total, missing, 1 - missing / total AS completeness FROM (SELECT count(*) AS total, count(*) - count(user_email) AS user_email, count(*) - count(utm_source) AS utm_source, count(*) - count(event_id) AS event_id FROM logs) UNPIVOT (missing FOR column_name IN (user_email, utm_source, event_id))", "completeness")
def _(s):
    return data_quality.completeness(s.logs.select("user_email", "utm_source", "event_id"), "web_logs")


@query("dq2_validity", "ord", "SELECT 'orders' AS dataset, rule, total, valid, valid / total AS validity FROM (SELECT count(*) AS total, count(*) FILTER (final_total > 0) AS positive_total, count(*) FILTER (order_status IN ('Livré', 'En cours')) AS known_status FROM ord) UNPIVOT (valid FOR rule IN (positive_total, known_status))", "validity")
def _(s):
    return data_quality.validity(s.orders, "orders", {"positive_total": F.col("final_total") > 0, "known_status": F.col("order_status").isin("Livré", "En cours")})


@query("dq3_referential_integrity", "logs cust", "SELECT 'logs-customers' AS relation, count(*) AS keys, count(*) FILTER (customer_id IS NULL) AS orphans, 1 - count(*) FILTER (customer_id IS NULL) / count(*) AS score, CASE WHEN count(*) FILTER (customer_id IS NULL) / count(*) <= 0.02 THEN 'PASSED' WHEN count(*) FILTER (customer_id IS NULL) / count(*) <= 0.1 THEN 'WARNING' ELSE 'FAILED' END AS status FROM (SELECT DISTINCT user_id FROM logs) LEFT JOIN cust ON customer_id = user_id", "score")
def _(s):
    return data_quality.referential_integrity(s.logs, s.customers, "user_id", "customer_id", "logs-customers")


@query("dq4_duplicates", "logs", "SELECT 'web_logs' AS dataset, count(*) AS total, count(*) - count(DISTINCT session_id) AS duplicates, (count(*) - count(DISTINCT session_id)) / count(*) * 100 AS percent, CASE WHEN (count(*) - count(DISTINCT session_id)) / count(*) < 0.01 THEN 'PASSED' WHEN (count(*) - count(DISTINCT session_id)) / count(*) < 0.05 THEN 'WARNING' ELSE 'FAILED' END AS status FROM logs", "percent")
def _(s):
    return data_quality.duplicates(s.logs, ["session_id"], "web_logs")


STATUS = "outliers / total * 100 AS percent, CASE WHEN outliers / total < 0.01 THEN 'PASSED' WHEN outliers / total < 0.05 THEN 'WARNING' ELSE 'FAILED' END AS status"


@query("dq5_outliers_zscore", "ord", f"SELECT *, {STATUS} FROM (SELECT 'orders' AS dataset, 'final_total' AS column_name, 'zscore' AS method, count(*) AS total, count(*) FILTER ((final_total - m) / s > 1.5) AS outliers FROM ord, (SELECT avg(final_total) AS m, stddev_samp(final_total) AS s FROM ord))", "percent")
def _(s):
    return data_quality.outliers(s.orders, "final_total", "orders", threshold=1.5)


@query("dq6_outliers_iqr", "ads", f"SELECT *, {STATUS} FROM (SELECT 'ads' AS dataset, 'cost' AS column_name, 'iqr' AS method, count(*) AS total, count(*) FILTER (cost < q1 - 1.5 * (q3 - q1) OR cost > q3 + 1.5 * (q3 - q1)) AS outliers FROM ads, (SELECT quantile_disc(cost, 0.25) AS q1, quantile_disc(cost, 0.75) AS q3 FROM ads))", "percent")
def _(s):
    return data_quality.outliers(s.ads, "cost", "ads", method="iqr")


@query("dq7_freshness", "logs", f"SELECT 'web_logs' AS dataset, max(event_timestamp)::DATE AS latest, date_diff('day', max(event_timestamp)::DATE, DATE '2024-02-02')::INT AS age_days, CASE WHEN date_diff('day', max(event_timestamp)::DATE, DATE '2024-02-02') <= 1 THEN 'PASSED' WHEN date_diff('day', max(event_timestamp)::DATE, DATE '2024-02-02') <= 3 THEN 'WARNING' ELSE 'FAILED' END AS status FROM logs")
def _(s):
    return data_quality.freshness(s.logs, "event_timestamp", "web_logs", date(2024, 2, 2))


@query("dq8_distribution", "ord", "SELECT 'orders' AS dataset, 'season' AS column_name, season AS value, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS percent FROM ord GROUP BY season", "percent")
def _(s):
    return data_quality.distribution(s.orders, "season", "orders")


def cells(table: str, of: str = "") -> str:
    """Sum of the values that aren't null over all columns, and number of columns, of a table."""
    return f"(SELECT sum(n) AS held, count(*) AS columns FROM (SELECT count(COLUMNS(*)) FROM {table}) UNPIVOT INCLUDE NULLS (n FOR c IN (*)))"


def dataset_sql(name: str, table: str, rules: list[str], more: str = "", complete: str = "") -> str:
    """Metric rows of a dataset: (dataset, kind, item, value, allowed)."""
    full = complete or f"(SELECT held / (columns * (SELECT count(*) FROM {table})) FROM {cells(table)})"
    valid = " + ".join(f"count(*) FILTER ({r})" for r in rules)
    head = f"SELECT '{name}' AS dataset, 'completeness' AS kind, NULL::VARCHAR AS item, {full}::DOUBLE AS value, NULL::DOUBLE AS allowed UNION ALL SELECT '{name}', 'validity', NULL, ({valid}) / ({len(rules)} * count(*)), NULL FROM {table}"
    return head + (" UNION ALL " + more if more else "")


def aged(name: str, table: str, column: str, days: int = 1) -> str:
    return f"SELECT '{name}', 'age_days', '{column}', date_diff('day', max({column})::DATE, DATE '{E}'), {days} FROM {table}"


def repeated(name: str, table: str, key: str) -> str:
    return f"SELECT '{name}', 'duplicate_percent', '{key}', (count(*) - count(DISTINCT {key})) / count(*) * 100, NULL FROM {table}"


def shares(name: str, table: str, column: str) -> str:
    return f"SELECT '{name}', 'value_percent', '{column}=' || coalesce({column}::VARCHAR, 'null'), count(*) / sum(count(*)) OVER () * 100, NULL FROM {table} GROUP BY {column}"


def orphans(name: str, table: str, column: str, parent: str, parent_table: str, key: str) -> str:
    return f"SELECT '{name}', 'integrity', '{parent}', count({key}) / count(*), NULL FROM (SELECT DISTINCT {column} AS own FROM {table} WHERE {column} IS NOT NULL) LEFT JOIN (SELECT DISTINCT {key} FROM {parent_table}) ON own = {key}"


def odd(name: str, table: str, column: str) -> str:
    return f"SELECT '{name}', 'outlier_percent', '{column}', count(*) FILTER (({column} - m) / s > 3) / count(*) * 100, NULL FROM {table}, (SELECT avg({column}) AS m, stddev_samp({column}) AS s FROM {table})"


def known(*columns: str) -> list[str]:
    return [f"{c} IS NOT NULL" for c in columns]


SUITE_SQL = " UNION ALL ".join([
    dataset_sql("web_logs", "wl", known("event_id", "session_id", "event_timestamp", "event_type"), " UNION ALL ".join([repeated("web_logs", "wl", "event_id"), aged("web_logs", "wl", "event_timestamp", 2), shares("web_logs", "wl", "event_type")])),
    dataset_sql("customers", "cust", [*known("customer_id", "registration_date"), "length(email) > 5 AND contains(email, '@')"], " UNION ALL ".join([repeated("customers", "cust", "customer_id"), aged("customers", "cust", "registration_date")])),
    dataset_sql("orders", "ord", [*known("order_id", "customer_id", "order_date"), "final_total >= 0"], " UNION ALL ".join([repeated("orders", "ord", "order_id"), orphans("orders", "ord", "customer_id", "customers", "cust", "customer_id"), aged("orders", "ord", "order_date"), odd("orders", "ord", "final_total")])),
    dataset_sql("order_items", "oi", [*known("order_id", "product_name"), "price > 0", "quantity > 0"], " UNION ALL ".join([orphans("order_items", "oi", "order_id", "orders", "ord", "order_id"), shares("order_items", "oi", "category")])),
    dataset_sql("google_ads", "ga", [*known("campaign_id", "ad_date"), "cost >= 0", "impressions >= 0"], " UNION ALL ".join([aged("google_ads", "ga", "ad_date"), odd("google_ads", "ga", "cost")])),
    dataset_sql("social_ads", "sa", [*known("campaign_id", "ad_date", "platform"), "cost >= 0"], " UNION ALL ".join([aged("social_ads", "sa", "ad_date"), shares("social_ads", "sa", "platform")])),
    dataset_sql("web_sessions", "ws", [*known("session_id", "session_start"), "session_duration_seconds >= 0"], " UNION ALL ".join([repeated("web_sessions", "ws", "session_id"), aged("web_sessions", "ws", "session_start"), odd("web_sessions", "ws", "session_duration_seconds")]),
        f"(SELECT (held + 8 * (SELECT count(*) FROM ws)) / (26 * (SELECT count(*) FROM ws)) FROM {cells('ws')})"),
    dataset_sql("customer_sessions", "cu", known("session_id", "user_id", "session_start"), " UNION ALL ".join([orphans("customer_sessions", "cu", "user_id", "customers", "cust", "customer_id"), aged("customer_sessions", "cu", "session_start")]),
        f"(SELECT (held + (SELECT 10 * count(*) + count(user_email) + 5 * count(*) FILTER (matched) FROM cu) - (SELECT count(*) FROM cu)) / (33 * (SELECT count(*) FROM cu)) FROM {cells('cu')})"),
    dataset_sql("customer_profiles", "cp0", [*known("customer_id"), "true", "length(email) > 5 AND contains(email, '@')"], " UNION ALL ".join([orphans("customer_profiles", "cp0", "customer_id", "customers", "cust", "customer_id"), shares("customer_profiles", "stages", "profile_lifecycle_stage")]),
        f"(SELECT (held + (SELECT 6 * count(*) + 10 * count(n) + count(*) FILTER (n > 1) FROM cp0) - (SELECT count(n) FROM cp0)) / (30 * (SELECT count(*) FROM cp0)) FROM {cells('cp0')})"),
    dataset_sql("marketing_attribution", "att", [*known("order_id", "user_id", "attribution_model"), "attributed_revenue >= 0"], " UNION ALL ".join([orphans("marketing_attribution", "att", "order_id", "web_orders", "pur", "order_id"), aged("marketing_attribution", "att", "order_date"), shares("marketing_attribution", "att", "attribution_model")])),
    dataset_sql("channel_performance", "ch", [*known("attribution_model", "utm_source"), "attributed_revenue >= 0"]),
])
SUITE_TABLES = f"""wl AS MATERIALIZED (SELECT logs.*, value FROM logs JOIN events USING (event_id)), oi AS (SELECT *, item_total / quantity AS price FROM items), ga AS (SELECT * FROM ads WHERE platform = 'Google'), sa AS (SELECT * FROM ads WHERE platform IN ('Facebook', 'Instagram', 'TikTok')),
ws AS MATERIALIZED (SELECT * EXCLUDE (pages_viewed), epoch(date_trunc('second', session_end))::BIGINT - epoch(date_trunc('second', session_start))::BIGINT AS session_duration_seconds FROM sess),
cu AS MATERIALIZED (SELECT sess.* EXCLUDE (pages_viewed), c.email IS NOT NULL AS matched FROM sess LEFT JOIN cust c ON lower(trim(c.email)) = lower(trim(user_email)) WHERE is_authenticated AND user_id IS NOT NULL),
{PREF}, cp0 AS MATERIALIZED (SELECT c.*, n, pref.* EXCLUDE (customer_id) FROM cust c LEFT JOIN (SELECT customer_id, count(*) AS n FROM ord GROUP BY 1) USING (customer_id) LEFT JOIN pref USING (customer_id)),
stages AS ({STAGES_SQL}), ch AS MATERIALIZED ({CHANNEL_PERFORMANCE})"""


def suite(s: Silver) -> DataFrame:
    """Metrics of the suite; the datasets, which are views here, are written for its two scans and go when it is done."""

    def metrics() -> DataFrame:
        return data_quality.suite_metrics(gold.silver_datasets(gold.stored(s), ORDERS_AS_OF, materialize), EVENTS_AS_OF)

    return settled(metrics)


@query("dq10_silver_metrics", "logs cust ord items ads sess att", f"WITH {SUITE_TABLES}, m AS MATERIALIZED ({SUITE_SQL})\nMAIN SELECT * FROM m", "value", 3)
def _(s):
    return suite(s)


@query("dq10_silver_suite", "logs cust ord items ads sess att", f"""WITH {SUITE_TABLES}, m AS MATERIALIZED ({SUITE_SQL}),
i AS (SELECT *, CASE WHEN kind IN ('completeness', 'validity') AND value < 0.9 THEN 'HIGH' WHEN kind IN ('completeness', 'validity') AND value < 0.95 THEN 'MEDIUM' WHEN kind = 'duplicate_percent' AND value > 5 THEN 'HIGH' WHEN kind = 'duplicate_percent' AND value > 1 THEN 'MEDIUM'
  WHEN kind = 'integrity' AND value < 0.9 THEN 'HIGH' WHEN kind = 'age_days' AND value > allowed AND value > 3 THEN 'HIGH' WHEN kind = 'age_days' AND value > allowed THEN 'MEDIUM' END AS severity FROM m)
MAIN SELECT *, map {{'completeness': 'LOW_COMPLETENESS', 'validity': 'LOW_VALIDITY', 'duplicate_percent': 'DUPLICATES', 'integrity': 'REFERENTIAL_INTEGRITY', 'age_days': 'DATA_STALENESS'}}[kind] AS issue_type FROM i WHERE severity IS NOT NULL""", "value", 3)
def _(s):
    return data_quality.issues(suite(s))


@query("dq11_volume_anomalies", "logs", "WITH d AS (SELECT date AS day, count(*) AS n FROM logs GROUP BY 1)\nMAIN SELECT day, n, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd, coalesce(abs(n - avg(n) OVER w) > 3 * stddev_samp(n) OVER w, false) AS is_anomaly FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)", "mean sd")
def _(s):
    return data_quality.volume_anomalies(s.logs, "event_timestamp")


@query("j6_orphan_items", "items ord", "SELECT order_id, product_id FROM items WHERE order_id NOT IN (SELECT order_id FROM ord WHERE order_status = 'Livré')")
def _(s):
    return s.items.join(s.orders.filter("order_status = 'Livré'"), "order_id", "left_anti").select("order_id", "product_id")


@query("so3_repeat_buyers", "ord", "SELECT customer_id FROM ord WHERE has_promotion INTERSECT SELECT customer_id FROM ord WHERE NOT has_promotion")
def _(s):
    return s.orders.filter("has_promotion").select("customer_id").intersect(s.orders.filter("not has_promotion").select("customer_id"))
