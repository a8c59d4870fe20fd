"""Drivers: named gold and warehouse tables from silver datasets, and their writing."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.steps import materialize
from tidemark.operators import acquisition, attribution, forecast, marketing, products, segments, sessions, warehouse
from tidemark.sources import adapters, lake

PERIODS = ["daily", "weekly", "monthly", "quarterly", "yearly"]


class Silver:
    """The silver datasets that the drivers read, by name."""

    def __init__(self, **datasets: DataFrame):
        self.__dict__.update(datasets)

    @classmethod
    def of_tables(cls, spark: SparkSession, d: str) -> Silver:
        logs = adapters.web_logs(spark, d)
        web = sessions.web_sessions(logs)
        return cls(customers=adapters.customers(spark, d), orders=adapters.orders(spark, d), items=adapters.order_items(spark, d), ads=adapters.all_platforms(spark, d), logs=logs, web=web, web_orders=adapters.purchases(spark, d))

    @classmethod
    def of_lake(cls, spark: SparkSession, paths: lake.LakePaths, names: dict[str, str]) -> Silver:
        return cls(**{k: spark.read.parquet(paths.at("silver", v)) for k, v in names.items()})


def stored(s: Silver) -> Silver:
    """s with its datasets written to the shared folder, for work that reads them many times. A lake's are tables as it is."""
    return Silver(**{k: materialize(df) for k, df in vars(s).items()})


def silver_datasets(s: Silver, as_of: date, keep=lambda df: df) -> dict[str, DataFrame]:
    """The datasets that the quality suite checks. as_of: the day of the customers' profiles. keep: what to do with a derived dataset,
    say materialize() it."""
    trips = keep(attribution.journeys(s.web, s.web_orders))  # attribution follows from an order's row, so it isn't kept
    derived = {
        "customer_sessions": sessions.customer_sessions(s.web, s.customers), "customer_profiles": sessions.enriched_profiles(s.customers, s.orders, s.items, as_of),
        "channel_performance": attribution.channel_performance(trips, s.ads),
    }
    return {k: keep(df) for k, df in derived.items()} | {"marketing_attribution": attribution.attribution_models(trips)} | {
        "web_logs": s.logs, "customers": s.customers, "orders": s.orders, "order_items": s.items, "google_ads": s.ads.filter("platform = 'Google'"), "social_ads": s.ads.filter("platform in ('Facebook', 'Instagram', 'TikTok')"),
        "web_sessions": s.web, "web_orders": s.web_orders,
    }


def marketing_attribution(s: Silver, lookback_days: int = 30, process_date: date | None = None, days_back: int = 30) -> dict[str, DataFrame]:
    """Attribution and channel performance; with a process_date, of the orders and spend of the days_back days up to it. Sessions are
    read back to the first order's lookback."""
    if process_date is not None:
        first = process_date - timedelta(days=days_back)
        s = Silver(web=lake.read_range(s.web, "session_start", first - timedelta(days=lookback_days), process_date), web_orders=lake.read_range(s.web_orders, "order_date", first, process_date), ads=lake.read_range(s.ads, "ad_date", first, process_date))
    trips = attribution.journeys(s.web, s.web_orders, lookback_days)
    return {"marketing_attribution": attribution.attribution_models(trips), "channel_performance": attribution.channel_performance(trips, s.ads)}


def product_performance(s: Silver, as_of: date) -> dict[str, DataFrame]:
    m = products.product_metrics(s.items, s.orders, as_of, PERIODS)
    return {
        "product_metrics": m, "category_analysis": products.category_analysis(m), "product_rankings": products.product_rankings(m), "product_trends": products.product_trend(s.items, s.orders, as_of),
        "seasonality_season": products.seasonality(s.items, s.orders, "season"), "seasonality_month": products.seasonality(s.items, s.orders, "month"), "product_pairs": products.product_pairs(s.items),
        "product_conversion": products.view_conversion(s.items.withColumn("product", F.col("product_name")), s.logs),
    }


def customer_segments(s: Silver, as_of: date) -> dict[str, DataFrame]:
    r, stages = segments.rfm(s.orders, as_of), segments.lifecycle(s.orders, as_of)
    affinity = segments.product_affinity(sessions.category_preference(s.items, s.orders))
    return {"rfm_segments": r, "lifecycle_segments": stages, "combined_segments": segments.combine(r, affinity, stages, s.customers)}


def acquisition_metrics(s: Silver, as_of: date) -> dict[str, DataFrame]:
    m = acquisition.source_metrics(s.customers, s.orders, s.ads)
    attributed = marketing_attribution(s)["marketing_attribution"]
    return {
        "source_metrics": m, "new_customers": acquisition.new_customers(s.customers, m, as_of, PERIODS), "cohorts": acquisition.cohorts(s.customers, s.orders), "first_purchase_cohorts": acquisition.first_purchase_cohorts(s.customers, s.orders),
        "ltv": acquisition.ltv_by_tenure(s.customers, s.orders), "channel_effectiveness": acquisition.channel_effectiveness(attributed, s.web, s.ads),
    }


def marketing_performance(s: Silver, as_of: date) -> dict[str, DataFrame]:
    trips = attribution.journeys(s.web, s.web_orders)
    attributed = attribution.attribution_models(trips)
    m = marketing.channel_metrics(trips, s.ads, as_of, ["daily", "weekly", "monthly", "quarterly"])
    return {"channel_metrics": marketing.channel_rankings(m), "trends": marketing.channel_trend(attributed, as_of, "weekly").unionByName(marketing.channel_trend(attributed, as_of, "monthly")), "channel_comparison": marketing.channel_comparison(trips, s.ads)}


def campaign_roi(s: Silver, as_of: date) -> dict[str, DataFrame]:
    table = marketing.campaign_table(attribution.journeys(s.web, s.web_orders), s.ads, as_of, ["daily", "weekly", "monthly", "quarterly", "ytd"])
    trends = marketing.roi_trends(table)
    return {"campaign_roi": table, "platform_comparison": marketing.platform_comparison(table), "roi_trends": trends, "roi_distribution": marketing.roi_distribution(trends), "efficiency": marketing.campaign_efficiency(table), "budget": marketing.budget_allocation(table)}


def sales_forecast(s: Silver, as_of: date, days: int = 365) -> dict[str, DataFrame]:
    base = forecast.delivered(s.items, s.orders, as_of, days)
    month, by_category = forecast.sales(base, "month", False), forecast.sales(base, "month", True)
    return {
        "daily_sales": forecast.sales(base, "day", False), "daily_category_sales": forecast.sales(base, "day", True), "monthly_sales": forecast.growth(month), "monthly_category_sales": forecast.growth(by_category), "growth_trends": forecast.growth_trends(by_category),
        "seasonal_index": forecast.seasonal_index(by_category), "forecast": forecast.ols_forecast(month), "category_forecast": forecast.ols_forecast(by_category),
    }


def load_attribution(s: Silver, paths: lake.LakePaths, process_date: date, lookback_days: int = 30, days_back: int = 30) -> dict[str, DataFrame]:
    """Writes both tables for one process date; a rerun replaces that date alone. Returns what was written."""
    day = {"processing_date": F.lit(process_date)}
    tables = {k: df.withColumns(day) for k, df in marketing_attribution(s, lookback_days, process_date, days_back).items()}
    for name, df in tables.items():
        lake.write(df, paths.at("silver", name), ["processing_date", "attribution_model"])
    return tables


def load_sessions(s: Silver, paths: lake.LakePaths, process_date: date) -> None:
    """Writes web and customer sessions with the date and time of their processing."""
    stamp = {"processing_date": F.lit(process_date), "silver_updated_at": F.current_timestamp()}
    for name, df in (("web_sessions", s.web), ("customer_sessions", sessions.customer_sessions(s.web, s.customers))):
        lake.write(df.withColumns(stamp), paths.at("silver", name), ["session_year", "session_month", "session_day"])


def load_campaign_days(s: Silver, paths: lake.LakePaths, process_date: date, days_back: int = 30) -> None:
    """Writes the daily partials of the days_back days up to process_date, each day a partition; a rerun replaces those days."""
    attributed = marketing_attribution(s, process_date=process_date, days_back=days_back)["marketing_attribution"]
    ads = lake.read_range(s.ads, "ad_date", process_date - timedelta(days=days_back), process_date)
    for name, df in zip(("campaign_order_days", "campaign_spend_days"), marketing.campaign_days(attributed, ads), strict=True):
        lake.write(df, paths.at("gold", name), ["day"])


def campaign_periods_of_lake(spark: SparkSession, paths: lake.LakePaths, as_of: date, names: list[str] = PERIODS) -> DataFrame:
    """Campaigns by period, put together from the stored days."""
    return marketing.campaign_periods_of_days(*[spark.read.parquet(paths.at("gold", n)) for n in ("campaign_order_days", "campaign_spend_days")], as_of, names)


def load_profiles(s: Silver, paths: lake.LakePaths, as_of: date) -> None:
    """Writes the customers' profiles with the time of their making, by which the quality suite judges how fresh they are."""
    profiles = sessions.enriched_profiles(s.customers, s.orders, s.items, as_of).withColumn("profile_updated_at", F.current_timestamp())
    lake.write(profiles, paths.at("silver", "customer_profiles"), ["profile_lifecycle_stage"])


def load_warehouse(spark: SparkSession, s: Silver, subject: str, as_of: date, fmt: str = "parquet", **options: str) -> list[str]:
    """Loads one subject's facts and dimensions into the warehouse; the names of the tables loaded."""
    build, dimensions = SUBJECTS[subject]
    tables = warehouse_tables(spark, s, build(s, as_of), as_of)
    chosen = [n for n in tables if n.startswith("FACT_") or n in dimensions]
    for n in chosen:
        lake.to_warehouse(tables[n], n.lower(), fmt, **options)
    return chosen


PARTITIONS = {"marketing_attribution": ["attribution_model"], "channel_performance": ["attribution_model"], "product_metrics": ["time_period"], "category_analysis": ["time_period"], "product_rankings": ["time_period"], "new_customers": ["time_period"], "channel_metrics": ["time_period"], "campaign_roi": ["time_period"]}


#: tables that reports read from top to bottom
ORDERS = {
    "daily_sales": ["order_date"], "daily_category_sales": ["order_date", "category"], "monthly_sales": ["month_idx"], "monthly_category_sales": ["month_idx", "category"],
    "cohorts": ["cohort", "months_since"], "first_purchase_cohorts": ["cohort"], "ltv": ["acquisition_source", "tenure_order"], "forecast": ["month_idx"], "category_forecast": ["category", "month_idx"],
}


def write_tables(tables: dict[str, DataFrame], paths: lake.LakePaths, zone: str = "gold") -> None:
    """Writes each table, those of ORDERS in their order."""
    for name, df in tables.items():
        if name in ORDERS:
            lake.write_sorted(df, paths.at(zone, name), ORDERS[name], PARTITIONS.get(name))
        else:
            lake.write(df, paths.at(zone, name), PARTITIONS.get(name))


def warehouse_tables(spark: SparkSession, s: Silver, gold: dict[str, DataFrame], as_of: date) -> dict[str, DataFrame]:
    """Facts and dimensions of the gold tables that are given. as_of: the day of the load."""
    facts = {
        "FACT_CHANNEL_PERFORMANCE": "channel_metrics", "FACT_MARKETING_TRENDS": "trends", "FACT_CHANNEL_COMPARISON": "channel_comparison", "FACT_PRODUCT_PERFORMANCE": "product_rankings", "FACT_PRODUCT_TRENDS": "product_trends",
        "FACT_CATEGORY_PERFORMANCE": "category_analysis", "FACT_PRODUCT_CONVERSION": "product_conversion", "FACT_CUSTOMER_SEGMENTS": "combined_segments", "FACT_RFM_SEGMENTS": "rfm_segments", "FACT_LIFECYCLE_SEGMENTS": "lifecycle_segments", "FACT_CAMPAIGN_PERFORMANCE": "campaign_roi",
        "FACT_CAMPAIGN_CHANNEL_COMPARISON": "platform_comparison", "FACT_CAMPAIGN_ROI_TRENDS": "roi_trends", "FACT_CAMPAIGN_BUDGET_ALLOCATION": "budget",
    }
    out = {f: warehouse.fact(gold[g], f, as_of) for f, g in facts.items() if g in gold}
    return out | {
        "DIM_MARKETING_DATE": warehouse.date_dimension(s.ads, "ad_date"), "DIM_MARKETING_CHANNEL": warehouse.channel_dimension(s.logs), "DIM_MARKETING_CAMPAIGN": warehouse.marketing_campaign_dimension(s.logs),
        "DIM_PRODUCT": warehouse.product_dimension(s.items), "DIM_CATEGORY": warehouse.category_dimension(s.items), "DIM_CUSTOMER": warehouse.customer_dimension(s.customers), "DIM_SEGMENT": warehouse.segment_dimension(spark),
        "DIM_CAMPAIGN": warehouse.campaign_dimension(s.ads), "DIM_PLATFORM": warehouse.platform_dimension(s.ads),
    }


#: subject -> (gold tables, dimensions)
SUBJECTS = {
    "marketing_performance": (marketing_performance, ["DIM_MARKETING_DATE", "DIM_MARKETING_CHANNEL", "DIM_MARKETING_CAMPAIGN"]),
    "product_performance": (product_performance, ["DIM_PRODUCT", "DIM_CATEGORY"]),
    "customer_segments": (customer_segments, ["DIM_CUSTOMER", "DIM_SEGMENT"]),
    "campaign_roi": (campaign_roi, ["DIM_CAMPAIGN", "DIM_PLATFORM"]),
}
