"""Gold channel and campaign tables."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import bands, change_percent, ladder, ratio, trend_label
from tidemark.functions.periods import ALL_DAYS, adjacent, by_period, periods
from tidemark.functions import partials
from tidemark.functions.ranks import dense_ranks_of_all
from tidemark.functions.steps import materialize
from tidemark.operators.attribution import TOUCH, sums

CHANNEL = ["attribution_model", "utm_source", "utm_medium", "utm_campaign"]


def roi(revenue: str, cost: str):
    return F.when(F.col(cost) > 0, (F.col(revenue) - F.col(cost)) / F.col(cost))


def channel_metrics(rows: DataFrame, ads: DataFrame, as_of: date, names: list[str]) -> DataFrame:
    """Per period, model and channel. Spend is that of the same period and of the channel's campaigns, summed before the join.
    rows: as for attribution.sums()."""
    keyed = ["time_period", *CHANNEL]
    by_campaign = sums(rows, TOUCH, as_of, names, distinct=False).select(*keyed, "campaign_id", "conversions", "revenue")
    orders = sums(rows, TOUCH[:3], as_of, names).select(*[F.col(c).alias(f"of_{c}") for c in keyed], "unique_orders", "unique_users")
    total = [F.sum(c).alias(c) for c in ("cost", "impressions", "clicks")]
    spend = by_period(ads, "ad_date", as_of, names).groupBy("time_period", "campaign_id").agg(*total)
    out = by_campaign.join(spend, ["time_period", "campaign_id"], "left").groupBy(*keyed).agg(F.sum("conversions").alias("conversions"), F.sum("revenue").alias("revenue"), *total)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keyed])
    out = out.join(orders, same).select(*keyed, "conversions", "revenue", "unique_orders", "unique_users", "cost", "impressions", "clicks")
    return out.withColumns({"roas": ratio("revenue", "cost"), "roi": roi("revenue", "cost"), "cpa": ratio("cost", "conversions"), "cpc": ratio("cost", "clicks"), "conversion_rate": ratio("conversions", "clicks")})


def channel_rankings(metrics: DataFrame) -> DataFrame:
    """Four dense ranks within period and model, their mean and its tier."""
    w = Window.partitionBy("time_period", "attribution_model")
    rank = lambda c: F.dense_rank().over(w.orderBy(F.desc_nulls_last(F.round(c, 6))))
    ranks = {"roi_rank": "roi", "roas_rank": "roas", "revenue_rank": "revenue", "conversion_rank": "conversions"}
    out = metrics.withColumns({k: rank(c) for k, c in ranks.items()})
    out = out.withColumn("performance_score", sum(F.col(k) for k in ranks) / 4)
    score = F.col("performance_score")
    # fixed values: tiers of the reports
    return out.withColumn("performance_tier", ladder([(score <= 3, "Top Performer"), (score <= 7, "Strong Performer"), (score <= 12, "Average Performer")], "Under Performer"))


def channel_trend(attributed: DataFrame, as_of: date, name: str) -> DataFrame:
    """A period against the adjacent one before it: one scan, conditional sums, no join; null channels match."""
    (a, b), (p, q) = adjacent(as_of, name)
    day = F.to_date("order_date")
    now, before = day.between(F.lit(a), F.lit(b)), day.between(F.lit(p), F.lit(q))
    both = lambda label, x: [F.coalesce(F.sum(F.when(now, x)), F.lit(0)).alias(f"current_{label}"), F.coalesce(F.sum(F.when(before, x)), F.lit(0)).alias(f"previous_{label}")]
    out = attributed.filter(now | before).groupBy(*CHANNEL).agg(*both("revenue", F.col("attributed_revenue")), *both("conversions", F.lit(1)))
    for c in ("revenue", "conversions"):
        out = out.withColumns({f"{c}_change": F.col(f"current_{c}") - F.col(f"previous_{c}"), f"{c}_growth": change_percent(f"current_{c}", f"previous_{c}")})
    dates = {"current_start": a, "current_end": b, "previous_start": p, "previous_end": q}
    return out.withColumns({"trend_period": F.lit(name), **{k: F.lit(v) for k, v in dates.items()}, "trend": trend_label(F.round("revenue_growth", 9))})


def channel_comparison(rows: DataFrame, ads: DataFrame) -> DataFrame:
    """rows: as for attribution.sums()."""
    by = sums(rows, ["utm_source", "utm_medium", "campaign_id"], distinct=False)
    spend = ads.groupBy("campaign_id").agg(F.sum("cost").alias("cost"))
    out = by.join(spend, "campaign_id", "left").groupBy("attribution_model", "utm_source", "utm_medium").agg(F.sum("conversions").alias("conversions"), F.sum("revenue").alias("revenue"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    w = Window.partitionBy("attribution_model")
    out = out.withColumns({f"{c}_share": ratio(c, F.sum(c).over(w), 0.0, 100) for c in ("revenue", "conversions", "cost")})
    return out.withColumn("efficiency_index", F.when(F.col("cost_share") > 0, F.col("revenue_share") / F.col("cost_share")).when(F.col("revenue_share") > 0, 999.0).otherwise(0.0))


# ---- campaigns ------------------------------------------------------------------------------------------------------


def _campaigns(rows: DataFrame, as_of: date | None = None, names: list[str] | None = None) -> DataFrame:
    """Orders and revenue by campaign and model. rows: as for attribution.sums()."""
    return sums(rows, ["utm_campaign"], as_of, names).filter("utm_campaign is not null").withColumnRenamed("utm_campaign", "campaign_name").withColumn("aov", F.col("revenue") / F.nullif(F.col("valued"), F.lit(0)))


def campaign_performance(rows: DataFrame, ads: DataFrame) -> DataFrame:
    """Campaign x model, full outer with spend by campaign name. rows: as for attribution.sums()."""
    return _with_all_spend(_campaigns(rows), ads)


def _with_all_spend(per: DataFrame, ads: DataFrame) -> DataFrame:
    per = per.select("campaign_name", "attribution_model", F.col("unique_orders").alias("orders"), F.col("unique_users").alias("customers"), "revenue", F.col("aov").alias("avg_order_value"))
    spend = ads.filter("campaign_name is not null").groupBy("campaign_name").agg(
        F.min("platform").alias("platform"), F.sum("cost").alias("cost"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("conversions").alias("tracked_conversions"))
    out = per.join(spend, "campaign_name", "full_outer").withColumns({"roas": ratio("revenue", "cost"), "roi": roi("revenue", "cost"), "ctr_percent": ratio("clicks", "impressions", None, 100), "cpc": ratio("cost", "clicks")})
    done = F.when(F.col("orders") > 0, F.col("orders")).otherwise(F.col("tracked_conversions"))
    return out.withColumns({"cpa": ratio("cost", done), "conversion_percent": ratio(done, "clicks", None, 100)})


def campaign_days(attributed: DataFrame, ads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily partials of orders by campaign and model, with sketches of orders and customers, and of spend by campaign."""
    named = attributed.filter("utm_campaign is not null").withColumnRenamed("utm_campaign", "campaign_name")
    orders = partials.daily(named, "order_date", ["campaign_name", "attribution_model"], ["attributed_revenue"], ["order_id", "user_id"])
    return orders, partials.daily(ads.filter("campaign_name is not null"), "ad_date", ["campaign_name"], ["cost", "impressions", "clicks", "conversions"], [])


def campaign_periods_of_days(orders: DataFrame, spend: DataFrame, as_of: date, names: list[str]) -> DataFrame:
    """campaign_periods() of campaign_days(), with distinct counts by sketches: a row a day is read, not the orders."""
    per = partials.over_periods(orders, as_of, names, ["campaign_name", "attribution_model"])
    per = per.select("time_period", "campaign_name", "attribution_model", F.col("count_order_id").alias("period_orders"), F.col("count_user_id").alias("period_customers"), F.col("attributed_revenue").alias("period_revenue"), (F.col("attributed_revenue") / F.col("n")).alias("period_aov"))
    spent = partials.over_periods(spend, as_of, names, ["campaign_name"]).drop("n")
    return _with_spend(per, spent.withColumnsRenamed(PERIOD_SPEND), as_of, names)


def campaign_periods(rows: DataFrame, ads: DataFrame, as_of: date, names: list[str], approximate: bool = False) -> DataFrame:
    """Period x campaign x model, full outer with the period's spend: all periods in one scan. Distinct counts are exact unless
    asked otherwise: then they come from daily sketches. Spend of a campaign without orders in the period has a null model.
    rows: as for attribution.sums(), for sketches attribution_models()."""
    if approximate:
        return campaign_periods_of_days(*campaign_days(rows, ads), as_of, names)
    return _with_period_spend(_campaigns(rows, as_of, names), ads, as_of, names)


def _with_period_spend(per: DataFrame, ads: DataFrame, as_of: date, names: list[str]) -> DataFrame:
    per = per.select("time_period", "campaign_name", "attribution_model", F.col("unique_orders").alias("period_orders"), F.col("unique_users").alias("period_customers"), F.col("revenue").alias("period_revenue"), F.col("aov").alias("period_aov"))
    spend = by_period(ads.filter("campaign_name is not null"), "ad_date", as_of, names).groupBy("time_period", "campaign_name").agg(*[F.sum(c).alias(k) for c, k in PERIOD_SPEND.items()])
    return _with_spend(per, spend, as_of, names)


def campaign_table(rows: DataFrame, ads: DataFrame, as_of: date, names: list[str]) -> DataFrame:
    """campaign_roi() of campaign_performance() and campaign_periods(), from one pass over rows and one over ads: what is written for
    it to read again are sums by campaign, and spend by day and campaign. rows: as for attribution.sums()."""
    per, ads = materialize(_campaigns(rows, as_of, [*names, ALL_DAYS])), materialize(ads)
    whole = F.col("time_period") == ALL_DAYS
    return campaign_roi(_with_all_spend(per.filter(whole), ads), _with_period_spend(per.filter(~whole), ads, as_of, names))


PERIOD_SPEND = {"cost": "period_cost", "impressions": "period_impressions", "clicks": "period_clicks", "conversions": "period_tracked_conversions"}


def _with_spend(per: DataFrame, spend: DataFrame, as_of: date, names: list[str]) -> DataFrame:
    both = per.join(spend, ["time_period", "campaign_name"], "full_outer").withColumns({"period_roas": ratio("period_revenue", "period_cost"), "period_roi": roi("period_revenue", "period_cost")})
    return both.join(F.broadcast(periods(per.sparkSession, as_of, names)), "time_period")  # a handful of rows


def roi_class(x):
    # fixed values: classes of the reports
    return ladder([(x.isNull(), "Unknown"), (x >= 2, "Excellent (200%+ ROI)"), (x >= 1, "Very Good (100-200% ROI)"), (x >= 0.5, "Good (50-100% ROI)"), (x >= 0, "Break-even (0-50% ROI)"), (x >= -0.5, "Poor (-50-0% ROI)")], "Very Poor (< -50% ROI)")


def campaign_roi(overall: DataFrame, by_time: DataFrame) -> DataFrame:
    """Each campaign and model with its periods; ranks and class are those of the period."""
    t = by_time.withColumnsRenamed({"campaign_name": "of_campaign", "attribution_model": "of_model"})
    same = (F.col("campaign_name") == F.col("of_campaign")) & F.col("attribution_model").eqNullSafe(F.col("of_model"))
    out = overall.join(t, same, "left").drop("of_campaign", "of_model")
    w = Window.partitionBy("time_period", "attribution_model")
    rank = lambda c, d: F.dense_rank().over(w.orderBy(F.desc_nulls_last(F.round(c, d))))
    return out.withColumns({"roi_rank": rank("period_roi", 6), "revenue_rank": rank("period_revenue", 2), "roi_class": roi_class(F.col("period_roi"))})


def platform_comparison(table: DataFrame) -> DataFrame:
    """Platform x period x model: sums of the period's columns, so that a campaign's spend and revenue count once in each row."""
    keys = ["platform", "time_period", "period_start", "period_end", "attribution_model"]
    sums = {"period_cost": "channel_cost", "period_revenue": "channel_revenue", "period_impressions": "channel_impressions", "period_clicks": "channel_clicks", "period_orders": "channel_orders"}
    out = table.filter("platform is not null and time_period is not null").groupBy(*keys).agg(*[F.sum(c).alias(k) for c, k in sums.items()], F.count("campaign_name").alias("campaign_count"), F.avg("period_roi").alias("avg_campaign_roi"))
    out = out.withColumns({
        "channel_roi": roi("channel_revenue", "channel_cost"), "channel_ctr": ratio("channel_clicks", "channel_impressions", None, 100),
        "channel_cpa": ratio("channel_cost", "channel_orders"), "channel_conversion_rate": ratio("channel_orders", "channel_clicks", None, 100),
    })
    return out.withColumn("roi_rank", F.dense_rank().over(Window.partitionBy("time_period", "attribution_model").orderBy(F.desc_nulls_last(F.round("channel_roi", 6)))))


MONTH = ["platform", "attribution_model", "campaign_name", "period_cost", "period_revenue", "period_roi", "time_period", "period_start", "period_end"]


def roi_trends(table: DataFrame) -> DataFrame:
    """Monthly rows that have a ROI, ranked within their platform."""
    rank = F.dense_rank().over(Window.partitionBy("platform").orderBy(F.desc_nulls_last(F.round("period_roi", 6))))
    rows = table.filter("time_period = 'monthly' and campaign_name is not null and period_roi is not null").select(*MONTH)
    # fixed values: bands of the reports
    return rows.withColumns({"roi_rank_in_channel": rank, "roi_quality": bands(F.col("period_roi"), [(1, "High ROI"), (0, "Positive ROI"), (-0.5, "Negative ROI")], "Poor ROI")})


def roi_distribution(trends: DataFrame) -> DataFrame:
    names = {"High ROI": "high", "Positive ROI": "positive", "Negative ROI": "negative", "Poor ROI": "poor"}
    out = trends.groupBy("platform", "time_period", "period_start", "period_end").agg(F.count("campaign_name").alias("campaign_count"), *[F.count_if(F.col("roi_quality") == k).alias(f"{v}_roi_campaigns") for k, v in names.items()])
    out = out.withColumns({f"{v}_roi_percentage": ratio(f"{v}_roi_campaigns", "campaign_count", 0.0, 100) for v in ("high", "positive")})
    high, positive = F.col("high_roi_percentage"), F.col("positive_roi_percentage")
    # fixed values: health of the reports
    return out.withColumn("platform_health", ladder([(high >= 50, "Excellent"), (high >= 30, "Good"), (high + positive >= 50, "Average")], "Poor"))


# fixed values: what a campaign should mend, by the first score that is low
FOCUS = {
    "cpc_score": "Optimize for lower CPC", "cvr_score": "Improve conversion rate", "cpm_score": "Refine targeting for better CPM",
    "cpo_score": "Reduce cost per order", "rpc_score": "Increase revenue per customer",
}


def campaign_efficiency(table: DataFrame) -> DataFrame:
    """Monthly costs and rates against the platform's means; a missing score counts as 1. Means are over rows that have all of
    cpm, cost per click and order, and conversion rate. table: campaign_roi()."""
    rows = table.filter("time_period = 'monthly'").select(*MONTH, "period_impressions", "period_clicks", "period_orders", "period_customers")
    cost = lambda c, scale=1.0: ratio("period_cost", c, None, scale)
    rows = rows.withColumns({
        "cost_per_impression": cost("period_impressions", 1000), "cost_per_click": cost("period_clicks"), "cost_per_order": cost("period_orders"), "cost_per_customer": cost("period_customers"),
        "conversion_rate": ratio("period_orders", "period_clicks", None, 100), "revenue_per_click": ratio("period_revenue", "period_clicks"), "revenue_per_customer": ratio("period_revenue", "period_customers"),
    })
    of = {"cpm": "cost_per_impression", "cpc": "cost_per_click", "cpo": "cost_per_order", "cvr": "conversion_rate", "rpc": "revenue_per_customer"}
    means = rows.dropna(subset=[of[k] for k in ("cpm", "cpc", "cpo", "cvr")]).groupBy("platform").agg(*[F.avg(c).alias(f"avg_{k}") for k, c in of.items()])
    out = rows.join(means, "platform", "left")
    for k, c in of.items():
        over = F.col(f"avg_{k}") / F.nullif(F.col(c), F.lit(0.0)) if k in ("cpm", "cpc", "cpo") else F.col(c) / F.col(f"avg_{k}")
        out = out.withColumn(f"{k}_score", F.when(F.col(f"avg_{k}") > 0, over))
    out = out.withColumn("efficiency_score", sum(F.coalesce(f"{k}_score", F.lit(1.0)) for k in of) / 5)
    # fixed values: ratings of the reports
    rating = bands(F.col("efficiency_score"), [(1.5, "Excellent"), (1.2, "Good"), (0.8, "Average"), (0.5, "Below Average")], "Poor")
    return out.withColumns({"efficiency_rating": rating, "efficiency_focus_area": ladder([(F.col(k) < 0.8, v) for k, v in FOCUS.items()], "Maintain current performance")})


def budget_allocation(table: DataFrame) -> DataFrame:
    """Shares of the month's budget over all rows with a cost and a ROI, and shares shifted towards high ROI. table: campaign_roi()."""
    rows = table.filter("time_period = 'monthly' and period_roi is not null and period_cost is not null").select(*MONTH)
    r = F.col("period_roi")
    # fixed values: factors of the reports
    factor = F.when(r > 2, 1.5).when(r > 1, 1.25).when(r > 0.5, 1.1).when(r > 0, 1.0).when(r > -0.5, 0.75).otherwise(0.5)
    rows = rows.withColumn("budget_reallocation_factor", factor).withColumn("adjusted_budget", F.col("period_cost") * F.col("budget_reallocation_factor"))
    whole = rows.agg(F.sum("period_cost").alias("all_cost"), F.sum("period_revenue").alias("all_revenue"), F.sum("adjusted_budget").alias("all_adjusted"))
    out = rows.join(F.broadcast(whole))  # one row
    out = out.withColumns({"current_budget_share": ratio("period_cost", "all_cost", 0.0, 100), "revenue_contribution": ratio("period_revenue", "all_revenue", 0.0, 100)})
    out = out.withColumn("suggested_budget_share", F.coalesce(ratio("adjusted_budget", "all_adjusted", None, 100), "current_budget_share"))
    out = out.withColumn("suggested_budget_change", F.col("suggested_budget_share") - F.col("current_budget_share")).drop("all_cost", "all_revenue", "all_adjusted")
    out = dense_ranks_of_all(out.withColumn("_roi", F.round("period_roi", 6)), [([], "_roi", "roi_rank")]).drop("_roi")
    x = F.round("suggested_budget_change", 6)
    # fixed values: recommendations of the reports
    return out.withColumn("allocation_recommendation", ladder([(x > 5, "Significantly Increase Budget"), (x > 2, "Increase Budget"), (x < -5, "Significantly Decrease Budget"), (x < -2, "Decrease Budget")], "Maintain Current Budget"))
