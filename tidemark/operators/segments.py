"""Customer segments: RFM quintiles, product affinity, lifecycle, k-means, and what to do about them."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import ladder, mapped
from tidemark.functions.ranks import ntiles_of_all
from tidemark.functions.steps import discard, materialize

# fixed values: segments of the reports
AFFINITY = {"soin_visage": "Facial Care Enthusiast", "soin_corps": "Body Care Focused", "soin_cheveux": "Hair Care Passionate", "maquillage": "Makeup Aficionado", "parfum": "Fragrance Collector"}


def customer_totals(orders: DataFrame, as_of: date) -> DataFrame:
    return orders.groupBy("customer_id").agg(F.date_diff(F.lit(as_of), F.max("order_date")).alias("recency_days"), F.count("*").alias("frequency"), F.sum("final_total").alias("monetary"), F.date_diff(F.lit(as_of), F.min("order_date")).alias("days_since_first"))


def rfm_label(r, f, m):
    # fixed values: segments of the reports
    return ladder([
        ((r <= 2) & (f <= 2) & (m <= 2), "Champions"), ((r <= 2) & (f <= 3) & (m <= 3), "Loyal Customers"), ((r <= 3) & (f <= 1) & (m <= 2), "Potential Loyalists"), ((r <= 2) & (f >= 4) & (m <= 2), "Recent Customers"),
        ((r <= 3) & (f >= 4) & (m >= 4), "Promising"), ((r >= 4) & (f <= 2) & (m <= 2), "Customers Needing Attention"), ((r >= 4) & (f <= 2) & (m >= 3), "At Risk"), ((r >= 4) & (f >= 3) & (m <= 3), "Can't Lose Them"),
        ((r >= 4) & (f >= 4) & (m >= 4), "Lost"), ((r >= 3) & (f >= 3) & (m >= 3), "Hibernating"),
    ], "Unknown")


def rfm(orders: DataFrame, as_of: date) -> DataFrame:
    """Quintiles with 1 best; ties by customer_id. Sums are compared at cents, so equal sums tie."""
    totals = customer_totals(orders, as_of).withColumn("monetary", F.round("monetary", 2))
    out = ntiles_of_all(totals, 5, {"recency_score": ("recency_days", False), "frequency_score": ("frequency", True), "monetary_score": ("monetary", True)}, "customer_id")
    r, f, m = (F.col(f"{x}_score") for x in ("recency", "frequency", "monetary"))
    return out.withColumns({"rfm_score": r + f + m, "rfm_segment": rfm_label(r, f, m)})


def product_affinity(preferences: DataFrame) -> DataFrame:
    """preferences: category_preference()."""
    return preferences.withColumn("product_affinity_segment", mapped(F.col("primary_category"), AFFINITY, "Mixed Category Shopper"))


def _stages(totals: DataFrame) -> DataFrame:
    n, last, first = F.col("frequency"), F.col("recency_days"), F.col("days_since_first")
    stage = ladder([((n == 1) & (first <= 30), "New Customer"), ((last <= 90) & (n > 1), "Active Customer"), (last.between(91, 180), "At-Risk Customer"), (last.between(181, 365), "Lapsed Customer"), (last > 365, "Lost Customer")], "Unknown")
    often = ladder([(n == 1, "One-Time Buyer"), (n <= 3, "Occasional Buyer"), (n <= 6, "Regular Buyer")], "Frequent Buyer")
    return totals.withColumns({"lifecycle_stage": stage, "purchase_frequency_segment": often})


def lifecycle(orders: DataFrame, as_of: date) -> DataFrame:
    """Value by quartile of spend."""
    totals = customer_totals(orders, as_of).withColumn("monetary", F.round("monetary", 2))
    out = ntiles_of_all(_stages(totals), 4, {"value_quartile": ("monetary", True)}, "customer_id")
    return out.withColumn("customer_value_segment", mapped(F.col("value_quartile"), {1: "Premium Value", 2: "High Value", 3: "Medium Value", 4: "Low Value"}))


def lifecycle_by_threshold(orders: DataFrame, as_of: date) -> DataFrame:
    """Value by half-open bands of spend."""
    m = F.col("monetary")
    value = ladder([(m <= 10_000, "Low Value"), (m <= 50_000, "Medium Value"), (m <= 150_000, "High Value")], "Premium Value")
    return _stages(customer_totals(orders, as_of)).withColumn("customer_value_segment", value)


UNITS, GRID = 100, 1000  #: steps of a feature that are told apart, and of a standard deviation
FEATURES = ("recency_days", "frequency", "monetary", "avg_order_value", "days_since_first")


def kmeans_clusters(totals: DataFrame, features: list[str] | None = None, k: int = 5, rounds: int = 10, by_id: str = "customer_id") -> DataFrame:
    """Clusters of standardised features (missing ones are dropped, nulls are 0) with a label from the cluster's means.

    Everything is summed in whole numbers: features in hundredths, standardised ones in thousandths, so clusters don't depend on how
    rows are partitioned. The first centre is the row whose id has the smallest hash, each further one the row farthest from all
    before (of equal ones, by hash); then each round moves the centres to the means of their rows, `rounds` times or until they stay.
    A centre without rows stays where it is. Each step is one aggregation, of which the driver gets k rows at most.
    """
    used = [f for f in features or FEATURES if f in totals.columns]
    whole = totals.select(by_id, *[F.round(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * UNITS).cast("long").alias(f) for f in used])
    big = lambda c: F.col(c).cast("decimal(38,0)")
    moments = whole.agg(F.count("*").alias("n"), *[F.sum(big(f)).alias(f"s_{f}") for f in used], *[F.sum(big(f) * F.col(f)).alias(f"q_{f}") for f in used]).first()
    n, scaled = moments["n"], {}
    for f in used:
        total, squares = int(moments[f"s_{f}"] or 0), int(moments[f"q_{f}"] or 0)
        deviation = ((n * squares - total * total) / (n * n)) ** 0.5 if n else 0.0
        scaled[f] = F.floor((F.col(f) * n - F.lit(total)).cast("double") / F.lit(n * deviation) * GRID + 0.5).cast("long") if deviation else F.lit(0).cast("long")
    rows = materialize(whole.select(by_id, F.md5(F.col(by_id).cast("string").cast("binary")).alias("hash"), *[scaled[f].alias(f) for f in used]))
    apart = lambda centre: reduce(add, [(F.col(f) - c) * (F.col(f) - c) for f, c in zip(used, centre, strict=True)])
    nearest = lambda centres: F.array_min(F.array(*[F.struct(apart(c).alias("d"), F.lit(j).alias("cluster")) for j, c in enumerate(centres)]))

    point, centres = F.struct(*used), []
    for j in range(min(k, n)):
        order = F.struct((-nearest(centres)["d"] if j else F.lit(0).cast("long")).alias("d"), F.col("hash"), F.col(by_id))
        centres.append(tuple(rows.agg(F.min_by(point, order)).first()[0]))
    for _ in range(rounds if centres else 0):
        sums = rows.groupBy(nearest(centres)["cluster"].alias("cluster")).agg(*[F.floor(F.sum(f).cast("decimal(38,0)") / F.count("*")).cast("long") for f in used]).collect()  # k rows
        moved = [next((tuple(r)[1:] for r in sums if r[0] == j), c) for j, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    assigned = (rows.select(by_id, nearest(centres)["cluster"].alias("cluster")) if centres else rows.select(by_id, F.lit(0).alias("cluster"))).join(whole, by_id)
    mean = lambda f: (F.sum(f).cast("double") / F.count("*") / UNITS).alias(f"mean_{f}")
    means = assigned.groupBy("cluster").agg(F.count("*").alias("cluster_size"), *[mean(f) for f in used])
    r, f, m = F.col("mean_recency_days"), F.col("mean_frequency"), F.col("mean_monetary")
    label = ladder([((r < 30) & (f > 5) & (m > 100_000), "High Value Active"), ((r < 30) & (f > 3), "Active Regular"), ((r > 90) & (f > 3), "Lapsed High Potential"), (f <= 2, "New or Occasional")], "Medium Value")
    found = means.withColumn("cluster_label", label).collect()  # k rows
    discard(rows)
    schema = "cluster int, cluster_size long, " + ", ".join(f"mean_{f} double" for f in used) + ", cluster_label string"
    at = nearest(centres)["cluster"] if centres else F.lit(0)
    placed = totals.join(whole.withColumns(scaled).select(by_id, at.alias("cluster")), by_id)
    return placed.join(F.broadcast(totals.sparkSession.createDataFrame([tuple(x) for x in found], schema)), "cluster")


def combine(rfm_segments: DataFrame | None, affinity: DataFrame | None, stages: DataFrame | None, customers: DataFrame) -> DataFrame:
    """All customers with their segments and recommendations; a missing set of segments is typed nulls."""
    out = customers.select("customer_id")
    for df, cols in ((rfm_segments, ["rfm_score", "rfm_segment"]), (affinity, ["primary_category", "product_affinity_segment"]), (stages, ["lifecycle_stage", "purchase_frequency_segment", "customer_value_segment"])):
        out = out.join(df.select("customer_id", *cols), "customer_id", "left") if df is not None else out.withColumns({c: F.lit(None).cast("int" if c == "rfm_score" else "string") for c in cols})
    stage, seg, value = F.col("lifecycle_stage"), F.col("rfm_segment"), F.col("customer_value_segment")
    # fixed values: recommendations of the reports
    message = ladder([
        (stage == "New Customer", "Welcome Series + Cross-Sell Related Products"), ((stage == "Active Customer") & (seg == "Champions"), "VIP Program + Early Access to New Products"),
        ((stage == "Active Customer") & (seg == "Loyal Customers"), "Loyalty Rewards + Personalized Recommendations"), (stage == "At-Risk Customer", "Re-engagement Campaign + Special Offer"),
        (stage == "Lapsed Customer", "Win-Back Campaign + Discount"), (stage == "Lost Customer", "Reactivation Campaign + Survey"), (seg == "Potential Loyalists", "Nurture Campaign + Second Purchase Incentive"),
        (seg == "Customers Needing Attention", "Targeted Content + Product Education"), (seg == "At Risk", "Special Offer + Personalized Communication"), (seg == "Can't Lose Them", "Deep Discount + Personal Outreach"),
    ], "Standard Marketing Communications")
    channel = ladder([
        (seg.isin("Champions", "Loyal Customers", "Potential Loyalists"), "Direct Email + SMS"), (stage.isin("At-Risk Customer", "Lapsed Customer"), "Retargeting Ads + Email"),
        (value == "Premium Value", "Personal Outreach + Direct Mail"), (value == "High Value", "Email + Social Media Ads"),
    ], "Email + General Advertising")
    return out.withColumns({"marketing_recommendation": message, "preferred_channel_recommendation": channel})


# fixed values: bands of customers' age in days, each below its bound
TENURES = [(30, "0-30 days"), (90, "31-90 days"), (180, "91-180 days"), (365, "181-365 days")]


def tenure_bucket(days):
    return ladder([(days < n, label) for n, label in TENURES], "365+ days")
