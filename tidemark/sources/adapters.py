"""The shop's datasets derived from the benchmark tables, so that every operator runs on the given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import mapped

# fixed values: the shop's names for what the tables hold
SOURCES = {"AUTOMOBILE": "Google", "BUILDING": "Facebook", "FURNITURE": "Instagram", "HOUSEHOLD": "TikTok", "MACHINERY": "Influencer"}
CATEGORIES = {"ECONOMY": "soin_visage", "STANDARD": "soin_corps", "SMALL": "soin_cheveux", "MEDIUM": "maquillage", "LARGE": "parfum", "PROMO": "homme"}
STATUS = {"F": "Livré", "O": "En cours", "P": "Annulé"}
SEASONS = {9: "tabaski", 10: "tabaski", 4: "ramadan", 12: "fin_annee", 1: "fin_annee", 2: "soldes", 7: "soldes"}
EVENTS = {"view": "product_view", "click": "add_to_cart", "signup": "begin_checkout", "purchase": "purchase", "error": "page_view"}
UTM = dict(enumerate(["google", "facebook", "instagram", "tiktok", "influencer"]))
MEDIA = dict(enumerate(["cpc", "social", "email"]))
CAMPAIGNS = dict(enumerate(["ramadan_2025", "tabaski_promo", "beaute_naturelle", "lancement_produit"]))
PLATFORMS = dict(enumerate(["Google", "Facebook", "Instagram", "TikTok", "Influencer_YouTube"]))


def campaign_name(k: Column) -> Column:
    """A theme and the place where it runs, so that a campaign has one platform."""
    return F.concat_ws("_", mapped(k % 4, CAMPAIGNS), mapped(k % 5, UTM))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.count("*").alias("total_orders"), F.sum("o_totalprice").alias("lifetime_value"))
    base = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return base.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@shop.example")).alias("email"),
        F.col("n_name").alias("city"), F.col("r_name").alias("region"), F.expr("date_sub(to_date(first), cast(c_custkey % 400 as int))").alias("registration_date"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"), F.coalesce("lifetime_value", F.lit(0.0)).alias("lifetime_value"), mapped(F.col("c_mktsegment"), SOURCES).alias("acquisition_source"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("final_total"),
        mapped(F.col("o_orderstatus"), STATUS).alias("order_status"), F.col("o_orderpriority").alias("payment_method"), mapped(F.month("o_orderdate"), SEASONS, "normal").alias("season"),
        (k % 5 < 2).alias("has_promotion"), F.when(k % 10 < 7, mapped((k % 5).cast("int"), UTM)).alias("utm_source"),
    )


def order_items(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    parts = read(spark, d, "part").select("p_partkey", "p_name", mapped(F.col("p_type"), CATEGORIES).alias("category"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("p_name").alias("product_name"), "category",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("item_total"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def web_logs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
    k, tagged = F.col("k"), F.col("k") % 10 != 9
    return e.select(
        "event_id", mapped(F.col("event_type"), EVENTS).alias("event_type"), F.col("ts").alias("event_timestamp"), F.to_date("ts").alias("date"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"), "user_id", (k % 3 == 0).alias("is_authenticated"),
        F.when(k % 3 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("@shop.example"))).alias("user_email"),
        F.when(tagged, mapped(k % 5, UTM)).alias("utm_source"), mapped(k % 3, MEDIA).alias("utm_medium"), F.when(tagged, campaign_name(k)).alias("utm_campaign"),
        F.concat(F.lit("C"), (k % 20).cast("string")).alias("campaign_id"), F.concat(F.lit("/products/p"), (k % 20).cast("string")).alias("page_url"), "value",
    )


def all_platforms(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = lambda t: F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)
    per = e.groupBy(F.to_date("ts").alias("ad_date"), (F.col("k") % 20).alias("c")).agg(
        (F.count("*") * 100).alias("impressions"), (F.count_if(F.col("event_type") == "click") * 10).alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("conversions"),
        F.sum(kind("click")).alias("cost"), F.sum(kind("purchase")).alias("conversion_value"),
    )
    c = F.col("c")
    return per.select("ad_date", mapped(c % 5, PLATFORMS).alias("platform"), F.concat(F.lit("C"), c.cast("string")).alias("campaign_id"), campaign_name(c).alias("campaign_name"), "impressions", "clicks", "conversions", "cost", "conversion_value")


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """Orders of web visitors: the purchase events."""
    return read(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("order_date"), F.col("value").alias("final_total"))


# ---- raw datasets, with rows that cleaning has to drop ---------------------------------------------------------------


def raw_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the shop writes them, with their items as JSON text; every seventh is there once more as it was a month before."""
    item = F.struct("product_name", "category", "price", F.col("quantity").cast("int").alias("quantity"), "item_total")
    items = order_items(spark, d).groupBy("order_id").agg(F.to_json(F.collect_list(item)).alias("items"))  # an order's items are few
    k = F.col("order_id")
    now = orders(spark, d).drop("has_promotion").join(items, "order_id", "left").withColumns({
        "discount_code": F.when(k % 5 < 2, F.lit("PROMO")), "discount_amount": (k % 3).cast("double"),
        "utm_medium": F.lit(None).cast("string"), "utm_campaign": F.when(k % 11 == 0, campaign_name((k % 20).cast("int"))),
    })
    before = now.filter(k % 7 == 0).withColumns({"order_date": F.date_sub("order_date", 30), "final_total": F.lit(0.0), "items": F.lit("[]")})
    return now.unionByName(before)


def raw_ads(spark: SparkSession, d: str, places: list[int]) -> DataFrame:
    """Spend by day, campaign and ad type of some platforms; each row is there once more with one impression less."""
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("c", F.col("k") % 20).filter((F.col("c") % 5).isin(places))
    kind = lambda t: F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)
    per = e.groupBy(F.to_date("ts").cast("string").alias("date"), "c", F.when(F.hour("ts") < 12, "Search").otherwise("Display").alias("ad_type")).agg(
        (F.count("*") * 100).alias("impressions"), (F.count_if(F.col("event_type") == "click") * 10).alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("conversions"),
        (F.count_if(F.col("event_type") == "view") * 3).alias("engagements"), F.sum(kind("click")).alias("cost"), F.sum(kind("purchase")).alias("conversion_value"),
    )
    c = F.col("c")
    rows = per.select("date", mapped(c % 5, PLATFORMS).alias("platform"), F.concat(F.lit("C"), c.cast("string")).alias("campaign_id"), F.concat(F.lit("I"), (c % 3).cast("string")).alias("influencer_id"), "ad_type", "impressions", "clicks", "conversions", "engagements", "cost", "conversion_value", F.lit(0.7).alias("avg_cpc"))
    return rows.unionByName(rows.withColumns({"impressions": F.col("impressions") - 1, "cost": F.lit(0.0)}))


def raw_influencer(spark: SparkSession, d: str) -> DataFrame:
    return raw_ads(spark, d, [4]).filter("ad_type = 'Search'").drop("ad_type", "avg_cpc").withColumnRenamed("cost", "fee").withColumn("duration", F.lit(5))
