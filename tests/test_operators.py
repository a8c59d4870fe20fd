"""Edge rows: what the given tables don't hold."""

import glob
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import partials, periods, ranks
from tidemark.functions.periods import by_period
from tidemark.operators import attribution, cleaning, data_quality, forecast, marketing, products, segments, sessions
from tidemark.plans import gold
from tidemark.sources import lake, schemas
from tidemark.streaming import weblogs


def test_periods():
    got = {n: (a, b) for n, a, b in periods.spans(date(2025, 3, 10), ["daily", "weekly", "prev_month", "ytd"])}
    assert got["weekly"] == (date(2025, 3, 4), date(2025, 3, 10)) and got["ytd"][0] == date(2025, 1, 1)
    assert got["prev_month"] == (date(2024, 2, 10), date(2024, 3, 10))
    assert periods.adjacent(date(2025, 3, 10), "weekly")[1] == (date(2025, 2, 25), date(2025, 3, 3))


def test_clean_orders_items_with_apostrophe(spark, tmp_path):
    (tmp_path / "orders_20250101.csv").write_text(
        "order_id,customer_id,order_date,order_total,discount_code,discount_amount,final_total,shipping_cost,payment_method,order_status,utm_source,utm_medium,utm_campaign,items,season,city,phone\n"
        'o1,c1,2025-01-01 10:00:00,10,X,1.0,9,0,card,Livré,google,,,"[{\'product_name\': ""Masque à l\'Argile"", \'category\': \'soin_visage\', \'price\': 5.0, \'quantity\': 2, \'item_total\': 10.0}]",normal,Dakar,1\n'
        "o2,c1,2025-01-02 10:00:00,10,,,10,0,card,Livré,,,,,normal,Dakar,1\n,c9,2025-01-02 10:00:00,10,,,10,0,card,Livré,,,,,normal,Dakar,1\n"
    )
    o = cleaning.clean_orders(lake.read_csv(spark, "orders", str(tmp_path)))
    r = {x.order_id: x for x in o.collect()}
    assert set(r) == {"o1", "o2"} and r["o1"].item_count == 1 and r["o2"].item_count == 0
    assert r["o1"].has_promotion and not r["o2"].has_promotion and r["o1"].has_marketing_attribution and not r["o2"].has_marketing_attribution
    assert [x.product_name for x in cleaning.explode_items(o).collect()] == ["Masque à l'Argile"]


def test_clean_customers_latest_and_lists(spark):
    rows = [("a", "X@Y.z ", 3, 60000.0, "x||y", "Sec"), ("a", "x@y.z", 1, 5.0, "", "?"), (None, "n", 1, 1.0, None, None), ("b", None, 0, None, None, "?")]
    df = spark.createDataFrame(rows, "customer_id string, email string, total_orders int, lifetime_value double, skin_concerns string, skin_type string").withColumn("registration_date", F.lit(date(2025, 1, 1)))
    r = {x.customer_id: x for x in cleaning.clean_customers(df, date(2025, 1, 31)).collect()}
    assert set(r) == {"a", "b"} and r["a"].email == "x@y.z" and r["a"].skin_concerns_array == ["x", "y"] and r["a"].value_segment == "High"
    assert r["a"].lifecycle_stage == "Client régulier" and r["b"].value_segment == "No purchase" and r["b"].skin_type == "Non spécifié" and r["a"].customer_tenure_days == 30


def test_ads(spark):
    g = spark.createDataFrame([("2025-01-01", "g1", "Search", 10, 0, 5.0, 0, 0.0, 0.7), ("2025-01-01", "g1", "Search", 20, 4, 8.0, 2, 16.0, 0.7)], "date string, campaign_id string, ad_type string, impressions int, clicks int, cost double, conversions int, conversion_value double, avg_cpc double")
    r = cleaning.clean_google_ads(g).collect()
    assert len(r) == 1 and (r[0].roas, r[0].cpa, r[0].cpc) == (2.0, 4.0, 2.0)
    i = spark.createDataFrame([("2025-01-01", "i1", "x", 100.0, 10, 5, 0, 50.0, 1)], "date string, campaign_id string, influencer_id string, fee double, duration int, clicks int, conversions int, conversion_value double, impressions int")
    r = cleaning.clean_influencer(i).first()
    assert (r.daily_cost, r.roi, r.cpa, r.cpc) == (10.0, -0.5, None, 2.0)


def session(i, user, at, source="google"):
    return (i, user, at, source, None, None, None)


def test_journeys_bounds_and_weights(spark):
    s = spark.createDataFrame(
        [session("before", 1, datetime(2025, 1, 1)), session("limit", 1, datetime(2025, 1, 10)), session("near", 1, datetime(2025, 2, 8)), session("after", 1, datetime(2025, 2, 9, 13)), session("direct", 1, datetime(2025, 2, 1), None), session("near", 1, datetime(2025, 2, 8))],
        "session_id string, user_id long, session_start timestamp, utm_source string, utm_medium string, utm_campaign string, campaign_id string",
    )
    o = spark.createDataFrame([(7, 1, datetime(2025, 2, 9, 12), 100.0)], "order_id long, customer_id long, order_date timestamp, final_total double")
    j = attribution.journeys(s, o, 30)
    assert [t.session_id for t in j.first().touchpoints] == ["limit", "near"]
    got = {(r.attribution_model, r.session_id): r.attributed_revenue for r in attribution.attribution_models(j).collect()}
    assert got["first_touch", "limit"] == 100 and got["last_touch", "near"] == 100 and got["linear", "near"] == 50
    assert abs(got["time_decay", "near"] + got["time_decay", "limit"] - 100) < 1e-9 and got["time_decay", "near"] > 99


def test_journeys_of_a_bot_and_of_random_visitors(spark):
    # a bot: 6 sessions an hour over 60 days and 300 orders; pairs would be over a million rows
    at = lambda minutes: F.timestamp_seconds(F.lit(1735689600) + minutes * 60)
    bot = spark.range(8640).select(F.concat(F.lit("b"), "id").alias("session_id"), F.lit(1).cast("long").alias("user_id"), at(F.col("id") * 10).alias("session_start"))
    idle = spark.range(5000).select(F.concat(F.lit("i"), "id").alias("session_id"), F.lit(2).cast("long").alias("user_id"), at(F.col("id")).alias("session_start"))  # a bot that orders nothing
    other = spark.range(3000).select(F.concat(F.lit("o"), "id").alias("session_id"), (F.pmod(F.xxhash64("id"), F.lit(200)) + 10).alias("user_id"), at(F.pmod(F.xxhash64(F.col("id") + 7), F.lit(200_000))).alias("session_start"))
    s = bot.unionByName(idle).unionByName(other).select("*", F.lit("google").alias("utm_source"), *[F.lit(None).cast("string").alias(c) for c in ("utm_medium", "utm_campaign", "campaign_id")])
    o = spark.range(1000).select(F.col("id").alias("order_id"), F.when(F.col("id") < 300, 1).otherwise(F.pmod(F.xxhash64(F.col("id") + 9), F.lit(210)) + 5).alias("customer_id"), at(F.pmod(F.xxhash64(F.col("id") + 3), F.lit(200_000))).alias("order_date"), F.lit(1.0).alias("final_total"))
    by_user: dict = {}
    for x in s.collect():
        by_user.setdefault(x.user_id, []).append((x.session_start, x.session_id))
    want = {}
    for x in o.collect():
        near = sorted(t for t in by_user.get(x.customer_id, []) if t[0] <= x.order_date and 0 <= (x.order_date.date() - t[0].date()).days <= 30)
        if near:
            days = [(x.order_date.date() - t[0].date()).days for t in near]
            want[x.order_id] = (len(near), near[0][0], near[-1][0], min(days), max(days), hash(tuple(t[1] for t in near)))
    j = attribution.journeys(s, o, 30).select("order_id", "touchpoint_count", "first_touch", "last_touch", "min_days", "max_days", F.col("touchpoints.session_id").alias("ids"))
    got = {x.order_id: (*x[1:6], hash(tuple(x.ids))) for x in j.collect()}
    assert got == want and sum(x[0] for x in want.values()) > 500_000


def test_preference_tie_and_profiles_without_orders(spark):
    o = spark.createDataFrame([(1, 5, date(2025, 1, 1), 10.0, "card", True, None)], "order_id long, customer_id long, order_date date, final_total double, payment_method string, has_promotion boolean, utm_source string")
    i = spark.createDataFrame([(1, "b", 4.0), (1, "a", 4.0)], "order_id long, category string, item_total double")
    c = spark.createDataFrame([(5,), (6,)], "customer_id long")
    r = {x.customer_id: x for x in sessions.enriched_profiles(c, o, i, date(2025, 1, 20)).collect()}
    assert (r[5].primary_category, r[5].secondary_category) == ("a", "b") and r[5].profile_lifecycle_stage == "New Customer"
    assert r[6].order_count == 0 and r[6].profile_lifecycle_stage == "Lead"


def steps_left(spark):
    return len(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/step-*"))


@pytest.mark.parametrize(("rows", "local"), [(0, True), (1, True), (3, True), (23, True), (240, True), (0, False), (23, False), (240, False)])
def test_ntiles_match_window(spark, rows, local, monkeypatch):
    """Three columns at once, with ties over the edges, nulls and a column of one value; nothing is left in the shared folder."""
    from pyspark.sql import Window

    if not local:
        monkeypatch.setattr(ranks, "LOCAL", 0)
    data = [(f"c{i * 37 % 240:03}", (i * 7) % 10 if i % 9 else None, float(i // 3) if i % 4 else None, 5) for i in range(rows)]
    df = spark.createDataFrame(data, "customer_id string, x long, y double, z int")
    before = steps_left(spark)
    got = ranks.ntiles_of_all(df, 5, {"tx": ("x", True), "ty": ("y", False), "tz": ("z", True)}, "customer_id")
    assert steps_left(spark) == before and got.count() == rows
    over = {"tx": F.desc("x"), "ty": F.asc("y"), "tz": F.desc("z")}
    want = got.withColumns({f"w{t}": F.ntile(5).over(Window.orderBy(o, "customer_id")) for t, o in over.items()})
    assert want.filter("tx <> wtx or ty <> wty or tz <> wtz").count() == 0


@pytest.mark.parametrize("local", [True, False])
def test_dense_ranks_match_window(spark, local, monkeypatch):
    from pyspark.sql import Window

    if not local:
        monkeypatch.setattr(ranks, "LOCAL", 0)
        monkeypatch.setattr(ranks, "SENT", 0)
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(i * 7 % 10) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, g string, x double")
    before = steps_left(spark)
    got = ranks.dense_ranks_of_all(df, [(["g"], "x", "r"), ([], "x", "s"), (["g"], "i", "t")])
    assert (steps_left(spark) == before) == local
    over = {"r": Window.partitionBy("g").orderBy(F.desc_nulls_last("x")), "s": Window.orderBy(F.desc_nulls_last("x")), "t": Window.partitionBy("g").orderBy(F.desc("i"))}
    got = got.withColumns({f"w{k}": F.dense_rank().over(w) for k, w in over.items()})
    assert got.filter("r <=> wr and s <=> ws and t <=> wt").count() == 60
    assert ranks.dense_ranks_of_all(df.limit(0), [([], "x", "r")]).count() == 0


def test_pairs_same_product_twice(spark):
    i = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x")], "order_id long, product_name string")
    assert [(r.product_a, r.product_b, r.pair_orders) for r in products.product_pairs(i).orderBy("product_a").collect()] == [("x", "y", 1), ("y", "x", 1)]


def test_growth_over_a_gap_and_single_month(spark):
    m = spark.createDataFrame([(24301, "a", 10.0, 1, 1.0), (24302, "a", 20.0, 2, 1.0), (24304, "a", 30.0, 3, 1.0), (24301, "b", 5.0, 1, 1.0)], "month_idx int, category string, revenue double, orders long, quantity double")
    g = {(r.category, r.month_idx): r.mom_growth for r in forecast.growth(m).collect()}
    assert g["a", 24302] == 100 and g["a", 24304] is None
    f = [r.forecast_revenue for r in forecast.ols_forecast(m).filter("category = 'b'").collect()]
    assert f == [5.0, 5.0, 5.0]
    ml = [r.forecast_revenue for r in forecast.ml_forecast(m.filter("category = 'a'")).orderBy("month_idx").collect()]
    assert ml == pytest.approx([r.forecast_revenue for r in forecast.ols_forecast(m.filter("category = 'a'")).orderBy("month_idx").collect()], rel=1e-5)


def test_quality(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (None, 3.0)], "k long, x double")
    assert {r.column_name: r.missing for r in data_quality.completeness(df, "d").collect()} == {"k": 1, "x": 1}
    assert data_quality.duplicates(df, ["k"], "d").first().duplicates == 1
    checks = {"d": data_quality.Checks({"valid_k": "k is not null", "valid_other": "other > 0"}, ("k",), {"k": ("p", "k")}, ("gone", "at"), 1, ("x",)), "gone": data_quality.Checks({})}
    held = {"d": df.withColumn("at", F.lit(date(2024, 12, 30))), "gone": None, "p": spark.createDataFrame([(2,)], "k long")}
    suite = {(r.dataset, r.issue_type, r.severity) for r in data_quality.silver_suite(held, date(2025, 1, 1), checks).collect()}
    assert suite == {("gone", "DATASET_NOT_FOUND", "HIGH"), ("d", "LOW_COMPLETENESS", "HIGH"), ("d", "LOW_VALIDITY", "HIGH"), ("d", "DUPLICATES", "HIGH"), ("d", "REFERENTIAL_INTEGRITY", "HIGH"), ("d", "DATA_STALENESS", "MEDIUM")}
    data_quality.write_report(data_quality.suite_metrics(held, date(2025, 1, 1), checks), str(tmp_path), date(2025, 1, 1))
    summary = spark.read.json(f"{tmp_path}/summary").first()
    assert (summary.high_issues, summary.medium_issues, summary.passed) == (5, 1, False)
    a, e = T.StructType().add("a", T.LongType()).add("b", T.StringType()), T.StructType().add("a", T.IntegerType()).add("c", T.StringType())
    assert data_quality.schema_drift(a, e) == [("a", "type int -> bigint"), ("b", "added"), ("c", "missing")]


def log(i, at, kind="page_view", **more):
    return json.dumps({"event_id": i, "event_type": kind, "timestamp": at, "session_id": "s", "user": {"user_id": "u", "authenticated": True}, **more})


def test_stream_and_batch(spark, tmp_path):
    values = [log("1", "2025-01-01T10:00:00"), log("1", "2025-01-01T10:00:00"), log("2", "2025-01-01T10:05:00", "purchase"), log("3", "2025-01-02T09:00:00", "product_view", product={"url": "/products/p1"}), json.dumps({"event_id": "4"})]
    raw = spark.createDataFrame([json.loads(v) for v in values], schemas_of(spark))
    lake.publish(weblogs.valid(raw), "json", path=str(tmp_path / "topic"))
    batch = weblogs.silver(weblogs.parse(weblogs.read_topic(spark, "json", streaming=False, path=str(tmp_path / "topic"))))
    want = {(r.event_id, r.event_category, r.page_url) for r in batch.collect()}
    assert want == {("1", "navigation", None), ("2", "conversion", None), ("3", "product", "/products/p1")}
    stream = weblogs.silver(weblogs.parse(weblogs.read_topic(spark, "json", path=str(tmp_path / "topic"))))
    q = weblogs.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["date"])
    q.awaitTermination(120)
    assert {(r.event_id, r.event_category, r.page_url) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert weblogs.session_windows(batch).count() == 2 and weblogs.windowed_counts(batch).count() == 3


def schemas_of(spark):
    return spark.read.schema(schemas.WEB_LOG).json(spark.sparkContext.parallelize([])).schema


def test_lake_overwrites_partitions_only(spark, tmp_path):
    p = lake.LakePaths(str(tmp_path)).at("gold", "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, part string")
    lake.write(df, p, ["part"])
    lake.write(df.filter("part = 'a'").withColumn("x", F.lit(9)), p, ["part"])
    assert sorted((r.x, r.part) for r in lake.read_first(spark, [p + "-missing", p]).collect()) == [(2, "b"), (9, "a")]
    assert lake.path_list("a, b") == ["a", "b"] and lake.path_list('["c"]') == ["c"]
    assert lake.with_ingestion(spark.read.parquet(p), "crm", "1", date(2025, 1, 2)).first().month == "01"


def test_gold_and_warehouse(spark, sf, tmp_path):
    s = gold.Silver.of_tables(spark, sf)
    tables = gold.campaign_roi(s, date(2024, 1, 28)) | gold.customer_segments(s, date(2001, 7, 15))
    gold.write_tables({"campaign_roi": tables["campaign_roi"]}, lake.LakePaths(str(tmp_path)))
    assert lake.read_partition(spark.read.parquet(str(tmp_path) + "/gold/campaign_roi"), time_period="monthly").count() > 0
    star = gold.warehouse_tables(spark, s, tables, date(2024, 1, 28))
    assert star["FACT_RFM_SEGMENTS"].count() == star["FACT_RFM_SEGMENTS"].select("rfm_segments_key").distinct().count() > 0
    assert star["DIM_SEGMENT"].count() == 29
    lake.to_warehouse(star["DIM_PLATFORM"], "dim_platform")
    assert spark.table("dim_platform").count() == 5


def test_channel_orders_are_counted_not_collected(spark, capsys):
    rows = [("linear", "google", None, "x", "C1", 1, 7, 2.0), ("linear", "google", None, "x", "C2", 1, 7, 2.0), ("linear", "google", None, "x", "C2", 2, 7, 1.0), ("linear", None, None, None, "C1", None, None, 1.0)]
    att = spark.createDataFrame(rows, "attribution_model string, utm_source string, utm_medium string, utm_campaign string, campaign_id string, order_id long, user_id long, attributed_revenue double").withColumn("order_date", F.lit(date(2024, 1, 28)))
    ads = spark.createDataFrame([(date(2024, 1, 28), "C1", 5.0, 9, 4), (date(2024, 1, 28), "C2", 1.0, 9, 2)], "ad_date date, campaign_id string, cost double, impressions long, clicks long")
    out = marketing.channel_metrics(att, ads, date(2024, 1, 28), ["daily"])
    got = {r.utm_source: (r.conversions, r.revenue, r.unique_orders, r.cost, r.clicks) for r in out.collect()}
    assert got == {"google": (3, 5.0, 2, 6.0, 6), None: (1, 1.0, 0, 5.0, 4)}
    out.explain()
    assert "collect_" not in capsys.readouterr().out


def test_loads_by_date(spark, sf, tmp_path):
    s, paths = gold.Silver.of_tables(spark, sf), lake.LakePaths(str(tmp_path))
    gold.load_attribution(s, paths, date(2024, 1, 20), days_back=5)
    gold.load_attribution(s, paths, date(2024, 1, 21), days_back=5)
    held = spark.read.parquet(paths.at("silver", "marketing_attribution"))
    spans = {str(r[0]): (r[1].date(), r[2].date()) for r in held.groupBy("processing_date").agg(F.min("order_date"), F.max("order_date")).collect()}
    assert set(spans) == {"2024-01-20", "2024-01-21"} and spans["2024-01-20"][0] >= date(2024, 1, 15) and spans["2024-01-20"][1] <= date(2024, 1, 20)
    whole = gold.marketing_attribution(s)["marketing_attribution"].filter("to_date(order_date) between '2024-01-15' and '2024-01-20'")
    assert held.filter("processing_date = '2024-01-20'").count() == whole.count() > 0  # no session is lost at the window's edge
    gold.load_sessions(s, paths, date(2024, 1, 20))
    web = spark.read.parquet(paths.at("silver", "web_sessions"))
    assert web.count() == s.web.count() and {"processing_date", "silver_updated_at"} <= set(web.columns)
    day = lake.read_day(s.logs, "event_timestamp", date(2024, 1, 3))
    assert day.count() == s.logs.filter("date = '2024-01-03'").count() > 0 and periods.parse_date("2024-01-03") == date(2024, 1, 3)


@pytest.mark.parametrize("subject", sorted(gold.SUBJECTS))
def test_warehouse_loads(spark, sf, subject):
    day = date(2024, 1, 28) if subject in ("marketing_performance", "campaign_roi") else date(2001, 7, 15)
    names = gold.load_warehouse(spark, gold.Silver.of_tables(spark, sf), subject, day)
    assert names and any(n.startswith("DIM_") for n in names) and all(spark.table(n.lower()).count() > 0 for n in names)
    assert spark.table(next(n for n in names if n.startswith("FACT_")).lower()).first().dw_load_ts == day


def test_json_append_and_csv_datasets(spark, tmp_path):
    for day in (1, 2):
        lake.write(spark.createDataFrame([(day, "x")], "k int, v string"), str(tmp_path / "j"), mode="append", fmt="json")
    assert sorted(r.k for r in lake.read_json(spark, str(tmp_path / "j"), "k int, v string").collect()) == [1, 2]
    (tmp_path / "customers_20250101.csv").write_text("customer_id,first_name\nc1,A\n")
    (tmp_path / "customers_20250102.csv").write_text("customer_id,first_name\nc1,B\n")
    raw = lake.read_csv(spark, "customers", str(tmp_path)).withColumn("source_file", F.col("_metadata.file_name"))
    assert cleaning.clean_customers(raw, date(2025, 1, 3)).first().first_name == "B"  # the latest snapshot wins


def test_social_ads_and_touch_sequence(spark):
    g = spark.createDataFrame([("2025-01-01", "g1", "Story", 100, 4, 8.0, 2, 16.0, 0.7, 25)], "date string, campaign_id string, ad_type string, impressions int, clicks int, cost double, conversions int, conversion_value double, avg_cpc double, engagements int")
    assert cleaning.clean_social_ads(g).first().engagement_rate == 0.25
    s = spark.createDataFrame([("b", 1, 2), ("a", 1, 1), ("c", 2, 1)], "session_id string, user_id long, session_start int")
    assert {r.session_id: r.session_seq for r in attribution.touch_sequence(s).collect()} == {"a": 1, "b": 2, "c": 1}


def test_stream_across_batches(spark, tmp_path):
    """Of an event that comes again in a later micro-batch one stays; one beyond the watermark is late and goes."""
    batches = [[log("1", "2025-01-01T10:00:00"), log("2", "2025-01-01T14:00:00")], [log("1", "2025-01-01T10:00:00"), log("2", "2025-01-01T14:00:00"), log("3", "2025-01-01T14:05:00")], [log("late", "2025-01-01T09:00:00"), log("4", "2025-01-01T14:06:00")]]
    out = str(tmp_path / "out")
    for k, values in enumerate(batches):  # each run takes up where the one before ended
        spark.createDataFrame([(str(k), v) for v in values], "key string, value string").coalesce(1).write.mode("append").json(str(tmp_path / "topic"))
        stream = weblogs.silver(weblogs.parse(weblogs.read_topic(spark, "json", path=str(tmp_path / "topic"))))
        weblogs.to_parquet(stream, out, str(tmp_path / "ck"), ["date"]).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "4"]


def test_segments_without_a_part(spark):
    c = spark.createDataFrame([(1,), (2,)], "customer_id long")
    rows = segments.combine(None, None, None, c)
    assert dict(rows.dtypes)["rfm_score"] == "int" and dict(rows.dtypes)["rfm_segment"] == "string"
    assert {(r.rfm_segment, r.marketing_recommendation) for r in rows.collect()} == {(None, "Standard Marketing Communications")}


def test_approximate_counts(spark, sf):
    s = gold.Silver.of_tables(spark, sf)
    held = gold.marketing_attribution(s)["marketing_attribution"]
    exact, near = ({(r.time_period, r.campaign_name, r.attribution_model): r.period_orders for r in marketing.campaign_periods(held, s.ads, date(2024, 1, 28), ["monthly"], approximate=a).collect()} for a in (False, True))
    assert exact.keys() == near.keys() and all(abs((near[k] or 0) - (v or 0)) <= 0.05 * (v or 0) for k, v in exact.items())


@pytest.mark.parametrize(("driver", "day"), [("acquisition_metrics", date(1995, 6, 15)), ("sales_forecast", date(2001, 7, 15))])
def test_gold_drivers(spark, sf, driver, day, tmp_path):
    tables = getattr(gold, driver)(gold.Silver.of_tables(spark, sf), day)
    gold.write_tables(tables, lake.LakePaths(str(tmp_path)))
    assert len(tables) >= 6 and all(spark.read.parquet(f"{tmp_path}/gold/{n}").count() > 0 for n in tables)


def test_sketches_over_days(spark):
    """20,000 orders on ten days, each order on two of them: a period counts it once, within five standard errors; sums are exact."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("order_id"), F.col("id").cast("double").alias("user_id"), F.lit(1.5).alias("x"), F.explode(F.array(F.col("id") % 10, (F.col("id") + 1) % 10)).alias("d"))
    df = df.withColumn("at", F.expr("timestamp'2024-01-19 10:00:00' + make_interval(0, 0, 0, cast(d as int))"))
    held = partials.daily(df, "at", ["k"], ["x"], ["order_id", "user_id"])
    assert held.count() == 30
    got = {(r.time_period, r.k): r for r in partials.over_periods(held, date(2024, 1, 28), ["daily", "weekly", "monthly"], ["k"]).collect()}
    exact = by_period(df, "at", date(2024, 1, 28), ["daily", "weekly", "monthly"]).groupBy("time_period", "k").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.count_distinct("order_id").alias("orders")).collect()
    assert len(exact) == len(got) == 9
    for r in exact:
        near = got[r.time_period, r.k]
        assert (near.n, near.x) == (r.n, r.x) and abs(near.count_order_id - r.orders) <= 0.08 * r.orders and abs(near.count_user_id - r.orders) <= 0.08 * r.orders


def test_campaign_days_in_the_lake(spark, sf, tmp_path):
    """Loaded twice, with overlapping days: the stored days give what the whole table gives, and events aren't read."""
    s, paths = gold.Silver.of_tables(spark, sf), lake.LakePaths(str(tmp_path))
    for day in (date(2024, 1, 20), date(2024, 1, 28), date(2024, 1, 28)):
        gold.load_campaign_days(s, paths, day, days_back=30)
    got = gold.campaign_periods_of_lake(spark, paths, date(2024, 1, 28), ["weekly", "monthly"])
    want = marketing.campaign_periods(gold.marketing_attribution(s)["marketing_attribution"], s.ads, date(2024, 1, 28), ["weekly", "monthly"])
    key = lambda r: (r.time_period, r.campaign_name, r.attribution_model or "")
    got, want = ({key(r): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(want) > 20
    for k, w in want.items():
        g = got[k]
        assert (g.period_impressions, g.period_clicks) == (w.period_impressions, w.period_clicks) and g.period_revenue == (w.period_revenue and pytest.approx(w.period_revenue)) and g.period_aov == (w.period_aov and pytest.approx(w.period_aov))
        assert abs((g.period_orders or 0) - (w.period_orders or 0)) <= 0.05 * (w.period_orders or 0)


def test_clusters_do_not_depend_on_partitions(spark, sf):
    totals = segments.customer_totals(gold.Silver.of_tables(spark, sf).orders, date(2001, 7, 15))
    before = steps_left(spark)
    got = [sorted(map(tuple, segments.kmeans_clusters(totals.repartition(n)).select("customer_id", "cluster", "cluster_size", "cluster_label").collect())) for n in (1, 4, 13)]
    assert got[0] == got[1] == got[2] and len({r[1] for r in got[0]}) == 5 and steps_left(spark) == before
    few = segments.kmeans_clusters(totals.limit(2))
    assert sorted(r.cluster for r in few.collect()) == [0, 1]
    assert segments.kmeans_clusters(totals.limit(0)).count() == 0
