"""Streams over micro-batches, sinks that replay, ordered tables and quarantine."""

import glob
import json
from datetime import date

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators import data_quality
from tidemark.plans import gold
from tidemark.sources import lake
from tidemark.streaming import weblogs


def log(i, at, user="u", kind="page_view"):
    return json.dumps({"event_id": i, "event_type": kind, "timestamp": f"2025-01-01T{at}:00", "session_id": "s", "user": {"user_id": user, "authenticated": True}})


#: micro-batches: duplicates within and across them, an event that is late but within the watermark, one beyond it, and one that closes all
BATCHES = [
    [log("1", "10:00"), log("1", "10:00"), log("2", "10:20"), log("3", "11:30", "v", "purchase")],
    [log("2", "10:20"), log("4", "10:45"), log("5", "14:00", "v")],
    [log("late", "09:00"), log("6", "14:10", "v", "purchase"), log("6", "14:10", "v", "purchase")],
    [log("last", "23:00", "w")],
]


def run(spark, tmp_path, make, batches=BATCHES, sink=weblogs.to_parquet, part="user_id", **more):
    for k, values in enumerate(batches):  # each run takes up where the one before ended
        spark.createDataFrame([(str(k), v) for v in values], "key string, value string").coalesce(1).write.mode("append").json(str(tmp_path / "topic"))
        stream = make(weblogs.silver(weblogs.parse(weblogs.read_topic(spark, "json", path=str(tmp_path / "topic")))))
        sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), [part], **more).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def of_batch(spark, make):
    values = [v for b in BATCHES for v in b if '"late"' not in v]
    return make(weblogs.silver(weblogs.parse(spark.createDataFrame([(v,) for v in values], "value string"))))


@pytest.mark.parametrize(("make", "part", "end"), [
    (weblogs.session_windows, "user_id", "session_end"),
    (lambda df: weblogs.windowed_counts(df, "1 hour"), "event_type", "window_end"),
])
def test_windows_on_the_silver_stream(spark, tmp_path, make, part, end):
    """Duplicates out, then windows: in one query, over four micro-batches, with one watermark; as the batch has them."""
    got = run(spark, tmp_path, make, part=part)
    closed = of_batch(spark, make).filter(F.col(end) <= "2025-01-01 22:00:00")
    rows = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert rows(got) == rows(closed) and closed.count() >= 3


def test_watermark_is_set_once(spark, tmp_path):
    (tmp_path / "topic").mkdir()
    stream = weblogs.silver(weblogs.parse(weblogs.read_topic(spark, "json", path=str(tmp_path / "topic"))), "2 hours")
    assert stream.schema["event_timestamp"].metadata["spark.watermarkDelayMs"] == 7_200_000
    plan = weblogs.session_windows(stream)._jdf.queryExecution().logical().toString()
    assert plan.count("EventTimeWatermark") == 1


def test_sink_replays_a_batch(spark, tmp_path):
    """The second batch fails when its files are written; the restart does it again, and each event is there once."""
    failed = []

    def fail(number):
        failed.append(number)
        raise RuntimeError("lost after its write")

    run(spark, tmp_path, lambda df: df, BATCHES[:1], weblogs.to_parquet_once, "date")
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, lambda df: df, BATCHES[1:2], weblogs.to_parquet_once, "date", written=fail)
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("batch_id") == failed[0]).count() == 2
    got = run(spark, tmp_path, lambda df: df, BATCHES[2:], weblogs.to_parquet_once, "date")
    assert sorted(r.event_id for r in got.collect()) == ["1", "2", "3", "4", "5", "6", "last"]
    last = got.agg(F.max("batch_id")).first()[0]
    weblogs.compacted(spark, str(tmp_path / "out"), last, str(tmp_path / "whole"), ["date"])
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "whole")).collect()) == sorted(r.event_id for r in got.filter(F.col("batch_id") < last).collect())


def in_name_order(spark, folder):
    return [tuple(r) for f in sorted(glob.glob(f"{folder}/*.parquet")) for r in spark.read.parquet(f).collect()]


def test_write_sorted(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("v"), F.lit(1).alias("p"))
    lake.write_sorted(df, str(tmp_path / "t"), ["v", "k"], files=5)
    assert len(glob.glob(f"{tmp_path}/t/*.parquet")) > 1
    assert in_name_order(spark, f"{tmp_path}/t") == [tuple(r) for r in df.orderBy("v", "k").collect()]
    lake.write_sorted(df, str(tmp_path / "parts"), ["k"], ["v"], files=5)
    got = [x[0] for x in in_name_order(spark, f"{tmp_path}/parts/v=1")]
    assert got == sorted(got) and len(got) == df.filter("v = 1").count()
    lake.write_sorted(df.limit(0), str(tmp_path / "none"), ["k"])
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).count() == 0


def test_reports_are_in_order(spark, sf, tmp_path):
    s = gold.Silver.of_tables(spark, sf)
    tables = gold.sales_forecast(s, date(2001, 7, 15)) | gold.acquisition_metrics(s, date(1995, 6, 15))
    tables = {k: v for k, v in tables.items() if k in ("daily_category_sales", "monthly_sales", "cohorts", "ltv")}
    gold.write_tables(tables, lake.LakePaths(str(tmp_path)))
    for name, df in tables.items():
        keys = gold.ORDERS[name]
        at = [df.columns.index(k) for k in keys]
        got = [tuple(r[i] for i in at) for r in in_name_order(spark, f"{tmp_path}/gold/{name}")]
        assert got == [tuple(r) for r in df.select(*keys).orderBy(*keys).collect()] and len(got) > 3


def test_quarantine(spark, tmp_path):
    (tmp_path / "orders_20250101.csv").write_text('order_id,customer_id,order_date\n' + "".join(f"o{i},c{i},2025-01-01 00:00:00\n" for i in range(30)))
    (tmp_path / "orders_20250102.csv").write_text("order_id,customer_id,order_date\no30,c30,not a date\no31,c31,2025-01-02 00:00:00\n")
    raw = lake.read_csv(spark, "orders", str(tmp_path))
    columns = [c for c in raw.columns if c != "_corrupt"]
    full = lambda *v: ",".join([*v, *[""] * (len(columns) - len(v))])
    for f, rows in (("orders_20250101.csv", [full(f"o{i}", f"c{i}", "2025-01-01 00:00:00") for i in range(30)]), ("orders_20250102.csv", [full("o30", "c30", "not a date"), full("o31", "c31", "2025-01-02 00:00:00")])):
        (tmp_path / f).write_text("\n".join([",".join(columns), *rows]) + "\n")
    raw = lake.read_csv(spark, "orders", str(tmp_path))
    for _ in range(2):  # a rerun of the load replaces its rows
        good = lake.quarantined(raw, "orders", "l1", str(tmp_path / "quarantine"))
    assert good.columns == columns and {r.order_id for r in good.collect()} == {f"o{i}" for i in range(30)} | {"o31"}
    (held,) = spark.read.parquet(str(tmp_path / "quarantine")).collect()
    assert (held.dataset, held.load_id, held.source_file) == ("orders", "l1", "orders_20250102.csv")
    assert held.record.startswith("o30,c30,not a date") and json.loads(held.parsed)["order_id"] == "o30"
    with pytest.raises(lake.BadLoad, match="1 of 32"):
        lake.quarantined(raw, "orders", "l2", str(tmp_path / "quarantine"), most=0.01)
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == 2
    (tmp_path / "j.json").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    rows = lake.quarantined(lake.read_json(spark, str(tmp_path / "j.json"), "k int", "_corrupt"), "j", "l1", str(tmp_path / "quarantine"), most=0.5)
    assert sorted(r.k for r in rows.collect()) == [1, 2]


def test_profiles_are_fresh(spark, sf, tmp_path):
    s, paths = gold.Silver.of_tables(spark, sf), lake.LakePaths(str(tmp_path))
    gold.load_profiles(s, paths, date(2001, 7, 15))
    held = spark.read.parquet(paths.at("silver", "customer_profiles"))
    assert held.count() == s.customers.count()
    today = spark.sql("select current_date()").first()[0]
    metrics = data_quality.suite_metrics({"customer_profiles": held}, today, {"customer_profiles": data_quality.SUITE["customer_profiles"]})
    assert [(r.item, r.value) for r in metrics.filter("kind = 'age_days'").collect()] == [("profile_updated_at", 0.0)]


def test_suite_scans_each_dataset_twice(spark, sf, tmp_path, monkeypatch):
    """One aggregation and one count of values, however many rules there are."""
    s, plans = gold.Silver.of_tables(spark, sf), []
    orders, customers = (lake.write(df, str(tmp_path / n)) or spark.read.parquet(str(tmp_path / n)) for n, df in (("orders", s.orders), ("customers", s.customers)))
    keep = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    monkeypatch.setattr(data_quality, "materialize", keep)
    monkeypatch.setattr(data_quality, "_facts", lambda *a, make=data_quality._facts: keep(make(*a)))
    suite = {n: data_quality.SUITE[n] for n in ("orders", "customers")}
    data_quality.suite_metrics({"orders": orders, "customers": customers}, date(2001, 7, 15), suite)
    assert len(plans) == 3 and [p.count("Relation [") for p in plans] == [1, 1, 2] and "Join" not in plans[2]
