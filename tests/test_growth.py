"""What the larger tables asked for: rows aren't multiplied by the distinct counts, and what is written is small."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.periods import ALL_DAYS
from tidemark.operators import attribution, data_quality, marketing, products

DAY = date(2024, 1, 28)


@pytest.fixture(scope="module")
def trips(spark):
    """Visitors who come back by the same channel, an order without a value and one without an id."""
    at = lambda n: datetime(2024, 1, n)
    visits = [(f"{u}-{d}", u, at(d), "google" if d % 3 else None, "cpc", ["a", "b", None][d % 3], f"C{d % 2}") for u in (1, 2, 3) for d in range(1, 29)]
    s = spark.createDataFrame(visits, "session_id string, user_id long, session_start timestamp, utm_source string, utm_medium string, utm_campaign string, campaign_id string")
    bought = [(1, 1, at(28), 10.0), (2, 1, at(20), 7.0), (3, 2, at(27), None), (None, 3, at(5), 4.0), (5, 3, at(28), 1.0)]
    return attribution.journeys(s, spark.createDataFrame(bought, "order_id long, customer_id long, order_date timestamp, final_total double"), 30)


def rows(df):
    cols = sorted(df.columns)
    return sorted(([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols] for r in df.collect()), key=str)


@pytest.mark.parametrize("keys", [attribution.TOUCH, ["utm_campaign"]])
@pytest.mark.parametrize("names", [None, ["daily", "weekly", "ytd"], ["weekly", ALL_DAYS]])
@pytest.mark.parametrize("distinct", [True, False])
def test_sums_of_journeys_and_of_their_models(trips, keys, names, distinct):
    got, want = (rows(attribution.sums(x, keys, DAY, names, distinct)) for x in (trips, attribution.attribution_models(trips)))
    assert got == want and len(got) > 4


def test_no_rows_for_each_distinct_count(trips, spark, sf, capsys):
    from tidemark.plans.gold import Silver

    s = Silver.of_tables(spark, sf)
    for df in (attribution.channel_performance(trips, s.ads), marketing.channel_metrics(trips, s.ads, DAY, ["weekly"]), marketing.campaign_periods(trips, s.ads, DAY, ["weekly"]), products.product_metrics(s.items, s.orders, date(2001, 7, 15), ["weekly"])):
        df.explain()
        assert "Expand" not in capsys.readouterr().out


def test_customers_and_orders_of_products(spark):
    items = spark.createDataFrame([(1, "p", "c", 1.0, 2.0), (1, "p", "c", 1.0, 3.0), (2, "p", "c", 1.0, 4.0), (3, "p", "c", 1.0, 5.0), (4, "p", "c", 1.0, 9.0)], "order_id long, product_name string, category string, quantity double, item_total double")
    orders = spark.createDataFrame([(1, 7, DAY), (2, 7, date(2024, 1, 25)), (3, None, DAY), (4, 8, date(2020, 1, 1))], "order_id long, customer_id long, order_date date")
    got = {r.time_period: (r.order_count, r.customer_count, r.total_revenue) for r in products.product_metrics(items, orders, DAY, ["daily", "weekly"]).collect()}
    assert got == {"daily": (2, 1, 10.0), "weekly": (3, 1, 14.0)}


def test_rankings_compute_the_metrics_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(products, "materialize", lambda df: written.append(df) or df)
    m = spark.createDataFrame([("weekly", "p", "c", 1.0, 1.0)], "time_period string, product_name string, category string, total_quantity double, total_revenue double")
    assert products.product_rankings(m).count() == 1 and len(written) == 1


def test_suite_writes_sums_and_not_values(spark, monkeypatch):
    keep, written = data_quality.materialize, []
    monkeypatch.setattr(data_quality, "materialize", lambda df: written.append(keep(df)) or written[-1])
    p = spark.range(1000).select(F.when(F.col("id") > 1, F.col("id")).alias("id"))  # two nulls
    c = spark.range(2000).select("id", (F.col("id") % 1500).alias("p"))
    checks = {"p": data_quality.Checks({}, ("id",)), "c": data_quality.Checks({}, ("id",), {"p": ("p", "id")})}
    got = {(r.dataset, r.kind): r.value for r in data_quality.suite_metrics({"p": p, "c": c}, DAY, checks).collect()}
    assert got["p", "duplicate_percent"] == pytest.approx(0.1) and got["c", "duplicate_percent"] == 0 and got["c", "integrity"] == pytest.approx(998 / 1500)
    assert len(written) == 1 and written[0].count() <= 6
