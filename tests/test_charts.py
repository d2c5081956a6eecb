"""Charts on hand-made edge rows (FIXTURES.md §3) and properties on the test tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesops.operators import basket, charts
from salesops.sources import tables as T

from sf_paths import SF_SMALL

COLS = "Date string, Day string, OrderID string, Item string, Quantity string, Price string, Category string, PaymentType string"


def rows(spark, data):
    return spark.createDataFrame(data, COLS)


def r(date, oid="O1", item="A", qty="1", price="1", cat="C", pay="Cash"):
    return (date, "Monday", oid, item, qty, price, cat, pay)


def test_order_volume_counts_per_day(spark):
    df = rows(spark, [r("01/03/1997/10:00:00", "O1"), r("02/03/1997/10:00:00", "O1"), r("02/03/1997/11:00:00", None),
                      r("02/03/1997/12:00:00", "NA"), r("02/03/1997/12:00:00", "  ")])
    out = {x.day: x["count"] for x in charts.order_volume(df, 1997, 3).collect()}
    assert len(out) == 31
    assert out[1] == 1 and out[2] == 2 and out[3] == 0  # O1 on two days counts twice; null and 'NA' are one 'nan' order
    assert charts.order_volume_total(df, 1997, 3).first()[0] == 3


def test_revenue_split_total_zero(spark):
    df = rows(spark, [r("01/03/1997/10:00:00", price="0"), r("01/03/1997/10:00:00", price="x")])
    assert charts.revenue_split(df, 1997).count() == 0
    assert charts.revenue_split_total(df, 1997).first()[0] == 0.0


def test_top_items_limit_and_total(spark):
    data = [r("01/03/1997/10:00:00", item=f"I{i:02d}", qty=str(i + 0.5)) for i in range(21)]
    out = charts.top_selling_items(rows(spark, data), 1997).collect()
    assert len(out) == 20 and out[0]["item"] == "I20"
    assert [x["quantity"] for x in out] == [round(i + 0.5) for i in range(20, 0, -1)]
    assert charts.top_selling_items_total(rows(spark, data), 1997).first()[0] == sum(round(i + 0.5) for i in range(1, 21))


def _py_basket(pairs_by_order, k=20):
    from collections import Counter
    from itertools import combinations

    cnt = Counter()
    for oid in sorted(pairs_by_order):
        items = sorted(set(pairs_by_order[oid]))
        for p in combinations(items, 2):
            cnt[p] += 1
    return [(f"{a} + {b}", n) for (a, b), n in cnt.most_common(k)], sum(cnt.values())


def test_market_basket_ties_and_repeats(spark):
    orders = {"O2": ["B", "C", "B"], "O1": ["A", "B"], "O3": ["A"], "O4": ["C", "B", "A"], "O5": ["D", "E"]}
    data = [r("05/06/1997/09:00:00", oid, item) for oid, items in orders.items() for item in items]
    df = rows(spark, data)
    got = [(x["label"], x["count"]) for x in basket.market_basket(df, 1997).collect()]
    want, total = _py_basket(orders)
    assert got == want
    assert basket.market_basket_total(df, 1997).first()[0] == total == 6


def test_market_basket_matches_python_on_table(spark):
    s = T.sales(spark, SF_SMALL)
    c = s.where(F.year("Date") == 1997).select("OrderID", "Item").collect()
    by = {}
    for x in c:
        by.setdefault(x.OrderID, []).append(x.Item)
    want, total = _py_basket(by)
    got = [(x["label"], x["count"]) for x in basket.market_basket(s, 1997).collect()]
    assert got == want
    assert basket.market_basket_total(s, 1997).first()[0] == total


def test_day_wise_buckets_and_zero_intensity(spark):
    data = [r(f"01/01/2024/{h}:00:00", price="0") for h in (11, 12, 17, 18)]
    out = charts.day_wise_pattern(rows(spark, data), 2024, 1).collect()
    assert len(out) == 31 * 3
    day1 = {x.bucket: x.sales_count for x in out if x.day == 1}
    assert day1 == {"morning": 1, "daytime": 2, "evening": 1}
    assert all(x.intensity == 0.0 for x in out)


def test_payment_vs_category_dense(spark):
    data = [r("01/03/1997/10:00:00", cat="X", pay="Cash"), r("01/03/1997/10:00:00", cat="X", pay="Card"),
            r("01/03/1997/10:00:00", cat="Y", pay="Cash"), r("01/03/1997/10:00:00", cat=None, pay=" ")]
    out = charts.payment_vs_category(rows(spark, data), 1997).collect()
    cells = {(x.category, x.payment_method): (x["count"], x.percentage) for x in out}
    assert len(cells) == 3 * 3
    assert cells[("X", "Cash")] == (1, 50.0) and cells[("Y", "Card")] == (0, 0.0) and cells[("Unknown", "Unknown")] == (1, 100.0)
    assert [x.category for x in out][:3] == ["X", "X", "X"]


@pytest.mark.parametrize("year,month", [(1997, 3), (1995, 12)])
def test_properties_on_tables(spark, year, month):
    s = T.sales(spark, SF_SMALL)
    split = charts.payment_method_split(s, year, month).collect()
    assert abs(sum(x.percentage for x in split) - 100) < 0.05 * len(split) + 1e-9
    total = charts.total_records(s, year, month).first()[0]
    assert sum(x["count"] for x in split) == total
    assert sum(x["count"] for x in charts.category_performance(s, year, month).collect()) == total
    pvc = charts.payment_vs_category(s, year, month).collect()
    assert sum(x["count"] for x in pvc) == total
    vol = charts.order_volume(s, year, month).collect()
    assert len(vol) == 31 if month in (3, 12) else True
    months = charts.revenue_trend_month(s, year).collect()
    days_total = sum(charts.revenue_trend_total(s, year, m).first()[0] for m in range(1, 13))
    assert abs(sum(x.revenue for x in months) - days_total) < 0.01


def test_available_years(spark):
    years = [x.year for x in charts.available_years(T.sales(spark, SF_SMALL)).collect()]
    assert years == sorted(years) and 1997 in years


def test_parameter_checks(spark):
    s = T.sales(spark, SF_SMALL)
    with pytest.raises(ValueError):
        charts.order_volume(s, 1997, None)
    with pytest.raises(ValueError):
        charts.revenue_trend(s, 1800)
    with pytest.raises(ValueError):
        charts.payment_method_split(s, 1997, 13)


def test_filter_reaches_scan(spark):
    plan = charts.revenue_trend_month(T.sales(spark, SF_SMALL), 1997)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def _orders_frame(spark, orders):
    return rows(spark, [r("05/06/1997/09:00:00", oid, item) for oid, its in orders.items() for item in its])


@pytest.mark.parametrize("n_large,n_small", [(100, 40), (1, 0), (3, 400)])
def test_market_basket_large_orders(spark, n_large, n_small, monkeypatch):
    """Large orders span several blocks; the result equals the brute-force count."""
    import random

    monkeypatch.setattr(basket, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(basket, "BOUND_ITEMS", 10)
    rnd = random.Random(3)
    items = [f"I{i:02d}" for i in range(60)]
    orders = {f"H{h:03d}": rnd.sample(items, 30) for h in range(n_large)}
    orders |= {f"L{o:03d}": rnd.sample(items[:8], rnd.choice([3, 4])) for o in range(n_small)}
    df = _orders_frame(spark, orders)
    want, total = _py_basket(orders)
    assert [(x["label"], x["count"]) for x in basket.market_basket(df, 1997).collect()] == want
    assert basket.market_basket_total(df, 1997).first()[0] == total


def test_market_basket_one_order_of_1500_items(spark):
    df = _orders_frame(spark, {"O1": [f"I{i:04d}" for i in range(1500)]})
    got = basket.market_basket(df, 1997).collect()
    assert [x["label"] for x in got] == [f"I0000 + I{i:04d}" for i in range(1, 21)]
    assert basket.market_basket_total(df, 1997).first()[0] == 1500 * 1499 // 2


def test_payment_matrix_of_20000_methods(spark):
    df = spark.range(20_000).selectExpr(
        "'01/03/1997/10:00:00' AS Date", "concat('C', id % 2) AS Category", "concat('P', id) AS PaymentType"
    )
    out = charts.payment_vs_category(df, 1997)
    assert out.count() == 40_000
    assert out.where("count = 1").count() == 20_000


def test_money_is_summed_unrounded_and_never_fails(spark):
    data = [r("05/03/1997/10:00:00", price="0.004", pay="Cash") for _ in range(1000)]
    data += [r("06/03/1997/10:00:00", price="3.333", pay="Card") for _ in range(1000)]
    got = {x.day: x.revenue for x in charts.revenue_trend_day(rows(spark, data), 1997, 3).collect()}
    assert got[5] == 4.0 and got[6] == 3333.0 and got[7] == 0.0
    split = {x.payment_method: x.revenue for x in charts.revenue_split(rows(spark, data), 1997).collect()}
    assert split == {"Cash": 4.0, "Card": 3333.0}
    for cell in ("1e20", "1e30", "-1e35"):
        odd = [*data, r("07/03/1997/10:00:00", price=cell, pay="Odd")]
        assert {x.day: x.revenue for x in charts.revenue_trend_day(rows(spark, odd), 1997, 3).collect()}[7] == float(cell)
        assert charts.chart_totals(rows(spark, odd), 1997, 3).first().total_records == 2001


def test_empty_period(spark):
    s = T.sales(spark, SF_SMALL)
    assert [x.revenue for x in charts.revenue_trend_month(s, 2015).collect()] == [0.0] * 12
    assert charts.revenue_split(s, 2015).collect() == [] and charts.payment_vs_category(s, 2015).collect() == []
    t = charts.chart_totals(s, 2015, 3).first()
    assert (t.total_revenue_year, t.total_orders, t.total_records, t.total_revenue) == (0.0, 0, 0, 0.0)


@pytest.mark.parametrize("value", [1997.9, "x", None, float("nan")])
def test_year_must_be_whole(spark, value):
    with pytest.raises(ValueError):
        charts.revenue_trend_month(T.sales(spark, SF_SMALL), value)


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="Price"):
        charts.revenue_trend_month(T.sales(spark, SF_SMALL).drop("Price"), 1997)
