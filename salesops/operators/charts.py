"""The chart aggregations.

Shapes every chart shares:

* filter first (a range predicate on ``Date`` that reaches the Parquet scan),
  then aggregate with map-side partial aggregation, so a hot key (one payment
  type holding a third of the rows) is pre-aggregated in every task before
  the shuffle;
* totals are scalar subqueries over the already aggregated frame — no cross
  join, nothing but one value per total;
* zero-filling joins a bounded aggregate onto a bounded calendar grid;
* results are flat frames ordered by the chart's sort (measure desc, key asc
  as the pinned tie-break); top-k charts use ``orderBy().limit()``, which Spark
  plans as a per-task top-k followed by a merge of k rows per task.

Amounts are summed as given (see ``clean.money_sum``) and rounded once, half to
even, when they are shown. Percentages use double division and round half to
even, like Python's ``round``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.constants import TOP_ITEMS
from salesops.functions.dates import days_in_month, month_abbr, time_bucket
from salesops.functions.numbers import pct
from salesops.operators.clean import (
    by_month_opt,
    by_year,
    by_year_month,
    check_month,
    check_year,
    clean_for,
    money_sum,
)
from salesops.plans.calendar import day_bucket_grid, day_grid, month_grid, zero_fill

# Parts into which the payment axis is dealt to meet the category axis.
AXIS_PARTS = 16

_KEEP = ("year", "month")


def _scalar(df: DataFrame):
    """A one-row, one-column frame as a scalar subquery column."""
    return df.scalar()


def available_years(df: DataFrame, chart: str = "revenue_trend") -> DataFrame:
    """A0: sorted distinct years of valid dates, after ``chart``'s cleaning."""
    c = clean_for(df, chart)
    return c.select(F.year("Date").cast("bigint").alias("year")).distinct().orderBy("year")


def _rank(*order):
    """Place in the chart's order, from 1: over the groups of an axis, not over lines."""
    return F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank")


def _share(df: DataFrame, chart: str, col: str, out: str, year, month) -> DataFrame:
    c = by_month_opt(clean_for(df, chart, keep=_KEEP), year, month)
    g = c.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = _scalar(g.select(F.sum("count")))
    return (
        g.select(F.col(col).alias(out), "count", pct(F.col("count"), total).alias("percentage"), _rank(F.desc("count"), F.asc(col)))
        .orderBy("rank")
    )


def payment_method_split(df: DataFrame, year, month=None) -> DataFrame:
    """A1: rows per payment type and share of all rows, by count desc."""
    return _share(df, "payment_method_split", "PaymentType", "payment_method", year, month)


def category_performance(df: DataFrame, year, month=None) -> DataFrame:
    """A2: rows (not revenue) per category and share, by count desc."""
    return _share(df, "category_performance", "Category", "category", year, month)


def revenue_split(df: DataFrame, year, month=None) -> DataFrame:
    """A3: summed Price per payment type and share; no rows when the total ≤ 0."""
    c = by_month_opt(clean_for(df, "revenue_split", keep=_KEEP), year, month)
    g = c.groupBy("PaymentType").agg(money_sum().alias("amount"))
    total = _scalar(g.select(F.sum("amount")))
    return (
        g.where(total > 0)
        .select(
            F.col("PaymentType").alias("payment_method"),
            F.bround("amount", 2).alias("revenue"),
            pct(F.col("amount"), total).alias("percentage"),
            _rank(F.desc("amount"), F.asc("PaymentType")),
        )
        .orderBy("rank")
    )


def revenue_trend_month(df: DataFrame, year) -> DataFrame:
    """A4: revenue per month 1–12 of a year, zero-filled, labelled Jan…Dec."""
    y = check_year(year)
    c = by_year(clean_for(df, "revenue_trend", keep=_KEEP), y)
    g = c.groupBy(F.month("Date").alias("month")).agg(money_sum().alias("amount"))
    filled = zero_fill(month_grid(df.sparkSession), g, ["month"], {"amount": 0.0})
    return filled.select(
        F.col("month").cast("bigint").alias("month"),
        month_abbr(F.col("month")).alias("label"),
        F.bround("amount", 2).alias("revenue"),
    ).orderBy("month")


def revenue_trend_day(df: DataFrame, year, month) -> DataFrame:
    """A5: revenue per day of one month, zero-filled, labelled '1'…'31'."""
    y, m = check_year(year), check_month(month, required=True)
    c = by_year_month(clean_for(df, "revenue_trend", keep=_KEEP), y, m)
    g = c.groupBy(F.dayofmonth("Date").alias("day")).agg(money_sum().alias("amount"))
    filled = zero_fill(day_grid(df.sparkSession, y, m), g, ["day"], {"amount": 0.0})
    return filled.select(
        F.col("day").cast("bigint").alias("day"),
        F.col("day").cast("string").alias("label"),
        F.bround("amount", 2).alias("revenue"),
    ).orderBy("day")


def revenue_trend_day_by(df: DataFrame, keys, year, month) -> DataFrame:
    """A5 of every dataset at once: ``keys`` name a dataset; each has all days of the month."""
    y, m = check_year(year), check_month(month, required=True)
    c = by_year_month(clean_for(df, "revenue_trend", keep=(*_KEEP, *keys)), y, m)
    g = c.groupBy(*keys, F.dayofmonth("Date").alias("day")).agg(money_sum().alias("amount"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(days_in_month(y, m)))).alias("day"))
    filled = grid.join(g, [*keys, "day"], "left")
    return filled.select(*keys, F.col("day").cast("bigint").alias("day"), F.col("day").cast("string").alias("label"), F.bround(F.coalesce("amount", F.lit(0.0)), 2).alias("revenue"))


def revenue_trend(df: DataFrame, year, month=None) -> DataFrame:
    """A4 when no month is given, A5 otherwise (as one chart)."""
    if month is None:
        return revenue_trend_month(df, year)
    return revenue_trend_day(df, year, month)


def order_volume(df: DataFrame, year, month) -> DataFrame:
    """Distinct orders per day of a month, zero-filled.

    ``countDistinct`` is planned as an aggregate on (day, OrderID) first, so a
    busy day is spread over tasks by order before the per-day count.
    """
    y, m = check_year(year), check_month(month, required=True)
    c = by_year_month(clean_for(df, "order_volume", keep=_KEEP), y, m)
    g = c.groupBy(F.dayofmonth("Date").alias("day")).agg(F.countDistinct("OrderID").alias("count"))
    filled = zero_fill(day_grid(df.sparkSession, y, m), g, ["day"], {"count": 0})
    return filled.select(F.col("day").cast("bigint").alias("day"), F.col("count").cast("bigint").alias("count")).orderBy("day")


def _day_bucket_agg(df: DataFrame, year, month) -> DataFrame:
    y, m = check_year(year), check_month(month, required=True)
    c = by_year_month(clean_for(df, "day_wise_pattern", keep=_KEEP), y, m)
    return c.groupBy(F.dayofmonth("Date").alias("day"), time_bucket(F.col("Date")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("sales_count"), money_sum().alias("amount")
    )


def day_wise_pattern(df: DataFrame, year, month) -> DataFrame:
    """Per day × {morning, daytime, evening}: rows, amount, and intensity
    = % of the month's largest cell (0 when that is ≤ 0); all cells present."""
    y, m = check_year(year), check_month(month, required=True)
    g = _day_bucket_agg(df, y, m)
    top = _scalar(g.select(F.max("amount")))
    g = g.withColumn(
        "intensity",
        F.when(F.coalesce(top, F.lit(0)) <= 0, F.lit(0.0)).otherwise(pct(F.col("amount"), top)),
    )
    filled = zero_fill(
        day_bucket_grid(df.sparkSession, y, m), g, ["day", "bucket"],
        {"sales_count": 0, "amount": 0.0, "intensity": 0.0},
    )
    return filled.select(
        F.col("day").cast("bigint").alias("day"),
        "bucket",
        F.col("sales_count").cast("bigint").alias("sales_count"),
        F.bround("amount", 2).alias("sales_amount"),
        F.col("intensity").cast("double").alias("intensity"),
    ).orderBy("day", F.col("bucket_pos") if "bucket_pos" in filled.columns else "bucket")


def day_wise_pattern_wide(df: DataFrame, year, month) -> DataFrame:
    """A7 as one row per day with a column group per bucket (the chart's shape)."""
    long = day_wise_pattern(df, year, month)
    from salesops.constants import BUCKETS

    wide = long.groupBy("day").pivot("bucket", BUCKETS).agg(  # one row per (day, bucket)
        F.max("sales_count").alias("sales_count"),
        F.max("sales_amount").alias("sales_amount"),
        F.max("intensity").alias("intensity"),
    )
    return wide.orderBy("day")


def top_selling_items(df: DataFrame, year, month=None, limit: int = TOP_ITEMS) -> DataFrame:
    """Summed quantity per item, the top ``limit``, rounded half to even."""
    c = by_month_opt(clean_for(df, "top_selling_items", keep=_KEEP), year, month)
    g = c.groupBy("Item").agg(F.sum("Quantity").alias("q"))
    top = g.orderBy(F.desc("q"), F.asc("Item")).limit(limit)
    w = Window.orderBy(F.desc("q"), F.asc("Item"))  # ≤ limit rows
    return top.select(
        F.row_number().over(w).cast("bigint").alias("rank"),
        F.col("Item").alias("item"),
        F.bround("q", 0).cast("bigint").alias("quantity"),
    ).orderBy("rank")


def top_selling_items_by(df: DataFrame, keys, year, month=None, limit: int = TOP_ITEMS) -> DataFrame:
    """A8 of every dataset at once: the top ``limit`` items of each of ``keys``' values.

    Ranked over summed items, with a limit in every task before the shuffle.
    """
    c = by_month_opt(clean_for(df, "top_selling_items", keep=(*_KEEP, *keys)), year, month)
    g = c.groupBy(*keys, "Item").agg(F.sum("Quantity").alias("q"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("q"), F.asc("Item")))).where(F.col("rank") <= limit)
    return ranked.select(*keys, F.col("rank").cast("bigint").alias("rank"), F.col("Item").alias("item"), F.bround("q", 0).cast("bigint").alias("quantity"))


def payment_cells(df: DataFrame, year, month=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A10's sparse form: the cells that occur, and each axis with its totals
    and rank (total desc, then name)."""
    c = by_month_opt(clean_for(df, "payment_vs_category", keep=_KEEP), year, month)
    g = c.groupBy("Category", "PaymentType").agg(F.count(F.lit(1)).alias("count"))
    return g, _axis(g, "Category", "category_total"), _axis(g, "PaymentType", "payment_total")


def _axis(cells: DataFrame, col: str, total: str) -> DataFrame:
    axis = cells.groupBy(col).agg(F.sum("count").cast("bigint").alias(total))
    return axis.withColumn(f"{total.split('_')[0]}_rank", _rank(F.desc(total), F.asc(col)))


def payment_vs_category(df: DataFrame, year, month=None) -> DataFrame:
    """A10: dense category × payment matrix of row counts, with each cell's
    share of its category; both axes ordered by their totals (desc, then name).

    The matrix is the chart's own shape. The payment axis is dealt by hash into
    AXIS_PARTS parts and every category goes to each part, so the two axes meet
    through an equi-join, in as many tasks as there are parts; the sparse counts
    are left-joined to the cells. Neither axis is collected or bounded.
    """
    g, cats, pays = payment_cells(df, year, month)
    part = F.pmod(F.xxhash64("PaymentType"), F.lit(AXIS_PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(AXIS_PARTS - 1)))
    grid = cats.withColumn("part", every).join(pays.withColumn("part", part), "part").drop("part")
    cells = grid.join(g, ["Category", "PaymentType"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return cells.select(
        F.col("Category").alias("category"),
        "category_total",
        F.col("PaymentType").alias("payment_method"),
        "payment_total",
        F.col("count").cast("bigint").alias("count"),
        pct(F.col("count"), F.col("category_total")).alias("percentage"),
        "category_rank",
        "payment_rank",
    ).orderBy("category_rank", "payment_rank")


# --- A12: the scalar totals next to each chart --------------------------------


def total_records(df: DataFrame, year, month=None, chart: str = "payment_method_split") -> DataFrame:
    """A1/A2/A10 total: rows after cleaning and filtering."""
    c = by_month_opt(clean_for(df, chart, keep=_KEEP), year, month)
    return c.select(F.count(F.lit(1)).cast("bigint").alias("total_records"))


def revenue_split_total(df: DataFrame, year, month=None) -> DataFrame:
    """A3 total: rounded sum of Price, 0.0 when ≤ 0."""
    c = by_month_opt(clean_for(df, "revenue_split", keep=_KEEP), year, month)
    return c.agg(money_sum().alias("s")).select(F.when(F.col("s") > 0, F.bround("s", 2)).otherwise(F.lit(0.0)).alias("total_revenue"))


def revenue_trend_total(df: DataFrame, year, month=None) -> DataFrame:
    """A4/A5 total: sum of the (already rounded) points."""
    pts = revenue_trend(df, year, month)
    return pts.select(F.bround(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("total_revenue"))


def order_volume_total(df: DataFrame, year, month) -> DataFrame:
    """A6 total: sum of the daily distinct counts."""
    return order_volume(df, year, month).select(F.sum("count").cast("bigint").alias("total_orders"))


def day_wise_pattern_totals(df: DataFrame, year, month) -> DataFrame:
    """A7 totals: all rows, and the rounded sum of the rounded cell amounts."""
    pts = day_wise_pattern(df, year, month)
    return pts.select(
        F.sum("sales_count").cast("bigint").alias("total_sales_count"),
        F.bround(F.sum("sales_amount"), 2).alias("total_sales_amount"),
    )


def top_selling_items_total(df: DataFrame, year, month=None) -> DataFrame:
    """A8 total: sum of the shown (top 20, rounded) quantities only."""
    pts = top_selling_items(df, year, month)
    return pts.select(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("total_quantity"))


def chart_totals(
    df: DataFrame,
    year,
    month,
    hours_df: DataFrame | None = None,
    hours_year=None,
    hours_month=None,
) -> DataFrame:
    """Every chart's total for one (year, month) in one row.

    The day-wise totals come from ``hours_df`` (a table with times of day) for
    (``hours_year``, ``hours_month``) when given, else from ``df``. The revenue
    totals and the record count come from one aggregate of the year by month
    and day; order, item, basket and day-wise totals from one frame each.
    """
    from salesops.operators.basket import market_basket_total

    y, m = check_year(year), check_month(month, required=True)
    if hours_df is None:
        hours_df, hours_year, hours_month = df, year, month
    c = by_year(clean_for(df, "revenue_trend", keep=_KEEP), y)
    days = c.groupBy(F.month("Date").alias("month"), F.dayofmonth("Date").alias("day")).agg(  # at most 366 rows
        money_sum().alias("amount"), F.count(F.lit(1)).alias("n")
    )
    months = days.groupBy("month").agg(F.sum("amount").alias("amount"), F.sum(F.bround("amount", 2)).alias("points"), F.sum("n").alias("n"))
    own = F.col("month") == m
    picked = lambda col: F.coalesce(F.sum(F.when(own, F.col(col))), F.lit(0))
    sums = months.agg(
        F.bround(F.coalesce(F.sum(F.bround("amount", 2)), F.lit(0.0)), 2).alias("total_revenue_year"),
        F.bround(picked("points"), 2).cast("double").alias("total_revenue_month"),
        picked("n").cast("bigint").alias("total_records"),
        F.bround(F.greatest(picked("amount"), F.lit(0)), 2).cast("double").alias("total_revenue"),
    )
    parts = [
        sums,
        order_volume_total(df, year, month),
        top_selling_items_total(df, year, month),
        market_basket_total(df, year),
        day_wise_pattern_totals(hours_df, hours_year, hours_month),
    ]
    structs = [f.select(F.struct(*f.columns)).scalar() for f in parts]  # one subquery for each frame
    one = df.sparkSession.range(1, 2, numPartitions=1).select(*[x.alias(f"s{i}") for i, x in enumerate(structs)])
    return one.select(*[F.col(f"s{i}.{n}") for i, f in enumerate(parts) for n in f.columns])
