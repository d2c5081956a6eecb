"""The registered queries: one per operator, each with its DuckDB oracle.

Each entry maps a key to ``(spark_fn, oracle_sql)``. ``spark_fn(spark,
sf_dir)`` returns a DataFrame over the driver's tables; ``oracle_sql`` is
the same result in DuckDB SQL over the pre-registered views (``None`` where
the result is not expressible in SQL and is checked by own tests instead).

Chart parameters follow FIXTURES.md: year 1997 / month 3 on ``sales``,
2024 / 1 on ``sales_hours``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesops import oracle as O
from salesops.operators import basket, charts
from salesops.sources import tables as T

YEAR, MONTH = 1997, 3
H_YEAR, H_MONTH = 2024, 1
EMPTY_YEAR = 2015  # no sales

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# Charts (A0–A12), on the clean ``sales`` table and on the dirty ``raw_sales``
# ---------------------------------------------------------------------------


def _clean_cte(src: str) -> str:
    """``c``: every chart input column, cleaned by the chart rules."""
    if src == "sales":
        date, qty, price, cte = '"Date"', '"Quantity"', '"Price"', O.SALES_CTE
    else:
        date, qty, price, cte = O.parse_date('"Date"'), O.num('"Quantity"'), O.money('"Price"'), O.RAW_SALES_CTE
    return _with(
        cte,
        f"""c AS (SELECT {date} AS "Date", {O.label('"PaymentType"')} AS pay, {O.label('"Category"')} AS cat,
                    {O.key('"OrderID"')} AS oid, {O.key('"Item"')} AS item, {qty} AS qty, {price} AS price
             FROM {src})""",
    )


def _where(year, month=None) -> str:
    return '"Date" IS NOT NULL AND ' + O.period('"Date"', year, month)


def sql_available_years(src):
    return _clean_cte(src) + 'SELECT DISTINCT CAST(year("Date") AS BIGINT) AS year FROM c WHERE "Date" IS NOT NULL'


def sql_share(src, col, out, year, month=None):
    return (
        _clean_cte(src)
        + f", g AS (SELECT {col} AS {out}, count(*) AS count FROM c WHERE {_where(year, month)} GROUP BY 1)\n"
        + f"SELECT {out}, count, {O.pct('count', '(SELECT sum(count) FROM g)')} AS percentage, "
        + f"row_number() OVER (ORDER BY count DESC, {out}) AS rank FROM g"
    )


def sql_revenue_split(src, year, month=None):
    return (
        _clean_cte(src)
        + f""", g AS (SELECT pay AS payment_method, sum(price) AS amount FROM c WHERE {_where(year, month)} GROUP BY 1),
           t AS (SELECT sum(amount) AS total FROM g)
        SELECT payment_method, {O.shown('amount')} AS revenue,
               {O.pct('amount', '(SELECT total FROM t)')} AS percentage,
               row_number() OVER (ORDER BY amount DESC, payment_method) AS rank
        FROM g WHERE (SELECT total FROM t) > 0"""
    )


def sql_revenue_trend_month(src, year):
    return (
        _clean_cte(src)
        + f""", g AS (SELECT month("Date") AS month, sum(price) AS amount FROM c WHERE {_where(year)} GROUP BY 1)
        SELECT CAST(m.month AS BIGINT) AS month, strftime(make_date(2000, CAST(m.month AS INTEGER), 1), '%b') AS label,
               {O.shown('g.amount')} AS revenue
        FROM range(1, 13) m(month) LEFT JOIN g ON g.month = m.month"""
    )


def _days(year, month):
    import calendar

    return calendar.monthrange(year, month)[1]


def sql_revenue_trend_day(src, year, month):
    return (
        _clean_cte(src)
        + f""", g AS (SELECT day("Date") AS day, sum(price) AS amount FROM c WHERE {_where(year, month)} GROUP BY 1)
        SELECT CAST(m.day AS BIGINT) AS day, CAST(m.day AS VARCHAR) AS label,
               {O.shown('g.amount')} AS revenue
        FROM range(1, {_days(year, month) + 1}) m(day) LEFT JOIN g ON g.day = m.day"""
    )


def sql_order_volume(src, year, month):
    return (
        _clean_cte(src)
        + f""", g AS (SELECT day("Date") AS day, count(DISTINCT oid) AS count FROM c
                   WHERE {_where(year, month)} AND oid <> '' GROUP BY 1)
        SELECT CAST(m.day AS BIGINT) AS day, CAST(coalesce(g.count, 0) AS BIGINT) AS count
        FROM range(1, {_days(year, month) + 1}) m(day) LEFT JOIN g ON g.day = m.day"""
    )


def sql_day_wise_pattern(src_cte, src, year, month):
    date = '"Date"' if src != "raw_sales" else O.parse_date('"Date"')
    price = '"Price"' if src != "raw_sales" else O.money('"Price"')
    return _with(
        src_cte,
        f'c AS (SELECT {date} AS "Date", {price} AS price FROM {src})',
        f"""g AS (SELECT day("Date") AS day,
                    CASE WHEN hour("Date") < 12 THEN 'morning' WHEN hour("Date") < 18 THEN 'daytime' ELSE 'evening' END AS bucket,
                    count(*) AS sales_count, sum(price) AS amount
             FROM c WHERE {_where(year, month)} GROUP BY 1, 2)""",
        "mx AS (SELECT max(amount) AS top FROM g)",
        f"""grid AS (SELECT d.day, b.bucket FROM range(1, {_days(year, month) + 1}) d(day),
                    (VALUES ('morning'), ('daytime'), ('evening')) b(bucket))""",
        f"""pts AS (SELECT CAST(grid.day AS BIGINT) AS day, grid.bucket,
              CAST(coalesce(g.sales_count, 0) AS BIGINT) AS sales_count,
              {O.shown('g.amount')} AS sales_amount,
              CASE WHEN g.amount IS NULL THEN 0.0
                   WHEN coalesce((SELECT top FROM mx), 0) <= 0 THEN 0.0
                   ELSE {O.pct('g.amount', '(SELECT top FROM mx)')} END AS intensity
       FROM grid LEFT JOIN g ON g.day = grid.day AND g.bucket = grid.bucket)""",
    )


def sql_top_selling_items(src, year, month=None):
    return (
        _clean_cte(src)
        + f""", g AS (SELECT item, sum(qty) AS q FROM c WHERE {_where(year, month)} AND item <> '' GROUP BY 1)
        SELECT CAST(row_number() OVER (ORDER BY q DESC, item) AS BIGINT) AS rank, item,
               CAST(round_even(q, 0) AS BIGINT) AS quantity
        FROM g ORDER BY q DESC, item LIMIT 20"""
    )


def _basket_ctes(src, year):
    return _clean_cte(src) + f""", dd AS (SELECT DISTINCT oid, item FROM c
                 WHERE {_where(year)} AND oid <> '' AND item <> '')"""


def sql_market_basket(src, year):
    return (
        _basket_ctes(src, year)
        + """, p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS count, min(a.oid) AS first_order
               FROM dd a JOIN dd b ON a.oid = b.oid AND a.item < b.item GROUP BY 1, 2)
        SELECT CAST(row_number() OVER (ORDER BY count DESC, first_order, item_a, item_b) AS BIGINT) AS rank,
               item_a || ' + ' || item_b AS label, CAST(count AS BIGINT) AS count
        FROM p ORDER BY rank LIMIT 20"""
    )


def sql_market_basket_total(src, year):
    return (
        _basket_ctes(src, year)
        + """, n AS (SELECT oid, count(*) AS n FROM dd GROUP BY 1)
        SELECT CAST(coalesce(sum(n * (n - 1) / 2), 0) AS BIGINT) AS total_pair_occurrences FROM n"""
    )


def sql_payment_vs_category(src, year, month=None):
    return (
        _clean_cte(src)
        + f""", g AS (SELECT cat AS category, pay AS payment_method, count(*) AS count
                   FROM c WHERE {_where(year, month)} GROUP BY 1, 2),
           ct AS (SELECT category, sum(count) AS category_total, row_number() OVER (ORDER BY sum(count) DESC, category) AS category_rank FROM g GROUP BY 1),
           pt AS (SELECT payment_method, sum(count) AS payment_total, row_number() OVER (ORDER BY sum(count) DESC, payment_method) AS payment_rank FROM g GROUP BY 1)
        SELECT ct.category, CAST(ct.category_total AS BIGINT) AS category_total,
               pt.payment_method, CAST(pt.payment_total AS BIGINT) AS payment_total,
               CAST(coalesce(g.count, 0) AS BIGINT) AS count,
               CASE WHEN ct.category_total > 0 THEN {O.pct('coalesce(g.count, 0)', 'ct.category_total')} ELSE 0.0 END AS percentage,
               category_rank, payment_rank
        FROM ct CROSS JOIN pt LEFT JOIN g ON g.category = ct.category AND g.payment_method = pt.payment_method"""
    )


def sql_chart_totals(year, month, h_year, h_month):
    """A12 in one row; each total restated from its chart's SQL."""
    src = "sales"
    rt_y = sql_revenue_trend_month(src, year)
    rt_m = sql_revenue_trend_day(src, year, month)
    ov = sql_order_volume(src, year, month)
    ti = sql_top_selling_items(src, year, month)
    mb = sql_market_basket_total(src, year)
    pv = sql_payment_vs_category(src, year, month)
    rs = _clean_cte(src) + f'SELECT sum(price) AS s FROM c WHERE {_where(year, month)}'
    dw = sql_day_wise_pattern(O.SALES_HOURS_CTE, "sales_hours", h_year, h_month) + "SELECT * FROM pts"
    return f"""SELECT
      (SELECT round_even(coalesce(sum(revenue), 0.0), 2) FROM ({rt_y})) AS total_revenue_year,
      (SELECT round_even(coalesce(sum(revenue), 0.0), 2) FROM ({rt_m})) AS total_revenue_month,
      (SELECT CAST(sum(count) AS BIGINT) FROM ({ov})) AS total_orders,
      (SELECT CAST(coalesce(sum(quantity), 0) AS BIGINT) FROM ({ti})) AS total_quantity,
      (SELECT total_pair_occurrences FROM ({mb})) AS total_pair_occurrences,
      (SELECT CAST(sum(count) AS BIGINT) FROM ({pv})) AS total_records,
      (SELECT CASE WHEN coalesce(s, 0) > 0 THEN {O.shown('s')} ELSE 0.0 END FROM ({rs})) AS total_revenue,
      (SELECT CAST(sum(sales_count) AS BIGINT) FROM ({dw})) AS total_sales_count,
      (SELECT round_even(sum(sales_amount), 2) FROM ({dw})) AS total_sales_amount"""


def _chart_set(src: str, load, suffix: str):
    register(f"available_years{suffix}", sql_available_years(src))(
        lambda spark, d: charts.available_years(load(spark, d))
    )
    register(f"payment_method_split{suffix}", sql_share(src, "pay", "payment_method", YEAR))(
        lambda spark, d: charts.payment_method_split(load(spark, d), YEAR)
    )
    register(f"category_performance{suffix}", sql_share(src, "cat", "category", YEAR, MONTH))(
        lambda spark, d: charts.category_performance(load(spark, d), YEAR, MONTH)
    )
    register(f"revenue_split{suffix}", sql_revenue_split(src, YEAR))(
        lambda spark, d: charts.revenue_split(load(spark, d), YEAR)
    )
    register(f"revenue_trend_month{suffix}", sql_revenue_trend_month(src, YEAR))(
        lambda spark, d: charts.revenue_trend_month(load(spark, d), YEAR)
    )
    register(f"revenue_trend_day{suffix}", sql_revenue_trend_day(src, YEAR, MONTH))(
        lambda spark, d: charts.revenue_trend_day(load(spark, d), YEAR, MONTH)
    )
    register(f"payment_method_split_month{suffix}", sql_share(src, "pay", "payment_method", YEAR, MONTH))(
        lambda spark, d: charts.payment_method_split(load(spark, d), YEAR, MONTH)
    )
    register(f"category_performance_year{suffix}", sql_share(src, "cat", "category", YEAR))(
        lambda spark, d: charts.category_performance(load(spark, d), YEAR)
    )
    register(f"revenue_split_month{suffix}", sql_revenue_split(src, YEAR, MONTH))(
        lambda spark, d: charts.revenue_split(load(spark, d), YEAR, MONTH)
    )
    register(f"top_selling_items_month{suffix}", sql_top_selling_items(src, YEAR, MONTH))(
        lambda spark, d: charts.top_selling_items(load(spark, d), YEAR, MONTH)
    )
    register(f"payment_vs_category_month{suffix}", sql_payment_vs_category(src, YEAR, MONTH))(
        lambda spark, d: charts.payment_vs_category(load(spark, d), YEAR, MONTH)
    )
    for chart, keys in (("order_volume", ("oid",)), ("market_basket", ("oid", "item")), ("top_selling_items", ("item",))):
        register(f"available_years_{chart}{suffix}", sql_available_years(src) + "".join(f" AND {k} <> ''" for k in keys))(
            lambda spark, d, chart=chart: charts.available_years(load(spark, d), chart)
        )
    register(f"revenue_trend_month_empty{suffix}", sql_revenue_trend_month(src, EMPTY_YEAR))(
        lambda spark, d: charts.revenue_trend_month(load(spark, d), EMPTY_YEAR)
    )
    register(f"revenue_split_empty{suffix}", sql_revenue_split(src, EMPTY_YEAR))(
        lambda spark, d: charts.revenue_split(load(spark, d), EMPTY_YEAR)
    )
    # What each chart shows when the filter leaves nothing.
    for name, sql, chart in (
        ("payment_method_split", sql_share(src, "pay", "payment_method", EMPTY_YEAR), lambda df: charts.payment_method_split(df, EMPTY_YEAR)),
        ("category_performance", sql_share(src, "cat", "category", EMPTY_YEAR, MONTH), lambda df: charts.category_performance(df, EMPTY_YEAR, MONTH)),
        ("revenue_trend_day", sql_revenue_trend_day(src, EMPTY_YEAR, MONTH), lambda df: charts.revenue_trend_day(df, EMPTY_YEAR, MONTH)),
        ("order_volume", sql_order_volume(src, EMPTY_YEAR, MONTH), lambda df: charts.order_volume(df, EMPTY_YEAR, MONTH)),
        ("top_selling_items", sql_top_selling_items(src, EMPTY_YEAR), lambda df: charts.top_selling_items(df, EMPTY_YEAR)),
        ("market_basket", sql_market_basket(src, EMPTY_YEAR), lambda df: basket.market_basket(df, EMPTY_YEAR)),
        ("payment_vs_category", sql_payment_vs_category(src, EMPTY_YEAR), lambda df: charts.payment_vs_category(df, EMPTY_YEAR)),
    ):
        if not suffix:
            register(f"{name}_empty", sql)(lambda spark, d, chart=chart: chart(load(spark, d)))
    register(f"order_volume{suffix}", sql_order_volume(src, YEAR, MONTH))(
        lambda spark, d: charts.order_volume(load(spark, d), YEAR, MONTH)
    )
    register(f"top_selling_items{suffix}", sql_top_selling_items(src, YEAR))(
        lambda spark, d: charts.top_selling_items(load(spark, d), YEAR)
    )
    register(f"market_basket{suffix}", sql_market_basket(src, YEAR))(
        lambda spark, d: basket.market_basket(load(spark, d), YEAR)
    )
    register(f"market_basket_total{suffix}", sql_market_basket_total(src, YEAR))(
        lambda spark, d: basket.market_basket_total(load(spark, d), YEAR)
    )
    register(f"payment_vs_category{suffix}", sql_payment_vs_category(src, YEAR))(
        lambda spark, d: charts.payment_vs_category(load(spark, d), YEAR)
    )


_chart_set("sales", T.sales, "")

register("day_wise_pattern", sql_day_wise_pattern(O.SALES_HOURS_CTE, "sales_hours", H_YEAR, H_MONTH) + "SELECT * FROM pts")(
    lambda spark, d: charts.day_wise_pattern(T.sales_hours(spark, d), H_YEAR, H_MONTH)
)
register("day_wise_pattern_empty", sql_day_wise_pattern(O.SALES_HOURS_CTE, "sales_hours", EMPTY_YEAR, H_MONTH) + "SELECT * FROM pts")(
    lambda spark, d: charts.day_wise_pattern(T.sales_hours(spark, d), EMPTY_YEAR, H_MONTH)
)
register("chart_totals", sql_chart_totals(YEAR, MONTH, H_YEAR, H_MONTH))(
    lambda spark, d: charts.chart_totals(T.sales(spark, d), YEAR, MONTH, T.sales_hours(spark, d), H_YEAR, H_MONTH)
)

_chart_set("raw_sales", T.raw_sales, "_raw")
register(
    "day_wise_pattern_raw",
    sql_day_wise_pattern(O.RAW_SALES_CTE, "raw_sales", YEAR, MONTH) + "SELECT * FROM pts",
)(lambda spark, d: charts.day_wise_pattern(T.raw_sales(spark, d), YEAR, MONTH))


# ---------------------------------------------------------------------------
# Cleaning (N1–N6) and filters (F1–F3) on the dirty text table
# ---------------------------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from salesops.functions.dates import parse_date as _parse_date  # noqa: E402
from salesops.functions.numbers import num_or_zero as _num  # noqa: E402
from salesops.functions.text import label_unknown as _label, text_key as _key  # noqa: E402
from salesops.operators import clean, quality  # noqa: E402

_R = O.RAW_SALES_CTE
_RD = O.parse_date('"Date"')


@register(
    "parse_date",
    _with(_R) + f"""SELECT row_number, "Date" AS date_text, strftime({_RD}, '%Y-%m-%d %H:%M:%S') AS parsed FROM raw_sales""",
)
def q_parse_date(spark, d):
    r = T.raw_sales(spark, d)
    return r.select(
        "row_number",
        F.col("Date").alias("date_text"),
        F.date_format(_parse_date("Date", r.schema["Date"].dataType), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
    )


@register("drop_bad_dates", _with(_R) + f"SELECT row_number FROM raw_sales WHERE {_RD} IS NOT NULL")
def q_drop_bad_dates(spark, d):
    return clean.drop_bad_dates(clean.parse_dates(T.raw_sales(spark, d))).select("row_number")


@register(
    "label_unknown",
    _with(_R) + f"""SELECT row_number, {O.label('"Category"')} AS category, {O.label('"PaymentType"')} AS payment_method FROM raw_sales""",
)
def q_label_unknown(spark, d):
    return T.raw_sales(spark, d).select("row_number", _label("Category").alias("category"), _label("PaymentType").alias("payment_method"))


@register(
    "text_key",
    _with(_R) + f"""SELECT row_number, {O.key('"OrderID"')} AS order_key, {O.key('"Item"')} AS item_key FROM raw_sales""",
)
def q_text_key(spark, d):
    return T.raw_sales(spark, d).select("row_number", _key("OrderID").alias("order_key"), _key("Item").alias("item_key"))


@register(
    "drop_empty_keys",
    _with(_R, f"""k AS (SELECT row_number, {O.key('"PaymentType"')} AS payment_key, {O.key('"OrderID"')} AS order_key FROM raw_sales)""")
    + "SELECT row_number, payment_key, order_key FROM k WHERE payment_key <> '' AND order_key <> ''",
)
def q_drop_empty_keys(spark, d):
    k = T.raw_sales(spark, d).select("row_number", _key("PaymentType").alias("payment_key"), _key("OrderID").alias("order_key"))
    return clean.drop_empty_keys(k, ["payment_key", "order_key"])


@register(
    "num_or_zero",
    _with(_R) + f"""SELECT row_number, {O.num('"Quantity"')} AS quantity, {O.num('"Price"')} AS price FROM raw_sales""",
)
def q_num_or_zero(spark, d):
    r = T.raw_sales(spark, d)
    return r.select("row_number", _num("Quantity", r.schema["Quantity"].dataType).alias("quantity"),
                    _num("Price", r.schema["Price"].dataType).alias("price"))


def _filter_sql(year, month=None):
    return _with(_R, f'p AS (SELECT row_number, {_RD} AS "Date" FROM raw_sales)') + (
        f'SELECT row_number FROM p WHERE "Date" IS NOT NULL AND {O.period(chr(34) + "Date" + chr(34), year, month)}'
    )


def _parsed(spark, d):
    return clean.drop_bad_dates(clean.parse_dates(T.raw_sales(spark, d).select("row_number", "Date")))


register("by_year", _filter_sql(YEAR))(lambda spark, d: clean.by_year(_parsed(spark, d), YEAR).select("row_number"))
register("by_month_opt", _filter_sql(YEAR, MONTH))(
    lambda spark, d: clean.by_month_opt(_parsed(spark, d), YEAR, MONTH).select("row_number")
)
register("by_year_month", _filter_sql(1998, 7))(
    lambda spark, d: clean.by_year_month(_parsed(spark, d), 1998, 7).select("row_number")
)


# ---------------------------------------------------------------------------
# Validation (V2–V5) on the dirty text table, as one file named 'raw_sales'
# ---------------------------------------------------------------------------


def _raw_cells(spark, d):
    return quality.text_cells(T.raw_sales(spark, d), "raw_sales")


def _viol_sql() -> str:
    def strip(x):
        return O.strip(x)

    def nnum(x):
        s = strip(x)
        return f"CASE WHEN regexp_full_match({s}, {O.q(O.NUMBER_SHAPE)}) THEN try_cast({s} AS DOUBLE) END"

    def text_ok(x):
        return f"({x} IS NOT NULL AND {strip(x)} <> '')"

    date_ok = (
        f"""("Date" IS NOT NULL AND regexp_full_match({strip('"Date"')}, {O.q(O.DATE_TEXT_SHAPE)})
             AND try_strptime({strip('"Date"')}, {O.q(O.DATE_FORMAT_SQL)}) IS NOT NULL)"""
    )
    qn, pn = nnum('"Quantity"'), nnum('"Price"')
    rules = [
        ("Date", date_ok),
        ("Day", text_ok('"Day"')),
        ("OrderID", text_ok('"OrderID"')),
        ("Item", text_ok('"Item"')),
        ("Quantity", f"(({qn}) IS NOT NULL AND ({qn}) = floor({qn}) AND ({qn}) > 0)"),
        ("Price", f"(({pn}) IS NOT NULL AND ({pn}) >= 0)"),
        ("Category", text_ok('"Category"')),
        ("PaymentType", text_ok('"PaymentType"')),
    ]
    blank = " AND ".join(f"({c} IS NULL OR {strip(c)} = '')" for c in [f'"{n}"' for n, _ in rules])
    parts = [
        f"SELECT 'raw_sales' AS path, row_number, CAST({i} AS BIGINT) AS col_index, '{n}' AS \"column\" FROM nb WHERE NOT coalesce({ok}, false)"
        for i, (n, ok) in enumerate(rules)
    ]
    return _with(_R, f"nb AS (SELECT * FROM raw_sales WHERE NOT ({blank}))", "v AS (" + " UNION ALL ".join(parts) + ")")


register("skip_blank_rows", _viol_sql() + "SELECT row_number FROM nb")(
    lambda spark, d: quality.skip_blank_rows(_raw_cells(spark, d)).select("row_number")
)
register("row_violations", _viol_sql() + 'SELECT * FROM v')(lambda spark, d: quality.row_violations(_raw_cells(spark, d)))
register(
    "first_violation",
    _viol_sql()
    + """, f AS (SELECT path, row_number, "column" FROM v ORDER BY row_number, col_index LIMIT 1)
    SELECT path, row_number, "column", 'Invalid datatype/value for ''' || "column" || ''' at row ' || CAST(row_number AS VARCHAR) || '.' AS message FROM f""",
)(lambda spark, d: quality.first_violation(_raw_cells(spark, d)))
register("has_data", _viol_sql() + "SELECT 'raw_sales' AS path, count(*) > 0 AS has_data FROM nb")(
    lambda spark, d: quality.has_data(_raw_cells(spark, d))
)
register("violation_counts", _viol_sql() + 'SELECT "column", count(*) AS violations FROM v GROUP BY 1')(
    lambda spark, d: quality.violation_counts(_raw_cells(spark, d))
)


# ---------------------------------------------------------------------------
# Recording sales and inventory (E1–E8), catalog
# ---------------------------------------------------------------------------

from salesops.operators import records  # noqa: E402
from salesops.sources import catalog  # noqa: E402

_HDR = "h AS (SELECT o_custkey AS dataset_id, o_orderkey AS request_id, o_orderdate AS ts, o_orderpriority AS payment_type FROM orders)"
_LINES = """l AS (SELECT li.l_orderkey AS request_id, li.l_linenumber AS line, p.p_name AS item,
                 CAST(li.l_quantity AS INTEGER) AS quantity, CAST(li.l_extendedprice AS DECIMAL(10,2)) AS price,
                 p.p_type AS category
          FROM lineitem li JOIN part p ON li.l_partkey = p.p_partkey)"""


def _text_ok(x, n):
    return f"({x} IS NOT NULL AND {O.strip(x)} <> '' AND length({O.strip(x)}) <= {n})"


_VALID = _with(
    _HDR,
    _LINES,
    f"""le AS (SELECT request_id, count(*) AS n_items,
                   min(CASE WHEN NOT {_text_ok('item', 120)} THEN 2
                            WHEN quantity IS NULL OR quantity < 1 THEN 3
                            WHEN price IS NULL OR price < 0 THEN 4
                            WHEN NOT {_text_ok('category', 80)} THEN 5 END) AS line_err
            FROM l GROUP BY 1)""",
    f"""e AS (SELECT h.request_id, CASE WHEN NOT {_text_ok('payment_type', 50)} THEN 0
                                     WHEN coalesce(n_items, 0) < 1 THEN 1 ELSE line_err END AS err
           FROM h LEFT JOIN le ON le.request_id = h.request_id)""",
    """v AS (SELECT request_id, err IS NULL AS is_valid,
                 ['payment_type', 'items', 'item', 'quantity', 'price', 'category'][err + 1] AS error FROM e)""",
    "num AS (SELECT h.*, CAST(100 + row_number() OVER (PARTITION BY dataset_id ORDER BY ts, h.request_id) AS BIGINT) AS order_number "
    "FROM h WHERE h.request_id IN (SELECT request_id FROM v WHERE is_valid))",
)


@register("validate_sales", _VALID + "SELECT * FROM v")
def q_validate_sales(spark, d):
    return records.validate_sales(T.sale_headers(spark, d), T.sale_lines(spark, d))


@register(
    "assign_order_ids",
    _with(_HDR)
    + """SELECT dataset_id, request_id, order_number, 'O' || CAST(order_number AS VARCHAR) AS "OrderID" FROM (
           SELECT dataset_id, request_id,
                  CAST(100 + row_number() OVER (PARTITION BY dataset_id ORDER BY ts, request_id) AS BIGINT) AS order_number
           FROM h)""",
)
def q_assign_order_ids(spark, d):
    r = records.assign_order_ids(T.sale_headers(spark, d), T.datasets(spark, d))
    return r.select("dataset_id", "request_id", "order_number", "OrderID")


@register(
    "next_order_numbers",
    _with(_HDR)
    + """SELECT c.c_custkey AS dataset_id, CAST(100 + coalesce(n.n, 0) AS BIGINT) AS last_order_number
       FROM customer c LEFT JOIN (SELECT dataset_id, count(*) AS n FROM h GROUP BY 1) n ON n.dataset_id = c.c_custkey""",
)
def q_next_order_numbers(spark, d):
    return records.next_order_numbers(T.sale_headers(spark, d), T.datasets(spark, d))


@register(
    "record_sales",
    _VALID
    + f"""SELECT num.request_id, l.line, strftime(num.ts, '%d/%m/%Y/%H:%M:%S') AS "Date", dayname(num.ts) AS "Day",
              'O' || CAST(num.order_number AS VARCHAR) AS "OrderID", {O.strip('l.item')} AS "Item",
              CAST(l.quantity AS BIGINT) AS "Quantity", CAST(l.price AS DOUBLE) AS "Price",
              {O.strip('l.category')} AS "Category", {O.strip('num.payment_type')} AS "PaymentType"
       FROM num JOIN l ON l.request_id = num.request_id""",
)
def q_record_sales(spark, d):
    return records.record_sales(T.sale_headers(spark, d), T.sale_lines(spark, d), T.datasets(spark, d))


_CAND = """cand AS (SELECT o_orderkey AS candidate_id, o_custkey % 100 AS dataset_id,
                  'I' || CAST(1001 + (o_custkey * 7) % 3000 AS VARCHAR) AS item_id,
                  'Item ' || CAST(o_orderkey AS VARCHAR) AS item_name, o_orderpriority AS item_category,
                  CASE WHEN o_orderkey % 3 = 0 THEN ''
                       ELSE 'Brand#' || CAST(1 + o_custkey % 5 AS VARCHAR) || CAST(1 + o_orderkey % 5 AS VARCHAR) END AS barcode_number,
                  CAST(o_totalprice AS DECIMAL(10,2)) AS cost_price,
                  CAST(o_totalprice * 1.2 AS DECIMAL(10,2)) AS selling_price
           FROM orders)"""
_INV = """inv AS (SELECT p_partkey AS inventory_id, p_partkey % 100 AS dataset_id, 'I' || CAST(1001 + p_partkey AS VARCHAR) AS item_id,
                 p_name AS item_name, p_type AS item_category, p_brand AS barcode_number,
                 CAST(p_retailprice * 0.7 AS DECIMAL(10,2)) AS cost_price, CAST(p_retailprice AS DECIMAL(10,2)) AS selling_price,
                 CAST(to_timestamp(1704067200 + p_partkey * 97) AS TIMESTAMP) AS created_at
          FROM part)"""


# Proposals for E4: numbers from a small range, so that some meet the number due.
_PROPOSED = """pp AS (SELECT o_orderkey AS candidate_id, o_custkey % 100 AS dataset_id,
                  CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE '' END || 'I' || CAST(1001 + (o_orderkey * 13) % 7 + (o_orderkey // 2000) AS VARCHAR) AS item_id
           FROM orders)"""


def _proposed(spark, d):
    o = T.table(spark, d, "orders")
    number = F.lit(1001) + (F.col("o_orderkey") * 13) % 7 + F.expr("o_orderkey div 2000")
    return o.select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_custkey") % 100).alias("dataset_id"),
                    F.concat(F.when(F.col("o_orderkey") % 11 == 0, F.lit(" ")).otherwise(F.lit("")), F.lit("I"), number.cast("string")).alias("item_id"))


_ONE_BY_ONE = (
    "WITH RECURSIVE " + _PROPOSED + """,
    s AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY candidate_id) AS pos FROM pp),
    r AS (SELECT dataset_id, CAST(0 AS BIGINT) AS pos, CAST(1001 AS BIGINT) AS due, CAST(1001 AS BIGINT) AS next_due, false AS ok FROM (SELECT DISTINCT dataset_id FROM s)
          UNION ALL
          SELECT s.dataset_id, s.pos, r.next_due, r.next_due + CASE WHEN trim(s.item_id) = 'I' || CAST(r.next_due AS VARCHAR) THEN 1 ELSE 0 END,
                 trim(s.item_id) = 'I' || CAST(r.next_due AS VARCHAR)
          FROM r JOIN s ON s.dataset_id = r.dataset_id AND s.pos = r.pos + 1)
    """
)


@register(
    "assign_item_ids",
    _ONE_BY_ONE
    + """SELECT s.candidate_id, s.dataset_id, s.item_id, 'I' || CAST(r.due AS VARCHAR) AS expected_item_id, r.ok AS id_ok
       FROM r JOIN s ON s.dataset_id = r.dataset_id AND s.pos = r.pos""",
)
def q_assign_item_ids(spark, d):
    r = records.assign_item_ids(_proposed(spark, d), T.datasets(spark, d))
    return r.select("candidate_id", "dataset_id", "item_id", "expected_item_id", "id_ok")


@register(
    "next_item_numbers",
    _ONE_BY_ONE
    + """SELECT c.c_custkey AS dataset_id, CAST(1000 + coalesce(n.n, 0) AS BIGINT) AS last_inventory_item_number
       FROM customer c LEFT JOIN (SELECT dataset_id, count(*) AS n FROM r WHERE ok GROUP BY 1) n ON n.dataset_id = c.c_custkey""",
)
def q_next_item_numbers(spark, d):
    return records.next_item_numbers(_proposed(spark, d), T.datasets(spark, d))


@register(
    "inventory_conflicts",
    "WITH RECURSIVE "
    + ",\n".join([
        _CAND,
        _INV,
        f"""c AS (SELECT *, {O.strip('item_id')} AS _id, {O.strip("coalesce(barcode_number, '')")} AS _bc FROM cand)""",
        f"ids AS (SELECT DISTINCT dataset_id, {O.strip('item_id')} AS _id FROM inv)",
        f"codes AS (SELECT DISTINCT dataset_id, {O.strip('barcode_number')} AS _bc FROM inv WHERE {O.strip('barcode_number')} <> '')",
        """f AS (SELECT c.*,
                     EXISTS (SELECT 1 FROM ids WHERE ids.dataset_id = c.dataset_id AND ids._id = c._id) AS id_exists,
                     EXISTS (SELECT 1 FROM codes WHERE codes.dataset_id = c.dataset_id AND codes._bc = c._bc) AS barcode_exists,
                     row_number() OVER (PARTITION BY c.dataset_id ORDER BY c.candidate_id) AS pos
              FROM c)""",
        """r AS (SELECT dataset_id, CAST(0 AS BIGINT) AS pos, false AS accepted, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS bcs
                FROM (SELECT DISTINCT dataset_id FROM f)
              UNION ALL
              SELECT x.dataset_id, x.pos, x.ok, CASE WHEN x.ok THEN list_append(x.ids, x._id) ELSE x.ids END,
                     CASE WHEN x.ok AND x._bc <> '' THEN list_append(x.bcs, x._bc) ELSE x.bcs END
              FROM (SELECT f.dataset_id, f.pos, f._id, f._bc, r.ids, r.bcs,
                           NOT f.id_exists AND NOT f.barcode_exists AND NOT list_contains(r.ids, f._id) AND NOT list_contains(r.bcs, f._bc) AS ok
                    FROM r JOIN f ON f.dataset_id = r.dataset_id AND f.pos = r.pos + 1) x)""",
    ])
    + """ SELECT f.candidate_id, f.dataset_id, f.item_id, f.barcode_number, f.id_exists, f.barcode_exists,
              NOT r.accepted AND NOT f.id_exists AND NOT f.barcode_exists AS taken_in_batch, r.accepted
       FROM f JOIN r ON r.dataset_id = f.dataset_id AND r.pos = f.pos""",
)
def q_inventory_conflicts(spark, d):
    return records.inventory_conflicts(T.inventory_candidates(spark, d), T.inventory(spark, d))


_CREATED = """ccand AS (SELECT candidate_id, dataset_id, item_id, 'Item ' || CAST(candidate_id AS VARCHAR) AS item_name,
    CASE WHEN candidate_id % 9 = 0 THEN ' ' ELSE 'c' END AS item_category,
    CASE WHEN candidate_id % 3 = 0 THEN '' ELSE 'B' || CAST(candidate_id % 4 AS VARCHAR) END AS barcode_number FROM pp)"""


@register(
    "create_inventory",
    "WITH RECURSIVE " + _PROPOSED + "," + _CREATED + """,
    s AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY candidate_id) AS pos FROM ccand),
    r AS (SELECT dataset_id, CAST(0 AS BIGINT) AS pos, CAST(1001 AS BIGINT) AS due, false AS accepted, CAST([] AS VARCHAR[]) AS bcs FROM (SELECT DISTINCT dataset_id FROM s)
          UNION ALL
          SELECT dataset_id, pos, due + CASE WHEN ok THEN 1 ELSE 0 END, ok, CASE WHEN ok AND barcode_number <> '' THEN list_append(bcs, barcode_number) ELSE bcs END
          FROM (SELECT s.dataset_id, s.pos, r.due, r.bcs, s.barcode_number,
                       trim(s.item_id) = 'I' || CAST(r.due AS VARCHAR) AND trim(s.item_category) <> '' AND NOT list_contains(r.bcs, s.barcode_number) AS ok
                FROM r JOIN s ON s.dataset_id = r.dataset_id AND s.pos = r.pos + 1) x)
    SELECT s.candidate_id, s.dataset_id, s.item_id, r.accepted FROM r JOIN s ON s.dataset_id = r.dataset_id AND s.pos = r.pos""",
)
def q_create_inventory(spark, d):
    """Proposals into an inventory that holds other datasets only, so ids and barcodes clash within the batch."""
    c = _proposed(spark, d)
    c = c.withColumns({
        "item_name": F.concat(F.lit("Item "), F.col("candidate_id").cast("string")),
        "item_category": F.when(F.col("candidate_id") % 9 == 0, F.lit(" ")).otherwise(F.lit("c")),
        "barcode_number": F.when(F.col("candidate_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("B"), (F.col("candidate_id") % 4).cast("string"))),
        "cost_price": F.lit(1).cast("decimal(10,2)"), "selling_price": F.lit(2).cast("decimal(10,2)"),
    })
    inventory = T.inventory(spark, d).withColumn("dataset_id", F.col("dataset_id") + 1000)
    return records.create_inventory(c, inventory, T.datasets(spark, d))


register(
    "by_owner",
    "SELECT c_custkey AS dataset_id, CAST(c_nationkey AS BIGINT) AS user_id FROM customer WHERE c_custkey = 7 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)",
)(lambda spark, d: clean.by_owner(
    T.datasets(spark, d).select("dataset_id", "user_id"), "dataset_id", 7, "user_id", T.datasets(spark, d).where("dataset_id = 7").select("user_id").scalar()))
register("iequals", "SELECT c_custkey AS dataset_id FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")(
    lambda spark, d: T.table(spark, d, "customer").where(clean.iequals("c_mktsegment", "bUiLdInG")).select(F.col("c_custkey").alias("dataset_id"))
)
register("not_self", "SELECT c_custkey AS dataset_id FROM customer WHERE c_custkey <> 7")(
    lambda spark, d: clean.not_self(T.datasets(spark, d).select("dataset_id"), "dataset_id", 7)
)


@register(
    "barcode_update_conflicts",
    _with(
        _INV,
        f"""pc AS (SELECT dataset_id, {O.strip('barcode_number')} AS _bc, count(*) AS n, min(inventory_id) AS one
                FROM inv WHERE {O.strip('barcode_number')} <> '' GROUP BY 1, 2)""",
    )
    + f"""SELECT u.inventory_id, u.dataset_id, u.barcode_number,
              coalesce({O.strip('u.barcode_number')} <> '' AND (pc.n > 1 OR (pc.n = 1 AND pc.one <> u.inventory_id)), false) AS conflict
       FROM inv u LEFT JOIN pc ON pc.dataset_id = u.dataset_id AND pc._bc = {O.strip('u.barcode_number')}""",
)
def q_barcode_update_conflicts(spark, d):
    inv = T.inventory(spark, d)
    return records.barcode_update_conflicts(inv.select("inventory_id", "dataset_id", "barcode_number"), inv)


_NOW = "2024-06-01 00:00:00"


@register(
    "upsert_inventory",
    _with(
        _CAND,
        _INV,
        """ch AS (SELECT dataset_id, item_id, arg_max(item_name, candidate_id) AS item_name,
                      arg_max(item_category, candidate_id) AS item_category, arg_max(barcode_number, candidate_id) AS barcode_number,
                      arg_max(cost_price, candidate_id) AS cost_price, arg_max(selling_price, candidate_id) AS selling_price
               FROM cand GROUP BY 1, 2)""",
    )
    + f"""SELECT coalesce(inv.inventory_id, (SELECT max(inventory_id) FROM inv)
                  + row_number() OVER (PARTITION BY inv.inventory_id IS NULL ORDER BY ch.dataset_id, ch.item_id)) AS inventory_id,
              coalesce(inv.dataset_id, ch.dataset_id) AS dataset_id, coalesce(inv.item_id, ch.item_id) AS item_id,
              CASE WHEN ch.item_name IS NOT NULL THEN {O.strip('ch.item_name')} ELSE inv.item_name END AS item_name,
              CASE WHEN ch.item_name IS NOT NULL THEN {O.strip('ch.item_category')} ELSE inv.item_category END AS item_category,
              CASE WHEN ch.item_name IS NOT NULL THEN {O.strip('ch.barcode_number')} ELSE inv.barcode_number END AS barcode_number,
              CAST(coalesce(ch.cost_price, inv.cost_price) AS DOUBLE) AS cost_price,
              CAST(coalesce(ch.selling_price, inv.selling_price) AS DOUBLE) AS selling_price,
              strftime(coalesce(inv.created_at, TIMESTAMP '{_NOW}'), '%Y-%m-%d %H:%M:%S') AS created_at
       FROM inv FULL OUTER JOIN ch ON inv.dataset_id = ch.dataset_id AND inv.item_id = ch.item_id""",
)
def q_upsert_inventory(spark, d):
    import datetime as dt

    from pyspark.sql import functions as F

    out = records.upsert_inventory(T.inventory(spark, d), T.inventory_candidates(spark, d), dt.datetime(2024, 6, 1), "candidate_id")
    return out.withColumns({
        "cost_price": F.col("cost_price").cast("double"),
        "selling_price": F.col("selling_price").cast("double"),
        "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
    })


@register(
    "inventory_list",
    _with(_INV)
    + """SELECT inv.dataset_id, inventory_id, item_id, item_name, item_category, barcode_number,
              CAST(cost_price AS DOUBLE) AS cost_price, CAST(selling_price AS DOUBLE) AS selling_price,
              strftime(created_at, '%d/%m/%Y %H:%M') AS created_at
       FROM inv JOIN customer c ON c.c_custkey = inv.dataset_id""",
)
def q_inventory_list(spark, d):
    from pyspark.sql import functions as F

    out = records.inventory_list(T.inventory(spark, d), T.datasets(spark, d))
    return out.withColumns({"cost_price": F.col("cost_price").cast("double"), "selling_price": F.col("selling_price").cast("double")})


_PROPOSALS = """pr AS (SELECT c_custkey AS proposal_id, CAST(c_nationkey AS BIGINT) AS user_id, ' ' || upper(c_name) AS name FROM customer
                UNION ALL
                SELECT 1000000 + s_suppkey, CAST(s_nationkey AS BIGINT), s_name FROM supplier
                UNION ALL
                SELECT 2000000 + s_suppkey, CAST(s_nationkey AS BIGINT), upper(s_name) || ' ' FROM supplier)"""


@register(
    "dataset_name_conflicts",
    _with(
        _PROPOSALS,
        f"ex AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS user_id, lower({O.strip('c_name')}) AS k FROM customer)",
        f"p AS (SELECT *, {O.strip('name')} AS clean_name FROM pr)",
        """e AS (SELECT p.proposal_id, p.user_id, p.clean_name,
                     CASE WHEN p.clean_name = '' THEN 'Dataset name is required.'
                          WHEN length(p.clean_name) > 120 THEN 'Ensure this field has no more than 120 characters.'
                          WHEN EXISTS (SELECT 1 FROM ex WHERE ex.user_id = p.user_id AND ex.k = lower(p.clean_name))
                          THEN 'A dataset with this name already exists.' END AS error
              FROM p)""",
        """w AS (SELECT *, error IS NULL AND row_number() OVER (PARTITION BY user_id, lower(clean_name), error IS NULL ORDER BY proposal_id) > 1 AS again FROM e)""",
    )
    + """SELECT proposal_id, user_id, clean_name, error IS NULL AND NOT again AS accepted,
              CASE WHEN again THEN 'A dataset with this name already exists.' ELSE error END AS error FROM w""",
)
def q_dataset_name_conflicts(spark, d):
    from pyspark.sql import functions as F

    c = T.table(spark, d, "customer")
    s = T.table(spark, d, "supplier")
    proposals = c.select(
        F.col("c_custkey").alias("proposal_id"), F.col("c_nationkey").cast("bigint").alias("user_id"),
        F.concat(F.lit(" "), F.upper("c_name")).alias("name"),
    ).unionByName(
        s.select((F.lit(1000000) + F.col("s_suppkey")).alias("proposal_id"), F.col("s_nationkey").cast("bigint").alias("user_id"),
                 F.col("s_name").alias("name"))
    ).unionByName(
        s.select((F.lit(2000000) + F.col("s_suppkey")).alias("proposal_id"), F.col("s_nationkey").cast("bigint").alias("user_id"),
                 F.concat(F.upper("s_name"), F.lit(" ")).alias("name"))
    )
    return records.dataset_name_conflicts(proposals, T.datasets(spark, d))


@register(
    "dataset_list",
    """SELECT CAST(c_nationkey AS BIGINT) AS user_id, c_custkey AS dataset_id, c_name AS name,
              strftime(CAST(to_timestamp(1704067200 + c_custkey * 60) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at
       FROM customer""",
)
def q_dataset_list(spark, d):
    from pyspark.sql import functions as F

    out = catalog.dataset_list(T.datasets(spark, d))
    return out.select("user_id", "dataset_id", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@register("slug", r"""SELECT p_partkey, regexp_replace(p_name, '[^\p{L}\p{N}_-]', '_', 'g') AS slug FROM part""")
def q_slug(spark, d):
    return T.table(spark, d, "part").select("p_partkey", catalog.slug("p_name").alias("slug"))


_KEYS = r"""st AS (SELECT CAST(c_nationkey AS BIGINT) AS user_id,
                   lpad(lower(hex(c_custkey)), 8, '0') || '_' || regexp_replace(replace(trim(c_name), ' ', '_'), '[^\p{L}\p{N}_.-]', '', 'g') || '.xlsx' AS dataset_key
            FROM customer)"""


@register(
    "dataset_by_key",
    _with(
        _KEYS,
        """lk AS (SELECT user_id, dataset_key AS key FROM st
               UNION ALL SELECT user_id, '../' || dataset_key FROM st
               UNION ALL SELECT user_id + 1, dataset_key FROM st
               UNION ALL SELECT user_id, dataset_key || '/' FROM st
               UNION ALL SELECT user_id, 'folder/..' FROM st)""",
        "lk2 AS (SELECT *, regexp_extract(rtrim(key, '/'), '([^/]*)$', 1) AS resolved_key FROM lk)",
    )
    + """SELECT user_id, key, resolved_key,
              CASE WHEN resolved_key IN ('', '.', '..') THEN 'refused'
                   WHEN EXISTS (SELECT 1 FROM st WHERE st.user_id = lk2.user_id AND st.dataset_key = lk2.resolved_key) THEN 'found'
                   ELSE 'missing' END AS status
       FROM lk2""",
)
def q_dataset_by_key(spark, d):
    from pyspark.sql import functions as F

    c = T.table(spark, d, "customer")
    stored = c.select(
        F.col("c_nationkey").cast("bigint").alias("user_id"),
        F.concat(F.lpad(F.lower(F.hex("c_custkey")), 8, "0"), F.lit("_"), catalog.valid_filename(F.col("c_name")), F.lit(".xlsx")).alias("dataset_key"),
    )
    lookups = (
        stored.select("user_id", F.col("dataset_key").alias("key"))
        .unionByName(stored.select("user_id", F.concat(F.lit("../"), "dataset_key").alias("key")))
        .unionByName(stored.select((F.col("user_id") + 1).alias("user_id"), F.col("dataset_key").alias("key")))
        .unionByName(stored.select("user_id", F.concat("dataset_key", F.lit("/")).alias("key")))
        .unionByName(stored.select("user_id", F.lit("folder/..").alias("key")))
    )
    return catalog.dataset_by_key(lookups, stored)


# ---------------------------------------------------------------------------
# Chat messages (C1–C5) and dataset profile
# ---------------------------------------------------------------------------

from salesops.functions import messages as MF  # noqa: E402
from salesops.operators import messages as msg  # noqa: E402
from salesops.operators import profile as prof  # noqa: E402

# Keywords that occur in the test conversations (the built-in list rarely does).
DATA_KEYWORDS = ["ent", "tion", "ung", "the"]


def _sql_compact(x: str) -> str:
    n = f"lower({O.strip(x)})"
    return f"trim(regexp_replace(regexp_replace({n}, {O.q(O.NON_WORD)}, ' ', 'g'), {O.q(O.SPACE_RUN)}, ' ', 'g'), ' ')"


def _sql_keyword(x: str, keywords) -> str:
    c = _sql_compact(x)
    anyk = " OR ".join(f"contains({c}, {O.q(k)})" for k in keywords)
    return f"coalesce(({anyk}) AND {c} <> '', false)"


def _sql_follow_up(x: str) -> str:
    n = f"lower({O.strip(x)})"
    return (
        f"coalesce({n} <> '' AND (regexp_full_match({n}, {O.q(O.digit_class() + '+')}) "
        f"OR (length({n}) <= 20 AND {n} IN {O.in_list(O.FOLLOW_UPS)})), false)"
    )


register(
    "has_business_keyword",
    f"SELECT conv_id, turn, {_sql_keyword('text', O.BUSINESS_WORDS)} AS has_keyword FROM conversations",
)(lambda spark, d: T.messages(spark, d).select("conv_id", "turn", MF.has_business_keyword(F.col("text")).alias("has_keyword")))
register(
    "has_business_keyword_data",
    f"SELECT conv_id, turn, {_sql_keyword('text', DATA_KEYWORDS)} AS has_keyword FROM conversations",
)(lambda spark, d: T.messages(spark, d).select("conv_id", "turn", MF.has_business_keyword(F.col("text"), DATA_KEYWORDS).alias("has_keyword")))
register(
    "is_short_follow_up",
    f"SELECT conv_id, turn, {_sql_follow_up('text')} AS is_follow_up FROM conversations",
)(lambda spark, d: T.messages(spark, d).select("conv_id", "turn", MF.is_short_follow_up(F.col("text")).alias("is_follow_up")))


def _sql_business(keywords):
    return _with(
        f"""f AS (SELECT conv_id, turn, role, {_sql_keyword('text', keywords)} AS has_keyword,
                        {_sql_follow_up('text')} AS is_follow_up FROM conversations)""",
        f"""w AS (SELECT *, coalesce(max(CAST(has_keyword AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn
                        ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) = 1 AS after_keyword FROM f)""",
    ) + "SELECT conv_id, turn, role, has_keyword, is_follow_up, has_keyword OR (is_follow_up AND after_keyword) AS is_business FROM w"


register("is_business_query", _sql_business(O.BUSINESS_WORDS))(lambda spark, d: msg.is_business_query(T.messages(spark, d)))
register("is_business_query_data", _sql_business(DATA_KEYWORDS))(
    lambda spark, d: msg.is_business_query(T.messages(spark, d), DATA_KEYWORDS)
)
register(
    "recent_history",
    _with(f"r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)")
    + f"""SELECT conv_id, turn, lower({O.strip('role')}) AS role, {O.strip("coalesce(text, '')")} AS content FROM r
        WHERE rn <= 8 AND lower({O.strip('role')}) IN ('user', 'assistant') AND {O.strip("coalesce(text, '')")} <> ''""",
)(lambda spark, d: msg.recent_history(T.messages(spark, d)))
register(
    "chat_payload",
    f"""WITH m AS (SELECT conv_id, turn, lower({O.strip('role')}) AS role, {O.strip("coalesce(text, '')")} AS content, text FROM conversations),
      u AS (SELECT conv_id, max(turn) AS last FROM m WHERE role = 'user' GROUP BY 1),
      r AS (SELECT m.*, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn DESC) AS rn FROM m JOIN u ON u.conv_id = m.conv_id AND m.turn < u.last),
      h AS (SELECT conv_id, list({{'role': role, 'content': content}} ORDER BY turn) AS hist FROM r
            WHERE rn <= 8 AND role IN ('user', 'assistant') AND content <> '' GROUP BY 1)
    SELECT u.conv_id, CAST(to_json({{'model': 'assistant-model', 'temperature': 0.2, 'max_tokens': 500,
        'messages': list_concat([{{'role': 'system', 'content': {O.q(O.SYSTEM_PROMPT)}}}], coalesce(h.hist, []), [{{'role': 'user', 'content': m.text}}])}}) AS VARCHAR) AS payload
    FROM u JOIN m ON m.conv_id = u.conv_id AND m.turn = u.last LEFT JOIN h ON h.conv_id = u.conv_id""",
)(lambda spark, d: msg.chat_payload(T.messages(spark, d), model="assistant-model"))

register(
    "drop_all_null_rows",
    "SELECT * FROM conversations WHERE NOT (conv_id IS NULL AND turn IS NULL AND role IS NULL AND text IS NULL)",
)(lambda spark, d: prof.drop_all_null_rows(T.messages(spark, d)))
register(
    "sample_rows",
    """SELECT substr(CAST(c_custkey AS VARCHAR), 1, 80) AS c_custkey, substr(c_name, 1, 80) AS c_name,
              substr(CAST(c_nationkey AS VARCHAR), 1, 80) AS c_nationkey, substr(CAST(c_acctbal AS VARCHAR), 1, 80) AS c_acctbal,
              substr(c_mktsegment, 1, 80) AS c_mktsegment
       FROM customer ORDER BY customer.c_custkey LIMIT 20""",
)(lambda spark, d: prof.sample_rows(T.table(spark, d, "customer"), ["c_custkey"]))
register(
    "profile_text",
    """WITH s AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 20)
    SELECT substr('Dataset name: customer.csv' || chr(10) || 'Rows: ' || (SELECT count(*) FROM customer) || chr(10)
      || 'Columns (5): c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' || chr(10)
      || 'Column types: c_custkey: int64; c_name: object; c_nationkey: int64; c_acctbal: float64; c_mktsegment: object' || chr(10)
      || 'Sample rows (first ' || count(*) || '): [' || string_agg(
           '{"c_custkey": "' || c_custkey || '", "c_name": "' || c_name || '", "c_nationkey": "' || c_nationkey
           || '", "c_acctbal": "' || c_acctbal || '", "c_mktsegment": "' || c_mktsegment || '"}', ', ' ORDER BY c_custkey) || ']', 1, 7000) AS context
    FROM s""",
)(lambda spark, d: prof.profile_text(T.table(spark, d, "customer"), "customer.csv", ["c_custkey"]))


# ---------------------------------------------------------------------------
# Barcode scans (T1): batch and streaming, on ``events`` with a 2-hour limit
# ---------------------------------------------------------------------------

from salesops.operators import scans as SC  # noqa: E402
from salesops.sources import files as FS  # noqa: E402

SCAN_LIMIT_MS = 2 * 60 * 60 * 1000

_DEBOUNCE_SQL = f"""WITH RECURSIVE s AS (
    SELECT user_id AS device, ts, {O.strip('event_type')} AS code, event_id AS scan_id, epoch_us(ts) AS us,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
    FROM events WHERE event_type IS NOT NULL AND {O.strip('event_type')} <> ''),
  r AS (
    SELECT device, pos, code AS last_code, us AS last_us, true AS acc FROM s WHERE pos = 1
    UNION ALL
    SELECT s.device, s.pos,
           CASE WHEN s.code <> r.last_code OR s.us - r.last_us > {SCAN_LIMIT_MS * 1000} THEN s.code ELSE r.last_code END,
           CASE WHEN s.code <> r.last_code OR s.us - r.last_us > {SCAN_LIMIT_MS * 1000} THEN s.us ELSE r.last_us END,
           s.code <> r.last_code OR s.us - r.last_us > {SCAN_LIMIT_MS * 1000}
    FROM r JOIN s ON s.device = r.device AND s.pos = r.pos + 1)
SELECT s.device, s.ts, s.code, s.scan_id FROM r JOIN s ON s.device = r.device AND s.pos = r.pos WHERE r.acc"""

register("debounce_scans", _DEBOUNCE_SQL)(lambda spark, d: SC.debounce_scans(T.scans(spark, d), SCAN_LIMIT_MS))


def q_debounce_stream(spark, d):
    """Scans arrive week by week; the stream goes on after each (same
    checkpoint), so a device's state is carried from batch to batch."""
    from salesops.streaming.debounce import run_debounce

    events = T.table(spark, d, "events")
    folder, out = FS.scratch_path(spark, "scans"), FS.scratch_path(spark, "debounce")
    weeks = ["0001-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "9999-12-31"]
    for start, end in zip(weeks, weeks[1:]):
        events.where((F.col("ts") >= start) & (F.col("ts") < end)).write.mode("append").parquet(folder)
        result = run_debounce(spark, folder, SCAN_LIMIT_MS, out_path=out)
    return result


register("debounce_scans_stream", _DEBOUNCE_SQL)(q_debounce_stream)


def q_debounce_late(spark, d):
    """Every scan arrives up to three days late, so files and rows are out of order."""
    from salesops.streaming.debounce_late import run_debounce_late

    events = T.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    late = F.pmod(F.xxhash64("event_id"), F.lit(3 * 86400))
    arrival = F.expr("unix_micros(cast(ts as timestamp)) div 1000000") + late
    dealt = FS.written(events.withColumn("file", F.floor(arrival / F.lit(4 * 86400))), "late-scans")
    folder, out = FS.scratch_path(spark, "late"), FS.scratch_path(spark, "debounce-late")
    files = [r["file"] for r in dealt.select("file").distinct().orderBy("file").collect()]  # one per four days
    for k in files:
        dealt.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(folder)
        if k == files[len(files) // 2]:
            run_debounce_late(spark, folder, SCAN_LIMIT_MS, "3 days", out)
    # A scan of the far future moves the watermark past all others.
    close = spark.sql("SELECT -1L AS event_id, timestamp_ntz'2100-01-01 00:00:00' AS ts, -1L AS user_id, 'end' AS event_type")
    close.coalesce(1).write.mode("append").parquet(folder)
    return run_debounce_late(spark, folder, SCAN_LIMIT_MS, "3 days", out).where("device <> -1")


register("debounce_scans_late", _DEBOUNCE_SQL)(q_debounce_late)


# ---------------------------------------------------------------------------
# Sources and sinks (S1, S3–S7): whole tables written to a scratch folder
# under the shared checkpoint folder, read back, compared with the input.
# ---------------------------------------------------------------------------



def _stored_sales(spark, d):
    path = FS.scratch_path(spark, "sales")
    FS.create_dataset(spark, path)
    FS.append_sales(T.sales(spark, d), path)
    return path


_SALES_TEXT_SQL = _with(O.SALES_CTE) + """SELECT strftime("Date", '%Y-%m-%d %H:%M:%S') AS "Date", "Day", "OrderID", "Item",
       "Quantity", CAST("Price" AS DOUBLE) AS "Price", "Category", "PaymentType",
       CAST(year("Date") AS INTEGER) AS year, CAST(month("Date") AS INTEGER) AS month FROM sales"""


@register("append_sales", _SALES_TEXT_SQL)
def q_append_sales(spark, d):
    path = _stored_sales(spark, d)
    back = FS.read_sales(spark, path)
    return back.select(F.date_format("Date", "yyyy-MM-dd HH:mm:ss").alias("Date"), "Day", "OrderID", "Item", "Quantity",
                       F.col("Price").cast("double").alias("Price"), "Category", "PaymentType", "year", "month")


@register(
    "scan_sales",
    _with(O.SALES_CTE) + """SELECT strftime("Date", '%Y-%m-%d %H:%M:%S') AS "Date", "Item", CAST("Price" AS DOUBLE) AS "Price"
       FROM sales WHERE year("Date") = 1997 AND month("Date") = 3""",
)
def q_scan_sales(spark, d):
    back = FS.scan_sales(spark, _stored_sales(spark, d), ["Date", "Item", "Price"], year=YEAR, month=MONTH)
    return back.select(F.date_format("Date", "yyyy-MM-dd HH:mm:ss").alias("Date"), "Item", F.col("Price").cast("double").alias("Price"))


_EXPORT_SQL = _with(O.SALES_CTE) + """SELECT strftime("Date", '%d/%m/%Y/%H:%M:%S') AS "Date", "Day", "OrderID", "Item",
       CAST("Quantity" AS VARCHAR) AS "Quantity", CAST("Price" AS VARCHAR) AS "Price", "Category", "PaymentType" FROM sales"""


def _exported(spark, d):
    path = FS.scratch_path(spark, "export")
    FS.export_dataset(T.sales(spark, d), path)
    return path


@register("export_dataset", _EXPORT_SQL)
def q_export_dataset(spark, d):
    return FS.csv_reader(spark).schema(FS.RAW_SALES_SCHEMA).csv(_exported(spark, d))


@register(
    "scan_csv",
    _with(O.SALES_CTE) + """SELECT strftime("Date", '%d/%m/%Y/%H:%M:%S') AS "Date", "Day", "OrderID", "Item",
       "Quantity", CAST("Price" AS DOUBLE) AS "Price", "Category", "PaymentType" FROM sales""",
)
def q_scan_csv(spark, d):
    return FS.scan_csv(spark, _exported(spark, d))


for _name, _sql, _chart in (
    ("revenue_trend_day", sql_revenue_trend_day("sales", YEAR, MONTH), lambda df: charts.revenue_trend_day(df, YEAR, MONTH)),
    ("top_selling_items", sql_top_selling_items("sales", YEAR), lambda df: charts.top_selling_items(df, YEAR)),
):
    register(f"{_name}_stored", _sql)(lambda spark, d, chart=_chart: chart(FS.read_sales(spark, _stored_sales(spark, d))))


@register(
    "explode_sales",
    _with(_HDR, _LINES)
    + f"""SELECT h.request_id,
              CAST(row_number() OVER (PARTITION BY h.request_id ORDER BY l.line, l.item, l.quantity, l.price, l.category) - 1 AS INTEGER) AS line,
              strftime(h.ts, '%d/%m/%Y/%H:%M:%S') AS "Date", dayname(h.ts) AS "Day",
              'O' || CAST(h.request_id AS VARCHAR) AS "OrderID", {O.strip('l.item')} AS "Item",
              CAST(l.quantity AS BIGINT) AS "Quantity", CAST(l.price AS DOUBLE) AS "Price",
              {O.strip('l.category')} AS "Category", {O.strip('h.payment_type')} AS "PaymentType"
       FROM h JOIN l ON l.request_id = h.request_id""",
)
def q_explode_sales(spark, d):
    return records.explode_sales(T.sale_requests(spark, d))


REQUESTS_PER_FILE = 250_000  # a micro-batch is bounded by its number of files


def q_stream_sales(spark, d):
    """Requests arrive in two time slices; the stream runs after each
    (same checkpoint), so the second run records only the new files."""
    from salesops.sources.files import scratch_path
    from salesops.streaming.sales_stream import run_sales_stream

    req = FS.written(T.sale_requests(spark, d).drop("OrderID"), "sale-requests")  # nested once for both slices
    folder, out = scratch_path(spark, "requests"), scratch_path(spark, "sales-stream")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    req.where(F.col("ts") < cut).write.mode("append").option("maxRecordsPerFile", REQUESTS_PER_FILE).json(folder)
    last = T.datasets(spark, d).withColumn("last_order_number", F.lit(100) + F.col("dataset_id") % 7 * 50)
    run_sales_stream(spark, folder, out, datasets=last)
    req.where(F.col("ts") >= cut).write.mode("append").option("maxRecordsPerFile", REQUESTS_PER_FILE).json(folder)
    sales_path, _ = run_sales_stream(spark, folder, out, datasets=last)
    return spark.read.parquet(sales_path).drop("batch_id")


register(
    "stream_sales",
    _VALID
    + f"""SELECT num.request_id,
              CAST(row_number() OVER (PARTITION BY num.request_id ORDER BY l.line, l.item, l.quantity, l.price, l.category) - 1 AS INTEGER) AS line,
              strftime(num.ts, '%d/%m/%Y/%H:%M:%S') AS "Date", dayname(num.ts) AS "Day",
              'O' || CAST(num.order_number + num.dataset_id % 7 * 50 AS VARCHAR) AS "OrderID", {O.strip('l.item')} AS "Item",
              CAST(l.quantity AS BIGINT) AS "Quantity", CAST(l.price AS DOUBLE) AS "Price",
              {O.strip('l.category')} AS "Category", {O.strip('num.payment_type')} AS "PaymentType"
       FROM num JOIN l ON l.request_id = num.request_id""",
)(q_stream_sales)


def _wide_sql() -> str:
    parts = ", ".join(
        f"max(CASE WHEN bucket = '{b}' THEN {m} END) AS {b}_{m}"
        for b in ("morning", "daytime", "evening")
        for m in ("sales_count", "sales_amount", "intensity")
    )
    return sql_day_wise_pattern(O.SALES_HOURS_CTE, "sales_hours", H_YEAR, H_MONTH) + f"SELECT day, {parts} FROM pts GROUP BY day"


register("day_wise_pattern_wide", _wide_sql())(
    lambda spark, d: charts.day_wise_pattern_wide(T.sales_hours(spark, d), H_YEAR, H_MONTH)
)

# ---------------------------------------------------------------------------
# Validation of uploads (V1, V6, V7): the dirty table as ten uploads, some of
# them with a wrong name, size, header, no data or unreadable.
# ---------------------------------------------------------------------------

_GOOD_CELLS = {"Date": "01/02/1997/00:00:00", "OrderID": "O1", "Price": "1", "Category": "c", "PaymentType": "p"}


def _checked_uploads(spark, d):
    """(files, cells): upload k holds every tenth order; see ``_report_sql``."""
    names = FS.RAW_SALES_SCHEMA.names
    k = F.expr("(row_number div 100) % 10")
    path = F.concat(F.lit("in/upload_"), F.col("k").cast("string"), F.when(F.col("k") == 0, F.lit(".csv")).otherwise(F.lit(".XLSX")))
    rows = T.raw_sales(spark, d).withColumn("k", k).withColumn("path", path)
    files = rows.groupBy("path", "k").agg(F.count(F.lit(1)).alias("n"))
    files = files.select("path", "k", F.when(F.col("k") == 1, F.lit(10 * 1024 * 1024)).otherwise(F.col("n")).alias("length"))
    data = rows.where("k <> 4").withColumns({c: F.when(F.col("k") == 5, F.lit(v)).otherwise(F.col(c)) for c, v in _GOOD_CELLS.items()})
    data = data.withColumns({c: F.when(F.col("k") == 3, F.lit(" ")).otherwise(F.col(c)) for c in names})
    swapped = [names[1], names[0], *names[2:]]
    header = files.where("k <> 4").select(
        "path", F.lit(1).cast("bigint").alias("row_number"),
        *[F.when(F.col("k") == 2, F.lit(w)).otherwise(F.lit(f" {c} ")).alias(c) for c, w in zip(names, swapped)],
    )
    lost = files.where("k = 4").select("path", F.lit(-1).cast("bigint").alias("row_number"), *[F.lit(None).cast("string").alias(c) for c in names])
    whole = data.select("path", "row_number", *names).unionByName(header).unionByName(lost)
    return files.select("path", "length"), quality.text_cells(whole, F.col("path"))


def _report_sql() -> str:
    cells = [f"CASE WHEN k = 3 THEN ' ' WHEN k = 5 THEN {O.q(_GOOD_CELLS[c])} ELSE \"{c}\" END AS \"{c}\"" if c in _GOOD_CELLS
             else f"CASE WHEN k = 3 THEN ' ' ELSE \"{c}\" END AS \"{c}\"" for c in FS.RAW_SALES_SCHEMA.names]
    ctes = O.RAW_SALES_CTE.replace("raw_sales AS (", "every_sale AS (", 1) + f""",
      keyed AS (SELECT *, (row_number // 100) % 10 AS k FROM every_sale),
      files AS (SELECT k, CASE WHEN k = 1 THEN 10485760 ELSE count(*) END AS length FROM keyed GROUP BY k),
      raw_sales AS (SELECT k, row_number, {", ".join(cells)} FROM keyed WHERE k <> 4)"""
    base = _viol_sql().replace(O.RAW_SALES_CTE, ctes).replace("SELECT 'raw_sales' AS path", "SELECT k AS path")
    return base + """,
      f AS (SELECT path AS k, arg_min("column", row_number * 10 + col_index) AS "column", min(row_number) AS row_number FROM v GROUP BY 1),
      d AS (SELECT k, count(*) AS n FROM nb GROUP BY 1),
      r AS (SELECT 'in/upload_' || CAST(files.k AS VARCHAR) || CASE WHEN files.k = 0 THEN '.csv' ELSE '.XLSX' END AS path,
                   files.k <> 0 AS type_ok, length < 10485760 AS size_ok,
                   CASE WHEN files.k IN (0, 1) THEN 'Skipped because file type or file size validation failed.'
                        WHEN files.k = 4 THEN 'Unable to read Excel file. The file might be corrupted.'
                        WHEN files.k = 2 THEN 'Required columns are missing or in incorrect order. Expected: Date, Day, OrderID, Item, Quantity, Price, Category, PaymentType'
                        WHEN f.k IS NOT NULL THEN 'Invalid datatype/value for ''' || "column" || ''' at row ' || CAST(f.row_number AS VARCHAR) || '.'
                        WHEN d.n IS NULL THEN 'Excel file must include at least one data row.'
                        ELSE 'Required columns and datatypes are valid.' END AS message
            FROM files LEFT JOIN f ON f.k = files.k LEFT JOIN d ON d.k = files.k)
    SELECT path, 1 AS n, '1. File Type: Excel' AS "check", type_ok AS is_valid,
           CASE WHEN type_ok THEN 'File type is valid Excel format.' ELSE 'Only Excel files (.xlsx/.xlsm/.xltx/.xltm) are allowed.' END AS message FROM r
    UNION ALL SELECT path, 2, '2. File Size: < 10MB', size_ok, CASE WHEN size_ok THEN 'File size is less than 10MB.' ELSE 'File size must be less than 10MB.' END FROM r
    UNION ALL SELECT path, 3, '3. Required Columns + Datatypes', message = 'Required columns and datatypes are valid.', message FROM r"""


register("validation_report", _report_sql())(lambda spark, d: quality.validation_report(*_checked_uploads(spark, d)))

# Further parts of the registry; each registers its queries when it is imported.
from salesops import registry_inventory, registry_profile, registry_uploads  # noqa: E402, F401
