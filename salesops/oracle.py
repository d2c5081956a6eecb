"""DuckDB SQL building blocks for the oracle side of the correctness gate.

The SQL here restates each operator's rule in plain SQL over the driver's
views (lineitem, orders, part, events, conversations, …) so the Spark result
can be compared with an independent engine.
"""

from __future__ import annotations

import unicodedata

# The oracle's own statement of the text rules; it takes none from the code it checks.
PY_WHITESPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
UNKNOWN_WORDS = ["", "nan", "None"]
NUMBER_SHAPE = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
DATE_TEXT_SHAPE = r"\d{1,2}/\d{1,2}/\d{4}/\d{1,2}:\d{1,2}:\d{1,2}"
DATE_FORMAT_SQL = "%d/%m/%Y/%H:%M:%S"

# FIXED VALUES of the message rules, stated again for the oracle.
NON_WORD = "[^abcdefghijklmnopqrstuvwxyz0123456789\\t\\n\\x0B\\x0C\\r -]"
SPACE_RUN = "(\\t|\\n|\\x0B|\\x0C|\\r| )+"
FOLLOW_UPS = ["yes", "no", "ok", "okay", "sure", "continue", "go ahead", "next", "first", "second", "third"]
BUSINESS_WORDS = [
    "business", "sale", "sales", "profit", "profits", "revenue", "inventory", "inventories", "pricing", "price", "prices",
    "margin", "margins", "customer", "customers", "marketing", "promotion", "promotions", "forecast", "forecasting", "demand",
    "order", "orders", "stock", "stocks", "cost", "costs", "retail", "upsell", "cross-sell", "cross sell", "growth", "strategy",
    "strategies", "operation", "operations", "trend", "trending", "month", "year", "cashflow", "cash flow", "conversion", "store",
]
SYSTEM_PROMPT = (
    "You are a business assistant for a retail management platform. Answer only questions about sales, profit, inventory, pricing, "
    "promotions, customers, forecasting and costs; politely decline other topics. Keep answers short and practical."
)


def digit_class() -> str:
    """Characters with a digit value in the Unicode tables, as a pattern."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in map(chr, range(0x20000)) if unicodedata.digit(c, None) is not None) + "]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(PY_WHITESPACE)})"


def missing(x: str) -> str:
    return f"({x} IS NULL OR {x} IN {in_list(MISSING_TEXTS)})"


def label(x: str) -> str:
    return (
        f"CASE WHEN {missing(x)} OR {strip(x)} IN {in_list(UNKNOWN_WORDS)} "
        f"THEN 'Unknown' ELSE {strip(x)} END"
    )


def key(x: str) -> str:
    return f"CASE WHEN {missing(x)} THEN 'nan' ELSE {strip(x)} END"


def num(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    return (
        f"coalesce(CASE WHEN regexp_full_match({s}, {q(NUMBER_SHAPE)}) "
        f"THEN try_cast({s} AS DOUBLE) END, 0.0)"
    )


def money(x: str) -> str:
    return f"CAST({num(x)} AS DECIMAL(38,10))"


def shown(x: str) -> str:
    """An amount as it is shown: rounded once, half to even."""
    return f"round_even(CAST(coalesce({x}, 0) AS DOUBLE), 2)"


def parse_date(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({x}, {q(DATE_TEXT_SHAPE)}) "
        f"THEN try_strptime({x}, {q(DATE_FORMAT_SQL)}) END"
    )


def pct(part: str, whole: str) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100, 2)"


def period(col: str, year: int, month: int | None = None) -> str:
    if month is None:
        return f"{col} >= TIMESTAMP '{year:04d}-01-01' AND {col} < TIMESTAMP '{year + 1:04d}-01-01'"
    ny, nm = (year + 1, 1) if month == 12 else (year, month + 1)
    return f"{col} >= TIMESTAMP '{year:04d}-{month:02d}-01' AND {col} < TIMESTAMP '{ny:04d}-{nm:02d}-01'"


SALES_CTE = """sales AS (
  SELECT o.o_orderdate AS "Date", dayname(o.o_orderdate) AS "Day",
         'O' || CAST(l.l_orderkey AS VARCHAR) AS "OrderID", p.p_name AS "Item",
         l.l_quantity AS "Quantity", CAST(l.l_extendedprice AS DECIMAL(18,2)) AS "Price",
         p.p_type AS "Category", o.o_orderpriority AS "PaymentType"
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey)"""

SALES_HOURS_CTE = """sales_hours AS (
  SELECT ts AS "Date", dayname(ts) AS "Day", 'O' || CAST(user_id AS VARCHAR) AS "OrderID",
         event_type AS "Item", 1.0 AS "Quantity", CAST(value AS DECIMAL(18,2)) AS "Price",
         event_type AS "Category", event_type AS "PaymentType"
  FROM events)"""

RAW_SALES_CTE = """raw_sales AS (
  SELECT CAST(l.l_orderkey * 100 + l.l_linenumber AS BIGINT) AS row_number,
         CASE WHEN l.l_suppkey % 17 = 0 THEN ' ' || strftime(o.o_orderdate, '%d/%m/%Y/%H:%M:%S')
              WHEN l.l_suppkey % 19 = 0 THEN '31/02/1997/00:00:00'
              ELSE strftime(o.o_orderdate, '%d/%m/%Y/%H:%M:%S') END AS "Date",
         dayname(o.o_orderdate) AS "Day",
         CASE WHEN l.l_orderkey % 29 = 0 THEN NULL ELSE 'O' || CAST(l.l_orderkey AS VARCHAR) END AS "OrderID",
         p.p_name AS "Item",
         CAST(CAST(l.l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS "Quantity",
         CASE WHEN l.l_partkey % 23 = 0 THEN 'n/a' ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS "Price",
         CASE WHEN l.l_partkey % 11 = 0 THEN NULL WHEN l.l_partkey % 13 = 0 THEN ' nan ' ELSE p.p_type END AS "Category",
         CASE WHEN l.l_linenumber = 7 THEN '  ' ELSE o.o_orderpriority END AS "PaymentType"
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey)"""
