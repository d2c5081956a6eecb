"""Cleaning (N1–N7) and filters.

Each chart cleans only the columns it reads, with its own rules (CHART_RULES);
the same functions work on the typed ``sales`` table and on an all-text
``raw_sales`` table, so the charts behave the same on both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from salesops.functions.dates import parse_date, period_bounds
from salesops.functions.numbers import num_or_zero
from salesops.functions.text import label_unknown, text_key

# Rule per column, per chart: "date" (N1, then N2), "label" (N3), "key" (N4,
# then N5), "number" (N6), "money" (N6, summed by ``money_sum``).
CHART_RULES: dict[str, dict[str, str]] = {
    "revenue_trend": {"Date": "date", "Price": "money"},
    "payment_vs_category": {"Date": "date", "Category": "label", "PaymentType": "label"},
    "order_volume": {"Date": "date", "OrderID": "key"},
    "market_basket": {"Date": "date", "OrderID": "key", "Item": "key"},
    "top_selling_items": {"Date": "date", "Item": "key", "Quantity": "number"},
    "payment_method_split": {"Date": "date", "PaymentType": "label"},
    "day_wise_pattern": {"Date": "date", "Price": "money"},
    "revenue_split": {"Date": "date", "PaymentType": "label", "Price": "money"},
    "category_performance": {"Date": "date", "Category": "label"},
}

# Room for amounts of 28 integer digits with ten decimals.
WIDE = DecimalType(38, 10)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Dataset is missing required columns: {', '.join(missing)}")
    return df


def money(col: str, dtype) -> Column:
    """An amount as it is given: decimals stay decimals, all else is a double."""
    return F.coalesce(F.col(col), F.lit(0).cast(dtype)) if isinstance(dtype, DecimalType) else num_or_zero(col, dtype)


def money_sum(col: str = "Price") -> Column:
    """Sum of an amount as a double, not rounded.

    Amounts are summed as wide decimals, exactly and in any order. Those that
    have no place there (28 digits and more), and a decimal sum that overflows,
    are summed as doubles: no cell makes the chart fail.
    """
    c = F.col(col)
    wide = c.try_cast(WIDE)
    exact = F.try_sum(wide)
    rest = F.coalesce(F.sum(F.when(wide.isNull(), c.cast("double"))), F.lit(0.0))
    return F.coalesce(exact.cast("double"), F.sum(F.when(wide.isNotNull(), c.cast("double"))), F.lit(0.0)) + rest


def _rule(types: dict, col: str, rule: str) -> Column:
    dtype = types[col]
    if rule == "date":
        return parse_date(col, dtype)
    if rule == "label":
        return label_unknown(col)
    if rule == "key":
        return text_key(col)
    if rule == "number":
        return num_or_zero(col, dtype)
    if rule == "money":
        return money(col, dtype)
    raise ValueError(f"unknown rule {rule}")


def clean_for(df: DataFrame, chart: str, keep=()) -> DataFrame:
    """Project ``df`` to a chart's columns, cleaned by that chart's rules.

    Rows with an unparsable date are dropped (N2) and, for key columns, rows
    whose trimmed key is empty (N5). Columns in ``keep`` (e.g. partition
    columns) are passed through for pruning.
    """
    rules = CHART_RULES[chart]
    types = {f.name: f.dataType for f in require_columns(df, rules).schema.fields}
    passthrough = [c for c in keep if c in types and c not in rules]
    out = df.select(*[_rule(types, c, r).alias(c) for c, r in rules.items()], *passthrough)
    out = drop_bad_dates(out)
    keys = [c for c, r in rules.items() if r == "key"]
    return drop_empty_keys(out, keys) if keys else out


# --- single-rule operators (N1–N6) as DataFrame → DataFrame -----------------


def parse_dates(df: DataFrame, col: str = "Date") -> DataFrame:
    """N1"""
    return df.withColumn(col, parse_date(col, df.schema[col].dataType))


def drop_bad_dates(df: DataFrame, col: str = "Date") -> DataFrame:
    """N2"""
    return df.where(F.col(col).isNotNull())


def drop_empty_keys(df: DataFrame, cols) -> DataFrame:
    """Drop rows whose trimmed key is '' (the 'nan' keys stay)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) != F.lit(""))
    return df.where(cond)


# --- filters (F1–F7) --------------------------------------------------------


def _whole(value, name: str) -> int:
    """A whole number, or the text of one."""
    try:
        n = int(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} must be a whole number") from e
    if not isinstance(value, str) and n != value:
        raise ValueError(f"{name} must be a whole number")
    return n


def check_year(year) -> int:
    """year must be an integer 1900–3000."""
    y = _whole(year, "year")
    if not 1900 <= y <= 3000:
        raise ValueError("year must be between 1900 and 3000")
    return y


def check_month(month, required: bool = False) -> int | None:
    """month 1–12; optional unless ``required``."""
    if month is None:
        if required:
            raise ValueError("month is required")
        return None
    m = _whole(month, "month")
    if not 1 <= m <= 12:
        raise ValueError("month must be between 1 and 12")
    return m


def _period(df: DataFrame, year: int, month: int | None, col: str) -> DataFrame:
    start, end = period_bounds(year, month)
    types = {f.name: f.dataType for f in df.schema.fields}
    dtype = types[col]
    cond = (F.col(col) >= F.lit(start).cast(dtype)) & (F.col(col) < F.lit(end).cast(dtype))
    # Stored tables are partitioned by year/month: filter those too so whole
    # folders are skipped.
    if "year" in types:
        cond = cond & (F.col("year") == year)
    if month is not None and "month" in types:
        cond = cond & (F.col("month") == month)
    return df.where(cond)


def by_year(df: DataFrame, year, col: str = "Date") -> DataFrame:
    """rows of one year (a range predicate, pushed to the scan)."""
    return _period(df, check_year(year), None, col)


def by_month_opt(df: DataFrame, year, month=None, col: str = "Date") -> DataFrame:
    """one year, and one month of it when given."""
    return _period(df, check_year(year), check_month(month), col)


def by_year_month(df: DataFrame, year, month, col: str = "Date") -> DataFrame:
    """one month of one year (both required)."""
    return _period(df, check_year(year), check_month(month, required=True), col)


def by_owner(df: DataFrame, id_col: str, id_value, user_col: str, user_id) -> DataFrame:
    """the row with this id owned by this user."""
    return df.where((F.col(id_col) == id_value) & (F.col(user_col) == user_id))


def iequals(col: Column | str, value: Column | str) -> Column:
    """case-insensitive equality."""
    a = F.col(col) if isinstance(col, str) else col
    b = F.lit(value) if isinstance(value, str) else value
    return F.lower(a) == F.lower(b)


def not_self(df: DataFrame, id_col: str, self_id) -> DataFrame:
    """every row but this one."""
    return df.where(F.col(id_col) != F.lit(self_id))
