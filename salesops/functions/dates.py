"""Date expressions.

Filters on a stored timestamp are written as half-open ranges
(``Date >= start AND Date < end``), never as ``year(Date) = y``: a range is a
plain comparison Catalyst pushes through joins into the Parquet scan, where
row-group statistics skip data; ``year(...)`` hides the column from pushdown.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from salesops.constants import (
    BUCKETS,
    DATE_PARSE_FORMAT_SPARK,
    DATE_TEXT_SHAPE,
    DAYTIME_BEFORE_HOUR,
    MORNING_BEFORE_HOUR,
)


def parse_date(col: Column | str, data_type: DataType | None = None) -> Column:
    """Text ``d/m/yyyy/H:M:S`` → timestamp; anything else → null.

    Timestamps pass through unchanged. Outer blanks make the text invalid (the
    charts do not trim), as do impossible dates, 2-digit years and 24:00:00.
    """
    c = F.col(col) if isinstance(col, str) else col
    if data_type is not None and not isinstance(data_type, StringType):
        return c
    shaped = c.rlike(DATE_TEXT_SHAPE)
    return F.when(shaped, F.try_to_timestamp(c, F.lit(DATE_PARSE_FORMAT_SPARK)).cast("timestamp_ntz"))


def period_bounds(year: int, month: int | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Half-open [start, end) of a year, or of one month of it."""
    if month is None:
        return dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    if month == 12:
        return dt.datetime(year, 12, 1), dt.datetime(year + 1, 1, 1)
    return dt.datetime(year, month, 1), dt.datetime(year, month + 1, 1)


def days_in_month(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


def month_abbr(month: Column) -> Column:
    """1 → 'Jan' … 12 → 'Dec' (English, as the charts label months)."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def time_bucket(ts: Column) -> Column:
    """Hour → 'morning' (<12h), 'daytime' (<18h), 'evening'."""
    h = F.hour(ts)
    return (
        F.when(h < MORNING_BEFORE_HOUR, F.lit(BUCKETS[0]))
        .when(h < DAYTIME_BEFORE_HOUR, F.lit(BUCKETS[1]))
        .otherwise(F.lit(BUCKETS[2]))
    )
