"""Number expressions: lenient parsing and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from salesops.constants import NUMBER_SHAPE
from salesops.functions.text import py_strip


def num_or_zero(col: Column | str, data_type: DataType | None = None) -> Column:
    """Text or number → double; unparsable or missing → 0.

    Text is accepted only in plain decimal/scientific notation (Spark alone
    would also read '1d' or 'inf'); outer white space is ignored.
    """
    c = F.col(col) if isinstance(col, str) else col
    if data_type is not None and isinstance(data_type, NumericType):
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    s = py_strip(c.cast("string"))
    parsed = F.when(s.rlike(NUMBER_SHAPE), s.try_cast("double"))
    return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    """round((part / whole) * 100, 2) in double arithmetic, half to even."""
    return F.bround((part.cast("double") / whole.cast("double")) * F.lit(100.0), 2)
