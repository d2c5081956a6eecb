"""Text expressions that follow Python's ``str`` rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesops.constants import (
    EXCEL_NA_VALUES,
    MISSING_KEY,
    PY_WHITESPACE,
    UNKNOWN_LABEL,
    UNKNOWN_WORDS,
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()``: removes all leading/trailing white space,
    including tabs and non-ASCII blanks (Spark's ``trim`` removes blanks only).
    ``btrim`` with an explicit character set: no regex per value."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def is_missing_text(col: Column | str) -> Column:
    """Null, or one of the reader's missing-value spellings (exact match)."""
    c = _c(col)
    return c.isNull() | c.isin(*EXCEL_NA_VALUES)


def label_unknown(col: Column | str) -> Column:
    """Trimmed text; missing, '', 'nan', 'None' → 'Unknown'."""
    c = _c(col).cast("string")
    s = py_strip(c)
    return F.when(is_missing_text(c) | s.isin(*UNKNOWN_WORDS), F.lit(UNKNOWN_LABEL)).otherwise(s)


def text_key(col: Column | str) -> Column:
    """Trimmed text with no Unknown rule; a missing value becomes 'nan'."""
    c = _c(col).cast("string")
    return F.when(is_missing_text(c), F.lit(MISSING_KEY)).otherwise(py_strip(c))


def slug(col: Column | str) -> Column:
    """Keep letters, digits, '-' and '_'; every other character → '_'."""
    return F.regexp_replace(_c(col), r"[^\p{L}\p{N}_-]", "_")
