"""Column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from salesops.functions.dates import (  # noqa: F401
    days_in_month,
    month_abbr,
    parse_date,
    period_bounds,
    time_bucket,
)
from salesops.functions.numbers import num_or_zero, pct  # noqa: F401
from salesops.functions.text import (  # noqa: F401
    is_missing_text,
    label_unknown,
    py_strip,
    slug,
    text_key,
)
