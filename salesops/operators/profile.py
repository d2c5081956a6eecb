"""A dataset profile for the chat assistant's context.

Everything is computed by Spark over the whole table: the row count is an
aggregate, the sample is ``orderBy(order).limit(20)`` (a per-task top-k), and
the text is assembled in a one-row frame — no rows pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesops.constants import EXCEL_NA_VALUES, MAX_CONTEXT_CHARS, MSG_EMPTY_DATASET, NUMBER_SHAPE, SAMPLE_ROWS, SAMPLE_VALUE_CHARS


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every value is missing."""
    return df.na.drop(how="all")


def trimmed_columns(df: DataFrame) -> DataFrame:
    """Column names with outer blanks removed (the profile shows them so)."""
    return df.toDF(*[c.strip() for c in df.columns])


def type_of(name: str, dt: T.DataType) -> Column:
    """The type name a pandas reader would show for a typed column, as an aggregate: a
    missing value makes a whole number a float and a flag an object."""
    missing = F.count(F.lit(1)) > F.count(F.col(f"`{name}`"))
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.when(missing, F.lit("float64")).otherwise(F.lit("int64"))
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.lit("float64")
    if isinstance(dt, T.BooleanType):
        return F.when(missing, F.lit("object")).otherwise(F.lit("bool"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("datetime64[ns]")
    return F.lit("object")


def _rows_of(clean: DataFrame, types: list[Column]) -> DataFrame:
    """(position, column, type, rows) from one aggregate over the table."""
    one = clean.agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.array(*types).alias("_types"))
    names = F.array(*[F.lit(c) for c in clean.columns])
    return one.select("rows", F.posexplode("_types").alias("position", "type")).select("position", F.get(names, F.col("position")).alias("column"), "type", "rows")


def profile(df: DataFrame) -> DataFrame:
    """(position, column, type, rows) — one row per column; ``rows`` is
    the row count after P1."""
    clean = trimmed_columns(drop_all_null_rows(df))
    return _rows_of(clean, [type_of(f.name, f.dataType) for f in clean.schema.fields])


# What a text cell can be read as; a column's types are the union of its cells'.
_NA, _WHOLE, _NEGATIVE, _UNSIGNED, _BEYOND, _FLOAT, _BOOL, _TEXT = (1 << i for i in range(8))
_MAX_UNSIGNED = (1 << 64) - 1


def _cell_types(c: Column) -> Column:
    """The bit of what one text cell is: numbers may have outer ASCII blanks, flags may not."""
    s = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    whole = s.try_cast("decimal(38,0)")
    return (
        F.when(c.isNull() | c.isin(*EXCEL_NA_VALUES), F.lit(_NA))
        .when(F.lower(c).isin("true", "false"), F.lit(_BOOL))
        .when(
            s.rlike("^[+-]?[0-9]+$"),
            F.when(s.try_cast("bigint").isNotNull(), F.when(s.startswith("-"), F.lit(_NEGATIVE)).otherwise(F.lit(_WHOLE)))
            .when(whole.between(F.lit(0), F.lit(str(_MAX_UNSIGNED)).cast("decimal(38,0)")) & ~s.startswith("-"), F.lit(_UNSIGNED))
            .otherwise(F.lit(_BEYOND)),
        )
        .when(s.rlike(NUMBER_SHAPE) | F.lower(s).rlike("^[+-]?inf(inity)?$"), F.lit(_FLOAT))
        .otherwise(F.lit(_TEXT))
    )


def profile_types(df: DataFrame) -> DataFrame:
    """P2 of an all-text table, typed as a CSV reader infers it: (position, column, type, rows).

    Every cell has a type; a column's is their least common one, merged as a
    bitwise OR with partial results in every task. Whole numbers and fractions
    make floats, a missing cell makes whole numbers floats and flags objects,
    anything mixed with text or flags, and numbers beyond 64 bits, are objects.
    Such a number beside fractions is too, though a reader that meets a
    fraction first says float; a table has no first row.
    """
    clean = trimmed_columns(drop_all_null_rows(df))
    types = []
    for c in clean.columns:
        bits = F.bit_or(_cell_types(F.col(f"`{c}`").cast("string")))
        has = lambda b, bits=bits: bits.bitwiseAND(F.lit(b)) != 0
        types.append(
            F.when(bits.isNull() | has(_TEXT | _BEYOND), F.lit("object"))
            .when(bits == _NA, F.lit("float64"))
            .when(has(_BOOL), F.when(bits == _BOOL, F.lit("bool")).otherwise(F.lit("object")))
            .when(has(_FLOAT), F.lit("float64"))
            .when(has(_UNSIGNED), F.when(has(_NEGATIVE | _NA), F.lit("object")).otherwise(F.lit("uint64")))
            .when(has(_NA), F.lit("float64"))
            .otherwise(F.lit("int64"))
        )
    return _rows_of(clean, types)


def _shown(c: str, dt: T.DataType):
    v = F.col(f"`{c}`")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        v = F.date_format(v, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(dt, T.BooleanType):
        v = F.when(v, F.lit("True")).when(~v, F.lit("False"))
    return F.substring(v.cast("string"), 1, SAMPLE_VALUE_CHARS)


def sample_rows(df: DataFrame, order_cols, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by ``order_cols`` (a Spark table has no "first
    rows" otherwise), every value as text cut to 80 chars, nulls kept."""
    clean = trimmed_columns(drop_all_null_rows(df))
    shown = clean.orderBy(*order_cols).limit(n)
    return shown.select(*[_shown(f.name, f.dataType).alias(f.name) for f in clean.schema.fields])


def _json_string(c):
    """A text as Python's ``json.dumps`` writes it: ASCII only, by UTF-16 code unit."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), 1)
    short = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}

    def shown(u):
        out = None
        for code, text in short.items():
            out = F.when(u == code, F.lit(text)) if out is None else out.when(u == code, F.lit(text))
        n = F.conv(u, 16, 10).cast("int")
        return out.when((n >= 32) & (n < 128), F.chr(n)).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    return F.concat(F.lit('"'), F.array_join(F.transform(units, shown), ""), F.lit('"'))


def sample_json(df: DataFrame, order_cols, n: int = SAMPLE_ROWS) -> DataFrame:
    """P3 as one JSON array of records, written as ``json.dumps`` writes it
    (blanks after commas and colons, nulls as null)."""
    s = sample_rows(df, order_cols, n)
    fields = []
    for i, c in enumerate(s.columns):
        name = _json_string(F.lit(c))
        value = F.coalesce(_json_string(F.col(f"`{c}`")), F.lit("null"))
        fields += [F.lit(", " if i else ""), name, F.lit(": "), value]
    rec = F.concat(F.lit("{"), *fields, F.lit("}"))
    ordered = s.select(F.monotonically_increasing_id().alias("_i"), rec.alias("r"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_i", "r"))), lambda x: x.r)  # ≤ n rows
    return ordered.agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("sample"))


def profile_text(df: DataFrame, name: str, order_cols) -> DataFrame:
    """The five-line summary, cut to 7,000 characters, as a one-row frame.

    A dataset without a non-empty row is an error, raised when the frame is read.
    """
    clean = trimmed_columns(drop_all_null_rows(df))
    cols = [f.name for f in clean.schema.fields]
    types = clean.agg(F.concat_ws("; ", *[F.concat(F.lit(f"{f.name}: "), type_of(f.name, f.dataType)) for f in clean.schema.fields])).scalar()
    counted = clean.select(F.count(F.lit(1))).scalar()
    rows = F.when(counted == 0, F.raise_error(F.lit(MSG_EMPTY_DATASET)).cast("bigint")).otherwise(counted)
    sample = sample_json(df, order_cols).select("sample")
    shown = sample.select(
        F.concat(
            F.lit(f"Dataset name: {name}\nRows: "), rows.cast("string"),
            F.lit(f"\nColumns ({len(cols)}): {', '.join(cols)}\nColumn types: "), types, F.lit("\nSample rows (first "),
            F.least(rows, F.lit(SAMPLE_ROWS)).cast("string"), F.lit("): "), F.col("sample"),
        ).alias("text")
    )
    return shown.select(F.substring("text", 1, MAX_CONTEXT_CHARS).alias("context"))
