"""V1–V9: the upload data-quality gate.

Cells carry their type (a workbook keeps numbers, text, booleans and dates
apart: text "5" is *not* a valid quantity), so the rules work on an array of
cell structs::

    cells: array<struct<type: string, text: string, num: double,
                        ts: timestamp_ntz, flag: boolean>>

with ``type`` one of none/str/int/float/bool/datetime. Workbooks give typed
cells (``salesops.sources.workbooks``); an all-text table becomes cells with
:func:`text_cells`, where a number-shaped Quantity/Price text counts as a
number.

Per file the checks reduce with aggregates only (``min`` of a struct for the
first violation, ``count`` for data rows), so a file with a third of all rows
is reduced in every task before the shuffle, never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.constants import (
    CHECK_TITLES,
    DATE_PARSE_FORMAT_SPARK,
    DATE_TEXT_SHAPE,
    MAX_PROFILE_BYTES,
    MAX_UPLOAD_BYTES,
    MSG_BAD_HEADER,
    MSG_EMPTY_FILE,
    MSG_NO_DATA,
    MSG_SCHEMA_OK,
    MSG_SIZE_BAD,
    MSG_SIZE_OK,
    MSG_SKIPPED,
    MSG_TYPE_BAD,
    MSG_TYPE_OK,
    MSG_UNREADABLE,
    NUMBER_SHAPE,
    PROFILE_SUFFIXES,
    SALES_COLUMNS,
    WORKBOOK_SUFFIXES,
)
from salesops.functions.text import py_strip

CELL_TYPE = (
    "struct<type: string, text: string, num: double, ts: timestamp_ntz, flag: boolean>"
)
NUMERIC_COLUMNS = ("Quantity", "Price")


# --- building cells -----------------------------------------------------------


def text_cells(df: DataFrame, path: str | Column = "table", row_col: str = "row_number") -> DataFrame:
    """An all-text sales table as flat cells (see :func:`flatten`).

    A number-shaped Quantity/Price text counts as a number. Strip and number
    parse are computed once per cell in their own projection; no cell structs
    are built, so the optimizer has nothing to copy into later references.
    """
    p = F.lit(path) if isinstance(path, str) else path
    first = []
    for i, c in enumerate(SALES_COLUMNS):
        x = F.col(c).cast("string")
        first += [x.alias(f"x{i}"), py_strip(x).alias(f"s{i}")]
    pre = df.select(p.alias("path"), F.col(row_col).cast("bigint").alias("row_number"), *first)
    second = []
    for i, c in enumerate(SALES_COLUMNS):
        x, st = F.col(f"x{i}"), F.col(f"s{i}")
        if c in NUMERIC_COLUMNS:
            n = F.when(st.rlike(NUMBER_SHAPE), st.try_cast("double"))
            second += [n.alias(f"n{i}")]
        else:
            second += [F.lit(None).cast("double").alias(f"n{i}")]
    pre = pre.select("path", "row_number", *[f"x{i}" for i in range(len(SALES_COLUMNS))],
                     *[f"s{i}" for i in range(len(SALES_COLUMNS))], *second)
    types = []
    for i, c in enumerate(SALES_COLUMNS):
        x, n = F.col(f"x{i}"), F.col(f"n{i}")
        t = F.when(x.isNull(), F.lit("none"))
        if c in NUMERIC_COLUMNS:
            t = t.when(n.isNotNull(), F.lit("float"))
        types.append(t.otherwise(F.lit("str")).alias(f"t{i}"))
    return pre.select("path", "row_number", *types, *[f"s{i}" for i in range(len(SALES_COLUMNS))],
                      *[f"n{i}" for i in range(len(SALES_COLUMNS))])


# --- per-cell rules (V3), on flat cells -----------------------------------------
#
# Flat cells are plain columns t<i> (type), s<i> (the cell as Python's str()
# shows it, stripped) and n<i> (number), for i = 0..7. Workbook cells come as
# an array of structs and are flattened with ``flatten``; each rule then reads
# cheap columns and every strip happens once per cell.


def flatten(cells_df: DataFrame) -> DataFrame:
    """Array-of-struct cells → flat cells; flat frames pass through."""
    if "cells" not in cells_df.columns:
        return cells_df
    if cells_df.schema["cells"].dataType.elementType.typeName() == "variant":
        return _flatten_variants(cells_df)
    types, texts, nums = [], [], []
    for i in range(len(SALES_COLUMNS)):
        c = F.col("cells").getItem(i)
        shown = (
            F.when(c.type == "str", c.text)
            .when(c.type.isin("int", "float"), c.num.cast("string"))
            .when(c.type == "bool", c.flag.cast("string"))
            .when(c.type == "datetime", c.ts.cast("string"))
        )
        types.append(F.coalesce(c.type, F.lit("none")).alias(f"t{i}"))
        texts.append(py_strip(shown).alias(f"s{i}"))
        nums.append(c.num.alias(f"n{i}"))
    return cells_df.select("*", *types, *texts, *nums)


# The type of a variant, as its schema names it, and the cell type it is.
_VARIANT_TYPES = {"BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "STRING": "str", "DATE": "datetime", "TIMESTAMP": "datetime", "TIMESTAMP_NTZ": "datetime"}


def _flatten_variants(cells_df: DataFrame) -> DataFrame:
    """Cells as an array of variants (any type in any column) → flat cells.

    Decimals count as floats; arrays and objects are no cell's type, so every
    rule refuses them. Rows may have fewer or more than eight cells.
    """
    n = len(SALES_COLUMNS)
    each = cells_df.select("*", *[F.get("cells", F.lit(i)).alias(f"_v{i}") for i in range(n)])
    each = each.select("*", *[F.schema_of_variant(f"_v{i}").alias(f"_k{i}") for i in range(n)])
    types, texts, nums = [], [], []
    for i in range(n):
        kind, v = F.col(f"_k{i}"), F.col(f"_v{i}")
        t = F.when(kind.isNull() | kind.isin("VOID", "NULL"), F.lit("none")).when(kind.startswith("DECIMAL"), F.lit("float"))
        for name, cell in _VARIANT_TYPES.items():
            t = t.when(kind == name, F.lit(cell))
        # Numbers, flags, dates, arrays and objects are never blank nor a header: their text is not made, which would be a cast for each.
        shown = kind.isin(*[k for k in _VARIANT_TYPES if k != "STRING"]) | kind.startswith("DECIMAL") | kind.startswith("ARRAY") | kind.startswith("OBJECT")
        types.append(t.otherwise(F.lit("other")).alias(f"t{i}"))
        texts.append(F.when(shown, F.lit("{}")).otherwise(py_strip(F.try_variant_get(v, "$", "string"))).alias(f"s{i}"))
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        nums.append(F.when(numeric, F.try_variant_get(v, "$", "double")).alias(f"n{i}"))
    return each.select(*cells_df.columns, *types, *texts, *nums)


def _blank(i: int) -> Column:
    return (F.col(f"t{i}") == "none") | (F.coalesce(F.col(f"s{i}"), F.lit("")) == "")


def valid_date(i: int) -> Column:
    t, s = F.col(f"t{i}"), F.col(f"s{i}")
    parsed = F.when(s.rlike(DATE_TEXT_SHAPE), F.try_to_timestamp(s, F.lit(DATE_PARSE_FORMAT_SPARK)))
    return (t == "datetime") | ((t == "str") & parsed.isNotNull())


def valid_text(i: int) -> Column:
    return (F.col(f"t{i}") == "str") & (F.col(f"s{i}") != "")


def valid_quantity(i: int) -> Column:
    t, n = F.col(f"t{i}"), F.col(f"n{i}")
    return ((t == "int") & (n > 0)) | ((t == "float") & (n == F.floor(n)) & (n > 0))


def valid_price(i: int) -> Column:
    return F.col(f"t{i}").isin("int", "float") & ~F.isnan(f"n{i}") & (F.col(f"n{i}") >= 0)  # NaN is above all numbers in Spark


RULES = {
    "Date": valid_date,
    "Day": valid_text,
    "OrderID": valid_text,
    "Item": valid_text,
    "Quantity": valid_quantity,
    "Price": valid_price,
    "Category": valid_text,
    "PaymentType": valid_text,
}


def _blank_row() -> Column:
    blank = F.lit(True)
    for i in range(len(SALES_COLUMNS)):
        blank = blank & _blank(i)
    return blank


# --- row operators (V2–V5) --------------------------------------------------------


def skip_blank_rows(cells_df: DataFrame) -> DataFrame:
    """V2: rows whose 8 cells are all blank are dropped; row numbers stay."""
    return flatten(cells_df).where(~_blank_row()).select(*cells_df.columns)


def row_violations(cells_df: DataFrame) -> DataFrame:
    """V3: every bad cell of every non-blank data row: (path, row_number, col_index, column)."""
    # Blank rows are told by a column: a filter would be pushed below the projection
    # of the flat cells, with each cell's type and text worked out for every reference.
    # The cells' checks are plain expressions, one row each: a lambda is not compiled.
    f = flatten(cells_df).withColumn("_blank_row", _blank_row())
    checks = [
        F.when(~F.col("_blank_row") & ~F.coalesce(RULES[name](i), F.lit(False)), F.lit(i))
        for i, name in enumerate(SALES_COLUMNS)
    ]
    bad = f.select("path", "row_number", F.explode(F.array(*checks)).alias("col_index")).where("col_index is not null")
    names = F.array(*[F.lit(n) for n in SALES_COLUMNS])
    return bad.select(
        "path", "row_number", F.col("col_index").cast("bigint").alias("col_index"),
        F.element_at(names, F.col("col_index") + 1).alias("column"),
    )


def first_violation(cells_df: DataFrame) -> DataFrame:
    """V4: per file, the first bad cell in row-major order and its message."""
    v = row_violations(cells_df)
    first = v.groupBy("path").agg(F.min(F.struct("row_number", "col_index", "column")).alias("f"))
    return first.select(
        "path",
        F.col("f.row_number").alias("row_number"),
        F.col("f.column").alias("column"),
        F.format_string("Invalid datatype/value for '%s' at row %d.", F.col("f.column"), F.col("f.row_number")).alias("message"),
    )


def has_data(cells_df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """V5: does each file have at least one non-blank data row?

    With ``files`` (one row per path) empty files appear too.
    """
    n = flatten(cells_df).where(~_blank_row()).groupBy("path").agg(F.count(F.lit(1)).alias("data_rows"))
    if files is not None:
        n = files.select("path").join(n, "path", "left")
    return n.select("path", (F.coalesce(F.col("data_rows"), F.lit(0)) > 0).alias("has_data"))


def violation_counts(cells_df: DataFrame) -> DataFrame:
    """Bad cells per column (the large-file summary of V3)."""
    return row_violations(cells_df).groupBy("column").agg(F.count(F.lit(1)).alias("violations"))


# --- file and header checks (V1, V6, V9) ------------------------------------------


def check_header(header_cells: DataFrame) -> DataFrame:
    """V1: per file, the first 8 stripped header texts equal the expected list.

    ``header_cells`` is (path, row_number, cells) restricted to row 1.
    """
    f = flatten(header_cells)
    ok = F.lit(True)
    for i, want in enumerate(SALES_COLUMNS):
        ok = ok & (F.coalesce(F.col(f"s{i}"), F.lit("")) == F.lit(want))
    return f.select("path", F.coalesce(ok, F.lit(False)).alias("header_ok"))


def _suffix(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def file_gate(files: DataFrame, suffixes=WORKBOOK_SUFFIXES, max_bytes=MAX_UPLOAD_BYTES, inclusive=False) -> DataFrame:
    """V6 / V9: suffix and size checks on (path, length)."""
    size_ok = F.col("length") <= max_bytes if inclusive else F.col("length") < max_bytes
    return files.select(
        "path",
        "length",
        _suffix(F.col("path")).isin(*suffixes).alias("type_ok"),
        size_ok.alias("size_ok"),
    )


def profile_gate(files: DataFrame) -> DataFrame:
    """V9: the dataset-profile upload: .xlsx/.xls/.csv, size ≤ 10 MiB."""
    return file_gate(files, PROFILE_SUFFIXES, MAX_PROFILE_BYTES, inclusive=True)


def validation_report(files: DataFrame, cells_df: DataFrame) -> DataFrame:
    """V7: three titled checks per file: (path, check, is_valid, message).

    ``files`` is (path, length); ``cells_df`` the parsed rows (row 1 =
    header, row -1 = unreadable file, row -2 = refused by the gate).
    """
    f = flatten(cells_df)
    row, data = F.col("row_number"), (F.col("row_number") > 1) & ~_blank_row()
    header = F.lit(True)
    for i, want in enumerate(SALES_COLUMNS):
        header = header & (F.coalesce(F.col(f"s{i}"), F.lit("")) == F.lit(want))
    bad = [F.when(~F.coalesce(RULES[name](i), F.lit(False)), F.lit(i)) for i, name in enumerate(SALES_COLUMNS)]
    names = F.array(*[F.lit(n) for n in SALES_COLUMNS])
    first = F.when(data, F.coalesce(*bad))  # the first bad cell of a row
    per_file = f.groupBy("path").agg(  # one aggregate for all checks
        F.max(row == -1).alias("unreadable"),
        F.max(F.when(row == 1, header)).alias("header_ok"),
        F.count(F.when(row >= 1, F.lit(1))).alias("sheet_rows"),
        F.count(F.when(data, F.lit(1))).alias("data_rows"),
        F.min(F.when(first.isNotNull(), F.struct(row.alias("row"), first.alias("col")))).alias("first"),
    )
    message = F.format_string("Invalid datatype/value for '%s' at row %d.", F.element_at(names, F.col("first.col") + 1), F.col("first.row"))
    per_file = (
        file_gate(files).join(per_file, "path", "left")
        .withColumn("readable", ~F.coalesce(F.col("unreadable"), F.lit(False)))
        .withColumn("header_ok", F.when(F.col("sheet_rows") > 0, F.coalesce(F.col("header_ok"), F.lit(False))))
        .withColumn("cell_message", F.when(F.col("first").isNotNull(), message))
    )
    gate_ok = F.col("type_ok") & F.col("size_ok")
    schema_msg = (
        F.when(~gate_ok, F.lit(MSG_SKIPPED))
        .when(~F.col("readable"), F.lit(MSG_UNREADABLE))
        .when(F.col("header_ok").isNull(), F.lit(MSG_EMPTY_FILE))
        .when(~F.col("header_ok"), F.lit(MSG_BAD_HEADER))
        .when(F.col("cell_message").isNotNull(), F.col("cell_message"))
        .when(F.coalesce(F.col("data_rows"), F.lit(0)) == 0, F.lit(MSG_NO_DATA))
        .otherwise(F.lit(MSG_SCHEMA_OK))
    )
    checks = F.array(
        F.struct(F.lit(1).alias("n"), F.lit(CHECK_TITLES[0]).alias("check"), F.col("type_ok").alias("is_valid"),
                 F.when(F.col("type_ok"), F.lit(MSG_TYPE_OK)).otherwise(F.lit(MSG_TYPE_BAD)).alias("message")),
        F.struct(F.lit(2).alias("n"), F.lit(CHECK_TITLES[1]).alias("check"), F.col("size_ok").alias("is_valid"),
                 F.when(F.col("size_ok"), F.lit(MSG_SIZE_OK)).otherwise(F.lit(MSG_SIZE_BAD)).alias("message")),
        F.struct(F.lit(3).alias("n"), F.lit(CHECK_TITLES[2]).alias("check"),
                 (schema_msg == F.lit(MSG_SCHEMA_OK)).alias("is_valid"), schema_msg.alias("message")),
    )
    out = per_file.select("path", F.explode(checks).alias("c"))
    return out.select("path", F.col("c.n").alias("n"), F.col("c.check").alias("check"),
                      F.col("c.is_valid").alias("is_valid"), F.col("c.message").alias("message"))
