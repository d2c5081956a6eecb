"""Queries over dataset profiles (P1, P2), row numbers of plain files, and rows that break each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesops import oracle as O
from salesops.operators import profile as prof
from salesops.operators import quality, records
from salesops.registry import _with, register
from salesops.sources import files as FS
from salesops.sources import tables as T

NAMES = FS.RAW_SALES_SCHEMA.names
QUOTED = [f'"{c}"' for c in NAMES]


def _typed_sql(source: str, columns: list[str], rows: str = "") -> str:
    """One row per column: the type by what the engine says it is and by missing values."""
    each = " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c.strip('"')}' AS "column", typeof(any_value({c})) AS t, count(*) = count({c}) AS whole, count(*) AS rows FROM {source}"""
        for i, c in enumerate(columns)
    )
    return f"""SELECT position, "column", CASE WHEN t IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN CASE WHEN whole THEN 'int64' ELSE 'float64' END
        WHEN t IN ('DOUBLE', 'FLOAT') THEN 'float64' WHEN t = 'BOOLEAN' THEN CASE WHEN whole THEN 'bool' ELSE 'object' END
        WHEN t LIKE 'TIMESTAMP%' OR t = 'DATE' THEN 'datetime64[ns]' ELSE 'object' END AS type, rows FROM ({each})"""


register("profile", _typed_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))(lambda spark, d: prof.profile(T.table(spark, d, "customer")))

_HOLES = """holes AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS some_number, o_orderkey % 3 = 0 AS flag,
    CASE WHEN o_orderkey % 4 <> 1 THEN o_custkey % 2 = 0 END AS some_flag, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate END AS some_date,
    o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS some_text, o_custkey FROM orders)"""


@register("profile_missing", _with(_HOLES) + _typed_sql("holes", ["some_number", "flag", "some_flag", "some_date", "o_totalprice", "some_text", "o_custkey"]))
def q_profile_missing(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    holes = T.table(spark, d, "orders").select(
        F.when(key % 5 != 0, key).alias("some_number"), (key % 3 == 0).alias("flag"), F.when(key % 4 != 1, cust % 2 == 0).alias("some_flag"),
        F.when(cust % 3 == 0, F.col("o_orderdate")).alias("some_date"), "o_totalprice", F.when(key % 2 == 0, F.col("o_orderpriority")).alias("some_text"), "o_custkey",
    )
    return prof.profile(holes)


# Text columns of the dirty table, and more that make every type.
_KINDS = {
    "n": "CAST(row_number AS STRING)",
    "n_missing": "CASE WHEN row_number % 7 = 0 THEN 'NA' ELSE CAST(row_number AS STRING) END",
    "n_signed": "CAST(row_number % 9 - 4 AS STRING)",
    "n_unsigned": "CASE WHEN row_number % 2 = 0 THEN '18446744073709551615' ELSE '1' END",
    "n_mixed": "CASE WHEN row_number % 2 = 0 THEN '18446744073709551615' ELSE '-1' END",
    "n_beyond": "CASE WHEN row_number % 2 = 0 THEN '18446744073709551616' ELSE '1' END",
    "fraction": "CASE WHEN row_number % 11 = 0 THEN ' 1e5 ' WHEN row_number % 11 = 1 THEN '-inf' ELSE CAST(row_number AS STRING) END",
    "flag": "CASE WHEN row_number % 2 = 0 THEN 'True' ELSE 'FALSE' END",
    "flag_missing": "CASE WHEN row_number % 2 = 0 THEN 'True' ELSE NULL END",
    "flag_number": "CASE WHEN row_number % 2 = 0 THEN 'True' ELSE '1' END",
    "nothing": "CASE WHEN row_number % 2 = 0 THEN '#N/A' ELSE NULL END",
}


def _inferred_sql() -> str:
    """The reader's rule column by column, in counts of what the cells are."""
    ctes = [O.RAW_SALES_CTE, "cells AS (SELECT *, " + ", ".join(f"{x.replace('STRING', 'VARCHAR')} AS {c}" for c, x in _KINDS.items()) + " FROM raw_sales)"]
    parts = []
    for i, c in enumerate([*QUOTED, *_KINDS]):
        s = f"trim({c}, {O.q(' ' + chr(9) + chr(10) + chr(11) + chr(12) + chr(13))})"
        digits = f"regexp_full_match({s}, '[+-]?[0-9]+')"
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS position, '{c.strip('"')}' AS "column", count(*) AS rows,
            count(*) FILTER (WHERE {O.missing(c)}) AS na, count(*) FILTER (WHERE NOT {O.missing(c)} AND lower({c}) IN ('true', 'false')) AS flags,
            count(*) FILTER (WHERE NOT {O.missing(c)} AND {digits}) AS whole, count(*) FILTER (WHERE NOT {O.missing(c)} AND {digits} AND {s} LIKE '-%') AS below,
            count(*) FILTER (WHERE NOT {O.missing(c)} AND {digits} AND try_cast({s} AS BIGINT) IS NULL) AS big,
            count(*) FILTER (WHERE NOT {O.missing(c)} AND {digits} AND try_cast({s} AS BIGINT) IS NULL AND try_cast({s} AS UBIGINT) IS NULL) AS beyond,
            count(*) FILTER (WHERE NOT {O.missing(c)} AND NOT {digits} AND (regexp_full_match({s}, {O.q(O.NUMBER_SHAPE)}) OR regexp_full_match(lower({s}), '[+-]?inf(inity)?'))) AS fractions
            FROM cells""")
    return _with(*ctes) + f"""SELECT position, "column", CASE WHEN na + flags + whole + fractions < rows OR beyond > 0 THEN 'object' WHEN na = rows THEN 'float64'
        WHEN flags > 0 THEN CASE WHEN flags = rows THEN 'bool' ELSE 'object' END WHEN fractions > 0 THEN 'float64'
        WHEN big > 0 THEN CASE WHEN below + na > 0 THEN 'object' ELSE 'uint64' END WHEN na > 0 THEN 'float64' ELSE 'int64' END AS type, rows
        FROM ({" UNION ALL ".join(parts)})"""


register("profile_types", _inferred_sql())(lambda spark, d: prof.profile_types(T.raw_sales(spark, d).select(*NAMES, *[F.expr(x).alias(c) for c, x in _KINDS.items()])))


# ---------------------------------------------------------------------------
# Rows that break the rules: blank and null rows, empty files, bad requests.
# ---------------------------------------------------------------------------


def _holed(spark, d):
    """The dirty table with every seventh order blank, every eleventh null."""
    order = F.expr("row_number div 100")
    cells = {c: F.when(order % 7 == 0, F.lit(" \t")).when(order % 11 == 0, F.lit(None).cast("string")).otherwise(F.col(c)) for c in NAMES}
    return T.raw_sales(spark, d).withColumns(cells).withColumn("path", F.concat(F.lit("f"), (order % 77).cast("string")))


_HOLED = _with(O.RAW_SALES_CTE, "ho AS (SELECT *, (row_number // 100) % 7 = 0 AS blank, (row_number // 100) % 11 = 0 AND (row_number // 100) % 7 <> 0 AS gone, 'f' || CAST((row_number // 100) % 77 AS VARCHAR) AS path FROM raw_sales)")


register("skip_blank_rows_holed", _HOLED + "SELECT path, row_number FROM ho WHERE NOT blank AND NOT gone")(
    lambda spark, d: quality.skip_blank_rows(quality.text_cells(_holed(spark, d), F.col("path"))).select("path", "row_number")
)
register("has_data_holed", _HOLED + "SELECT path, bool_or(NOT blank AND NOT gone) AS has_data FROM ho GROUP BY path")(
    lambda spark, d: quality.has_data(quality.text_cells(_holed(spark, d), F.col("path")), FS.written(_holed(spark, d).select("path").distinct(), "paths"))
)
register(
    "drop_all_null_rows_holed",
    _HOLED + "SELECT " + ", ".join(f"""CASE WHEN blank THEN ' ' || chr(9) ELSE {c} END AS {c}""" for c in QUOTED) + " FROM ho WHERE NOT gone",
)(lambda spark, d: prof.drop_all_null_rows(_holed(spark, d).select(*NAMES)))


@register(
    "validate_sales_broken",
    """WITH h AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 19 = 0 THEN ' ' WHEN o_orderkey % 19 = 1 THEN repeat('p', 51) ELSE o_orderpriority END AS payment_type FROM orders),
      l AS (SELECT l_orderkey AS request_id, CASE WHEN l_partkey % 31 = 0 THEN chr(9) WHEN l_partkey % 31 = 1 THEN repeat('i', 121) ELSE p_name END AS item,
                   CASE WHEN l_suppkey % 37 = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
                   CASE WHEN l_partkey % 29 = 0 THEN -1.0 WHEN l_partkey % 29 = 1 THEN 1.005 ELSE 2.5 END AS price,
                   CASE WHEN l_suppkey % 41 = 0 THEN repeat('c', 81) ELSE p_type END AS category
            FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 23 <> 0),
      e AS (SELECT request_id, count(*) AS n, min(CASE WHEN item = chr(9) OR length(item) > 120 THEN 2 WHEN quantity < 1 THEN 3 WHEN price <> 2.5 THEN 4 WHEN length(category) > 80 THEN 5 END) AS bad FROM l GROUP BY 1),
      r AS (SELECT h.request_id, CASE WHEN trim(payment_type) = '' OR length(payment_type) > 50 THEN 0 WHEN n IS NULL THEN 1 ELSE bad END AS bad FROM h LEFT JOIN e USING (request_id))
    SELECT request_id, bad IS NULL AS is_valid, ['payment_type', 'items', 'item', 'quantity', 'price', 'category'][bad + 1] AS error FROM r""",
)
def q_validate_sales_broken(spark, d):
    """Requests of which every rule refuses some."""
    h = T.sale_headers(spark, d)
    pay = F.when(h.request_id % 19 == 0, F.lit(" ")).when(h.request_id % 19 == 1, F.lit("p" * 51)).otherwise(F.col("payment_type"))
    li, p = T.table(spark, d, "lineitem").where("l_orderkey % 23 <> 0"), T.table(spark, d, "part")
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    lines = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("request_id"),
        F.when(k % 31 == 0, F.lit("\t")).when(k % 31 == 1, F.lit("i" * 121)).otherwise(F.col("p_name")).alias("item"),
        F.when(s % 37 == 0, F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
        F.when(k % 29 == 0, F.lit(-1.0)).when(k % 29 == 1, F.lit(1.005)).otherwise(F.lit(2.5)).cast("decimal(12,4)").alias("price"),
        F.when(s % 41 == 0, F.lit("c" * 81)).otherwise(F.col("p_type")).alias("category"),
    )
    return records.validate_sales(h.withColumn("payment_type", pay), lines)


# ---------------------------------------------------------------------------
# Row numbers of CSV files: the dirty table written in order over many files,
# read in splits of 64 KiB.
# ---------------------------------------------------------------------------


@register(
    "csv_row_numbers",
    _with(
        O.RAW_SALES_CTE,
        f"nb AS (SELECT *, row_number() OVER (ORDER BY row_number, {', '.join(f'{c} NULLS FIRST' for c in QUOTED)}) AS position FROM raw_sales)",
    )
    + f"""SELECT (position - 1) // 20000 AS file, 2 + (position - 1) % 20000 AS sheet_row, position, {", ".join(QUOTED)} FROM nb""",
)
def q_csv_row_numbers(spark, d):
    from salesops.plans.numbering import number_within
    from salesops.plans.row_numbers import with_row_numbers

    path = FS.scratch_path(spark, "csv")
    rows = number_within(T.raw_sales(spark, d), [], ["row_number", *NAMES], "at").withColumn("file", F.expr("(at - 1) div 20000"))
    plain = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # Files of 20,000 rows each, in order; a folder's name keeps the order of numbers.
    rows.withColumn("file", F.lpad(F.col("file").cast("string"), 8, "0")).repartition("file").sortWithinPartitions("file", "at").drop("row_number", "at").write.options(**plain).partitionBy("file").csv(path)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 64 * 1024)
    try:
        # The files are parsed, and their splits so made, within the call.
        found = with_row_numbers(FS.csv_reader(spark, multi_line=False).schema(FS.RAW_SALES_SCHEMA).csv(f"{path}/*"), "sheet_row", "path", first=2)
    finally:
        spark.conf.set(setting, before)
    found = FS.written(found, "numbered")
    return found.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint").alias("file"), "sheet_row", "position", *NAMES)
