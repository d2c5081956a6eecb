"""Queries over uploads: landing (S7), created datasets (S4), workbooks (S2), typed cells (V1, V3), CSV (S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesops import oracle as O
from salesops.operators import charts, quality
from salesops.registry import MONTH, YEAR, _clean_cte, _days, _where, _with, register
from salesops.sources import catalog
from salesops.sources import files as FS
from salesops.sources import tables as T
from salesops.sources import uploads as U

NAMES = FS.RAW_SALES_SCHEMA.names
QUOTED = ", ".join(f'"{c}"' for c in NAMES)


# ---------------------------------------------------------------------------
# The dirty table as 21 uploads of three users and seven names, of which
# every second row number pair is another upload of the same name.
# ---------------------------------------------------------------------------


def _uploads(spark, d):
    order = F.expr("row_number div 100")
    return T.raw_sales(spark, d).withColumns({
        "user_id": (1 + order % 3).cast("bigint"),
        "file_name": F.concat(F.lit("sales "), (order % 7).cast("string"), F.lit(".xlsx")),
        "upload_id": (order % 2).cast("string"),
    })


def _digest_ctes(source: str, by: str, columns: list[str]) -> str:
    """``dg``: the digest of each of ``by``'s groups of ``source``, and its key."""
    shown = " || chr(31) || ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in columns)
    joined = " || '/' || ".join(["CAST(count(*) AS VARCHAR)", *[f"CAST(CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR)" for i in range(4)]])
    return f"""hs AS (SELECT *, sha256({shown}) AS h FROM {source}),
  dd AS (SELECT {by}, count(*) AS n_rows, sha256({joined}) AS digest FROM hs GROUP BY {by}),
  dg AS (SELECT *, substr(sha256(CAST(user_id AS VARCHAR) || '/' || file_name || '/' || digest), 1, 8) || '_' || replace(file_name, ' ', '_') AS dataset_key FROM dd)"""


_CONTENT = ["row_number", *[f'"{c}"' for c in NAMES]]
_LANDED = _with(
    O.RAW_SALES_CTE,
    """up AS (SELECT *, 1 + (row_number // 100) % 3 AS user_id, 'sales ' || CAST((row_number // 100) % 7 AS VARCHAR) || '.xlsx' AS file_name,
              CAST((row_number // 100) % 2 AS VARCHAR) AS upload_id FROM raw_sales)""",
    _digest_ctes("up", "user_id, upload_id, file_name", _CONTENT),
)


def _landed(spark, d):
    root = FS.scratch_path(spark, "uploads")
    rows = FS.written(_uploads(spark, d), "sent")  # the joins of the tables are made once
    U.land_upload(rows, root)
    U.land_upload(rows, root)  # the same uploads again: found, not stored twice
    return U.landed(spark, root)


@register("land_upload", _LANDED + f"SELECT row_number, {QUOTED}, CAST(user_id AS BIGINT) AS user_id, dataset_key FROM up JOIN dg USING (user_id, upload_id, file_name)")
def q_land_upload(spark, d):
    return _landed(spark, d).select("row_number", *NAMES, "user_id", "dataset_key")


def _by_key_sql(body: str) -> str:
    """A chart of every landed table: ``c`` is the cleaned rows with user and key."""
    cleaned = _clean_cte("raw_sales").split("c AS (SELECT", 1)[1].rsplit("FROM raw_sales", 1)[0]
    return _LANDED.rstrip() + f""", lu AS (SELECT up.*, dg.dataset_key FROM up JOIN dg USING (user_id, upload_id, file_name)),
  c AS (SELECT CAST(user_id AS BIGINT) AS user_id, dataset_key, {cleaned} FROM lu),
  ks AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, dataset_key FROM lu){body}"""


def _found(spark, d):
    """Key to stored table: keys are looked up as the charts' pages do, then the found ones' rows are read."""
    root = FS.scratch_path(spark, "uploads")
    files = U.land_upload(FS.written(_uploads(spark, d), "sent"), root)
    asked = files.select("user_id", F.concat(F.lit("uploads/"), "dataset_key").alias("key"))
    found = catalog.dataset_by_key(asked, files.select("user_id", "dataset_key")).where("status = 'found'")
    return U.landed(spark, root).join(found.select("user_id", F.col("resolved_key").alias("dataset_key")), ["user_id", "dataset_key"], "left_semi")


register(
    "revenue_trend_day_landed",
    _by_key_sql(f""", g AS (SELECT user_id, dataset_key, day("Date") AS day, sum(price) AS amount FROM c WHERE {_where(YEAR, MONTH)} GROUP BY ALL)
    SELECT ks.user_id, ks.dataset_key, CAST(m.day AS BIGINT) AS day, CAST(m.day AS VARCHAR) AS label, {O.shown('g.amount')} AS revenue
    FROM ks CROSS JOIN range(1, {_days(YEAR, MONTH) + 1}) m(day) LEFT JOIN g ON g.user_id = ks.user_id AND g.dataset_key = ks.dataset_key AND g.day = m.day"""),
)(lambda spark, d: charts.revenue_trend_day_by(_found(spark, d), ["user_id", "dataset_key"], YEAR, MONTH))
register(
    "top_selling_items_landed",
    _by_key_sql(f""", g AS (SELECT user_id, dataset_key, item, sum(qty) AS q FROM c WHERE {_where(YEAR)} AND item <> '' GROUP BY ALL)
    SELECT user_id, dataset_key, CAST(row_number() OVER w AS BIGINT) AS rank, item, CAST(round_even(q, 0) AS BIGINT) AS quantity
    FROM g WINDOW w AS (PARTITION BY user_id, dataset_key ORDER BY q DESC, item) QUALIFY row_number() OVER w <= 20"""),
)(lambda spark, d: charts.top_selling_items_by(_found(spark, d), ["user_id", "dataset_key"], YEAR))


# ---------------------------------------------------------------------------
# V6–V7, then S7: twelve uploads, some of which fail a check; three good ones
# have one name (two of one user), and one is sent twice.
# ---------------------------------------------------------------------------

_GOOD = {"Date": "01/02/1997/00:00:00", "OrderID": "O1", "Price": "1", "Category": "c", "PaymentType": "p"}


def _gated(spark, d):
    k = F.expr("(row_number div 100) % 12")
    rows = T.raw_sales(spark, d).withColumn("k", k).where("k <> 9")
    rows = rows.withColumn("k", F.explode(F.expr("if(k = 8, array(k, 9L), array(k))")))  # sent again; the table is read once
    good = {c: F.when(F.col("k").between(5, 9), F.lit(v)).otherwise(F.col(c)) for c, v in _GOOD.items()}
    rows = rows.withColumns(good).withColumns({c: F.when(F.col("k") == 3, F.lit(" ")).otherwise(F.col(c)) for c in NAMES})
    name = F.when(F.col("k") == 0, F.lit("sales.csv")).when(F.col("k").between(5, 7), F.lit("sales.xlsx")).when(F.col("k").between(8, 9), F.lit("again.xlsx")).otherwise(F.lit("other.xlsx"))
    rows = rows.withColumn("path", F.concat(F.lit("in/"), F.col("k").cast("string"), F.lit("/"), name))
    files = rows.select("path", "k").distinct()
    # A file's length is what its upload says, not its number of rows: that passes the gate's 10 MiB where the tables are large.
    files = files.select("path", "k", F.when(F.col("k") == 1, F.lit(10 * 1024 * 1024)).otherwise(F.lit(1024)).cast("bigint").alias("length"), F.when(F.col("k") == 7, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("user_id"))
    files = FS.written(files, "gated-files")
    swapped = [NAMES[1], NAMES[0], *NAMES[2:]]
    head = files.where("k <> 4").select("path", F.lit(1).cast("bigint").alias("row_number"), *[F.when(F.col("k") == 2, F.lit(w)).otherwise(F.lit(c)).alias(c) for c, w in zip(NAMES, swapped, strict=True)])
    lost = files.where("k = 4").select("path", F.lit(-1).cast("bigint").alias("row_number"), *[F.lit(None).cast("string").alias(c) for c in NAMES])
    data = rows.where("k <> 4").select("path", "row_number", *NAMES)
    return files, quality.text_cells(data.unionByName(head).unionByName(lost), F.col("path")), data


def _gated_sql() -> str:
    cells = ", ".join(f"""{O.q(_GOOD[c])} AS "{c}\"""" if c in _GOOD else f'"{c}"' for c in NAMES)
    return _with(
        O.RAW_SALES_CTE,
        f"""up AS (SELECT row_number, {cells}, k, CASE WHEN k = 7 THEN 2 ELSE 1 END AS user_id, CASE WHEN k < 8 THEN 'sales.xlsx' ELSE 'again.xlsx' END AS file_name
               FROM (SELECT *, (row_number // 100) % 12 AS k FROM raw_sales) WHERE k BETWEEN 5 AND 8)""",
        _digest_ctes("up", "user_id, k, file_name", _CONTENT),
    ) + f"SELECT row_number, {QUOTED}, CAST(user_id AS BIGINT) AS user_id, dataset_key FROM up JOIN dg USING (user_id, k, file_name)"


@register("land_accepted", _gated_sql())
def q_land_accepted(spark, d):
    root = FS.scratch_path(spark, "accepted")
    U.land_accepted(*_gated(spark, d), root)
    return U.landed(spark, root).select("row_number", *NAMES, "user_id", "dataset_key")


# ---------------------------------------------------------------------------
# A dataset for every customer row, then a listing of what was created.
# ---------------------------------------------------------------------------


@register(
    "create_dataset",
    r"""SELECT CAST(c_nationkey AS BIGINT) AS user_id, c_custkey AS dataset_id, c_name AS name,
              regexp_replace(c_name, '[^\p{L}\p{N}_-]', '_', 'g') || '_' || CAST(c_custkey AS VARCHAR) AS table_name, CAST(0 AS BIGINT) AS rows,
              'Date, Day, OrderID, Item, Quantity, Price, Category, PaymentType' AS columns
       FROM customer""",
)
def q_create_dataset(spark, d):
    root = FS.scratch_path(spark, "datasets")
    FS.create_datasets(T.datasets(spark, d), root)
    return FS.created_datasets(spark, root)


# ---------------------------------------------------------------------------
# The dirty table dealt into workbooks of up to 500 rows by tasks, read
# back by the data source; some are refused or unreadable.
# ---------------------------------------------------------------------------

BOOK_ROWS = 500


def _write_books(rows, folder):
    """One workbook for each ``book``: a header, then its rows in the order of ``at``; returns what was written."""
    names, width = list(NAMES), len(NAMES)

    def write(batches):
        import itertools

        import pyarrow as pa

        from salesops.sources.workbook_fixture import workbook_bytes
        from salesops.sources.workbook_source import write_file

        lines = itertools.chain.from_iterable(zip(b.column("book").to_pylist(), zip(*[b.column(c).to_pylist() for c in names], strict=True), strict=True) for b in batches)
        for k, of in itertools.groupby(lines, key=lambda x: x[0]):
            cells = [x[1] for x in of]
            data = b"no workbook" if k % 11 == 5 else workbook_bytes([names, *cells])
            name = f"book_{k}.{'xlsb' if k % 13 == 7 else 'xlsx' if k % 2 else 'XLSM'}"
            write_file(folder, name, data)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(cells) * width], pa.int64())], ["name", "cells"])

    # A book's rows come one after the other, in one task; a stream of its own for each book would cost more than its rows.
    dealt = rows.select("book", "at", *names).repartition("book").sortWithinPartitions("book", "at")
    return FS.written(dealt.mapInArrow(write, "name string, cells long"), "books")


@register(
    "ingest_workbooks",
    _with(
        O.RAW_SALES_CTE,
        f"nb AS (SELECT *, row_number() OVER (ORDER BY row_number, {', '.join(f'{c} NULLS FIRST' for c in QUOTED.split(', '))}) - 1 AS pos FROM raw_sales)",  # row numbers are not unique
        f"bk AS (SELECT *, pos // {BOOK_ROWS} AS book, CAST(pos % {BOOK_ROWS} + 2 AS BIGINT) AS sheet_row FROM nb)",
        """nm AS (SELECT DISTINCT book, 'book_' || CAST(book AS VARCHAR) || CASE WHEN book % 13 = 7 THEN '.xlsb' WHEN book % 2 = 1 THEN '.xlsx' ELSE '.XLSM' END AS name FROM bk)""",
    )
    + f"""SELECT name, sheet_row AS row_number, {QUOTED} FROM bk JOIN nm USING (book) WHERE book % 11 <> 5 AND book % 13 <> 7
       UNION ALL SELECT name, 1, {", ".join(O.q(c) for c in NAMES)} FROM nm WHERE book % 11 <> 5 AND book % 13 <> 7
       UNION ALL SELECT name, CASE WHEN book % 13 = 7 THEN -2 ELSE -1 END, {", ".join("NULL" for _ in NAMES)} FROM nm WHERE book % 11 = 5 OR book % 13 = 7""",
)
def q_ingest_workbooks(spark, d):
    from salesops.plans.numbering import number_within
    from salesops.sources.workbook_source import read_workbooks
    from salesops.sources.workbooks import cell_texts

    folder = FS.scratch_path(spark, "books")
    rows = number_within(T.raw_sales(spark, d), [], ["row_number", *NAMES], "at")
    _write_books(rows.withColumn("book", F.expr(f"(at - 1) div {BOOK_ROWS}")), folder)
    back = read_workbooks(spark, folder)
    return back.select(F.substring_index("path", "/", -1).alias("name"), "row_number", *cell_texts())


# ---------------------------------------------------------------------------
# V1 and V3 on typed cells: every type in every column, and typed headers.
# ---------------------------------------------------------------------------

# What a cell becomes by (row number + 3 * column) % 13; 9 to 12 leave its good value.
_TYPED = 9


def _typed_cells(spark, d):
    """The clean table as variants: a cell's type is chosen by its row and column."""
    rows = T.raw_sales(spark, d).select("row_number", *NAMES)
    good = {
        "Date": F.to_timestamp_ntz(F.lit("1997-03-04 10:00:00")).cast("variant"), "Quantity": F.lit(2).cast("variant"), "Price": F.lit(3.5).cast("double").cast("variant"),
    }
    cells = []
    for i, c in enumerate(NAMES):
        kind = F.pmod(F.col("row_number") + 3 * i, F.lit(13))
        text = F.concat(F.lit(" "), F.coalesce(F.col(c), F.lit("text")))
        typed = (
            F.when(kind == 0, F.lit(None).cast("variant"))
            .when(kind == 1, F.lit(" \t").cast("variant"))
            .when(kind == 2, text.cast("variant"))
            .when(kind == 3, (F.col("row_number") % 5 - 1).cast("bigint").cast("variant"))
            .when(kind == 4, F.lit(4.0).cast("double").cast("variant"))
            .when(kind == 5, F.lit(2.5).cast("double").cast("variant"))
            .when(kind == 6, (F.col("row_number") % 2 == 0).cast("variant"))
            .when(kind == 7, F.to_timestamp_ntz(F.lit("2024-02-29 23:59:59")).cast("variant"))
            .when(kind == 8, F.lit("5").cast("variant"))
            .otherwise(good.get(c, F.lit("good").cast("variant")))
        )
        cells.append(F.when(F.col("row_number") % 17 == 0, F.lit(None).cast("variant")).otherwise(typed))
    return rows.select(F.lit("typed").alias("path"), "row_number", F.array(*cells).alias("cells"))


def _typed_sql() -> str:
    parts = []
    for i, c in enumerate(NAMES):
        k = f"(row_number + {3 * i}) % 13"
        n = "(row_number % 5 - 1)"
        if c == "Date":
            s = f"""trim(' ' || coalesce("{c}", 'text'))"""
            shape = O.q(O.DATE_TEXT_SHAPE)
            ok = f"""CASE WHEN {k} = 2 THEN regexp_full_match({s}, {shape}) AND try_strptime({s}, {O.q(O.DATE_FORMAT_SQL)}) IS NOT NULL ELSE {k} = 7 OR {k} >= 9 END"""
        elif c == "Quantity":
            ok = f"CASE WHEN {k} = 3 THEN {n} > 0 ELSE {k} = 4 OR {k} >= 9 END"
        elif c == "Price":
            ok = f"CASE WHEN {k} = 3 THEN {n} >= 0 ELSE {k} IN (4, 5) OR {k} >= 9 END"
        else:
            ok = f"""CASE WHEN {k} = 2 THEN {O.strip(f"' ' || coalesce({chr(34)}{c}{chr(34)}, 'text')")} <> '' ELSE {k} = 8 OR {k} >= 9 END"""
        parts.append(f"""SELECT row_number, CAST({i} AS BIGINT) AS col_index, '{c}' AS "column" FROM raw_sales WHERE row_number % 17 <> 0 AND NOT ({ok})""")
    return _with(O.RAW_SALES_CTE) + "SELECT 'typed' AS path, * FROM (" + " UNION ALL ".join(parts) + ")"


register("typed_violations", _typed_sql())(lambda spark, d: quality.row_violations(FS.written(_typed_cells(spark, d), "typed")))


@register(
    "typed_headers",
    _with(O.RAW_SALES_CTE, "f AS (SELECT DISTINCT row_number // 100 AS k FROM raw_sales)")
    + """SELECT 'sheet_' || CAST(k AS VARCHAR) AS path, k % 7 IN (0, 6) AS header_ok FROM f""",
)
def q_typed_headers(spark, d):
    """A header row for each order of the table: by its number right, or with a number, a flag, a date, no cell, another text or a ninth cell."""
    k = F.col("k")
    odd = (
        F.when(k % 7 == 1, F.lit(5).cast("variant")).when(k % 7 == 2, F.lit(True).cast("variant")).when(k % 7 == 3, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).cast("variant"))
        .when(k % 7 == 4, F.lit(None).cast("variant")).when(k % 7 == 5, F.lit("Dates").cast("variant"))
    )
    heads = T.raw_sales(spark, d).select(F.expr("row_number div 100").alias("k")).distinct()
    cells = [F.lit(f" {c} ").cast("variant") for c in NAMES]
    at = F.pmod(k, F.lit(len(NAMES)))
    cells = [F.when((at == i) & (k % 7).between(1, 5), odd).otherwise(c) for i, c in enumerate(cells)]
    rows = heads.select(F.concat(F.lit("sheet_"), k.cast("string")).alias("path"), F.lit(1).cast("bigint").alias("row_number"), F.array(*cells, F.lit("more").cast("variant")).alias("cells"))
    return quality.check_header(rows)
