"""Validation on typed workbook cells (S2 + V1–V7) and on text tables."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from salesops.constants import MSG_BAD_HEADER, MSG_NO_DATA, MSG_SCHEMA_OK, MSG_SKIPPED, MSG_UNREADABLE, SALES_COLUMNS
from salesops.operators import quality as Q
from salesops.sources import files as FS
from salesops.sources import workbooks as W

from salesops.sources.workbook_fixture import write_xlsx

GOOD = ["01/02/2024/10:00:00", "Thursday", "O101", "Tea", 2, 3.5, "Drinks", "Cash"]


def _folder(files):
    d = tempfile.mkdtemp(prefix="wb-", dir="/tmp")
    for name, rows in files.items():
        p = os.path.join(d, name)
        if isinstance(rows, bytes):
            open(p, "wb").write(rows)
        else:
            write_xlsx(p, rows)
    return d


def _report(spark, folder):
    files = W.list_files(spark, folder + "/*")
    cells = W.ingest_workbooks(spark, folder + "/*")
    rep = Q.validation_report(files, cells).collect()
    return {(os.path.basename(x.path), x.n): (x.is_valid, x.message) for x in rep}


def test_report_first_violation_and_typed_cells(spark):
    bad_qty = list(GOOD)
    bad_qty[4] = "5"  # text, not a number
    bad_price = list(GOOD)
    bad_price[5] = -1
    folder = _folder({
        "a.xlsx": [SALES_COLUMNS, GOOD, None, bad_qty + ["extra"], bad_price],
        "b.xlsx": [SALES_COLUMNS, [dt.datetime(2024, 2, 1, 9, 0), "Thu", "O1", "Tea", 2.0, 0, "D", "Card"]],
        "c.xlsx": [SALES_COLUMNS],
        "d.xlsx": [["Date", "Day"], GOOD],
        "e.csv": [SALES_COLUMNS, GOOD],
        "f.xlsx": b"not a zip",
        "g.xlsx": [[" Date "] + SALES_COLUMNS[1:], [*GOOD[:4], 2.5, *GOOD[5:]]],
        "h.xlsx": [SALES_COLUMNS, [*GOOD[:4], True, *GOOD[5:]]],
    })
    rep = _report(spark, folder)
    assert rep[("a.xlsx", 3)] == (False, "Invalid datatype/value for 'Quantity' at row 4.")
    assert rep[("b.xlsx", 3)] == (True, MSG_SCHEMA_OK)
    assert rep[("c.xlsx", 3)] == (False, MSG_NO_DATA)
    assert rep[("d.xlsx", 3)] == (False, MSG_BAD_HEADER)
    assert rep[("e.csv", 1)][0] is False and rep[("e.csv", 3)] == (False, MSG_SKIPPED)
    assert rep[("f.xlsx", 3)] == (False, MSG_UNREADABLE)
    assert rep[("g.xlsx", 3)] == (False, "Invalid datatype/value for 'Quantity' at row 2.")
    assert rep[("h.xlsx", 3)] == (False, "Invalid datatype/value for 'Quantity' at row 2.")
    assert all(rep[(n, 2)][0] for n in ["a.xlsx", "b.xlsx"])


def test_size_gate_does_not_open_large_files(spark):
    folder = _folder({"big.xlsx": b"x" * (10 * 1024 * 1024)})
    marks = W.ingest_workbooks(spark, folder + "/*").collect()
    assert [(os.path.basename(x.path), x.row_number, x.cells) for x in marks] == [("big.xlsx", -2, None)]  # refused, and said so
    rep = _report(spark, folder)
    assert rep[("big.xlsx", 2)][0] is False and rep[("big.xlsx", 3)] == (False, MSG_SKIPPED)


def test_text_table_rules(spark):
    data = [(2, *GOOD[:4], "2.0", "3.5", "Drinks", "Cash"),
            (3, None, " ", None, None, None, None, None, None),
            (4, " 01/02/2024/10:00:00", "Thu", "O1", "Tea", "2.5", "-1", "D", "Card"),
            (5, "31/02/2024/10:00:00", "Thu", "O1", "Tea", "x", "1", " ", "Card")]
    df = spark.createDataFrame(data, "row_number long, " + ", ".join(f"{c} string" for c in SALES_COLUMNS))
    cells = Q.text_cells(df, "t")
    v = sorted((x.row_number, x.column) for x in Q.row_violations(cells).collect())
    assert v == sorted([(4, "Quantity"), (4, "Price"), (5, "Date"), (5, "Quantity"), (5, "Category")])
    assert Q.first_violation(cells).first().message == "Invalid datatype/value for 'Quantity' at row 4."
    assert [x.row_number for x in Q.skip_blank_rows(cells).orderBy("row_number").collect()] == [2, 4, 5]
    assert Q.has_data(cells).first().has_data is True


def test_profile_gate(spark):
    files = spark.createDataFrame([("/x/a.CSV", 10 * 1024 * 1024), ("/x/b.xls", 10 * 1024 * 1024 + 1), ("/x/c.txt", 1)], "path string, length long")
    g = {x.path: (x.type_ok, x.size_ok) for x in Q.profile_gate(files).collect()}
    assert g == {"/x/a.CSV": (True, True), "/x/b.xls": (True, False), "/x/c.txt": (False, True)}


def test_rows_and_cells_without_references(spark):
    """The row and cell references of a sheet are optional."""
    import re
    import zipfile

    folder = _folder({"a.XLSX": [SALES_COLUMNS, GOOD]})
    path = os.path.join(folder, "a.XLSX")
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"].decode()
    parts["xl/worksheets/sheet1.xml"] = re.sub(r' r="[A-Z]*[0-9]+"', "", sheet).encode()
    with zipfile.ZipFile(os.path.join(folder, "b.xlsx"), "w") as z:
        for n, c in parts.items():
            z.writestr(n, c)
    rep = _report(spark, folder)
    assert rep[("a.XLSX", 3)] == rep[("b.xlsx", 3)] == (True, MSG_SCHEMA_OK)


def test_nan_is_no_price(spark):
    cells = spark.createDataFrame([("f", 2, "float", float("nan"))], "path string, row_number long, t5 string, n5 double")
    assert cells.select(Q.valid_price(5).alias("ok")).first().ok is False


def test_source_reads_as_ingest_does(spark):
    from salesops.sources.workbook_source import read_workbooks

    folder = _folder({"a.xlsx": [SALES_COLUMNS, GOOD, None, [dt.datetime(2024, 2, 1, 9, 0), True, 5, "x\ry", 2.5]], "b.XLSM": [SALES_COLUMNS], "c.csv": b"x", "d.xlsx": b"no zip", "_e.xlsx": b"hidden", "big.xlsx": b"x" * 5000})
    key = lambda r: (os.path.basename(r.path), r.row_number, str(r.cells))
    for size in (1, 1 << 30):
        got = read_workbooks(spark, folder, partitionBytes=size, maxBytes=4000)
        assert got.rdd.getNumPartitions() == (5 if size == 1 else 1)  # hidden files are no input
        assert sorted(map(key, got.collect())) == sorted(map(key, W.ingest_workbooks(spark, folder + "/[a-z]*", max_bytes=4000).collect()))
    os.makedirs(folder + "/empty")
    assert read_workbooks(spark, folder + "/empty").collect() == []


def test_rules_on_variant_cells(spark):
    """Every rule against every type of cell, by what the rules say in words."""
    values = {"none": "NULL", "void": "cast(NULL as string)", "blank": "' '", "text": "'x'", "date text": "' 1/2/2024/3:04:05 '", "number text": "'5'", "int": "3", "zero": "0", "negative": "-1", "long": "cast(5000000000 as bigint)",
              "whole float": "2.0D", "float": "2.5D", "NaN": "double('NaN')", "decimal": "2.5BD", "whole decimal": "cast(2 as decimal(10,2))", "true": "true", "date": "date'2024-01-02'", "time": "timestamp_ntz'2024-01-02 03:04:05'", "list": "array(1)"}
    good = {"Date": {"date text", "date", "time"}, "Quantity": {"int", "long", "whole float", "whole decimal"}, "Price": {"int", "zero", "long", "whole float", "float", "decimal", "whole decimal"}}
    texts = {"text", "date text", "number text"}
    for i, c in enumerate(SALES_COLUMNS):
        rows = ", ".join(f"({n}, cast({v} as variant))" for n, v in enumerate(values.values()))
        df = spark.sql(f"select 'f' as path, cast(n as bigint) as row_number, v from values {rows} as t(n, v)")
        filler = [F.lit("keep").cast("variant") if j != i else F.col("v") for j in range(len(SALES_COLUMNS))]
        bad = Q.row_violations(df.select("path", "row_number", F.array(*filler).alias("cells"))).where(F.col("column") == c).collect()
        assert {k for n, k in enumerate(values) if n not in {r.row_number for r in bad}} == good.get(c, texts), c
    short = spark.sql("select 'f' as path, 2L as row_number, array(cast('x' as variant)) as cells")
    assert Q.row_violations(short).count() == 8  # 'x' is no date, and missing cells are no values
    blank = spark.sql("select 'f' as path, 2L as row_number, array(cast(' ' as variant), cast(NULL as variant)) as cells")
    assert Q.skip_blank_rows(blank).count() == 0


def test_cells_of_a_row_are_checked_by_compiled_code(spark):
    """F8: no lambda over the checks, and no filter that repeats each cell's type and text."""
    rows = spark.sql("SELECT 'p' AS path, id AS row_number, transform(array(1, 2, 3, 4, 5, 6, 7, 8), x -> cast(id + x AS variant)) AS cells FROM range(3)")
    rows = FS.written(rows, "cells")
    plan = Q.row_violations(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("schemaOfVariant(") == len(SALES_COLUMNS)


def test_a_workbook_is_parsed_once(monkeypatch):
    """rows are held until the end of the sheet; a longer sheet is read again, an unreadable one gives a marker."""
    from salesops.sources.workbook_fixture import workbook_bytes

    good = workbook_bytes([list(SALES_COLUMNS), *[["d", i, 2.5, None, True, dt.datetime(2024, 1, 1), "x", "y"] for i in range(20)]])
    calls, read = [], W.read_first_sheet
    monkeypatch.setattr(W, "read_first_sheet", lambda content: calls.append(1) or read(content))
    files = [("a", good), ("b", b"no workbook"), ("c", None), ("d", good)]
    want = [r for b in W.parse_files(files, chunk=7) for r in b.to_pylist()]
    assert len(calls) == 3 and [r["row_number"] for r in want] == [*range(1, 22), -1, -1, *range(1, 22)]
    assert want[5]["cells"][1] == {"type": "int", "text": None, "num": 4.0, "ts": None, "flag": None} and want[21]["cells"] is None
    monkeypatch.setattr(W, "HELD_ROWS", 5)
    assert [r for b in W.parse_files(files) for r in b.to_pylist()] == want and len(calls) == 8


def test_plain_rows_are_what_a_parser_finds():
    """sheets written the plain way are taken apart without a tree; all others go to the XML parser."""
    import functools
    import io

    from salesops.sources.workbook_fixture import workbook_bytes

    value = functools.partial(W._value, shared=["A & B"], date_styles={1}, base_1904=False)
    top = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:x14ac="http://x">'
    cells = '<c r="A1" s="1"><v>44000.5</v></c><c r="B1" t="s"><v>0</v></c><c t="b"><v>1</v></c><c r="J1" t="s"><v>9</v></c><c r="E1" t="inlineStr"><is><t>a&lt;\u00e9</t></is></c><c t="inlineStr"/><c/><c><f>1&gt;0</f><v>-3</v></c>'
    sheet = lambda rows, before="", after="": f"{top}{before}<sheetData>{rows}</sheetData>{after}</worksheet>".encode()
    plain = [sheet(""), sheet(f'<row r="3" spans="1:8" x14ac:dyDescent="0.25">{cells}</row><row/><row>{cells}</row>', "<cols/>", "<pageMargins/>")]
    odd = [
        sheet("<row> <c><v>1</v></c></row>"), sheet('<row ht="3"><c><v>1</v></c></row>'), sheet("<row><c><v>&#65;</v></c></row>"), sheet("<row><c t='str'><v>x</v></c></row>"),
        sheet("<row><c><v>1</v></c></row>", "<!-- <sheetData><row><c><v>7</v></c></row></sheetData> -->"), sheet("", after="<row/>"), sheet('<row><c t="str"><v>a\rb</v></c></row>'),
    ]
    for data in plain + odd:
        rows = W._plain_rows(data, value)
        assert (rows is not None) == (data in plain) and (rows is None or rows == list(W._any_rows(io.BytesIO(data), value)))
    assert list(W._any_rows(io.BytesIO(plain[1]), value))[0][1][7] == ("int", None, -3.0, None, None)
    for data in (sheet("<row></c></row>"), sheet("<row/>")[:-3]):  # cut or torn: refused by both, or left to the parser
        for read in (lambda: W._plain_rows(data, value) or 1 / 0, lambda: list(W._any_rows(io.BytesIO(data), value))):
            try:
                read()
            except (W.ET.ParseError, ZeroDivisionError):
                continue
            raise AssertionError(data)
    # Most files: read without the parser, also beyond the length that is held at once.
    data = workbook_bytes([SALES_COLUMNS, *[[*GOOD[:3], f"<{i}> & more", i, None, "\r", "x"] for i in range(50)]])
    want = list(W.read_first_sheet(data))
    before, W.PLAIN_BYTES = W.PLAIN_BYTES, 100
    try:
        assert list(W.read_first_sheet(data)) == want and len(want) == 51 and want[50][1][3][1] == "<49> & more" and want[50][1][6][1] == "\r"
    finally:
        W.PLAIN_BYTES = before


def test_books_are_written_whole(spark):
    """a book's rows are one run of one task, also over several batches."""
    from salesops.registry_uploads import _write_books

    folder = tempfile.mkdtemp(prefix="books-", dir="/tmp")
    rows = spark.range(40).select(F.expr("id div 10 as book"), (F.col("id") + 1).alias("at"), *[F.concat(F.lit(f"{c} "), F.col("id").cast("string")).alias(c) for c in SALES_COLUMNS]).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = {r.name: r.cells for r in _write_books(rows, folder).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert made == {"book_0.XLSM": 80, "book_1.xlsx": 80, "book_2.XLSM": 80, "book_3.xlsx": 80}
    for k, name in enumerate(sorted(made)):
        with open(os.path.join(folder, name), "rb") as f:
            got = list(W.read_first_sheet(f.read()))
        assert [r for r, _ in got] == [*range(1, 12)] and [c[0][1] for _, c in got[1:]] == [f"Date {10 * k + i}" for i in range(10)]
