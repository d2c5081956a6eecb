"""S7 landing, S4 creation and CSV round trips."""

import tempfile

import pytest
from pyspark.sql import functions as F

from salesops.operators import quality as Q
from salesops.sources import files as FS
from salesops.sources import uploads as U

COLS = "user_id long, file_name string, upload_id string, row_number long, Date string, Item string"


def _root(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp") + "/root"


def _rows(spark, uploads):
    """uploads: (user, name, upload, [(date, item), …])."""
    return spark.createDataFrame([(u, n, i, k + 2, *cells) for u, n, i, rows in uploads for k, cells in enumerate(rows)], COLS).repartition(3)


def _stored(spark, root):
    out = {}
    for r in U.landed(spark, root).orderBy("row_number").collect():
        out.setdefault((r.user_id, r.dataset_key), []).append((r.Date, r.Item))
    return out


def test_every_upload_is_kept(spark):
    root = _root("land")
    first = [(1, "s.xlsx", "a", [("d", "Tea"), ("d", "Milk")])]
    U.land_upload(_rows(spark, first), root)
    # Another upload of the same name with as many rows, two of one name in one batch, and the first again.
    second = [(1, "s.xlsx", "b", [("d", "Tea"), ("d", "Cake")]), (1, "s.xlsx", "c", [("d", None), ("d", "Cake")]), (2, "s.xlsx", "d", [("d", "Tea"), ("d", "Milk")]), (1, "s.xlsx", "e", [("d", "Tea"), ("d", "Milk")])]
    found = {r.upload_id: r for r in U.land_upload(_rows(spark, second), root).collect()}
    assert {k: r.stored for k, r in found.items()} == {"b": True, "c": True, "d": True, "e": False}
    assert len({(r.user_id, r.dataset_key) for r in found.values()}) == 4
    assert all(r.dataset_key.endswith("_s.xlsx") and len(r.dataset_key) == 8 + 7 for r in found.values())
    held = _stored(spark, root)
    assert sorted(map(str, held.values())) == sorted(map(str, [rows for _, _, _, rows in first + second[:3]]))
    assert held[(1, found["b"].dataset_key)] == second[0][3]


def test_cells_that_look_alike_are_told_apart(spark):
    uploads = [(1, "s", "a", [(None, "x")]), (1, "s", "b", [("x", None)]), (1, "s", "c", [("", "x")]), (1, "s", "d", [("-", "x")]), (1, "s", "e", [("x", "x")]), (1, "s", "f", [("x", "x"), ("x", "x")])]
    digests = U.content_digests(_rows(spark, uploads).drop("row_number"), ["upload_id"], ["Date", "Item"]).collect()
    assert len({r.digest for r in digests}) == len(uploads)
    # Order does not count.
    a = _rows(spark, [(1, "s", "a", [("1", "x"), ("2", "y")])]).drop("row_number")
    b = _rows(spark, [(1, "s", "a", [("2", "y"), ("1", "x")])]).drop("row_number")
    assert U.content_digests(a, ["upload_id"], ["Date", "Item"]).first() == U.content_digests(b, ["upload_id"], ["Date", "Item"]).first()


def test_shared_keys_get_further_digits(spark):
    root = _root("digits")
    for batch in range(2):  # sixteen keys for twelve contents: some must meet, in a batch and with stored ones
        uploads = [(1, "s", f"{batch}-{i}", [(f"d{batch}", f"i{i}")]) for i in range(6)]
        out = U.land_upload(_rows(spark, uploads), root, digits=1).collect()
        assert all(r.stored for r in out)
    held = _stored(spark, root)
    assert len(held) == 12 and sorted(held.values()) == sorted([[(f"d{b}", f"i{i}")] for b in range(2) for i in range(6)])


def test_files_without_a_commit_are_not_read(spark):
    root = _root("half")
    U.land_upload(_rows(spark, [(1, "s", "a", [("d", "Tea")])]), root)
    lost = _rows(spark, [(1, "t", "b", [("d", "Lost")])]).withColumns({"dataset_key": F.lit("00000000_t"), "land_id": F.lit("l-0")})
    lost.drop("file_name", "upload_id").write.mode("append").partitionBy("land_id", "user_id", "dataset_key").parquet(f"{root}/data")
    assert list(_stored(spark, root).values()) == [[("d", "Tea")]]


def test_csv_keeps_quotes_commas_and_line_breaks(spark):
    cells = ['say "hi"', "a,b", "two\nlines", '"', "", None, " blank ", "back\\slash", 'mix",\n"x']
    rows = [("01/02/2024/10:00:00", "Thu", f"O{i}", c, "1", "2", "c", "p") for i, c in enumerate(cells)]
    path = _root("csv")
    FS.export_dataset(spark.createDataFrame(rows, FS.RAW_SALES_SCHEMA), path)
    back = FS.csv_reader(spark).schema(FS.RAW_SALES_SCHEMA).csv(path).orderBy("OrderID").collect()
    assert [r.Item for r in back] == [c or None for c in cells]  # an empty text reads as missing
    assert FS.scan_csv(spark, path).count() == len(cells)
    with tempfile.NamedTemporaryFile("w", suffix=".csv", dir="/tmp") as f:
        f.write('a,b\n1,"x\ny"\n2,"he said ""no"""\n')
        f.flush()
        got = FS.scan_csv(spark, f.name)
        assert dict(got.dtypes)["a"] == "int" and [tuple(r) for r in got.orderBy("a").collect()] == [(1, "x\ny"), (2, 'he said "no"')]


def test_csv_is_read_by_other_tools(spark):
    import glob

    import pandas as pd

    rows = [("d", "Thu", "O1", 'a "b", c\nd', "1", "2", " x ", "p")]
    path = _root("other")
    FS.export_dataset(spark.createDataFrame(rows, FS.RAW_SALES_SCHEMA), path)
    got = pd.concat(pd.read_csv(f) for f in glob.glob(path + "/*.csv"))
    assert got["Item"].tolist() == ['a "b", c\nd'] and got["Category"].tolist() == [" x "]


@pytest.mark.parametrize("n", [0, 3])
def test_created_datasets_are_listed(spark, n):
    root = _root("created")
    FS.create_datasets(spark.createDataFrame([(1, i, f"Shop {i}/x") for i in range(n)], "user_id long, dataset_id long, name string"), root)
    got = FS.created_datasets(spark, root).orderBy("dataset_id").collect()
    assert [(r.table_name, r.rows) for r in got] == [(f"Shop_{i}_x_{i}", 0) for i in range(n)]


def test_rows_are_shuffled_once_to_their_folders(spark):
    """neither the counts' join nor the counts take the rows through a shuffle of their own."""
    rows = _rows(spark, [(1, "s", "a", [("d", "Tea"), ("e", None)])])
    for df in (FS.clustered(rows, ["user_id", "Date"]), FS.spread(rows.withColumn("n", F.lit(2)), ["user_id"], "n")):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert df.columns == rows.columns and df.count() == 2


def test_digests_sum_all_pieces_of_a_hash(spark):
    """the halves' sums give the sum of the whole pieces."""
    import hashlib

    cells = [(f"d{i}", None if i % 3 else "") for i in range(50)]
    got = U.content_digests(_rows(spark, [(1, "s", "a", cells)]), ["upload_id"], ["Date", "Item"]).first()
    hashes = [hashlib.sha256(f"={d}\x1f{'-' if i is None else '='}".encode()).hexdigest() for d, i in cells]
    sums = [sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes) for k in range(4)]
    assert got.digest == hashlib.sha256("/".join(map(str, [50, *sums])).encode()).hexdigest()


def test_uploads_sent_again_read_the_table_once(spark):
    """the copy of an upload is made of its rows, not of another join of the tables."""
    from salesops.registry_uploads import _gated

    from sf_paths import SF_SMALL

    data = _gated(spark, SF_SMALL)[2]
    assert data._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey#") and sum("lineitem" in x for x in data._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x) == 1
    assert data.where("path = 'in/8/again.xlsx'").count() == data.where("path = 'in/9/again.xlsx'").count() > 0


def test_no_accepted_upload_is_no_error(spark):
    """where every upload is refused, what is landed has no rows; later ones land beside it."""
    root = _root("refused")
    names = FS.RAW_SALES_SCHEMA.names
    good = ["01/02/2024/10:00:00", "Thu", "O1", "Tea", "2", "3.5", "Drinks", "Cash"]
    data = spark.createDataFrame([("in/a.xlsx", 2, *good)], ["path", "row_number", *names])
    head = spark.createDataFrame([("in/a.xlsx", 1, *names)], ["path", "row_number", *names])
    cells = Q.text_cells(data.unionByName(head), F.col("path"))
    for length, n in ((10 * 1024 * 1024, 0), (1024, 1), (1024, 1)):
        files = spark.createDataFrame([("in/a.xlsx", length, 1)], "path string, length long, user_id long")
        report, uploads = U.land_accepted(files, cells, data, root)
        assert report.where("not is_valid").isEmpty() == bool(n) and uploads.count() == n
        found = U.landed(spark, root)
        assert sorted(found.columns) == sorted(["row_number", *names, "user_id", "dataset_key"]) and dict(found.dtypes)["user_id"] == "bigint"
        assert [(r.Item, r.user_id, r.dataset_key[8:]) for r in found.collect()] == [("Tea", 1, "_a.xlsx")] * n


def test_an_upload_is_not_refused_for_its_rows(spark, monkeypatch):
    """an upload of more rows than the gate's bytes is accepted; its length is not its number of rows."""
    from salesops import registry_uploads as R
    from salesops.constants import MAX_UPLOAD_BYTES

    def many(spark, d):  # orders 5 and 1: more rows each than the gate allows bytes
        rows = spark.range(2 * (MAX_UPLOAD_BYTES + 1)).select((F.col("id") % 2 * 400 + 100).alias("row_number"))
        return rows.select("row_number", *[F.lit("x").alias(c) for c in FS.RAW_SALES_SCHEMA.names])

    monkeypatch.setattr(R.T, "raw_sales", many)
    files = R._gated(spark, None)[0]
    assert {r.path: r.size_ok for r in Q.file_gate(files).collect()} == {"in/1/other.xlsx": False, "in/5/sales.xlsx": True}


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.splitlines() if "/shuffle_" in x}


def test_a_landing_leaves_no_shuffle_files(spark):
    """what was shuffled to be written is removed when it is written."""
    import time

    rows = _rows(spark, [(1, "s", f"{i}", [(f"d{k}", f"i{i}") for k in range(20)]) for i in range(3)])
    before = _shuffle_files(spark)
    written = FS.written(rows.repartition(4, "Date"), "sent")
    out = U.land_upload(written, _root("clean"))
    left = time.time() + 20
    while (new := _shuffle_files(spark) - before) and time.time() < left:  # removed in the background
        time.sleep(0.2)
    assert not new and out.where("stored").count() == 3 and spark.conf.get(FS.SHUFFLE_CLEANUP, None) is None


def test_parts_of_a_landing_are_all_its_rows(spark):
    """each row is in one part, and a file's rows are in one part."""
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 5).alias("k"), F.lit(3).alias("n"))
    parts = [FS.spread(rows, ["k"], "n", i, 4).withColumn("salt", F.pmod(F.xxhash64("id", "k"), F.lit(3))).collect() for i in range(4)]
    assert sorted(r.id for p in parts for r in p) == list(range(3000))
    assert sum(len({(r.k, r.salt) for r in p}) for p in parts) == 15 and sum(1 for p in parts if p) > 1
    root = _root("parts")
    uploads = [(1, "s", f"{i}", [(f"d{k}", f"i{i}") for k in range(40)]) for i in range(U.LAND_PARTS + 3)]
    U.land_upload(_rows(spark, uploads), root)
    assert sorted(sorted(v) for v in _stored(spark, root).values()) == sorted(sorted(rows) for *_, rows in uploads)
    again = U.land_upload(_rows(spark, uploads), root)
    assert again.where("stored").isEmpty() and len(_stored(spark, root)) == len(uploads)
