"""T1 stream over several micro-batches equals the batch result."""

import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from salesops.operators import scans as S
from salesops.sources import tables as T
from salesops.streaming.debounce import run_debounce

from sf_paths import SF_SMALL

LIMIT = 2 * 60 * 60 * 1000


def test_stream_equals_batch(spark):
    events = T.table(spark, SF_SMALL, "events")
    folder = tempfile.mkdtemp(prefix="events-stream-", dir="/tmp")
    src = os.path.join(folder, "in")
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for lo, hi in zip(bounds, bounds[1:]):  # in time order, one append per week
        events.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(src)
    streamed = run_debounce(spark, src, LIMIT, max_files_per_trigger=1, out_path=os.path.join(folder, "out"))
    batch = S.debounce_scans(T.scans(spark, SF_SMALL), LIMIT)
    got = sorted(x.scan_id for x in streamed.collect())
    want = sorted(x.scan_id for x in batch.collect())
    assert got == want and 0 < len(got) < events.count()


def test_sale_stream_counts_from_the_catalog_and_fails_on_damage(spark):
    import glob

    import pytest

    from salesops.streaming.sales_stream import REQUEST_SCHEMA, run_sales_stream

    folder = tempfile.mkdtemp(prefix="sale-stream-", dir="/tmp")
    source, out = os.path.join(folder, "in"), os.path.join(folder, "out")

    def arrive(request_id):
        rows = [(1, request_id, None, "Cash", [("Tea", 1, None, "D")])]
        df = spark.createDataFrame(rows, REQUEST_SCHEMA)
        df = df.withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
        df = df.withColumn("items", F.expr("transform(items, x -> named_struct('item', x.item, 'quantity', x.quantity, 'price', cast(1 as decimal(10,2)), 'category', x.category))"))
        df.write.mode("append").json(source)

    catalog = spark.createDataFrame([(1, 500)], "dataset_id long, last_order_number long")
    for i in (1, 2):
        arrive(i)
        sales, counters = run_sales_stream(spark, source, out, datasets=catalog)
    assert sorted(x.OrderID for x in spark.read.parquet(sales).collect()) == ["O501", "O502"]
    arrive(3)
    for f in glob.glob(counters + "/batch_id=1/*.parquet"):
        with open(f, "wb") as fh:
            fh.write(b"damaged")
    with pytest.raises(Exception):
        run_sales_stream(spark, source, out, datasets=catalog)


def test_stored_charts_prune_folders(spark):
    from salesops.operators import charts
    from salesops.sources import files as FS

    path = FS.scratch_path(spark, "sales")
    FS.create_dataset(spark, path)
    FS.append_sales(T.sales(spark, SF_SMALL), path)
    plan = charts.revenue_trend_day(FS.read_sales(spark, path), 1997, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(year#" in plan and "(month#" in plan
    names = [f for f in spark.read.parquet(path).inputFiles() if "year=1997/month=3/" in f]
    assert len(names) == 1  # clustered: one file of a small folder


def _late(spark, batches, limit=1000, delay="10 seconds"):
    """Batches of (device, second, code, id), one file each, in arrival order; accepted ids, by batch of output."""
    from salesops.streaming.debounce_late import run_debounce_late

    folder = tempfile.mkdtemp(prefix="late-", dir="/tmp")
    out = []
    for rows in batches:
        df = spark.createDataFrame([(i, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", d, c) for d, s, c, i in rows], "event_id long, ts string, user_id long, event_type string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder + "/in")
        out.append(sorted(x.scan_id for x in run_debounce_late(spark, folder + "/in", limit, delay, folder + "/out").collect()))
    return out


def test_late_scans_are_put_in_order(spark):
    # In arrival order 'b' at 3 would split the run of 'a'; in time order it does so between 2 and 4.
    got = _late(spark, [[(1, 4, " a ", 40), (1, 2, "a", 20)], [(1, 3, "b", 30), (1, 4, "a", 41), (2, 1, "", 50)], [(9, 100, "end", 99)]], limit=10_000)
    assert got[:2] == [[], []] and got[2] == [20, 30, 40]  # 41 is the same code at the same time
    # Behind the watermark: dropped, and the state stays as it was.
    got = _late(spark, [[(1, 0, "a", 1)], [(1, 60, "a", 2)], [(1, 5, "b", 3)], [(9, 200, "end", 99)]])
    assert got[-1] == [1, 2]


def test_pieces_of_one_unbroken_run(spark):
    """Equal exits are one step of a piece's table: as a plain walk gives."""
    import random

    rng = random.Random(4)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([0, 1, 1, 2, 7])
        rows.append((1, t, "a" if rng.random() < 0.97 else "b", i))
    want, last = [], None
    for _, t, c, i in rows:
        if last is None or c != last[0] or t - last[1] > 5:
            last = (c, t)
            want.append(i)
    df = spark.createDataFrame(rows, "device long, s long, code string, scan_id long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    for n in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert sorted(x.scan_id for x in S.debounce_scans(df, 5000).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_late_state_travels_with_the_rows(spark):
    """state comes and goes with the rows of a bucket of devices; no calls for each device."""
    from salesops.streaming.debounce_late import debounce_late

    src = spark.readStream.format("rate").load().selectExpr("value % 3 AS device", "cast(timestamp AS timestamp_ntz) AS ts", "'a' AS code", "value AS scan_id")
    plan = debounce_late(src, 1000)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "pmod(xxhash64(device" in plan


def test_late_scans_of_many_devices(spark):
    import random

    rng = random.Random(7)
    rows = [(rng.randrange(5), s, rng.choice(["a", "b", " a", ""]), i) for i, s in enumerate(sorted(rng.randrange(90) for _ in range(120)))]
    arrive = sorted(rows, key=lambda r: r[1] + rng.randrange(9))
    want, last = [], {}
    for d, s, c, i in rows:
        if (c := c.strip()) and (d not in last or c != last[d][0] or s - last[d][1] > 3):
            last[d] = (c, s)
            want.append(i)
    assert _late(spark, [arrive[:60], arrive[60:], [(9, 300, "end", 999)]], limit=3000)[-1] == want


def test_requests_are_joined_whole_and_counters_to_pieces(spark):
    from salesops.operators import records

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    schema = "dataset_id long, request_id long, day string, payment_type string, items array<struct<item: string, quantity: int, price: decimal(10,2), category: string>>"
    tea, cup = (" Tea ", 1, 2, "D"), ("Cup", 2, 3, "K")
    rows = [(1, 10, "2024-01-01", " Cash ", [tea, cup]), (1, 11, "2024-01-02", "Card", [cup]), (1, 11, "2024-01-03", "Cash", [tea]),
            (2, 12, "2024-01-01", "Cash", [cup]), (None, 13, "2024-01-01", "Cash", [tea]), (3, 14, "2024-01-01", "Cash", None), (3, None, "2024-01-01", "Cash", [tea])]
    rows = [(*r[:4], r[4] and [(i, q, Decimal(p), c) for i, q, p, c in r[4]]) for r in rows]
    requests = spark.createDataFrame(rows, schema).withColumn("ts", F.col("day").cast("timestamp_ntz"))
    last = spark.createDataFrame([(1, 500), (2, 700), (2, 900), (None, 5)], "dataset_id long, last_order_number long")
    numbered = records.assign_order_ids(requests.drop("items", "day"), last)
    # Rows meet their piece only, which has the counter; a dataset listed twice gives both numbers, a null one has no counter.
    assert plan(numbered).count("Join") == 1
    got = sorted((x.request_id or 0, x.OrderID) for x in numbered.collect())
    assert got == [(0, "O101"), (10, "O501"), (11, "O502"), (11, "O503"), (12, "O701"), (12, "O901"), (13, "O101"), (14, "O102")]
    whole = records.sale_rows(numbered, requests.select("request_id", "items"))
    flat = records.sale_rows(numbered, requests.select("request_id", F.posexplode("items").alias("line", "it")).select("request_id", "line", "it.*"))
    assert whole.dtypes == flat.dtypes and sorted(whole.collect()) == sorted(flat.collect())
    assert whole.where("request_id = 11").count() == 4  # both headers with the items of both
    assert whole.where("request_id = 10 and line = 0").first()[2:] == ("01/01/2024/00:00:00", "Monday", "O501", "Tea", 1, 2.0, "D", "Cash")
    # A price whose type holds no others is not checked as text.
    prices = [(1, Decimal("0.00")), (2, Decimal("-0.01")), (3, None)]
    lines = spark.createDataFrame(prices, "request_id long, price decimal(10,2)").selectExpr("*", "'a' as item", "1 as quantity", "'b' as category")
    checked = records.validate_sales(lines.selectExpr("request_id", "'Cash' as payment_type"), lines)
    assert {x.request_id: x.error for x in checked.collect()} == {1: None, 2: "price", 3: "price"}
    assert "cast(price" not in plan(checked)
