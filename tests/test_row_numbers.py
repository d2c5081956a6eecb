"""Row numbers equal the written order over files and splits."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from salesops.operators import quality as Q
from salesops.plans.row_numbers import with_row_numbers
from salesops.sources import files as FS


@pytest.fixture
def folder():
    d = tempfile.mkdtemp(prefix="rows-", dir="/tmp")
    for f, n in (("a.csv", 1), ("b.csv", 5000), ("c.csv", 0), ("d.csv", 2500)):
        with open(os.path.join(d, f), "w") as out:
            out.write("k,text\n" + "".join(f"{f[0]}{i},{'x' * (i % 60)}\n" + ("\n" if i % 100 == 0 else "") for i in range(n)))
    return d


@pytest.mark.parametrize("split", [2000, 1 << 27])
def test_numbers_follow_the_files(spark, folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = FS.csv_reader(spark, multi_line=False).schema("k string, text string").csv(folder)
        assert (df.rdd.getNumPartitions() > 20) == (split == 2000)
        got = with_row_numbers(df, first=2).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("a", 0)] + [("b", i) for i in range(5000)] + [("d", i) for i in range(2500)]  # blank lines are no rows
    assert [(r.k, r.position) for r in got] == [(f"{f}{i}", p + 1) for p, (f, i) in enumerate(want)]
    assert [(os.path.basename(r.file)[0], r.row_number) for r in got] == [(f, i + 2) for f, i in want]


def test_first_violation_of_a_csv(spark):
    d = tempfile.mkdtemp(prefix="rows-", dir="/tmp")
    good = '01/02/2024/10:00:00,Thu,O1,Tea,2,3.5,Drinks,Cash\n'
    with open(d + "/a.csv", "w") as f:
        f.write(",".join(FS.RAW_SALES_SCHEMA.names) + "\n" + good * 10 + good.replace(",2,", ",x,") + good)
    rows = with_row_numbers(FS.csv_reader(spark).schema(FS.RAW_SALES_SCHEMA).csv(d), first=2)
    first = Q.first_violation(Q.text_cells(rows, F.col("file"))).first()
    assert first.message == "Invalid datatype/value for 'Quantity' at row 12."


def test_no_files_and_chosen_columns(spark, folder):
    os.makedirs(folder + "/sub")
    assert with_row_numbers(spark.read.schema("k string").csv(folder + "/sub")).collect() == []
    few = with_row_numbers(FS.csv_reader(spark, multi_line=False).schema("k string, text string").csv(folder).select("k"))
    assert few.columns == ["file", "row_number", "position", "k"] and few.where("k = 'd7'").first().position == 5009


def test_tasks_follow_the_bytes(spark, folder):
    """many small splits are read by few tasks, once; numbers hold when the setting has changed since."""
    from salesops.plans.row_numbers import TASKS_PER_CORE, _few_tasks

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        df = FS.csv_reader(spark, multi_line=False).schema("k string, text string").csv(folder)
        assert _few_tasks(df).rdd.getNumPartitions() == TASKS_PER_CORE * spark.sparkContext.defaultParallelism < df.rdd.getNumPartitions()
        numbered = with_row_numbers(df, first=2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.k for r in numbered.orderBy("position").collect()] == ["a0", *[f"b{i}" for i in range(5000)], *[f"d{i}" for i in range(2500)]]


def test_no_task_reads_many_splits(spark, folder):
    """a task holds the buffers of all splits it has read, so their number is bounded, not only their bytes."""
    from salesops.plans.row_numbers import TASK_SPLITS, TASKS_PER_CORE, _few_tasks

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        df = FS.csv_reader(spark, multi_line=False).schema("k string, text string").csv(folder)
        splits, tasks = df.rdd.getNumPartitions(), _few_tasks(df).rdd.getNumPartitions()
        assert splits > TASK_SPLITS * TASKS_PER_CORE * spark.sparkContext.defaultParallelism and splits > tasks >= splits / TASK_SPLITS
        numbered = with_row_numbers(df, first=2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.k for r in numbered.orderBy("position").collect()] == ["a0", *[f"b{i}" for i in range(5000)], *[f"d{i}" for i in range(2500)]]


def test_numbering_joins_its_pieces_without_a_shuffle(spark):
    """the pieces are written, so the join with them is planned by their size."""
    from salesops.plans.numbering import number_within

    plan = number_within(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
