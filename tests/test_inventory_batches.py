"""Batches settled one by one, and stored versions."""

import random
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from salesops.operators import records as R
from salesops.plans import settle as P
from salesops.sources import versions as V

UPD = "update_id long, dataset_id long, inventory_id long, barcode_number string"
INV = "dataset_id long, inventory_id long, barcode_number string"


def one_by_one(updates, inventory):
    now = {(d, i): (c or "").strip() for d, i, c in inventory}
    out = {}
    for u, d, i, c in sorted(updates):
        c = (c or "").strip()
        ok = (d, i) in now and (not c or all(x == (d, i) or x[0] != d or held != c for x, held in now.items()))
        if ok:
            now[d, i] = c
        out[u] = ok
    return {u: (out[u], now.get((d, i))) for u, d, i, _ in updates}


def result(df):
    return {r.update_id: (r.accepted, r.final_barcode) for r in df.collect()}


@pytest.mark.parametrize("piece_rows", [500_000, 7])
def test_updates_equal_one_by_one(spark, piece_rows):
    rng = random.Random(3)
    inventory = [(d, i, rng.choice(["", None, " a ", "b", "c", "d", f"x{i}"])) for d in range(3) for i in range(12)]
    updates = [(u, rng.randrange(4), rng.randrange(14), rng.choice([" a", "b ", "c", "d", "e", "", None, f"x{rng.randrange(12)}"])) for u in range(150)]
    got = R.apply_inventory_updates(spark.createDataFrame(updates, UPD).repartition(3), spark.createDataFrame(inventory, INV), piece_rows)
    assert result(got) == one_by_one(updates, inventory)


def test_a_long_chain_is_settled_in_few_jobs(spark):
    """Each update of 10,000 can only be accepted as the one before freed its barcode."""
    n = 10_000
    inventory = spark.range(n).select(F.lit(1).cast("long").alias("dataset_id"), F.col("id").alias("inventory_id"), F.concat(F.lit("c"), "id").alias("barcode_number"))
    step = lambda order: spark.range(n).select(order.alias("update_id"), F.lit(1).cast("long").alias("dataset_id"), F.col("id").alias("inventory_id"), F.concat(F.lit("c"), (F.col("id") + 1).cast("string")).alias("barcode_number"))
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    try:
        assert R.apply_inventory_updates(step(n - F.col("id")), inventory).where("accepted").count() == n  # the last item moves first
        assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 400
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert R.apply_inventory_updates(step(F.col("id")), inventory).where("accepted").count() == 1  # the other way round only the last one


@pytest.mark.parametrize("piece_rows", [500_000, 5])
def test_first_wins_equals_one_by_one(spark, piece_rows):
    rng = random.Random(5)
    rows = [(k, rng.randrange(3), f"I{rng.randrange(30)}", rng.choice(["", *"abcdefghij"])) for k in range(200)]
    ids, codes, want = set(), set(), set()
    for k, d, i, c in rows:
        if (d, i) not in ids and (not c or (d, c) not in codes):
            ids.add((d, i))
            codes.add((d, c))
            want.add(k)
    df = spark.createDataFrame(rows, "candidate_id long, dataset_id long, _id string, _bc string").repartition(3)
    assert {r.candidate_id for r in R._first_wins(df, piece_rows).collect()} == want


def test_components_of_a_chain_and_a_star(spark):
    n = 3000
    chain = spark.range(n - 1).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    star = spark.range(1, 500).select((F.col("id") + n).alias("x"), F.lit(n).alias("y"))
    got = P.components(chain.unionByName(star).repartition(4)).groupBy("group").count().collect()
    assert sorted((r.group, r["count"]) for r in got) == [(0, n), (n, 500)]
    assert P.components(chain.limit(0)).count() == 0


def test_create_inventory_in_pieces(spark):
    from salesops import registry as REG
    from sf_paths import SF_SMALL
    from salesops.sources import tables as T

    c = REG._proposed(spark, SF_SMALL).withColumns({
        "item_name": F.lit("x"), "item_category": F.lit("c"), "barcode_number": F.concat(F.lit("B"), (F.col("candidate_id") % 40).cast("string")),
        "cost_price": F.lit(1).cast("decimal(10,2)"), "selling_price": F.lit(2).cast("decimal(10,2)")})
    inventory = T.inventory(spark, SF_SMALL).withColumn("dataset_id", F.col("dataset_id") + 1000)
    a, b = (R.create_inventory(c, inventory, T.datasets(spark, SF_SMALL), p).where("accepted") for p in (500_000, 4))
    assert a.count() > 0 and sorted(x.candidate_id for x in a.collect()) == sorted(x.candidate_id for x in b.collect())


def test_the_last_of_several_changes_counts(spark):
    cols = "dataset_id long, item_id string, item_name string, item_category string, barcode_number string, cost_price decimal(10,2), selling_price decimal(10,2)"
    old = spark.createDataFrame([(7, 1, "I1", "Tea", "c", "b", None, None)], "inventory_id long, " + cols).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    new = spark.createDataFrame([(2, 1, "I1", "Z", "c", "", None, None), (9, 1, "I1", "A", "c", "", None, None), (3, 1, "I2", "New", "c", "", None, None), (4, 1, "I2", "Newer", "c", "", None, None)], "at long, " + cols)
    out = R.upsert_inventory(old, new, "2024-06-01 00:00:00", "at").collect()
    assert sorted((r.inventory_id, r.item_id, r.item_name) for r in out) == [(7, "I1", "A"), (8, "I2", "Newer")]
    assert len(R.upsert_inventory(old, new.drop("at"), "2024-06-01 00:00:00").collect()) == 2


def test_two_writers_lose_nothing(spark):
    root = tempfile.mkdtemp(prefix="versions-", dir="/tmp") + "/t"
    V.publish(spark, root, lambda _: spark.range(1).select(F.lit("start").alias("who")))
    pinned = V.read_version(spark, root)
    meet, tries = threading.Barrier(2, timeout=60), {"a": 0, "b": 0}

    def write(who):
        def build(base):
            tries[who] += 1
            if tries[who] == 1:
                meet.wait()  # both have read the same version
            return base.unionByName(spark.range(1).select(F.lit(who).alias("who")))

        V.publish(spark, root, build)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert V.versions(spark, root) == [0, 1, 2] and sum(tries.values()) == 3  # one had to build again
    assert sorted(r.who for r in V.read_version(spark, root).collect()) == ["a", "b", "start"]
    assert [r.who for r in pinned.collect()] == ["start"] and V.read_version(spark, root, 1).count() == 2


def test_a_manifest_is_created_once(spark):
    root = tempfile.mkdtemp(prefix="versions-", dir="/tmp")
    assert V._create_if_absent(spark, f"{root}/m/0.json", "{}") and not V._create_if_absent(spark, f"{root}/m/0.json", "x")
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, f"{root}/none")
