"""Sale recording, inventory, chat history and the barcode rule on edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from salesops.operators import messages as M
from salesops.operators import records as R
from salesops.operators import scans as S
from salesops.plans.numbering import number_within


def test_number_within_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3 * 0 + (F.col("id") < 4000).cast("int")).alias("k"), (F.col("id") * 7 % 5000).alias("o"))
    got = number_within(df, ["k"], ["o"], "n", partitions=6)
    from pyspark.sql import Window

    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 5)], "k long, o long")
    assert sorted((x.o, x.n) for x in number_within(df, ["k"], ["o"], "n").collect()) == [(1, 1), (2, 2), (5, 1)]
    base = dt.datetime(2024, 1, 1)
    scans = spark.createDataFrame([(None, base, "A", 1), (None, base, "A", 2), (3, base, "A", 3)], "device long, ts timestamp_ntz, code string, scan_id long")
    assert sorted(x.scan_id for x in S.debounce_scans(scans).collect()) == [1, 3]
    msgs = spark.createDataFrame([(None, 0, "user", "revenue?"), (None, 1, "user", "yes")], "conv_id long, turn long, role string, text string")
    assert [x.is_business for x in M.is_business_query(msgs).collect()] == [True, True]
    heads = spark.createDataFrame([(None, 1, base)], "dataset_id long, request_id long, ts timestamp_ntz")
    ds = spark.createDataFrame([(1, 100)], "dataset_id long, last_order_number long")
    assert R.assign_order_ids(heads, ds).first().OrderID == "O101"


def test_debounce_of_one_run_over_many_pieces(spark):
    """One device, one code, scanned without a pause: one segment that spans all pieces."""
    base = dt.datetime(2024, 1, 1)
    data = [(1, base + dt.timedelta(milliseconds=400 * i), "A", i) for i in range(3000)]
    scans = spark.createDataFrame(data, "device long, ts timestamp_ntz, code string, scan_id long").repartition(5)
    assert sorted(x.scan_id for x in S.debounce_scans(scans).collect()) == list(range(0, 3000, 4))


def test_debounce_pieces_equal_one_walk():
    import random

    rnd = random.Random(1)
    for _ in range(500):
        rows = []
        for device in (None, 1, 2):
            us = 0
            for _ in range(rnd.randint(0, 25)):
                us += rnd.choice([0, 1, 2, 3, 9, 20])
                rows.append((device, rnd.choice("AAAB"), us))
        cuts = sorted(rnd.sample(range(len(rows) + 1), min(4, len(rows) + 1)))
        entry = None
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            piece, walked = S.summarise_piece(iter(rows[a:b]), 7), entry
            for device, code, us in rows[a:b]:
                if walked is None or walked[:2] != (device, code) or us - walked[2] > 7:
                    walked = (device, code, us)
            entry = S.exit_state(piece, entry, 7) if piece else entry
            assert entry == walked


def test_record_sales_batch(spark):
    ts = dt.datetime(2024, 3, 5, 14, 7, 9)
    headers = spark.createDataFrame([(1, 10, ts, " Cash "), (1, 11, ts, "Card"), (2, 12, ts, "  "), (1, 13, ts + dt.timedelta(1), "QR")],
                                    "dataset_id long, request_id long, ts timestamp_ntz, payment_type string")
    lines = spark.createDataFrame([(10, 1, " Tea ", 2, 3.5, "Drinks"), (10, 2, "Cake", 1, 2.0, "Food"), (11, 1, "Tea", 0, 3.5, "Drinks"),
                                   (12, 1, "Tea", 1, 1.0, "D"), (13, 1, "Milk", 1, 1.255, "D")],
                                  "request_id long, line int, item string, quantity int, price double, category string")
    v = {x.request_id: (x.is_valid, x.error) for x in R.validate_sales(headers, lines).collect()}
    assert v == {10: (True, None), 11: (False, "quantity"), 12: (False, "payment_type"), 13: (False, "price")}
    datasets = spark.createDataFrame([(1, 100)], "dataset_id long, last_order_number long")
    rows = R.record_sales(headers, lines, datasets).orderBy("line").collect()
    assert [(x.Date, x.Day, x.OrderID, x.Item, x.PaymentType) for x in rows] == [
        ("05/03/2024/14:07:09", "Tuesday", "O101", "Tea", "Cash"), ("05/03/2024/14:07:09", "Tuesday", "O101", "Cake", "Cash")]


def test_inventory_conflicts_and_upsert(spark):
    inv = spark.createDataFrame([(1, 7, "I1001", "Tea", "D", "111", 1.0, 2.0, dt.datetime(2024, 1, 1))],
                                "inventory_id long, dataset_id long, item_id string, item_name string, item_category string, "
                                "barcode_number string, cost_price double, selling_price double, created_at timestamp_ntz")
    cand = spark.createDataFrame([(1, 7, "I1001", " 222 "), (2, 7, "I1002", "111"), (3, 7, "I1003", "333"), (4, 7, "I1004", "333"), (5, 7, "I1005", "")],
                                 "candidate_id long, dataset_id long, item_id string, barcode_number string")
    got = {x.candidate_id: (x.id_exists, x.barcode_exists, x.taken_in_batch, x.accepted) for x in R.inventory_conflicts(cand, inv).collect()}
    assert got == {1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, False, True),
                   4: (False, False, True, False), 5: (False, False, False, True)}
    ds = spark.createDataFrame([(7, 1000)], "dataset_id long, last_inventory_item_number long")
    ids = {x.candidate_id: (x.expected_item_id, x.id_ok) for x in R.assign_item_ids(cand, ds).collect()}
    assert ids[1] == ("I1001", True) and ids[5] == ("I1005", True)
    odd = spark.createDataFrame([(1, 7, "I5"), (2, 7, "I1001"), (3, 7, " I1002 "), (4, 7, "I1002"), (5, None, "I1001")], "candidate_id long, dataset_id long, item_id string")
    ids = {x.candidate_id: (x.expected_item_id, x.id_ok) for x in R.assign_item_ids(odd, ds).where("dataset_id = 7").collect()}
    assert ids == {1: ("I1001", False), 2: ("I1001", True), 3: ("I1002", True), 4: ("I1003", False)}
    assert {x.dataset_id: x.last_inventory_item_number for x in R.next_item_numbers(odd, ds).collect()} == {7: 1002}
    # refused by its barcode, so its id is free for the next; the first of a batch wins
    chain = spark.createDataFrame([(1, 7, "I1", "a"), (2, 7, "I2", "a"), (3, 7, "I2", "b"), (4, 7, "I3", "b"), (5, 7, "I3", " ")], "candidate_id long, dataset_id long, item_id string, barcode_number string")
    assert {x.candidate_id for x in R.inventory_conflicts(chain, inv).collect() if x.accepted} == {1, 3, 5}
    new = spark.createDataFrame([(7, "I1009", "Jam", "D", "", 1.0, 2.0), (7, "I1001", "Tea 2", "D", "", 1.0, 2.0)], "dataset_id long, item_id string, item_name string, item_category string, barcode_number string, cost_price double, selling_price double")
    assert sorted((x.inventory_id, x.item_name) for x in R.upsert_inventory(inv, new, dt.datetime(2024, 2, 1)).collect()) == [(1, "Tea 2"), (2, "Jam")]

    upd = spark.createDataFrame([(1, 7, "111"), (9, 7, "111")], "inventory_id long, dataset_id long, barcode_number string")
    assert {x.inventory_id: x.conflict for x in R.barcode_update_conflicts(upd, inv).collect()} == {1: False, 9: True}


def test_names_taken_by_earlier_proposals(spark):
    ds = spark.createDataFrame([(1, 1, "Old")], "dataset_id long, user_id long, name string")
    pr = spark.createDataFrame([(1, 1, "Shop"), (2, 1, "shop "), (3, 2, "SHOP"), (4, 1, "old")], "proposal_id long, user_id long, name string")
    assert {x.proposal_id for x in R.dataset_name_conflicts(pr, ds).collect() if x.accepted} == {1, 3}


def test_recent_history_and_topic(spark):
    roles = ["user", "assistant", "system", "user", "assistant", "system", "user", "assistant", "user", "assistant"]
    msgs = spark.createDataFrame([(1, t, r, f"m{t}") for t, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    hist = M.recent_history(msgs).collect()
    assert len(hist) == 6 and min(x.turn for x in hist) == 3  # turns 2..9 kept, system turns 2 and 5 dropped
    # a business message, then 6 others, then 'yes' → too far back; with 5 others it counts
    def conv(cid, n_between):
        texts = ["how to grow revenue?"] + ["hello"] * n_between + ["yes"]
        return [(cid, t, "user", x) for t, x in enumerate(texts)]
    df = spark.createDataFrame(conv(1, 6) + conv(2, 5), "conv_id long, turn long, role string, text string")
    last = {x.conv_id: x.is_business for x in M.is_business_query(df).collect() if x.turn == (7 if x.conv_id == 1 else 6)}
    assert last == {1: False, 2: True}


def test_chat_payload(spark):
    import json

    msgs = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", " hello "), (1, 2, "system", "x"), (1, 3, "user", "sales?")],
                                 "conv_id long, turn long, role string, text string")
    p = json.loads(M.chat_payload(msgs, model="m").first().payload)
    assert p["model"] == "m" and p["max_tokens"] == 500 and p["temperature"] == 0.2
    assert [m["role"] for m in p["messages"]] == ["system", "user", "assistant", "user"]
    assert p["messages"][2]["content"] == "hello" and p["messages"][-1]["content"] == "sales?"
    later = msgs.unionByName(spark.createDataFrame([(1, 4, "assistant", "yes"), (2, 0, "assistant", "nobody asked")], msgs.schema))
    got = M.chat_payload(later, model="m").collect()  # the last user message, not the last message
    assert len(got) == 1 and json.loads(got[0].payload)["messages"] == p["messages"]


def _scan_rows(spark, events):
    base = dt.datetime(2024, 1, 1)
    data = [(1, base + dt.timedelta(seconds=s), c, i) for i, (c, s) in enumerate(events)]
    return spark.createDataFrame(data, "device long, ts timestamp_ntz, code string, scan_id long")


def test_debounce_fixture(spark):
    ev = [("A", 0), ("A", 1.0), ("A", 1.6), ("B", 1.7), ("A", 1.8), ("A", 3.3), ("A", 3.31), (" ", 3.4)]
    got = sorted((x.code, (x.ts - dt.datetime(2024, 1, 1)).total_seconds()) for x in S.debounce_scans(_scan_rows(spark, ev)).collect())
    assert got == sorted([("A", 0.0), ("A", 1.6), ("B", 1.7), ("A", 1.8), ("A", 3.31)])


def test_debounce_matches_python(spark):
    import random

    rnd = random.Random(7)
    ev, t = [], 0.0
    for _ in range(400):
        t += rnd.choice([0.2, 0.5, 1.0, 1.4, 1.6, 3.0])
        ev.append((rnd.choice("AAAB"), round(t, 3)))
    last_c, last_t, want = None, None, []
    for i, (c, s) in enumerate(ev):
        if last_c is None or c != last_c or (s - last_t) * 1000 > 1500:
            last_c, last_t = c, s
            want.append(i)
    got = sorted(x.scan_id for x in S.debounce_scans(_scan_rows(spark, ev)).collect())
    assert got == want
