"""Recording sales and keeping inventory, for a *batch* of requests.

Requests arrive one at a time in a web app; here a batch of them is one job:
validate (E3) → number orders per dataset (E2) → one sales row per item (E1)
→ append (S5). Inventory proposals are numbered (E4), checked against the
current inventory and each other (E5) and merged in (E6).

Every per-dataset step is an aggregate or a join on (dataset, key); numbering
uses :func:`salesops.plans.numbering.number_within`, so a dataset with a third
of all requests is still spread over many tasks. A batch is settled as if its
rows came one by one, in the order of their ids: what a row may do depends on
the rows accepted before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from salesops.constants import (
    DATE_TEXT_FORMAT_SPARK,
    FIRST_LAST_ITEM_NUMBER,
    FIRST_LAST_ORDER_NUMBER,
    INVENTORY_TIME_FORMAT,
    ITEM_PREFIX,
    MAX_BARCODE_LEN,
    MAX_CATEGORY_LEN,
    MAX_DATASET_NAME_LEN,
    MAX_ITEM_ID_LEN,
    MAX_ITEM_LEN,
    MAX_PAYMENT_LEN,
    ORDER_PREFIX,
    SALES_COLUMNS,
    WEEKDAY_FORMAT,
)
from salesops.functions.text import py_strip
from salesops.plans.numbering import number_within, running_max_within
from salesops.plans.settle import PIECE_ROWS, components, node, walk
from salesops.sources.files import written


def _text_ok(col: Column, max_len: int) -> Column:
    s = py_strip(col)
    return col.isNotNull() & (s != "") & (F.length(s) <= max_len)


def _money_ok(col: Column, kind: DataType | None = None) -> Column:
    """decimal(10,2) ≥ 0: at most 2 decimals and 8 integer digits."""
    if isinstance(kind, DecimalType) and kind.scale <= 2 and kind.precision - kind.scale <= 8:
        return col.isNotNull() & (col >= 0)  # the type holds no others: no text and wide decimal for each cell
    d = col.cast("string").try_cast("decimal(38,10)")
    return d.isNotNull() & (d >= 0) & (d == F.round(d, 2)) & (F.abs(d) < F.lit(10**8))


# --- E3 ---------------------------------------------------------------------------


def validate_sales(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per request: (request_id, is_valid, error).

    Rules: payment type trimmed, non-empty, ≤ 50 chars; at least one item;
    each item trimmed non-empty ≤ 120, category trimmed non-empty ≤ 80,
    quantity an integer ≥ 1, price a decimal(10,2) ≥ 0. ``error`` names the
    first failing rule in that order.
    """
    q = F.col("quantity")
    line_err = (
        F.when(~_text_ok(F.col("item"), MAX_ITEM_LEN), F.lit(2))
        .when(q.isNull() | (q.cast("double") != F.floor(q.cast("double"))) | (q < 1), F.lit(3))
        .when(~_money_ok(F.col("price"), lines.schema["price"].dataType), F.lit(4))
        .when(~_text_ok(F.col("category"), MAX_CATEGORY_LEN), F.lit(5))
    )
    per_req = lines.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.min(line_err).alias("line_err")
    )
    names = F.array(*[F.lit(x) for x in ["payment_type", "items", "item", "quantity", "price", "category"]])
    j = headers.select("request_id", "payment_type").join(per_req, "request_id", "left")
    err = (
        F.when(~_text_ok(F.col("payment_type"), MAX_PAYMENT_LEN), F.lit(0))
        .when(F.coalesce(F.col("n_items"), F.lit(0)) < 1, F.lit(1))
        .otherwise(F.col("line_err"))
    )
    j = j.withColumn("_err", err)
    return j.select(
        "request_id",
        F.col("_err").isNull().alias("is_valid"),
        F.when(F.col("_err").isNotNull(), F.element_at(names, F.col("_err") + 1)).alias("error"),
    )


# --- E2 ---------------------------------------------------------------------------


def assign_order_ids(headers: DataFrame, datasets: DataFrame) -> DataFrame:
    """Number requests per dataset by (ts, request_id) after the dataset's
    ``last_order_number``: adds ``order_number`` and ``OrderID`` = 'O<n>'."""
    last = datasets.select("dataset_id", F.col("last_order_number").alias("last"))
    numbered = number_within(headers, ["dataset_id"], ["ts", "request_id"], "order_number", after=last, start=FIRST_LAST_ORDER_NUMBER)
    return numbered.withColumn("OrderID", F.concat(F.lit(ORDER_PREFIX), F.col("order_number").cast("string")))


def next_order_numbers(headers: DataFrame, datasets: DataFrame) -> DataFrame:
    """The datasets' counters after a batch: last + number of requests."""
    n = headers.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    return datasets.join(n, "dataset_id", "left").select(
        "dataset_id", (F.col("last_order_number") + F.coalesce(F.col("_n"), F.lit(0))).cast("bigint").alias("last_order_number")
    )


# --- E1 ---------------------------------------------------------------------------


def _headed(headers: DataFrame) -> DataFrame:
    """``headers`` with what the rows of one request share: made once for a request, not for each of its items."""
    return headers.withColumns({
        "Date": F.date_format("ts", DATE_TEXT_FORMAT_SPARK),
        "Day": F.date_format("ts", WEEKDAY_FORMAT),
        "PaymentType": py_strip(F.col("payment_type")),
    })


def _sales_row(item: Column, qty: Column, price: Column, cat: Column) -> list:
    return [
        "Date",
        "Day",
        "OrderID",
        py_strip(item).alias("Item"),
        qty.cast("bigint").alias("Quantity"),
        price.cast("double").alias("Price"),
        py_strip(cat).alias("Category"),
        "PaymentType",
    ]


def explode_sales(requests: DataFrame) -> DataFrame:
    """E1 on nested requests: (…, ts, OrderID, payment_type, items[]) → one
    sales row per item, sharing date text, weekday, order id and payment."""
    x = _headed(requests).select("request_id", "Date", "Day", "OrderID", "PaymentType", F.posexplode("items").alias("line", "it"))
    return x.select("request_id", "line", *_sales_row(F.col("it.item"), F.col("it.quantity"), F.col("it.price"), F.col("it.category")))


def sale_rows(numbered_headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers (with OrderID) ⋈ lines on request_id. Lines are flat, or
    nested (request_id, items): those are joined whole and exploded afterwards."""
    if "items" in lines.columns:
        return explode_sales(numbered_headers.join(lines, "request_id"))
    j = _headed(numbered_headers).join(lines, "request_id")
    return j.select("request_id", "line", *_sales_row(F.col("item"), F.col("quantity"), F.col("price"), F.col("category")))


def record_sales(headers: DataFrame, lines: DataFrame, datasets: DataFrame) -> DataFrame:
    """E3 → E2 → E1: the sales rows a batch of valid requests appends."""
    ok = validate_sales(headers, lines).where("is_valid").select("request_id")
    valid = headers.join(ok, "request_id", "left_semi")
    numbered = assign_order_ids(valid, datasets)
    return sale_rows(numbered, lines).select("request_id", "line", *SALES_COLUMNS)


# --- E4 / E5 / E6 / E7 ---------------------------------------------------------------


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "batch")


def accepted_item_ids(candidates: DataFrame, datasets: DataFrame, order_col: str = "candidate_id") -> DataFrame:
    """E4's accepted proposals: (dataset_id, ``order_col``, number).

    A proposal is accepted when its number is the next after those accepted
    before it. So the accepted ones of a dataset have the numbers last + 1,
    last + 2, …, each the first proposal of its number after the one before:
    a path through "first later proposal of the next number", followed from
    its start by doubling (as many rounds as the path's length has bits).
    """
    text = py_strip(F.col("item_id"))
    digits = F.regexp_extract(text, f"^{ITEM_PREFIX}([0-9]+)$", 1).try_cast("bigint")
    last = datasets.select("dataset_id", "last_inventory_item_number")
    c = candidates.select("dataset_id", F.col(order_col).alias("_at"), text.alias("_text"), digits.alias("_n"))
    c = c.where(F.col("_text") == F.concat(F.lit(ITEM_PREFIX), F.col("_n").cast("string"))).join(last, "dataset_id", "left")
    c = c.withColumn("_last", F.coalesce("last_inventory_item_number", F.lit(FIRST_LAST_ITEM_NUMBER))).where(F.col("_n") > F.col("_last"))
    c = _kept(c.select("dataset_id", "_at", "_n", "_last"))
    # The first later proposal of the next number: both kinds of row side by side, per (dataset, number).
    asks = c.select("dataset_id", (F.col("_n") + 1).alias("_n"), "_at", F.lit(True).alias("_asks"))
    both = asks.unionByName(c.select("dataset_id", "_n", "_at", F.lit(False).alias("_asks")))
    later = Window.partitionBy("dataset_id", "_n").orderBy("_at", "_asks").rowsBetween(1, Window.unboundedFollowing)
    step = both.withColumn("_next", F.first(F.when(~F.col("_asks"), F.col("_at")), ignorenulls=True).over(later)).where("_asks and _next is not null")
    jump = _kept(step.select("dataset_id", "_at", "_next"))
    path = _kept(c.where(F.col("_n") == F.col("_last") + 1).groupBy("dataset_id").agg(F.min("_at").alias("_at")))
    size = path.count()
    while True:
        path = _kept(path.unionByName(path.join(jump, ["dataset_id", "_at"]).select("dataset_id", F.col("_next").alias("_at"))).distinct())
        grown = path.count()
        if grown == size:
            return path.join(c, ["dataset_id", "_at"]).select("dataset_id", F.col("_at").alias(order_col), F.col("_n").alias("number"))
        size = grown
        onward = jump.select("dataset_id", F.col("_at").alias("_next"), F.col("_next").alias("_then"))
        jump = _kept(jump.join(onward, ["dataset_id", "_next"]).select("dataset_id", "_at", F.col("_then").alias("_next")))


def assign_item_ids(candidates: DataFrame, datasets: DataFrame, order_col: str = "candidate_id") -> DataFrame:
    """Adds ``expected_item_id``, the id that was due when the proposal came
    (in ``order_col`` order), and ``id_ok``: it was the one proposed. The
    dataset's counter moves on with an accepted proposal only."""
    taken = accepted_item_ids(candidates, datasets, order_col)
    j = candidates.join(taken, ["dataset_id", order_col], "left")
    j = running_max_within(j, ["dataset_id"], [order_col], "number", "_upto")
    last = datasets.select("dataset_id", "last_inventory_item_number")
    j = j.join(last, "dataset_id", "left")
    due = F.coalesce("number", F.greatest("_upto", F.lit(0)) + 1)
    due = F.greatest(due, F.coalesce("last_inventory_item_number", F.lit(FIRST_LAST_ITEM_NUMBER)) + 1)
    j = j.withColumn("expected_item_id", F.concat(F.lit(ITEM_PREFIX), due.cast("string"))).withColumn("id_ok", F.col("number").isNotNull())
    return j.drop("number", "_upto", "last_inventory_item_number")


def next_item_numbers(candidates: DataFrame, datasets: DataFrame, order_col: str = "candidate_id") -> DataFrame:
    """The datasets' item counters after a batch: last + number of accepted proposals."""
    n = accepted_item_ids(candidates, datasets, order_col).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    return datasets.join(n, "dataset_id", "left").select(
        "dataset_id", (F.col("last_inventory_item_number") + F.coalesce(F.col("_n"), F.lit(0))).cast("bigint").alias("last_inventory_item_number")
    )


def _first_wins(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``candidate_id`` of the rows accepted one by one, by (dataset, id) and (dataset, non-blank barcode)."""
    coded = F.col("_bc") != ""
    keyed = written(rows.select("candidate_id", "dataset_id", "_id", "_bc").withColumns({"_x": node("id", "dataset_id", "_id"), "_y": F.when(coded, node("code", "dataset_id", "_bc"))}), "keyed")
    groups = components(keyed.where("_y is not null").select(F.col("_x").alias("x"), F.col("_y").alias("y")))
    keyed = keyed.join(groups.select(F.col("node").alias("_x"), "group"), "_x", "left").withColumn("group", F.coalesce("group", "_x")).drop("_x", "_y")

    def in_order(key, table):
        import pyarrow as pa

        ids, codes, won = set(), set(), []
        cols = [table.sort_by("candidate_id")[c].to_pylist() for c in ("candidate_id", "dataset_id", "_id", "_bc")]
        for candidate, dataset, item, code in zip(*cols, strict=True):
            if (dataset, item) not in ids and (not code or (dataset, code) not in codes):
                won.append((candidate, dataset, item, code))
                ids.add((dataset, item))
                codes.add((dataset, code))
        names = ["candidate_id", "dataset_id", "_id", "_bc"]
        return pa.table({n: pa.array([w[k] for w in won], table.schema.field(n).type) for k, n in enumerate(names)})

    kinds = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in ("candidate_id", "dataset_id", "_id", "_bc"))

    def step(piece: DataFrame, done: DataFrame | None) -> DataFrame:
        if done is not None:
            piece = piece.join(done.select("dataset_id", "_id"), ["dataset_id", "_id"], "left_anti")
            piece = piece.join(done.where(F.col("_bc") != "").select("dataset_id", "_bc"), ["dataset_id", "_bc"], "left_anti")
        return piece.groupBy("group").applyInArrow(in_order, kinds)

    return walk(keyed, ["candidate_id"], step, piece_rows).select("candidate_id")


def _stored_conflicts(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """Candidates with ``_id, _bc, id_exists, barcode_exists``, by the stored inventory alone."""
    ids = inventory.select("dataset_id", py_strip(F.col("item_id")).alias("_id")).distinct().withColumn("id_exists", F.lit(True))
    codes = (
        inventory.select("dataset_id", py_strip(F.col("barcode_number")).alias("_bc"))
        .where(F.col("_bc") != "").distinct().withColumn("barcode_exists", F.lit(True))
    )
    c = candidates.withColumn("_id", py_strip(F.col("item_id"))).withColumn("_bc", py_strip(F.coalesce(F.col("barcode_number"), F.lit(""))))
    c = c.join(ids, ["dataset_id", "_id"], "left").withColumn("id_exists", F.coalesce("id_exists", F.lit(False)))
    blank = F.col("_bc") == ""
    coded = c.where(~blank).join(codes, ["dataset_id", "_bc"], "left").withColumn("barcode_exists", F.coalesce("barcode_exists", F.lit(False)))
    return written(coded.unionByName(c.where(blank).withColumn("barcode_exists", F.lit(False))), "conflicts")


def inventory_conflicts(candidates: DataFrame, inventory: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """E5 (create): flags per candidate — its (dataset, item id) exists or its
    non-blank trimmed barcode exists in the dataset, or a candidate accepted
    before it has either; ``accepted`` when none holds."""
    c = _stored_conflicts(candidates, inventory)
    won = _first_wins(c.where("not id_exists and not barcode_exists"), piece_rows).withColumn("accepted", F.lit(True))
    j = c.join(won, "candidate_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return j.select(
        "candidate_id", "dataset_id", "item_id", "barcode_number", "id_exists", "barcode_exists",
        (~F.col("accepted") & ~F.col("id_exists") & ~F.col("barcode_exists")).alias("taken_in_batch"), "accepted",
    )


def create_inventory(candidates: DataFrame, inventory: DataFrame, datasets: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Creating items one by one: field rules, then E5, then E4 (the id due).

    A candidate is accepted when its fields are valid, neither its id nor its
    barcode is in the inventory or among those accepted before it, and its id
    is the next after the accepted ones. So a dataset's candidates are walked
    in order, in pieces of bounded size, with the id due and the barcodes taken
    so far. Returns (candidate_id, dataset_id, item_id, accepted).
    """
    free = _stored_conflicts(candidates, inventory).where("not id_exists and not barcode_exists").select("candidate_id")
    valid = validate_inventory_items(candidates).where("is_valid").join(free, "candidate_id", "left_semi")
    text = py_strip(F.col("item_id"))
    number = F.regexp_extract(text, f"^{ITEM_PREFIX}([0-9]+)$", 1).try_cast("bigint")
    last = datasets.select("dataset_id", F.col("last_inventory_item_number").alias("_last"))
    rows = valid.join(last, "dataset_id", "left").select(
        "candidate_id", "dataset_id", number.alias("_n"), py_strip(F.coalesce(F.col("barcode_number"), F.lit(""))).alias("_bc"),
        F.coalesce("_last", F.lit(FIRST_LAST_ITEM_NUMBER)).cast("bigint").alias("_last"), (text == F.concat(F.lit(ITEM_PREFIX), number.cast("string"))).alias("_plain"),
    )
    rows = rows.where("_plain and _n > _last").drop("_plain").withColumn("group", node("dataset", "dataset_id"))

    def in_order(key, table):
        import pyarrow as pa

        due, codes, won = {}, set(), []
        cols = [table.sort_by("candidate_id")[c].to_pylist() for c in ("candidate_id", "dataset_id", "_n", "_bc", "_last")]
        for candidate, dataset, n, code, before in zip(*cols, strict=True):
            if n == due.setdefault(dataset, before) + 1 and (not code or (dataset, code) not in codes):
                won.append((candidate, dataset, n, code))
                due[dataset] = n
                codes.add((dataset, code))
        names = ["candidate_id", "dataset_id", "_n", "_bc"]
        return pa.table({c: pa.array([w[k] for w in won], table.schema.field(c).type) for k, c in enumerate(names)})

    kinds = f"candidate_id {rows.schema['candidate_id'].dataType.simpleString()}, dataset_id {rows.schema['dataset_id'].dataType.simpleString()}, _n bigint, _bc string"

    def step(piece: DataFrame, done: DataFrame | None) -> DataFrame:
        if done is not None:
            upto = done.groupBy("dataset_id").agg(F.max("_n").alias("_upto"))
            piece = piece.join(upto, "dataset_id", "left").withColumn("_last", F.coalesce("_upto", "_last")).drop("_upto")
            piece = piece.join(done.where(F.col("_bc") != "").select("dataset_id", "_bc"), ["dataset_id", "_bc"], "left_anti")
        return piece.groupBy("group").applyInArrow(in_order, kinds)

    won = walk(rows, ["candidate_id"], step, piece_rows).select("candidate_id", F.lit(True).alias("accepted"))
    return candidates.join(won, "candidate_id", "left").select("candidate_id", "dataset_id", "item_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def apply_inventory_updates(updates: DataFrame, inventory: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """E5/E6 for a batch of updates, one by one in ``update_id`` order.

    ``updates``: (update_id, dataset_id, inventory_id, barcode_number). An
    update is accepted when its item is in the dataset and its trimmed barcode
    is blank or no *other* item holds it at that moment; an accepted update
    frees the item's old barcode for those after it. Returns (update_id,
    dataset_id, inventory_id, barcode_number, accepted, final_barcode), the last
    being the item's barcode after the whole batch (null: no such item).

    Items and barcodes that updates or present holdings connect are one group.
    A task gets a piece's updates, the present barcode of each of its items
    and, for each barcode it wants, how many other items hold it.
    """
    held = inventory.groupBy("dataset_id", "inventory_id").agg(F.min(py_strip(F.coalesce(F.col("barcode_number"), F.lit("")))).alias("code"))  # an item is one row
    held = written(held, "holdings")
    wanted = updates.select("update_id", "dataset_id", "inventory_id", py_strip(F.coalesce(F.col("barcode_number"), F.lit(""))).alias("code"))
    wanted = written(wanted.join(held, ["dataset_id", "inventory_id"], "left_semi"), "updates")
    item, code = node("item", "dataset_id", "inventory_id"), F.when(F.col("code") != "", node("code", "dataset_id", "code"))
    codes, items = wanted.where("code <> ''").select("dataset_id", "code").distinct(), wanted.select("dataset_id", "inventory_id").distinct()
    links = wanted.select(item.alias("x"), code.alias("y")).where("y is not null")
    present = held.join(items, ["dataset_id", "inventory_id"], "left_semi").join(codes, ["dataset_id", "code"], "left_semi").select(item.alias("x"), code.alias("y"))
    groups = written(components(links.unionByName(present)), "groups")
    of = lambda df, key: df.withColumn("_x", key).join(groups.withColumnRenamed("node", "_x"), "_x", "left").withColumn("group", F.coalesce("group", "_x")).drop("_x")
    dataset, inv, upd = (updates.schema[c].dataType.simpleString() for c in ("dataset_id", "inventory_id", "update_id"))

    def in_order(key, table):
        import pyarrow as pa

        kind, *cols = (table.sort_by([("kind", "ascending"), ("update_id", "ascending")])[c].to_pylist() for c in ("kind", "update_id", "dataset_id", "inventory_id", "code", "n"))
        now, holders, out = {}, {}, []
        for k, update, d, i, c, n in zip(kind, *cols, strict=True):
            if k == 0:  # an item's present barcode
                now[d, i] = c
                holders[d, c] = holders.get((d, c), 0) + 1
            elif k == 1:  # other items that hold a barcode and stay as they are
                holders[d, c] = holders.get((d, c), 0) + n
            else:
                own = now[d, i]
                ok = not c or holders.get((d, c), 0) == (own == c)
                if ok and own != c:
                    holders[d, own] -= 1
                    holders[d, c] = holders.get((d, c), 0) + 1
                    now[d, i] = c
                out.append((update, d, i, c, ok))
        names = ["update_id", "dataset_id", "inventory_id", "code"]
        cols = {c: pa.array([o[k] for o in out], table.schema.field(c).type) for k, c in enumerate(names)}
        return pa.table({**cols, "ok": pa.array([o[4] for o in out], pa.bool_())})

    def current(done: DataFrame | None) -> DataFrame:
        if done is None:
            return held
        last = done.where("ok").groupBy("dataset_id", "inventory_id").agg(F.max_by("code", "update_id").alias("_new"))
        return held.join(last, ["dataset_id", "inventory_id"], "left").withColumn("code", F.coalesce("_new", "code")).drop("_new")

    def step(piece: DataFrame, done: DataFrame | None) -> DataFrame:
        state, mine, asked = current(done), piece.select("dataset_id", "inventory_id").distinct(), piece.where("code <> ''").select("dataset_id", "code").distinct()
        none = F.lit(None)
        own = of(state.join(mine, ["dataset_id", "inventory_id"], "left_semi"), item).select("group", F.lit(0).alias("kind"), none.cast(upd).alias("update_id"), "dataset_id", "inventory_id", "code", F.lit(1).cast("bigint").alias("n"))
        others = state.join(mine, ["dataset_id", "inventory_id"], "left_anti").join(asked, ["dataset_id", "code"], "left_semi").groupBy("dataset_id", "code").agg(F.count(F.lit(1)).alias("n"))
        others = of(others, code).select("group", F.lit(1).alias("kind"), none.cast(upd).alias("update_id"), "dataset_id", none.cast(inv).alias("inventory_id"), "code", "n")
        ask = piece.select("group", F.lit(2).alias("kind"), "update_id", "dataset_id", "inventory_id", "code", none.cast("bigint").alias("n"))
        whole = ask.unionByName(own).unionByName(others)
        return whole.groupBy("group").applyInArrow(in_order, f"update_id {upd}, dataset_id {dataset}, inventory_id {inv}, code string, ok boolean")

    done = walk(of(wanted, item), ["update_id"], step, piece_rows)
    after = current(done).withColumnRenamed("code", "final_barcode")
    out = updates.select("update_id", "dataset_id", "inventory_id", "barcode_number").join(done.select("update_id", "ok"), "update_id", "left").join(after, ["dataset_id", "inventory_id"], "left")
    return out.select("update_id", "dataset_id", "inventory_id", "barcode_number", F.coalesce("ok", F.lit(False)).alias("accepted"), "final_barcode")


def barcode_update_conflicts(updates: DataFrame, inventory: DataFrame) -> DataFrame:
    """E5 (update): a new non-blank barcode conflicts when another row of the
    same dataset (not the row itself) already has it."""
    per_code = (
        inventory.select("dataset_id", "inventory_id", py_strip(F.col("barcode_number")).alias("_bc"))
        .where(F.col("_bc") != "").groupBy("dataset_id", "_bc")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("inventory_id").alias("_one"))
    )
    u = updates.withColumn("_bc", py_strip(F.coalesce(F.col("barcode_number"), F.lit(""))))
    j = u.join(per_code, ["dataset_id", "_bc"], "left")
    conflict = (F.col("_bc") != "") & ((F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col("_one") != F.col("inventory_id"))))
    return j.select("inventory_id", "dataset_id", "barcode_number", F.coalesce(conflict, F.lit(False)).alias("conflict"))


INVENTORY_FIELDS = ["item_name", "item_category", "barcode_number", "cost_price", "selling_price"]


def last_changes(changes: DataFrame, order_col: str) -> DataFrame:
    """The last change of each (dataset, item id), as if they came one by one."""
    whole = changes.groupBy("dataset_id", "item_id").agg(F.max(F.struct(order_col, *INVENTORY_FIELDS)).alias("_c"))
    return whole.select("dataset_id", "item_id", *[F.col(f"_c.{f}").alias(f) for f in INVENTORY_FIELDS])


def upsert_inventory(inventory: DataFrame, changes: DataFrame, now, order_col: str | None = None) -> DataFrame:
    """Rows of ``changes`` whose (dataset, item id) exists update only the
    five editable fields; the others are inserted with ``created_at = now`` and
    ids after the largest, in (dataset, item id) order. Of several changes of
    one item the last by ``order_col`` counts; without that column (or where it
    ties) the largest by their fields does, so an item is always one row.

    Returns the new inventory; write it to a new folder (Spark cannot
    overwrite a path it is reading).
    """
    old = inventory.alias("o")
    if order_col is None:
        order_col, changes = "_same", changes.withColumn("_same", F.lit(0))
    new = last_changes(changes, order_col).select("dataset_id", "item_id", *[F.col(c).alias(f"new_{c}") for c in INVENTORY_FIELDS]).alias("n")
    j = old.join(new, ["dataset_id", "item_id"], "full_outer")
    cols = [
        F.col("inventory_id"),
        F.col("dataset_id"),
        F.col("item_id"),
        *[
            (F.when(F.col("new_item_name").isNotNull(), py_strip(F.col(f"new_{c}"))).otherwise(F.col(c)) if c in ("item_name", "item_category", "barcode_number")
             else F.coalesce(F.col(f"new_{c}"), F.col(c))).alias(c)
            for c in INVENTORY_FIELDS
        ],
        F.coalesce(F.col("created_at"), F.lit(now).cast("timestamp_ntz")).alias("created_at"),
    ]
    whole = j.select(*cols)
    old_rows = whole.where(F.col("inventory_id").isNotNull())
    added = number_within(whole.where(F.col("inventory_id").isNull()), [], ["dataset_id", "item_id"], "_k")
    top = inventory.agg(F.coalesce(F.max("inventory_id"), F.lit(0))).scalar()
    return old_rows.unionByName(added.withColumn("inventory_id", (top + F.col("_k")).cast("bigint")).drop("_k"))


def inventory_list(inventory: DataFrame, datasets: DataFrame) -> DataFrame:
    """Each dataset's items newest first, ``created_at`` as dd/MM/yyyy HH:mm."""
    j = inventory.join(datasets.select("dataset_id"), "dataset_id")
    return j.select(
        "dataset_id", "inventory_id", "item_id", "item_name", "item_category", "barcode_number",
        "cost_price", "selling_price",
        F.date_format("created_at", INVENTORY_TIME_FORMAT).alias("created_at"),
        F.col("created_at").alias("_ts"),
    ).orderBy("dataset_id", F.desc("_ts"), F.desc("inventory_id")).drop("_ts")


def validate_inventory_items(items: DataFrame) -> DataFrame:
    """Field rules of an inventory form: id ≤ 20, name ≤ 120, category ≤ 80
    (all trimmed, non-empty), barcode ≤ 80 (may be blank), prices decimal(10,2) ≥ 0."""
    ok = (
        _text_ok(F.col("item_id"), MAX_ITEM_ID_LEN)
        & _text_ok(F.col("item_name"), MAX_ITEM_LEN)
        & _text_ok(F.col("item_category"), MAX_CATEGORY_LEN)
        & (F.length(py_strip(F.coalesce(F.col("barcode_number"), F.lit("")))) <= MAX_BARCODE_LEN)
        & _money_ok(F.col("cost_price"))
        & _money_ok(F.col("selling_price"))
    )
    return items.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


# --- E8 ---------------------------------------------------------------------------


def dataset_name_conflicts(proposals: DataFrame, datasets: DataFrame) -> DataFrame:
    """A proposed (user_id, name) is accepted when the trimmed name is
    non-empty, ≤ 120 chars, and no dataset of that user has it ignoring case,
    nor any accepted proposal with a smaller id."""
    existing = datasets.select("user_id", F.lower(py_strip(F.col("name"))).alias("_k")).distinct().withColumn("_taken", F.lit(True))
    p = proposals.withColumn("clean_name", py_strip(F.col("name"))).withColumn("_k", F.lower(F.col("clean_name")))
    j = p.join(existing, ["user_id", "_k"], "left")
    error = (
        F.when(F.col("clean_name") == "", F.lit("Dataset name is required."))
        .when(F.length(F.col("clean_name")) > MAX_DATASET_NAME_LEN, F.lit("Ensure this field has no more than 120 characters."))
        .when(F.coalesce(F.col("_taken"), F.lit(False)), F.lit("A dataset with this name already exists."))
    )
    first = j.where(error.isNull()).groupBy("user_id", "_k").agg(F.min("proposal_id").alias("_first"))
    j = j.withColumn("_error", error).join(first, ["user_id", "_k"], "left")
    error = F.when(F.col("_error").isNull() & (F.col("proposal_id") != F.col("_first")), F.lit("A dataset with this name already exists.")).otherwise(F.col("_error"))
    return j.select("proposal_id", "user_id", "clean_name", error.isNull().alias("accepted"), error.alias("error"))
