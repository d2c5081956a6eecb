"""The test tables mapped onto the sales data model.

The driver ships TPC-H-like Parquet tables; these functions expose them with
the shapes the operators expect (see FIXTURES.md §2). All are lazy
DataFrames: Catalyst prunes every column a query does not use, and a date
range filter on ``Date`` is pushed through the joins into the ``orders`` scan.

Joins are left to the optimizer: ``part`` and ``orders`` are joined without
hints, so AQE broadcasts them only when their *measured* size is below
``spark.sql.autoBroadcastJoinThreshold`` and falls back to a shuffle join on
the keys otherwise (part and orders both grow with the data).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.constants import DATE_TEXT_FORMAT_SPARK, WEEKDAY_FORMAT

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read from ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean ``sales`` table: one row per order line."""
    j = _lines(spark, sf_dir)
    return j.select(
        F.col("o_orderdate").alias("Date"),
        F.date_format("o_orderdate", WEEKDAY_FORMAT).alias("Day"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("OrderID"),
        F.col("p_name").alias("Item"),
        F.col("l_quantity").alias("Quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("Price"),
        F.col("p_type").alias("Category"),
        F.col("o_orderpriority").alias("PaymentType"),
    )


def sales_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sales with a time of day (for the day-wise pattern)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").alias("Date"),
        F.date_format("ts", WEEKDAY_FORMAT).alias("Day"),
        F.concat(F.lit("O"), F.col("user_id").cast("string")).alias("OrderID"),
        F.col("event_type").alias("Item"),
        F.lit(1.0).alias("Quantity"),
        F.col("value").cast("decimal(18,2)").alias("Price"),
        F.col("event_type").alias("Category"),
        F.col("event_type").alias("PaymentType"),
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales`` as text with deterministic dirt (FIXTURES.md §2).

    All rows are kept; the rules only change cell values:
    line 7 → PaymentType '  '; partkey multiple of 11 → Category null, of 13 →
    ' nan '; suppkey multiple of 17 → Date with a leading blank, of 19 →
    '31/02/1997/00:00:00'; partkey multiple of 23 → Price 'n/a'; orderkey
    multiple of 29 → OrderID null. ``row_number`` orders rows like a sheet.
    """
    j = _lines(spark, sf_dir)
    date_text = F.date_format("o_orderdate", DATE_TEXT_FORMAT_SPARK)
    return j.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("bigint").alias("row_number"),
        F.when(F.col("l_suppkey") % 17 == 0, F.concat(F.lit(" "), date_text))
        .when(F.col("l_suppkey") % 19 == 0, F.lit("31/02/1997/00:00:00"))
        .otherwise(date_text)
        .alias("Date"),
        F.date_format("o_orderdate", WEEKDAY_FORMAT).alias("Day"),
        F.when(F.col("l_orderkey") % 29 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")))
        .alias("OrderID"),
        F.col("p_name").alias("Item"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("Quantity"),
        F.when(F.col("l_partkey") % 23 == 0, F.lit("n/a"))
        .otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
        .alias("Price"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("l_partkey") % 13 == 0, F.lit(" nan "))
        .otherwise(F.col("p_type"))
        .alias("Category"),
        F.when(F.col("l_linenumber") == 7, F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("PaymentType"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: ``conversations`` as (conv_id, turn, role, text)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode scans: ``events`` as (device, ts, code, scan_id)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"),
        F.col("ts"),
        F.col("event_type").alias("code"),
        F.col("event_id").alias("scan_id"),
    )


def sale_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sale request per order: (dataset_id, request_id, ts, payment_type).

    A customer stands for a shop's dataset.
    """
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("payment_type"),
    )


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each sale request, flat: (request_id, line, item, quantity, price, category)."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("line"),
        F.col("p_name").alias("item"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        F.col("p_type").alias("category"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset catalog: one dataset per customer (shop), owned by its nation.

    ``last_order_number`` / ``last_inventory_item_number`` start at the
    defaults (100 / 1000); ``created_at`` is spread by key so "newest first"
    has a total order.
    """
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("dataset_id"),
        F.col("c_nationkey").cast("bigint").alias("user_id"),
        F.col("c_name").alias("name"),
        F.lit(100).cast("bigint").alias("last_order_number"),
        F.lit(1000).cast("bigint").alias("last_inventory_item_number"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 60).cast("timestamp_ntz").alias("created_at"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current inventory: ``part`` as items of the dataset ``p_partkey % 100``.

    item ids ``I<1001 + partkey>``; barcode taken from ``p_brand`` so that
    duplicates exist; selling price = retail price, cost = 70 % of it.
    """
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("inventory_id"),
        (F.col("p_partkey") % 100).alias("dataset_id"),
        F.concat(F.lit("I"), (F.lit(1001) + F.col("p_partkey")).cast("string")).alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("item_category"),
        F.col("p_brand").alias("barcode_number"),
        (F.col("p_retailprice") * 0.7).cast("decimal(10,2)").alias("cost_price"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("selling_price"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 97).cast("timestamp_ntz").alias("created_at"),
    )


def inventory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed inventory rows: one per order (``candidate_id`` = order key,
    unique, and the order of proposals).

    Each targets the dataset ``custkey % 100``; proposed item ids and barcodes
    (in the ``Brand#MN`` form of the current inventory, blank for every third
    order) are built so that some collide with the inventory and with each
    other.
    """
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("candidate_id"),
        (F.col("o_custkey") % 100).alias("dataset_id"),
        F.concat(F.lit("I"), (F.lit(1001) + (F.col("o_custkey") * 7) % 3000).cast("string")).alias("item_id"),
        F.concat(F.lit("Item "), F.col("o_orderkey").cast("string")).alias("item_name"),
        F.col("o_orderpriority").alias("item_category"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("Brand#"), (F.lit(1) + F.col("o_custkey") % 5).cast("string"),
                            (F.lit(1) + F.col("o_orderkey") % 5).cast("string")))
        .alias("barcode_number"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("cost_price"),
        (F.col("o_totalprice") * 1.2).cast("decimal(10,2)").alias("selling_price"),
    )


def sale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sale requests, one per order: header fields, ``OrderID`` and
    ``items`` (array of item/quantity/price/category in line order).

    A request holds one order's lines (a handful), so the per-order
    ``collect_list`` is bounded by the order size.
    """
    h = sale_headers(spark, sf_dir)
    lines = sale_lines(spark, sf_dir)
    items = lines.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("line", "item", "quantity", "price", "category"))).alias("_items")
    )
    j = h.join(items, "request_id", "left")  # a request without items arrives too (E3 refuses it)
    return j.select(
        "dataset_id", "request_id", "ts", "payment_type",
        F.concat(F.lit("O"), F.col("request_id").cast("string")).alias("OrderID"),
        F.transform("_items", lambda x: F.struct(x.item.alias("item"), x.quantity.alias("quantity"),
                                                 x.price.alias("price"), x.category.alias("category"))).alias("items"),
    )
