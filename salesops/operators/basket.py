"""Items bought together.

Pairs are unordered pairs of *distinct* items in one order, counted over
orders; the chart shows the top 20 as "a + b" and the total number of pair
occurrences over all orders.

Plan, the same for every input:

* ``distinct(OrderID, Item)`` first — repeated items in an order count once,
  and the year filter is applied before it (pushed into the scan). These rows
  are read several times below, so they are written once below the shared folder;
* the total is Σ n(n-1)/2 over per-order distinct item counts: an aggregate,
  no pairs are formed for it;
* a pair's count is at most the support (number of orders) of either item. The
  pairs of the best-supported items are counted first; their ``limit``-th
  best count T bounds the result from below, so only items with a support of
  at least T are paired. Exact, ties at T included;
* an order's items are cut into blocks and joined on (OrderID, block a,
  block b), so a large order is spread over many tasks, each with a bounded
  number of pairs; every unordered pair meets in exactly one cell. Join rows
  are folded at once into a map-side partial aggregate (count, first order);
* ties keep the order in which pairs are first met when orders are visited in
  OrderID text order: count desc, then the smallest OrderID holding the
  pair, then the pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.constants import PAIR_SEPARATOR, TOP_PAIRS
from salesops.operators.clean import by_year, clean_for
from salesops.sources.files import written


def order_items(df: DataFrame, year) -> DataFrame:
    """Distinct (OrderID, Item) of one year, after the basket chart's cleaning."""
    c = by_year(clean_for(df, "market_basket", keep=("year", "month")), year)
    return c.select("OrderID", "Item").distinct()


def pair_counts(df: DataFrame, year) -> DataFrame:
    """Every co-occurring pair: (item_a, item_b, count, first_order), item_a < item_b."""
    return _pairs(_blocked(order_items(df, year)))


# Items of one order that one block holds, and the items whose pairs give the
# first bound. Neither changes a result.
BLOCK_ITEMS = 256
BOUND_ITEMS = 200


def _order():
    return [F.desc("count"), F.asc("first_order"), F.asc("item_a"), F.asc("item_b")]


def _blocked(d: DataFrame) -> DataFrame:
    """Distinct (OrderID, Item) rows with the order's number of blocks and the item's own."""
    sizes = d.groupBy("OrderID").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ITEMS)).cast("int").alias("blocks"))
    return d.join(sizes, "OrderID").withColumn("own", F.pmod(F.xxhash64("Item"), F.col("blocks")).cast("int"))


def _pairs(x: DataFrame) -> DataFrame:
    """Pairs of ``_blocked`` rows with their count and first order."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = x.select("OrderID", F.col("Item").alias("item_a"), F.col("own").alias("block_a"), every.alias("block_b"))
    b = x.select("OrderID", F.col("Item").alias("item_b"), F.col("own").alias("block_b"), every.alias("block_a"))
    pairs = a.join(b, ["OrderID", "block_a", "block_b"]).where(F.col("item_a") < F.col("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"), F.min("OrderID").alias("first_order")
    )


def _top_pairs(d: DataFrame, limit: int) -> DataFrame:
    x = written(_blocked(d), "order-items")
    support = x.groupBy("Item").agg(F.count(F.lit(1)).alias("support"))
    best = support.orderBy(F.desc("support"), "Item").limit(BOUND_ITEMS).select("Item")
    bound = _pairs(x.join(F.broadcast(best), "Item", "left_semi")).orderBy(F.desc("count")).limit(limit)  # best: at most BOUND_ITEMS rows
    floor = bound.agg(F.when(F.count(F.lit(1)) == limit, F.min("count")).otherwise(F.lit(1))).scalar()
    frequent = support.where(F.col("support") >= floor).select("Item")
    return _pairs(x.join(frequent, "Item", "left_semi")).orderBy(*_order()).limit(limit)


def market_basket(df: DataFrame, year, limit: int = TOP_PAIRS) -> DataFrame:
    """The top ``limit`` pairs: (rank, label, count)."""
    order = _order()
    top = _top_pairs(order_items(df, year), limit)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),  # ≤ limit rows
        F.concat(F.col("item_a"), F.lit(PAIR_SEPARATOR), F.col("item_b")).alias("label"),
        "count",
    ).orderBy("rank")


def market_basket_total(df: DataFrame, year) -> DataFrame:
    """Total pair occurrences over all orders: Σ n(n-1)/2."""
    n = order_items(df, year).groupBy("OrderID").agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("total_pair_occurrences")
    )
