"""Mixing sources to target weights, by hierarchical budgeting.

A token budget runs down a domain - language - source tree. Among siblings it
is shared by weight; a child that cannot use its share (its tokens times
``max_epochs``) is held at what it has, and the shortage goes to its siblings.
Only what a whole subtree cannot use goes to the subtree's own siblings,
because a subtree's capacity caps its share one level up.

A leaf's budget is spent in seeded epochs: whole passes over its documents,
then a prefix, in the order of a hash of (seed, epoch, id), whose running
tokens stay within what is left.

Native: DataFrame operations only. The prefix needs no sort of a leaf: tokens
are summed per leaf and hash bucket, running sums over buckets show the one
bucket where the budget ends, and only that bucket's rows are ordered. The
document rows themselves are never shuffled, except those of that bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import stored

LEVELS = ("domain", "lang", "source")
SEED = 20
MAX_EPOCHS = 4
# Share of all tokens that the mixture holds.
BUDGET_PERCENT = 90
BUCKET_HEX = 4  # leading hex digits of the hash: 65,536 buckets for each leaf
WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Words of the whole text; the tokens that budgets count."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``got``: each node's part of its parent's ``budget``.

    ``nodes`` has ``capacity``, ``weight`` and ``budget`` (the parent's).
    Siblings in the order of capacity by weight: those that the rest of the
    budget would fill are held at their capacity, the others share what is
    left by weight, rounded down. Integers throughout.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(name)]
    upto = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(*parent)
    big = lambda c: c.cast(BIG)
    full = big(F.col("capacity")) * big(F.col("rest_weight")) <= big(F.col("budget") - F.col("before")) * big(F.col("weight"))
    held = nodes.withColumn("before", F.coalesce(F.sum("capacity").over(upto), F.lit(0))).withColumn("rest_weight", F.sum("weight").over(on)).withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(every), F.lit(0))
    weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    summed = held.withColumn("left", left).withColumn("open_weight", weights)
    part = F.floor(big(F.col("left")) * big(F.col("weight")) / big(F.col("open_weight")))
    # Division of decimals may round the last digit up; step back where it did.
    exact = part - F.when(big(part) * big(F.col("open_weight")) > big(F.col("left")) * big(F.col("weight")), 1).otherwise(0)
    return summed.withColumn("got", F.when(F.col("full"), F.col("capacity")).otherwise(exact.cast("long"))).drop("before", "rest_weight", "full", "left", "open_weight")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, Column], max_epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves`` (levels, ``tokens``) plus ``leaf_budget``; weights are positive integers by level."""
    base = leaves.withColumn("capacity_leaf", F.col("tokens") * max_epochs).withColumn("root", F.lit(0))
    given, above = base.select("root").distinct().withColumn("budget", budget.cast("long")), ["root"]
    for i, level in enumerate(levels):
        path = list(levels[: i + 1])
        nodes = base.groupBy("root", *path).agg(F.sum("capacity_leaf").alias("capacity")).withColumn("weight", weights[level].cast("long"))
        shared = share_out(nodes.join(given, above), above, level)
        given, above = shared.select("root", *path, F.col("got").alias("budget")), ["root", *path]
    return base.join(given, above).select(*leaves.columns, F.col("budget").alias("leaf_budget"))


def default_levels() -> dict[str, Column]:
    """Tree of the documents table: domain by source number, then lang, then source."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    number = F.regexp_extract(source, r"(\d+)$", 1)
    domain = F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.substring(number, -1, 1).cast("int") % 4).cast("string")))
    return {"domain": domain, "lang": F.coalesce(F.col("lang"), F.lit("unknown")), "source": source}


def default_weights() -> dict[str, Column]:
    """The mixture's weights at each level."""
    return {
        "domain": F.when(F.col("domain") == "domain0", 4).when(F.col("domain") == "domain1", 3).when(F.col("domain") == "domain2", 2).otherwise(1),
        "lang": F.when(F.col("lang") == "en", 5).when(F.col("lang").isin("de", "fr", "es"), 2).otherwise(1),
        "source": F.lit(1),
    }


def mix_to_weights(docs: DataFrame, *, levels: dict[str, Column] | None = None, weights: dict[str, Column] | None = None, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", mix_col: str = "mix") -> DataFrame:
    """The chosen documents, one row for each epoch they are in.

    All columns of ``docs`` and a struct ``mix_col`` (``domain, lang, source,
    n_tokens, leaf_tokens, leaf_budget, epoch``). The budget is
    ``budget_percent`` of all tokens.

    Defined cases: a null language or source is the leaf ``unknown``; a null
    or empty text has no tokens and is in the prefix if its turn comes within
    it; rows with equal ids (null ids are equal) share one place in the order
    and stand or fall together, repeated rows count as often as they stand
    there; a leaf without tokens is given none and none of its rows; an empty
    table gives an empty result. Columns of ``docs`` named like the levels do
    no harm, as those are kept in one struct; one named ``mix_col`` is replaced.
    """
    levels, weights = levels or default_levels(), weights or default_weights()
    names = [n for n in docs.columns if n != mix_col]
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    tree = F.struct(*[levels[n].alias(n) for n in LEVELS])
    slim = docs.select(tree.alias("leaf"), word_count(F.col(text_col)).alias("n"))
    leaves = slim.groupBy("leaf").agg(F.sum("n").alias("tokens")).select(*[F.col(f"leaf.{n}").alias(n) for n in LEVELS], "tokens")
    leaves = stored(leaves, "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = F.lit(int(total) * budget_percent // 100)
    plan = leaf_budgets(leaves, budget, weights, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("tokens"))
    # One row per leaf, written: a join reads its true size and broadcasts it only if small.
    plan = stored(plan.select(F.struct(*LEVELS).alias("leaf"), F.col("tokens").alias("leaf_tokens"), "leaf_budget", "epochs", "rest"), "mix-plan")

    def keyed(columns: list) -> DataFrame:
        rows = docs.select(*columns, tree.alias("leaf"), word_count(F.col(text_col)).alias("n"), ident.alias("ident")).join(plan, "leaf")
        turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("ident")).cast("binary"))
        return rows.withColumn("turn", turn).withColumn("bucket", F.conv(F.substring("turn", 1, BUCKET_HEX), 16, 10).cast("int"))

    running = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed([]).groupBy("leaf", "bucket").agg(F.sum("n").alias("in_bucket"), F.first("rest").alias("rest"))
    ends = buckets.withColumn("upto", F.coalesce(F.sum("in_bucket").over(running), F.lit(0))).where((F.col("upto") <= F.col("rest")) & (F.col("upto") + F.col("in_bucket") > F.col("rest")))
    ends = stored(ends.select("leaf", F.col("bucket").alias("end_bucket"), "upto"), "mix-ends")  # at most one row per leaf

    kept = F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc")
    rows = keyed([kept]).join(ends, "leaf", "left")
    mix = lambda epoch: F.struct("leaf.*", F.col("n").alias("n_tokens"), "leaf_tokens", "leaf_budget", epoch.cast("int").alias("epoch")).alias(mix_col)
    passes = F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("bucket") < F.col("end_bucket")), 1).otherwise(0)
    full = rows.where(passes > 0).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1))).select("doc.*", mix(F.col("at")))
    place = Window.partitionBy("leaf", "bucket").orderBy("turn", "ident").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.where((F.col("bucket") == F.col("end_bucket")) & (F.col("rest") > 0)).withColumn("used", F.col("upto") + F.sum("n").over(place)).where(F.col("used") <= F.col("rest"))
    return full.unionByName(last.select("doc.*", mix(F.col("epochs"))))
