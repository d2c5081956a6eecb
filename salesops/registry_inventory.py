"""Queries over inventory that changes batch by batch: updates one by one (E5/E6) and stored versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from salesops import oracle as O
from salesops.operators import records
from salesops.registry import _CAND, _INV, register
from salesops.sources import files as FS
from salesops.sources import tables as T
from salesops.sources import versions as V

# One update per order: an item of the dataset (a fifth of them unknown) gets a
# barcode in the form of the stored ones, every seventh a blank one.
_UPD = """upd AS (SELECT o_orderkey AS update_id, o_custkey % 100 AS dataset_id, o_custkey % 100 + 100 * (o_orderkey % 25) AS inventory_id,
    CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE ' Brand#' || CAST(1 + o_orderkey % 9 AS VARCHAR) || CAST(1 + (o_orderkey // 9) % 9 AS VARCHAR) END AS barcode_number FROM orders)"""


def _updates(spark, d):
    o = T.table(spark, d, "orders")
    code = F.concat(F.lit(" Brand#"), (1 + F.col("o_orderkey") % 9).cast("string"), (1 + F.expr("o_orderkey div 9") % 9).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("update_id"), (F.col("o_custkey") % 100).alias("dataset_id"),
        (F.col("o_custkey") % 100 + 100 * (F.col("o_orderkey") % 25)).alias("inventory_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(" ")).otherwise(code).alias("barcode_number"),
    )


register(
    "apply_inventory_updates",
    "WITH RECURSIVE "
    + ",\n".join([
        _UPD,
        _INV,
        f"""h AS (SELECT dataset_id, map_from_entries(list({{'k': inventory_id, 'v': {O.strip("coalesce(barcode_number, '')")}}})) AS m FROM inv GROUP BY 1)""",
        f"s AS (SELECT *, {O.strip('barcode_number')} AS code, row_number() OVER (PARTITION BY dataset_id ORDER BY update_id) AS pos FROM upd)",
        """r AS (SELECT dataset_id, CAST(0 AS BIGINT) AS pos, m, false AS ok FROM h
              UNION ALL
              SELECT dataset_id, pos, CASE WHEN ok THEN map_concat(m, MAP([inventory_id], [code])) ELSE m END, ok
              FROM (SELECT s.dataset_id, s.pos, s.inventory_id, s.code, r.m,
                           list_contains(map_keys(r.m), s.inventory_id) AND (s.code = '' OR len(list_filter(map_entries(r.m), lambda e: e.key <> s.inventory_id AND e.value = s.code)) = 0) AS ok
                    FROM r JOIN s ON s.dataset_id = r.dataset_id AND s.pos = r.pos + 1) x)""",
        "l AS (SELECT dataset_id, arg_max(m, pos) AS m FROM r GROUP BY 1)",
    ])
    + """ SELECT s.update_id, s.dataset_id, s.inventory_id, s.barcode_number, coalesce(r.ok, false) AS accepted, l.m[s.inventory_id] AS final_barcode
       FROM s LEFT JOIN r ON r.dataset_id = s.dataset_id AND r.pos = s.pos LEFT JOIN l ON l.dataset_id = s.dataset_id""",
)(lambda spark, d: records.apply_inventory_updates(_updates(spark, d), T.inventory(spark, d)))


# ---------------------------------------------------------------------------
# Stored versions: changes come in four batches, each published as a version.
# ---------------------------------------------------------------------------

_BATCHES = 4


@register(
    "inventory_versions",
    "WITH "
    + ",\n".join([
        _CAND,
        _INV,
        f"vs AS (SELECT CAST(v AS BIGINT) AS version FROM range({_BATCHES + 1}) t(v))",
        f"""ch AS (SELECT vs.version, dataset_id, item_id, arg_max(item_name, (candidate_id % {_BATCHES}, candidate_id)) AS item_name,
                      arg_max(barcode_number, (candidate_id % {_BATCHES}, candidate_id)) AS barcode_number, arg_max(selling_price, (candidate_id % {_BATCHES}, candidate_id)) AS selling_price,
                      min(candidate_id % {_BATCHES}) AS since
               FROM cand JOIN vs ON candidate_id % {_BATCHES} < vs.version GROUP BY 1, 2, 3)""",
        "ov AS (SELECT vs.version, inv.* FROM inv, vs)",
    ])
    + f"""SELECT coalesce(ov.version, ch.version) AS version, coalesce(ov.dataset_id, ch.dataset_id) AS dataset_id, coalesce(ov.item_id, ch.item_id) AS item_id,
              CASE WHEN ch.item_name IS NOT NULL THEN {O.strip('ch.item_name')} ELSE ov.item_name END AS item_name,
              CASE WHEN ch.item_name IS NOT NULL THEN {O.strip('ch.barcode_number')} ELSE ov.barcode_number END AS barcode_number,
              CAST(coalesce(ch.selling_price, ov.selling_price) AS DOUBLE) AS selling_price,
              strftime(coalesce(ov.created_at, TIMESTAMP '2024-06-01 00:00:00' + to_hours(CAST(ch.since AS INTEGER))), '%Y-%m-%d %H:%M:%S') AS created_at
       FROM ov FULL OUTER JOIN ch ON ov.version = ch.version AND ov.dataset_id = ch.dataset_id AND ov.item_id = ch.item_id""",
)
def q_inventory_versions(spark, d):
    root = FS.scratch_path(spark, "inventory")
    V.publish(spark, root, lambda _: T.inventory(spark, d))
    changes = T.inventory_candidates(spark, d)
    for k in range(_BATCHES):
        now = dt.datetime(2024, 6, 1, k)
        batch = changes.where(F.col("candidate_id") % _BATCHES == k)
        V.publish(spark, root, lambda base, batch=batch, now=now: records.upsert_inventory(base, batch, now, "candidate_id"))
    whole = None
    for n in V.versions(spark, root):
        one = V.read_version(spark, root, n).select(
            F.lit(n).cast("bigint").alias("version"), "dataset_id", "item_id", "item_name", "barcode_number", F.col("selling_price").cast("double").alias("selling_price"),
            F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        )
        whole = one if whole is None else whole.unionByName(one)
    return whole
