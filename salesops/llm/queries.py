"""The registered queries: each operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.ann import approximate_neighbours

    return approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.pitman_yor import score_documents

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_documents(table(spark, sf_dir, "documents"), held_out=held_out)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.mixing import mix_to_weights

    mixed = mix_to_weights(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *[F.col(f"mix.{n}") for n in ("domain", "lang", "source", "n_tokens", "leaf_tokens", "leaf_budget", "epoch")])


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.near_dup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def _share_sql(level: str, path: list[str], above: str, weight: str) -> str:
    """CTEs that share the budgets of ``b_<above>`` out among one level's nodes."""
    keys, parent = ", ".join(path), ", ".join(path[:-1]) or "1"
    link = " AND ".join(f"n.{c} = p.{c}" for c in path[:-1]) or "TRUE"
    return f"""
n_{level} AS (SELECT {keys}, sum(capacity)::HUGEINT AS capacity, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {keys}),
w_{level} AS (
  SELECT n.*, p.budget::HUGEINT AS budget,
    coalesce(sum(n.capacity) OVER (PARTITION BY {", ".join("n." + c for c in path[:-1]) or "1"} ORDER BY CAST(n.capacity AS DOUBLE) / n.weight, n.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
    sum(n.weight) OVER (PARTITION BY {", ".join("n." + c for c in path[:-1]) or "1"} ORDER BY CAST(n.capacity AS DOUBLE) / n.weight, n.{level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest_weight
  FROM n_{level} n JOIN b_{above} p ON {link}),
f_{level} AS (SELECT *, capacity * rest_weight <= (budget - before) * weight AS held FROM w_{level}),
b_{level} AS (
  SELECT {keys}, CASE WHEN held THEN capacity ELSE
    ((budget - coalesce(sum(capacity) FILTER (WHERE held) OVER (PARTITION BY {parent}), 0)::HUGEINT) * weight)
      // (sum(weight) FILTER (WHERE NOT held) OVER (PARTITION BY {parent}))::HUGEINT END AS budget
  FROM f_{level}),"""


OP5_SQL = (
    """
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident,
    CASE WHEN regexp_extract(coalesce(source, 'unknown'), '([0-9]+)$', 1) = '' THEN 'other'
         ELSE 'domain' || CAST(CAST(right(regexp_extract(coalesce(source, 'unknown'), '([0-9]+)$', 1), 1) AS INTEGER) % 4 AS VARCHAR) END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens, sum(n_tokens)::HUGEINT * 4 AS capacity FROM d GROUP BY ALL),
b_root AS (SELECT coalesce(sum(n_tokens), 0)::HUGEINT * 90 // 100 AS budget FROM d),"""
    + _share_sql("domain", ["domain"], "root", "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END")
    + _share_sql("lang", ["domain", "lang"], "domain", "CASE WHEN lang = 'en' THEN 5 WHEN lang IN ('de', 'fr', 'es') THEN 2 ELSE 1 END")
    + _share_sql("source", ["domain", "lang", "source"], "lang", "1")
    + """
p AS (
  SELECT l.domain, l.lang, l.source, l.leaf_tokens, b.budget::BIGINT AS leaf_budget,
    CASE WHEN l.leaf_tokens > 0 THEN b.budget::BIGINT // l.leaf_tokens ELSE 0 END AS epochs
  FROM leaves l JOIN b_source b USING (domain, lang, source)),
o AS (
  SELECT d.*, p.leaf_tokens, p.leaf_budget, p.epochs, p.leaf_budget - p.epochs * p.leaf_tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('20:' || CAST(p.epochs AS VARCHAR) || ':' || ident), ident RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
  FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, CAST(e AS INTEGER) AS epoch
FROM (SELECT o.*, unnest(range(CAST(epochs + CASE WHEN rest > 0 AND used <= rest THEN 1 ELSE 0 END AS BIGINT))) AS e FROM o)
"""
)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def held_out_quality() -> Column:
    """The fourth of the ids that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.quality import score_quality

    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), held_out=held_out_quality())
    return out.select("doc_id", held_out_quality().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.exact_topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id AS vec_id, c.r AS cr,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr) <= 5
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.vector_codes import encode

    out = encode(table(spark, sf_dir, "embeddings"))
    # Sums that 64 bits cannot hold are null as longs; the operator gives them whole.
    return out.drop("label").withColumns({c: F.expr(f"try_cast({c} AS BIGINT)") for c in ("error", "label_error")})


def _op11_sql(rounds: int = 4, entries: int = 256) -> str:
    """k-means on each part, round by round; ``d * entries + j`` orders by distance, then index."""

    def assign(t: int) -> str:
        return f"""
a{t} AS MATERIALIZED (
  SELECT r, q, any_value(x) AS x, min(CAST(x2 + c2 - 2 * list_inner_product(x, c) AS BIGINT) * {entries} + j) AS near
  FROM p JOIN c{t} USING (q) GROUP BY r, q)"""

    def move(t: int) -> str:
        return f"""
u{t} AS (SELECT q, near % {entries} AS j, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS n FROM a{t}, range(1, 1 + len(x)) g(i) GROUP BY ALL),
m{t} AS (SELECT q, j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM u{t} GROUP BY q, j),
c{t + 1} AS MATERIALIZED (
  SELECT q, j, c, list_inner_product(c, c) AS c2
  FROM (SELECT c{t}.q, c{t}.j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON m{t}.q = c{t}.q AND m{t}.j = c{t}.j))"""

    chain = ",".join(x for t in range(rounds) for x in (assign(t), move(t)))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, q, x, list_inner_product(x, x) AS x2 FROM (
    SELECT r, q, e[q * (len(e) // 4) + 1 : (q + 1) * (len(e) // 4)] AS x FROM v, range(4) g(q))),
c0 AS MATERIALIZED (
  SELECT q, j, x AS c, x2 AS c2 FROM (SELECT q, x, x2, row_number() OVER (PARTITION BY q ORDER BY vec_id NULLS LAST, e) - 1 AS j FROM p JOIN v USING (r))
  WHERE j < {entries}),{chain},{assign(rounds)},
b AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY q, j, i)) AS codebooks_sha256 FROM c{rounds}, range(1, 1 + len(c)) g(i)),
f AS (
  SELECT r, string_agg(format('{{:02x}}', near % {entries}), '' ORDER BY q) AS code, CAST(sum(near // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM f JOIN v USING (r), b
"""


OP11_SQL = _op11_sql()


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.simhash import simhash_duplicates

    out = simhash_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from salesops.llm.whitening import whiten

    out = whiten(table(spark, sf_dir, "embeddings"))
    # A square sum that 64 bits cannot hold (from millions of rows on) is null as a long, and whole beside it.
    return out.withColumn("deviation_whole", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_licenses": (op1_licenses, None),
    "op2_kmeans_tree": (op2_kmeans_tree, None),
    "op3_pitman_yor": (op3_pitman_yor, None),
    "op4_token_files": (op4_token_files, None),
    "op5_mix": (op5_mix, OP5_SQL),
    "op6_near_dup": (op6_near_dup, None),
    "op7_best_fit": (op7_best_fit, None),
    "op8_html_text": (op8_html_text, None),
    "op9_quality": (op9_quality, None),
    "op10_exact_topk": (op10_exact_topk, OP10_SQL),
    "op11_vector_codes": (op11_vector_codes, OP11_SQL),
    "op12_simhash": (op12_simhash, None),
    "op13_whitening": (op13_whitening, None),
}
