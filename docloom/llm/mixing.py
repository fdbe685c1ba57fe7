"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import partitions, stored, unit

#: Rates above this are drawn as sums of equal parts, so that exp(-rate) keeps its digits.
PART = 64.0
#: Up to so many sources their rates are broadcast (at most some 30 MB); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def rates(docs: DataFrame, weights: dict[str, float], other: float = 1.0, total: float | None = None) -> DataFrame:
    """One row per source: rows, mean repetitions, and the cumulative Poisson distribution of one part of the mean."""
    named = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else None
    weight = F.coalesce(named[F.col("_source")], F.lit(float(other))) if weights else F.lit(float(other))
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts.withColumn("_w", weight), "mix")
    weights_sum, rows_sum = counts.agg(F.sum("_w"), F.sum("_n")).first()
    budget = float((rows_sum or 0) if total is None else total)
    out = counts.withColumn("_rate", F.col("_w") / F.lit(weights_sum or 1.0) * F.lit(budget) / F.col("_n"))
    out = out.withColumn("_parts", F.greatest(F.ceil(F.col("_rate") / PART), F.lit(1)).cast("int"))
    out = out.withColumn("_mean", F.col("_rate") / F.col("_parts"))
    first = F.exp(-F.col("_mean"))
    steps = F.sequence(F.lit(1), (F.ceil(F.col("_mean") + 12 * F.sqrt("_mean")) + 20).cast("int"))
    grown = F.aggregate(
        steps,
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct((s.p * F.col("_mean") / k).alias("p"), F.concat(s.c, F.array(F.element_at(s.c, -1) + s.p * F.col("_mean") / k)).alias("c")),
    )
    return out.select("_source", "_rate", "_parts", grown.c.alias("_cdf"))


def replicate(docs: DataFrame, weights: dict[str, float], other: float = 1.0, total: float | None = None, seed: int = 42) -> DataFrame:
    """Repeat each document a Poisson number of times so that sources reach their weights in expectation, in random order.

    The mean of a source is weight / sum of weights * total / rows (total: as many rows as come in). The draw inverts the
    distribution at a number hashed from seed and doc_id, so it does not depend on partitions. Null and unnamed sources
    take the weight `other`; rows with a null id share one draw, repeated ids too. Texts, however long, are only carried.
    Empty input gives no rows. Adds copy (from 1), n_copies and order_key, by whose hash the rows are dealt out and sorted;
    input columns so named are replaced, all others stay whatever their names.
    """
    table = rates(docs, weights, other, total)
    few = table.count() <= BROADCAST_SOURCES
    kept = [c for c in docs.columns if c not in ("copy", "n_copies", "order_key")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("_source"))
    rows = rows.join(F.broadcast(table) if few else table, "_source")
    below = lambda u: F.size(F.filter(F.col("_cdf"), lambda c: c <= u))
    draw = lambda j: F.transform(F.array(unit(F.lit(seed), F.col("id"), j)), below)[0]
    n = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda a, j: a + draw(j))
    rows = rows.withColumn("n_copies", n.cast("long")).filter("n_copies > 0").select("row", "id", "n_copies")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    rows = rows.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("id"), F.lit("")), F.col("copy"))))
    dealt = rows.repartition(partitions(docs), "order_key").sortWithinPartitions("order_key")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "n_copies", "copy", "order_key")


def sql(weights: dict[str, float], other: float, seed: int) -> str:
    """The same rows in DuckDB's dialect."""
    case = " ".join(f"WHEN '{k}' THEN {float(w)}" for k, w in weights.items())
    return f"""
WITH RECURSIVE sized AS (SELECT coalesce(source, '') AS s, count(*) AS n, CASE coalesce(source, '') {case} ELSE {float(other)} END AS w FROM documents GROUP BY 1),
rated AS (SELECT s, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM sized),
parted AS (SELECT s, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS mean FROM rated),
cdf AS (SELECT s, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
  UNION ALL SELECT s, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean)) + 20),
listed AS (SELECT s, any_value(parts) AS parts, list(c) AS cs FROM cdf GROUP BY s),
drawn AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cs, lambda c: c <=
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / {float(1 << 52)}))))::BIGINT AS n_copies
  FROM documents d JOIN listed ON coalesce(source, '') = s)
SELECT * EXCLUDE (i), i AS copy, md5('order{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || i) AS order_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS i FROM drawn WHERE n_copies > 0)"""
