"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Repeated rows are numbered in runs of so many.
RUN = 100_000
#: A tree is a list of regions, a region a list of racks, a rack a list of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]


def layout(shards: int, base: int = 40, per_rack: int = 4, racks: int = 2) -> Tree:
    """The first `base` shards fill regions of `racks` racks; each shard added later is a region of its own.

    A new shard so changes no weight below the root: documents move into it and nowhere else.
    """
    old, tree = min(shards, base), []
    for first in range(0, old, per_rack * racks):
        region = range(first, min(first + per_rack * racks, old))
        tree.append([[(s, 1.0) for s in region[k : k + per_rack]] for k in range(0, len(region), per_rack)])
    return tree + [[[(s, 1.0)]] for s in range(old, shards)]


def _weigh(node) -> float:
    return node[1] if isinstance(node, tuple) else sum(map(_weigh, node))


def _draw(key: F.Column, path: F.Column, weights: F.Column) -> F.Column:
    """The place, from 1, of the child with the earliest exponential arrival: chance in proportion to weight."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(path, k, key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.array_min(F.transform(weights, lambda w, k: F.struct((-F.log(u(k)) / w).alias("t"), k.alias("k")))).k + 1


def _given(value: F.Column, then) -> F.Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def place(key: F.Column, tree: Tree) -> F.Column:
    """The shard of the key, by a weighted draw among regions, then among racks, then among shards."""
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    regions = numbers(map(_weigh, tree))
    racks = F.array(*[numbers(map(_weigh, r)) for r in tree])
    leaves = F.array(*[F.array(*[numbers(w for _, w in k) for k in r]) for r in tree])
    shards = F.array(*[F.array(*[numbers(s for s, _ in k) for k in r]) for r in tree])
    at = lambda table, *path: at(F.element_at(table, path[0]), *path[1:]) if path else table
    leaf = lambda r, k: F.element_at(at(shards, r, k), _draw(key, r * 1000 + k, at(leaves, r, k)))
    found = _given(_draw(key, F.lit(-1), regions), lambda r: _given(_draw(key, r, at(racks, r)), lambda k: leaf(r, k)))
    return found.cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, rows_each: int = 100_000, keep: list[str] | None = None, base: int = 40) -> DataFrame:
    """Place every row in a shard and number the rows of each shard without gaps from 0.

    The law is `key`: doc_id (null counts as an empty key) and the shard count decide. Equal ids, repeated rows included,
    share a shard and get slots of their own. Null texts have no bytes: size 16, checksum 0. Texts, however long, are only
    measured and carried. An empty table gives no rows. Slots come from counts of (shard, hash part) groups of about
    `rows_each` rows, so no task holds a whole shard; equal rows are counted first and numbered last.
    `keep` names input columns to carry along; input columns that clash with an output column are left out.
    """
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    parts = max(8, math.ceil(docs.count() / (shards * rows_each)))
    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    kept = [c for c in keep or [] if c not in own]
    rows = docs.select(key.alias("id"), F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    # Equal rows are counted before any shuffle, so that one that is repeated often is one row until it is numbered.
    rows = rows.groupBy("id", "row", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    key = F.col("id")
    part = F.pmod(F.xxhash64(F.lit("part"), key.cast("string"), F.col("crc")), F.lit(parts)).cast("int")
    rows = rows.select("*", part.alias("part"), place(key, layout(shards, base)).alias("shard"), place(key, layout(shards + 1, base)).alias("grown_shard"))
    known = docs.select(F.col("doc_id").alias("id"), F.crc32(text.cast("binary")).alias("crc"))
    counts = known.select(place(key, layout(shards, base)).alias("shard"), part.alias("part")).groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "part"])
    placed = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    placed = placed.withColumn("k", F.explode(F.sequence(F.col("run"), F.least(F.col("n") - 1, F.col("run") + RUN - 1))))
    names = [F.col(f"row.`{c}`").alias(c) for c in kept]
    return placed.select(F.col("id").alias("doc_id"), *names, "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("start") + F.col("first") + F.col("k")).alias("slot"), "grown_shard")
