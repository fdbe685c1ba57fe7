"""Operators on tables of matches. A match is a row of the node table with `ord`, its place in the document's sequence.

Every join has doc_id among its keys, so with nodes dealt out by doc_id no operator needs another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tree import NAMES

ROW = ("doc_id", *NAMES)


def _left(matches: DataFrame, key: Column) -> DataFrame:
    return matches.select(F.col("doc_id").alias("_d"), key.alias("_k"), F.col("ord").alias("_o"))


def _step(*more: Column) -> Column:
    return F.concat(F.col("_o"), F.array(*[c.cast("long") for c in more])).alias("ord")


def expand(matches: DataFrame, nodes: DataFrame, roles: list[str], condition: Column | None = None) -> DataFrame:
    """Children of some roles, in order; what has none gives nothing."""
    kids = nodes.filter(F.col("role").isin(roles))
    kids = kids if condition is None else kids.filter(condition)
    left = _left(matches, F.col("node_id"))
    return left.join(kids, (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_k"))).select(*ROW, _step(F.col("ordinal")))


def hop(matches: DataFrame, nodes: DataFrame, column: Column) -> DataFrame:
    """The row each match points to."""
    left = _left(matches, column).filter("_k IS NOT NULL")
    return left.join(nodes, (F.col("doc_id") == F.col("_d")) & (F.col("node_id") == F.col("_k"))).select(*ROW, F.col("_o").alias("ord"))


def group(matches: DataFrame, nodes: DataFrame, key: Column) -> DataFrame:
    """All mates of each match's duplicate group, in source order."""
    left = matches.select(F.col("doc_id").alias("_d"), key.alias("_k"), F.col("role").alias("_role"), F.col("ord").alias("_o")).filter("_k IS NOT NULL")
    mates = nodes.withColumn("_g", key)
    return left.join(mates, (F.col("doc_id") == F.col("_d")) & (F.col("_g") == F.col("_k")) & (F.col("role") == F.col("_role"))).select(*ROW, _step(F.col("node_id")))


def gate(matches: DataFrame, nodes: DataFrame, condition: Column) -> DataFrame:
    """All rows that meet a condition, of documents with a match."""
    some = matches.select("doc_id").distinct()
    return nodes.filter(condition).join(some, "doc_id", "left_semi").select(*ROW, F.array(F.col("ordinal").cast("long"), F.col("node_id").cast("long")).alias("ord"))


def descendants(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements below each element, in pre-order: an interval join within a document."""
    left = matches.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("last_desc").alias("_l"), F.col("ord").alias("_o"))
    below = nodes.filter("role = 'XmlElement'")
    return left.join(below, (F.col("doc_id") == F.col("_d")) & (F.col("pre") > F.col("_p")) & (F.col("pre") <= F.col("_l"))).select(*ROW, _step(F.col("pre")))


def scope(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Namespace bindings on the way from the root to each element, oldest first, shadowed ones too."""
    left = matches.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("ord").alias("_o"))
    above = nodes.filter("role = 'XmlElement'").select(F.col("doc_id").alias("_d2"), F.col("node_id").alias("_n"), F.col("pre").alias("_a"), F.col("last_desc").alias("_l"))
    chain = left.join(above, (F.col("_d2") == F.col("_d")) & (F.col("_a") <= F.col("_p")) & (F.col("_l") >= F.col("_p")))
    bindings = nodes.filter("role = 'XmlNamespaceBinding'")
    return chain.join(bindings, (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_n"))).select(*ROW, _step(F.col("_a"), F.col("ordinal")))


def natural_lines(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """The natural lines of each logical line."""
    left = _left(matches, F.col("node_id"))
    lines = nodes.filter("role = 'PropertiesNaturalLine'")
    return left.join(lines, (F.col("doc_id") == F.col("_d")) & (F.col("target_id") == F.col("_k"))).select(*ROW, _step(F.col("ordinal")))


def _walk(pdf):
    """Depth-first order of one graph from its matches; a node is visited once."""
    import pandas as pd

    nodes = pdf[pdf["role"] == "GraphNode"].set_index("node_id", drop=False)
    edges: dict[int, list[tuple]] = {}
    for r in pdf[pdf["role"] != "GraphNode"].sort_values("ordinal").itertuples():
        edges.setdefault(int(r.parent_id), []).extend(int(x) for x in (r.key_id, r.value_id) if not pd.isna(x))
    starts = sorted((list(o), int(n)) for o, n in zip(nodes["ord"], nodes["node_id"]) if o is not None)
    seen, out = set(), []
    for _, start in starts:
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                out.append(n)
                stack += reversed(edges.get(n, []))
    found = nodes.loc[out].copy()
    found["ord"] = [[k] for k in range(len(out))]
    return found.reset_index(drop=True)


def reachable(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that can be reached, in depth-first order with one set of visited nodes for all matches of a document.

    Order and the shared set need the whole graph of a document, so each is walked in one call, bounded by the document.
    """
    starts = matches.groupBy("doc_id", "node_id").agg(F.min("ord").alias("ord"))
    rows = nodes.filter("role LIKE 'Graph%'").join(starts, ["doc_id", "node_id"], "left").select(*ROW, "ord")
    return rows.groupBy("doc_id").applyInPandas(_walk, rows.schema)


def take(matches: DataFrame, count: int) -> DataFrame:
    """The first matches of each document."""
    return matches.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).filter(F.col("_n") <= min(count, (1 << 31) - 1)).drop("_n")


def distinct(matches: DataFrame) -> DataFrame:
    """The first match of each row."""
    return matches.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("ord"))).filter("_n = 1").drop("_n")


def concat(branches: list[DataFrame]) -> DataFrame:
    """One branch after the other."""
    out = None
    for k, b in enumerate(branches):
        b = b.withColumn("ord", F.concat(F.array(F.lit(k).cast("long")), F.col("ord")))
        out = b if out is None else out.unionByName(b)
    return out


def merge(branches: list[DataFrame], key: list[str]) -> DataFrame:
    """All branches in structural order; ties keep the order of branches."""
    out = None
    for k, b in enumerate(branches):
        b = b.withColumn("ord", F.concat(F.array(*[F.col(c).cast("long") for c in key], F.lit(k).cast("long")), F.col("ord")))
        out = b if out is None else out.unionByName(b)
    return out
