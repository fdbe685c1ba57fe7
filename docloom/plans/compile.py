"""From a query tree to DataFrames: matches, and the documents for which the query fails."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import matches as M
from docloom.plans.algebra import Apply, Concat, Input, Query, validate
from docloom.plans.catalog import DOMAINS, STRUCTURE, Operator, operators
from docloom.sources.tree import NAMES

LITERALS = {"as-string": ["String"], "as-integer": ["Integer"], "as-real": ["Integer", "Decimal"], "as-boolean-is": ["Boolean"], "as-null-is": ["Null"]}


@dataclass
class Result:
    """matches: node rows with ord; failures: doc_id and code. A document is in one of them or in neither, never in both."""

    matches: DataFrame
    failures: DataFrame | None

    def ordered(self, *columns: str) -> DataFrame:
        """doc_id, pos (from 0 in each document) and columns."""
        if "pos" in self.matches.columns:
            return self.matches.select("doc_id", "pos", *columns)
        pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long") - 1
        return self.matches.select("doc_id", pos.alias("pos"), *columns)


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _condition(op: Operator, args: dict, text: str) -> Column:
    return F.expr(re.sub(r"\{(\w+)\}", lambda m: _literal(args[m[1]]), text))


class Compiler:
    def __init__(self, query: Query, nodes: DataFrame):
        validate(query)
        self.query, self.nodes, self.known = query, nodes, operators(query.domain)
        self.failed: list[DataFrame] = []

    def fail(self, matches: DataFrame, bad: Column, code: str) -> DataFrame:
        """Documents with a bad match fail as a whole."""
        docs = matches.filter(bad).select("doc_id").distinct()
        self.failed.append(docs.withColumn("code", F.lit(code)))
        return matches.join(docs, "doc_id", "left_anti")

    def node(self, node) -> DataFrame:
        if isinstance(node, Input):
            start = self.nodes.filter(DOMAINS[self.query.domain][0])
            return start.select("doc_id", *NAMES, F.array(F.coalesce("dup_group", F.lit(0)).cast("long"), F.coalesce("ordinal", F.lit(0)).cast("long")).alias("ord"))
        if isinstance(node, Apply):
            return self.apply(self.known[node.operator], node.args, self.node(node.input))
        branches = [self.node(b) for b in node.branches]
        if isinstance(node, Concat):
            return M.concat(branches)
        family = self.query.domain.split(".")[0]
        return M.merge(branches, ["ordinal"] if "syntax" in self.query.domain else STRUCTURE[family].split(", "))

    def apply(self, op: Operator, args: dict, m: DataFrame) -> DataFrame:
        what, _, more = op.what.partition(":")
        if op.act == "filter":
            return m.filter(_condition(op, args, op.what))
        if op.act == "expand":
            extra = None if not more else _condition(op, args, more) if "=" in more else F.col("state") == more
            return M.expand(m, self.nodes, what.split(","), extra)
        if op.act == "hop":
            return M.hop(m, self.nodes, F.expr(op.what))
        if op.act == "group":
            return M.group(m, self.nodes, F.expr(op.what))
        if op.act == "gate":
            extra = F.lit(True) if not more else F.col("tag") == more if what == "Piece" else F.col("state") == more
            return M.gate(m, self.nodes, (F.col("role") == what) & extra)
        if op.act == "assert":
            m = self.fail(m, ~F.coalesce(_condition(op, args, what), F.lit(False)), "core.query.required-type-mismatch@1")
            return m.filter(_condition(op, args, more)) if more else m
        match what:
            case "take":
                return M.take(m, args["count"])
            case "distinct":
                return M.distinct(m)
            case "reachable":
                return M.reachable(m, self.nodes)
            case "descendants":
                return M.descendants(m, self.nodes)
            case "scope":
                return M.scope(m, self.nodes)
            case "natural":
                return M.natural_lines(m, self.nodes)
            case "body":
                return M.gate(m, self.nodes, F.expr("role = 'HclBody' AND parent_id IS NULL"))
            case "tuple" | "object":
                return M.expand(m.filter(F.col("kind") == what), self.nodes, ["HclExpression"])
            case "literal":
                return self.literal(m, args["accessor"])
        raise NotImplementedError(op.name)

    def literal(self, m: DataFrame, accessor: str) -> DataFrame:
        """Attributes must hold literals of the accessor's type."""
        found = M.hop(m, self.nodes, F.expr("CASE WHEN role = 'HclAttribute' THEN value_id ELSE node_id END"))
        self.fail(found, F.coalesce(F.col("state"), F.lit("")) != "literal", "core.query.target-unavailable@1")
        self.fail(found, (F.col("state") == "literal") & ~F.col("tag").isin(LITERALS[accessor]), "core.query.required-type-mismatch@1")
        return reduce(lambda x, docs: x.join(docs.select("doc_id"), "doc_id", "left_anti"), self.failed[-2:], m)

    def run(self) -> Result:
        m = self.node(self.query.root)
        for docs in self.failed:
            m = m.join(docs.select("doc_id"), "doc_id", "left_anti")
        if self.query.max_results is not None:
            m = self.count(m, F.col("_n") > self.query.max_results, "core.query.resource-limit@1")
        kind = self.query.selection
        if kind in ("First", "Last"):
            order = F.col("ord").asc() if kind == "First" else F.col("ord").desc()
            m = m.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).filter("_n = 1").drop("_n")
        elif kind in ("ZeroOrOne", "RequireOne"):
            m = self.count(m, F.col("_n") > 1, "core.query.cardinality-violation@1")
            if kind == "RequireOne":
                gone = [m.select("doc_id"), *[d.select("doc_id") for d in self.failed]]
                docs = self.nodes.filter("role = 'Document' AND kind <> 'Failed'").select("doc_id")
                none = reduce(lambda x, y: x.join(y.distinct(), "doc_id", "left_anti"), gone, docs)
                self.failed.append(none.withColumn("code", F.lit("core.query.cardinality-violation@1")))
        failures = reduce(DataFrame.unionByName, self.failed).groupBy("doc_id").agg(F.max("code").alias("code")) if self.failed else None
        return Result(m, failures)

    def count(self, m: DataFrame, bad: Column, code: str) -> DataFrame:
        counts = m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(bad).select("doc_id")
        self.failed.append(counts.withColumn("code", F.lit(code)))
        return m.join(counts, "doc_id", "left_anti")


def run(query: Query, nodes: DataFrame) -> Result:
    """Plan a query over the documents of a node table; one bad document never fails the others."""
    return Compiler(query, nodes).run()
