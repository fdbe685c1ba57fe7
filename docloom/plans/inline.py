"""Queries evaluated where documents are parsed: one pass over the documents, no shuffle, and only matches leave it.

All joins of a query are within one document, so a document that has just been parsed can answer the whole query. The
compiler plans the same queries as joins over node tables that are kept; tests hold the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.algebra import Apply, Concat, Input, Query, StructureOrderMerge, validate
from docloom.plans.catalog import DOMAINS, STRUCTURE, Operator, operators
from docloom.plans.compile import LITERALS, Result
from docloom.sources.scan import TYPES, bytes_of, formed, viewed
from docloom.sources.tree import COLUMNS, NAMES, Tree

Row = dict
Match = tuple[Row, tuple]  # a row and its place in the document's sequence


class Failed(Exception):
    """The document fails the query: a code."""


def fold(name: str, row: Row) -> str:
    return name.lower() if row.get("tag") == "lower" else name


def _ini(argument: str) -> Callable:
    return lambda r, a: r.get("name") == a[argument] if a["comparison"] == "OriginalExact" else r.get("cmp_name") == fold(a[argument], r)


#: Conditions that are no plain comparisons of columns.
CONDITIONS: dict[str, Callable[[Row, dict], bool]] = {
    "ini.section-name-equals": _ini("name"),
    "ini.entry-key-equals": _ini("key"),
    "xml.name-equals": lambda r, a: r.get("name") == a["local"] and (r.get("tag") == a["prefix"] if a["comparison"] == "OriginalExact" else r.get("cmp_name") == a["namespace"]),
    "xml.reference-kind-is": lambda r, a: r.get("kind") == (a["kind"] if a["kind"] in ("Predefined", "General") else "Character"),
    "plist.document-root": lambda r, a: r.get("parent_id") is None,
    "plist.value-as-boolean-is": lambda r, a: r.get("text") == str(a["value"]).lower(),
    "properties.syntax-raw-bytes-equals": lambda r, a: (r.get("text") or "").encode("utf-8", "surrogatepass") == bytes(a["bytes"]),
    "properties.syntax-utf16be-equals": lambda r, a: (r.get("text") or "").encode("utf-16-be", "surrogatepass") == bytes(a["code_units"]),
}
_TERM = re.compile(r"(\w+) = (?:\{(\w+)\}|'([^']*)')")


def _plain(what: str) -> Callable[[Row, dict], bool]:
    """A conjunction of comparisons, as the catalogue writes them."""
    terms = [_TERM.fullmatch(t.strip()).groups() for t in what.split(" AND ")]
    return lambda r, a: all(r.get(c) is not None and r.get(c) == (a[n] if n else v) for c, n, v in terms)


def _pointer(what: str) -> Callable[[Row], int | None]:
    if m := re.fullmatch(r"coalesce\((\w+), (\w+)\)", what):
        return lambda r: r.get(m[1]) if r.get(m[1]) is not None else r.get(m[2])
    if m := re.fullmatch(r"CASE WHEN role = '(\w+)' THEN (\w+) END", what):
        return lambda r: r.get(m[2]) if r["role"] == m[1] else None
    return lambda r: r.get(what)


class Document:
    """The rows of a parsed document with the indexes that queries need, made on first use."""

    def __init__(self, tree: Tree, pieces: bool):
        self.tree = tree
        for k, r in enumerate(tree.rows):
            r["node_id"] = k + 1
        first = 1 + len(tree.rows) + len(tree.diagnostics)
        self.pieces = [{"node_id": first + n, "role": "Piece", "tag": f, "kind": k, "ordinal": n, "text": tree.text[s:e], "start_byte": s, "end_byte": e} for n, (f, k, s, e) in enumerate(tree.pieces)] if pieces else []
        self._kids: dict[int, list[Row]] | None = None
        self._groups: dict[str, dict] = {}

    def rows(self, role: str) -> list[Row]:
        return self.pieces if role == "Piece" else [r for r in self.tree.rows if r["role"] == role]

    def kids(self, node: int) -> list[Row]:
        if self._kids is None:
            self._kids = {}
            for r in self.tree.rows:
                if r.get("parent_id") is not None:
                    self._kids.setdefault(r["parent_id"], []).append(r)
        return self._kids.get(node, [])

    def mates(self, key: Callable, name: str, row: Row) -> list[Row]:
        if name not in self._groups:
            found: dict = {}
            for r in self.tree.rows:
                if key(r) is not None:
                    found.setdefault((key(r), r["role"]), []).append(r)
            self._groups[name] = found
        return self._groups[name].get((key(row), row["role"]), []) if key(row) is not None else []

    def at(self, node: int | None) -> Row | None:
        return self.tree.rows[node - 1] if node is not None and 0 < node <= len(self.tree.rows) else None


def _n(x) -> int:
    return 0 if x is None else int(x)


class Evaluator:
    """A validated query, ready to run over documents."""

    def __init__(self, query: Query):
        validate(query)
        self.query, self.known = query, operators(query.domain)
        start = DOMAINS[query.domain][0]
        self.top = "parent_id IS NULL" in start
        self.role = re.search(r"role = '(\w+)'", start)[1]
        self.state = m[1] if (m := re.search(r"state = '(\w+)'", start)) else None

    def start(self, doc: Document) -> list[Match]:
        rows = [r for r in doc.rows(self.role) if (not self.top or r.get("parent_id") is None) and (self.state is None or r.get("state") == self.state)]
        return [(r, (_n(r.get("dup_group")), _n(r.get("ordinal")))) for r in rows]

    def node(self, node, doc: Document) -> list[Match]:
        if isinstance(node, Input):
            return self.start(doc)
        if isinstance(node, Apply):
            return self.apply(self.known[node.operator], node.args, self.node(node.input, doc), doc)
        branches = [self.node(b, doc) for b in node.branches]
        if isinstance(node, Concat):
            return [(r, (k, *o)) for k, b in enumerate(branches) for r, o in b]
        family = self.query.domain.split(".")[0]
        key = ["ordinal"] if "syntax" in self.query.domain else STRUCTURE[family].split(", ")
        return [(r, (*[_n(r.get(c)) for c in key], k, *o)) for k, b in enumerate(branches) for r, o in b]

    def condition(self, op: Operator, what: str) -> Callable[[Row, dict], bool]:
        return CONDITIONS.get(op.name) or _plain(what)

    def apply(self, op: Operator, args: dict, m: list[Match], doc: Document) -> list[Match]:
        what, _, more = (x.strip() for x in op.what.partition(":"))
        if op.act == "filter":
            test = self.condition(op, op.what)
            return [(r, o) for r, o in m if test(r, args)]
        if op.act == "expand":
            roles = set(what.split(","))
            test = (lambda r, a: True) if not more else _plain(more) if "=" in more else lambda r, a: r.get("state") == more
            return [(k, (*o, _n(k.get("ordinal")))) for r, o in m for k in doc.kids(r["node_id"]) if k["role"] in roles and test(k, args)]
        if op.act == "hop":
            to = _pointer(op.what)
            return [(k, o) for r, o in m if (k := doc.at(to(r))) is not None]
        if op.act == "group":
            key = (lambda r: r.get("dup_group")) if what == "dup_group" else lambda r: r.get("dup_group") or r["node_id"]
            return [(k, (*o, k["node_id"])) for r, o in m for k in doc.mates(key, what, r)]
        if op.act == "gate":
            test = (lambda r: True) if not more else (lambda r: r.get("tag") == more) if what == "Piece" else lambda r: r.get("state") == more
            return [(r, (_n(r.get("ordinal")), r["node_id"])) for r in doc.rows(what) if test(r)] if m else []
        if op.act == "assert":
            kind = _plain(what)
            if not all(kind(r, args) for r, _ in m):
                raise Failed("core.query.required-type-mismatch@1")
            return [(r, o) for r, o in m if CONDITIONS[op.name](r, args)] if more else m
        return getattr(self, f"_{what}")(m, args, doc)

    def _take(self, m, args, doc):
        return sorted(m, key=lambda x: x[1])[: args["count"]]

    def _distinct(self, m, args, doc):
        seen: dict[int, Match] = {}
        for r, o in sorted(m, key=lambda x: x[1]):
            seen.setdefault(r["node_id"], (r, o))
        return list(seen.values())

    def _reachable(self, m, args, doc):
        order: list[int] = []
        seen: set[int] = set()
        for start, _ in sorted(m, key=lambda x: (x[1], x[0]["node_id"])):
            stack = [start["node_id"]]
            while stack:
                n = stack.pop()
                if n not in seen:
                    seen.add(n)
                    order.append(n)
                    kids = sorted((k for k in doc.kids(n) if k["role"] != "GraphNode" and k["role"].startswith("Graph")), key=lambda k: _n(k.get("ordinal")))
                    stack += reversed([x for k in kids for x in (k.get("key_id"), k.get("value_id")) if x is not None])
        return [(doc.at(n), (k,)) for k, n in enumerate(order)]

    def _descendants(self, m, args, doc):
        below = sorted((r for r in doc.rows("XmlElement") if r.get("pre") is not None), key=lambda r: r["pre"])
        first = below[0]["pre"] if below else 0  # pre-order numbers have no gaps
        return [(r, (*o, r["pre"])) for x, o in m if x.get("pre") is not None for r in below[x["pre"] + 1 - first : x["last_desc"] + 1 - first]]

    def _scope(self, m, args, doc):
        out = []
        for x, o in m:
            chain, up = [], x
            while up is not None and up["role"] == "XmlElement":
                chain.append(up)
                up = doc.at(up.get("parent_id"))
            for e in reversed(chain):
                out += [(k, (*o, e["pre"], _n(k.get("ordinal")))) for k in doc.kids(e["node_id"]) if k["role"] == "XmlNamespaceBinding"]
        return out

    def _natural(self, m, args, doc):
        by: dict = {}
        for r in doc.rows("PropertiesNaturalLine"):
            by.setdefault(r.get("target_id"), []).append(r)
        return [(k, (*o, _n(k.get("ordinal")))) for r, o in m for k in by.get(r["node_id"], [])]

    def _body(self, m, args, doc):
        return [(r, (_n(r.get("ordinal")), r["node_id"])) for r in doc.rows("HclBody") if r.get("parent_id") is None] if m else []

    def _inside(self, kind, m, doc):
        return [(k, (*o, _n(k.get("ordinal")))) for r, o in m if r.get("kind") == kind for k in doc.kids(r["node_id"]) if k["role"] == "HclExpression"]

    def _tuple(self, m, args, doc):
        return self._inside("tuple", m, doc)

    def _object(self, m, args, doc):
        return self._inside("object", m, doc)

    def _literal(self, m, args, doc):
        found = [doc.at(r.get("value_id") if r["role"] == "HclAttribute" else r["node_id"]) for r, _ in m]
        codes = ["core.query.target-unavailable@1" if r.get("state") != "literal" else "core.query.required-type-mismatch@1" for r in found if r is not None and (r.get("state") != "literal" or r.get("tag") not in LITERALS[args["accessor"]])]
        if codes:
            raise Failed(max(codes))
        return m

    def run(self, doc: Document) -> list[Match]:
        """The matches in order; raises Failed if the document fails the query."""
        m = sorted(self.node(self.query.root, doc), key=lambda x: x[1])
        if self.query.max_results is not None and len(m) > self.query.max_results:
            raise Failed("core.query.resource-limit@1")
        kind = self.query.selection
        if kind in ("ZeroOrOne", "RequireOne") and len(m) > 1 or kind == "RequireOne" and not m:
            raise Failed("core.query.cardinality-violation@1")
        return m[:1] if kind == "First" else m[-1:] if kind == "Last" else m


def merges(node) -> bool:
    """Does the query merge by places in the source?"""
    return isinstance(node, StructureOrderMerge) or any(map(merges, getattr(node, "branches", ()))) or isinstance(node, Apply) and merges(node.input)


def query_documents(query: Query, docs: DataFrame, profile: str, view: str | None = None, encoding: str | None = None, columns: tuple[str, ...] = NAMES) -> Result:
    """The result of a query over documents (doc_id, text or content), each parsed once and answered on the spot.

    matches and failures come from one scan each; documents that cannot be formed have no match. The matches' ord is what
    the compiler gives, and pos their place. columns: those of the matches that are needed; without places in the source a
    faster parser may do.
    """
    evaluator = Evaluator(query)
    pieces = "syntax" in query.domain or "hcl." in query.domain
    kinds = dict(COLUMNS)
    names = [c for c in NAMES if c in columns]
    places = bool({"start_byte", "end_byte"} & set(names)) or merges(query.root)

    def answer(failures: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part, ids, found, ords, spots = batch.slice(at, 500), [], [], [], []
                    for doc_id, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        tree = viewed(formed(content, profile, encoding, pieces, places or view is not None), view)
                        if isinstance(tree, str):
                            continue
                        try:
                            got, code = evaluator.run(Document(tree, pieces)), None
                        except Failed as e:
                            got, code = [], str(e)
                        if failures:
                            if code:
                                ids.append(doc_id)
                                found.append(code)
                            continue
                        at_byte = bytes_of(tree.text, tree.encoding) if got else None
                        for k, (r, o) in enumerate(got):
                            ids.append(doc_id)
                            found.append(tuple(at_byte(r[c]) if c in ("start_byte", "end_byte") and r.get(c) is not None else r.get(c) for c in names))
                            ords.append(list(o))
                            spots.append(k)
                    if failures:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "code"])
                        continue
                    values = list(zip(*found)) if found and names else [()] * len(names)
                    arrays = [pa.array(ids, pa.int64()), *[pa.array(c, TYPES[kinds[n]]) for n, c in zip(names, values)], pa.array(ords, pa.list_(pa.int64())), pa.array(spots, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "ord", "pos"])

        return run

    content = "content" if "content" in docs.columns else "text"
    rows = docs.select(F.col("doc_id").cast("long"), F.col(content))
    return Result(rows.mapInArrow(answer(False), "doc_id long, " + "".join(f"{n} {kinds[n]}, " for n in names) + "ord array<long>, pos long"), rows.mapInArrow(answer(True), "doc_id long, code string"))
