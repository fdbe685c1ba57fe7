"""Portable graphs: built with checks, compared by their canonical numbering, and written in a canonical binary form."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docloom.functions.values import _count, _text, fnv1a
from docloom.sources.tree import Tree

# The marks of the binary form.
MAGIC, MARKS = b"PGCE\x01", {"Scalar": 0x20, "Sequence": 0x40, "Mapping": 0x41}
KINDS = {v: k for k, v in MARKS.items()}


class GraphError(ValueError):
    """A graph that is not well formed; code says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Node:
    """kind, tag and content: text of a scalar, node numbers of a sequence, pairs of node numbers of a mapping."""

    kind: str
    tag: str
    content: object

    def edges(self) -> list[int]:
        return [] if self.kind == "Scalar" else list(self.content) if self.kind == "Sequence" else [x for pair in self.content for x in pair]


@dataclass(frozen=True)
class Limits:
    nodes: int = 1_000_000
    edges: int = 4_000_000
    depth: int = 1_000_000
    bytes: int = 64 << 20


@dataclass(frozen=True)
class Graph:
    """Nodes in canonical order (depth first from the roots, a key before its value, each node at its first visit) and the
    roots, so that graphs of equal shape and content are equal."""

    nodes: tuple[Node, ...]
    roots: tuple[int, ...]


class Builder:
    """Nodes are reserved, defined once, and rooted; build() checks the whole and numbers it. Sharing and cycles are allowed."""

    def __init__(self, limits: Limits = Limits()):
        self.limits, self.nodes, self.roots, self.edges = limits, [], [], 0

    def reserve(self) -> int:
        if len(self.nodes) >= self.limits.nodes:
            raise GraphError("core.graph.resource-limit@1")
        self.nodes.append(None)
        return len(self.nodes) - 1

    def define(self, at: int, kind: str, tag: str, content) -> int:
        if not 0 <= at < len(self.nodes):
            raise GraphError("core.graph.unknown-node@1")
        if self.nodes[at] is not None:
            raise GraphError("core.graph.redefined-node@1")
        if kind not in MARKS or not tag:
            raise GraphError("core.graph.invalid-node@1")
        node = Node(kind, tag, content if kind == "Scalar" else tuple(content) if kind == "Sequence" else tuple((k, v) for k, v in content))
        self.edges += len(node.edges())
        if self.edges > self.limits.edges:
            raise GraphError("core.graph.resource-limit@1")
        if any(not 0 <= x < len(self.nodes) for x in node.edges()):
            raise GraphError("core.graph.unknown-node@1")
        self.nodes[at] = node
        return at

    def node(self, kind: str, tag: str, content) -> int:
        return self.define(self.reserve(), kind, tag, content)

    def root(self, at: int) -> None:
        if not 0 <= at < len(self.nodes):
            raise GraphError("core.graph.unknown-node@1")
        self.roots.append(at)

    def build(self) -> Graph:
        if any(n is None for n in self.nodes):
            raise GraphError("core.graph.undefined-node@1")
        number: dict[int, int] = {}
        stack = [(r, 0) for r in reversed(self.roots)]
        while stack:
            at, depth = stack.pop()
            if at in number:
                continue
            if depth > self.limits.depth:
                raise GraphError("core.graph.resource-limit@1")
            number[at] = len(number)
            stack += [(x, depth + 1) for x in reversed(self.nodes[at].edges())]
        if len(number) < len(self.nodes):
            raise GraphError("core.graph.unreachable-node@1")
        new = lambda n: n if n.kind == "Scalar" else Node(n.kind, n.tag, tuple(number[x] for x in n.content) if n.kind == "Sequence" else tuple((number[k], number[v]) for k, v in n.content))
        return Graph(tuple(new(self.nodes[at]) for at in number), tuple(number[r] for r in self.roots))


def of_tree(tree: Tree, limits: Limits = Limits()) -> Graph:
    """The graph that a tree's GraphNode rows and their edges describe."""
    b, place = Builder(limits), {}
    for k, r in enumerate(tree.rows, 1):
        if r["role"] == "GraphNode":
            place[k] = b.reserve()
    kids: dict[int, list[dict]] = {}
    for r in tree.rows:
        if r["role"] != "GraphNode":
            kids.setdefault(r["parent_id"], []).append(r)
    roots = []
    for k, r in enumerate(tree.rows, 1):
        if r["role"] != "GraphNode":
            continue
        own = sorted(kids.get(k, []), key=lambda e: e["ordinal"])
        content = (r.get("text") or "") if r["kind"] == "Scalar" else [place[e["value_id"]] for e in own] if r["kind"] == "Sequence" else [(place[e["key_id"]], place[e["value_id"]]) for e in own]
        b.define(place[k], r["kind"], r["tag"], content)
        if r.get("state") == "root":
            roots.append((r.get("dup_group") or 0, place[k]))
    for _, at in sorted(roots):
        b.root(at)
    return b.build()


def encode(graph: Graph) -> bytes:
    """The canonical binary form: roots, then every node with its tag and content; equal graphs have equal bytes."""
    out = bytearray(MAGIC) + _count(len(graph.roots)) + _count(len(graph.nodes))
    for r in graph.roots:
        out += _count(r)
    for n in graph.nodes:
        out += bytes([MARKS[n.kind]]) + _text(n.tag.encode())
        out += _text(n.content.encode()) if n.kind == "Scalar" else _count(len(n.content)) + b"".join(map(_count, n.edges()))
    return bytes(out)


def decode(data: bytes, limits: Limits = Limits()) -> Graph:
    """The graph of a binary form; only the canonical spelling is taken."""
    if len(data) > limits.bytes:
        raise GraphError("core.graph.resource-limit@1")
    if data[:5] != MAGIC:
        raise GraphError("core.graph.not-a-graph@1")
    at = 5

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise GraphError("core.graph.truncated@1")
        at += n
        return data[at - n : at]

    def count() -> int:
        n = shift = 0
        while True:
            (b,) = take(1)
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7
            if shift > 63:
                raise GraphError("core.graph.not-canonical@1")

    def some() -> int:
        n = count()
        if n > len(data):  # each takes a byte at least
            raise GraphError("core.graph.truncated@1")
        return n

    def word() -> str:
        try:
            return take(count()).decode()
        except UnicodeDecodeError as e:
            raise GraphError("core.graph.invalid-text@1") from e

    b = Builder(limits)
    n_roots, n_nodes = some(), some()
    roots = [count() for _ in range(n_roots)]
    for _ in range(n_nodes):
        b.reserve()
    for k in range(n_nodes):
        kind = KINDS.get(take(1)[0])
        if kind is None:
            raise GraphError("core.graph.unknown-mark@1")
        tag = word()
        b.define(k, kind, tag, word() if kind == "Scalar" else [count() for _ in range(some())] if kind == "Sequence" else [(count(), count()) for _ in range(some())])
    for r in roots:
        b.root(r)
    graph = b.build()
    if at != len(data) or encode(graph) != data:
        raise GraphError("core.graph.not-canonical@1")
    return graph


def hash64(graph: Graph) -> int:
    return fnv1a(encode(graph))


def codes(docs: DataFrame, profile: str) -> DataFrame:
    """doc_id, status, canonical binary form and its FNV-1a hash (as a signed long) of the graph of each YAML stream."""
    from docloom.sources.scan import each
    from docloom.sources.yaml_doc import graph

    def make(tree: Tree | str) -> tuple:
        if isinstance(tree, str):
            return tree, None, None
        try:
            found = of_tree(graph(tree))
        except GraphError as e:
            return e.code, None, None
        h = hash64(found)
        return "Ok", encode(found), h - (1 << 64) if h >> 63 else h

    return each(docs, profile, make, "status string, pgce binary, hash long")


def write_yaml(graph: Graph) -> str:
    """A YAML stream of the graph's roots in flow style: every node with its tag, shared ones with an anchor, a document each.

    A node that two documents share, or whose own text cannot be quoted, cannot be written.
    """
    count = [0] * len(graph.nodes)
    for at in [*graph.roots, *[x for n in graph.nodes for x in n.edges()]]:
        count[at] += 1
    prefix, done, out = "tag:yaml.org,2002:", set(), []

    def put(at: int, own: set[int]) -> str:
        node = graph.nodes[at]
        if at in own:
            return f"*n{at}"
        if at in done:
            raise GraphError("yaml.materialization.shared-between-documents@1")
        own.add(at)
        tag = f"!!{node.tag[len(prefix) :]}" if node.tag.startswith(prefix) and node.tag[len(prefix) :].isalpha() else f"!<{node.tag}>"
        head = (f"&n{at} " if count[at] > 1 else "") + tag + " "
        if node.kind == "Scalar":
            return head + json.dumps(node.content, ensure_ascii=False).replace("\x7f", "\\u007f").replace("\x85", "\\u0085").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
        if node.kind == "Sequence":
            return head + "[" + ", ".join(put(x, own) for x in node.content) + "]"
        return head + "{" + ", ".join(f"? {put(k, own)} : {put(v, own)}" for k, v in node.content) + "}"

    for root in graph.roots:
        own: set[int] = set()
        out.append("--- " + put(root, own) + "\n")
        done |= own
    return "".join(out)
