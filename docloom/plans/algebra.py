"""Queries as trees: input, application, concatenation, structural merge; their wire form and validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from docloom.plans.catalog import DOMAINS, SELECTIONS, input_role, operators


class InvalidQuery(ValueError):
    """A query that its domain does not allow; code says why."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


@dataclass(frozen=True)
class Input:
    pass


@dataclass(frozen=True)
class Apply:
    input: object
    operator: str
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Concat:
    branches: tuple


@dataclass(frozen=True)
class StructureOrderMerge:
    branches: tuple


@dataclass(frozen=True)
class Query:
    domain: str
    root: object
    selection: str = "All"
    max_steps: int = 100_000
    max_results: int | None = None


def chain(domain: str, *steps, selection: str = "All") -> Query:
    """A query of one operator after another; a step is a name, or a name with arguments."""
    node: object = Input()
    for step in steps:
        name, args = step if isinstance(step, tuple) else (step, {})
        node = Apply(node, name, args)
    return Query(domain, node, selection)


KINDS = {"String": str, "Integer": int, "Boolean": bool, "Bytes": (bytes, bytearray)}


def validate(query: Query) -> str:
    """Check domain, operators, roles and arguments before anything is planned; gives the role of the result."""
    if query.domain not in DOMAINS:
        raise InvalidQuery("core.query.unknown-domain@1", query.domain)
    if query.selection not in SELECTIONS:
        raise InvalidQuery("core.query.unknown-selection@1", query.selection)
    known, steps = operators(query.domain), 1

    def role(node, depth: int) -> str:
        nonlocal steps
        if depth > 256:
            raise InvalidQuery("core.query.depth@1", "more than 256 levels")
        steps += 1
        if isinstance(node, Input):
            return input_role(query.domain)
        if isinstance(node, (Concat, StructureOrderMerge)):
            if not node.branches:
                raise InvalidQuery("core.query.empty-branches@1", "no branch")
            if isinstance(node, StructureOrderMerge) and query.domain.startswith("core."):
                raise InvalidQuery("core.query.target-unavailable@1", "structural merge")
            roles = {role(b, depth + 1) for b in node.branches}
            if len(roles) > 1:
                raise InvalidQuery("core.query.role-mismatch@1", ", ".join(sorted(roles)))
            return roles.pop()
        op = known.get(node.operator)
        if op is None:
            raise InvalidQuery("core.query.unknown-operator@1", node.operator)
        came = role(node.input, depth + 1)
        if op.source not in ("*", came) and not (op.source == "XmlElement" and came == "XmlContentItem"):
            raise InvalidQuery("core.query.role-mismatch@1", f"{op.name} takes {op.source}, not {came}")
        if set(node.args) != set(op.args):
            raise InvalidQuery("core.query.arguments@1", f"{op.name} takes {sorted(op.args)}")
        for name, kind in op.args.items():
            value = node.args[name]
            if not isinstance(value, KINDS[kind]) or (kind == "Integer" and (isinstance(value, bool) or value < 0)):
                raise InvalidQuery("core.query.argument-kind@1", f"{op.name}: {name} must be {kind}")
        if op.words and node.args[op.chosen or next(iter(op.args))] not in op.words:
            raise InvalidQuery("core.query.argument-vocabulary@1", f"{op.name}: {node.args}")
        if op.name == "core.take" and node.args["count"] >= 1 << 64:
            raise InvalidQuery("core.query.argument-vocabulary@1", "a count of more than 64 bits")
        if op.name.endswith("where-tag") and not node.args["tag"]:
            raise InvalidQuery("core.query.argument-vocabulary@1", "an empty tag")
        units = {"properties.property-key-equals": "key", "properties.syntax-utf16be-equals": "code_units"}.get(op.name)
        if units and len(node.args[units]) % 2:
            raise InvalidQuery("core.query.argument-vocabulary@1", "an odd number of bytes")
        return came if op.target == "*" else op.target

    out = role(query.root, 0)
    if steps > query.max_steps:
        raise InvalidQuery("core.query.resource-limit@1", f"{steps} steps")
    return out


def to_wire(query: Query) -> str:
    def one(node) -> dict:
        if isinstance(node, Input):
            return {"node": "Input"}
        if isinstance(node, Apply):
            args = [{"name": k, "kind": next(n for n, t in KINDS.items() if isinstance(v, t) and not (n == "Integer" and isinstance(v, bool))), "value": v.hex() if isinstance(v, bytes) else v} for k, v in node.args.items()]
            return {"node": "Apply", "input": one(node.input), "operator": node.operator, "version": 1, "arguments": args}
        return {"node": type(node).__name__, "branches": [one(b) for b in node.branches]}

    return json.dumps({"contract": "core.query-definition@1", "domain": query.domain, "selection": query.selection, "root": one(query.root)}, separators=(",", ":"))


def from_wire(text: str) -> Query:
    """Strict: fields that are missing, unknown or in another order are refused."""

    def fields(x, *names: str) -> list:
        if not isinstance(x, dict) or tuple(x) != names:
            raise InvalidQuery("core.query.wire@1", f"fields must be {names}")
        return list(x.values())

    def one(x):
        kind = x.get("node") if isinstance(x, dict) else None
        if kind == "Input":
            fields(x, "node")
            return Input()
        if kind == "Apply":
            _, inner, name, version, args = fields(x, "node", "input", "operator", "version", "arguments")
            if version != 1:
                raise InvalidQuery("core.query.operator-version@1", str(version))
            found = {}
            for a in args:
                n, k, v = fields(a, "name", "kind", "value")
                found[n] = bytes.fromhex(v) if k == "Bytes" else v
            return Apply(one(inner), name, found)
        if kind in ("Concat", "StructureOrderMerge"):
            _, branches = fields(x, "node", "branches")
            return (Concat if kind == "Concat" else StructureOrderMerge)(tuple(map(one, branches)))
        raise InvalidQuery("core.query.wire@1", str(kind))

    contract, domain, selection, root = fields(json.loads(text), "contract", "domain", "selection", "root")
    if contract != "core.query-definition@1":
        raise InvalidQuery("core.query.wire@1", contract)
    query = Query(domain, one(root), selection)
    validate(query)
    return query
