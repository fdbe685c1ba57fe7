"""Projection policies: what becomes of duplicate keys, and how faithful the result is."""

from __future__ import annotations

from docloom.functions.values import Value, string

FIDELITY = ("Exact", "Transformed", "Lossy")
#: What dropping a duplicate means in each family.
COLLAPSE = {"json": "Lossy", "java-properties": "Lossy", "ini": "Transformed", "plist": "Transformed"}


class Rejected(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def as_object(v: Value, policy: str = "Reject", loss: str = "Lossy", compare=lambda k: k) -> tuple[Value, str]:
    """Entry mappings with string keys as objects. Reject, FirstWins or LastWins decides on duplicates; the last occurrence
    keeps its own position. Gives the value and its fidelity."""
    if v.kind == "Sequence":
        parts = [as_object(x, policy, loss, compare) for x in v.data]
        return Value(v.kind, tuple(p for p, _ in parts)), worst(*[f for _, f in parts])
    if v.kind not in ("Object", "EntryMapping"):
        return v, "Exact"
    entries = [(k if isinstance(k, str) else k.data if k.kind == "String" else None, x) for k, x in v.data]
    if any(k is None for k, _ in entries):
        raise Rejected("core.projection.non-string-key@1")
    fidelity, seen = "Exact", {}
    for at, (k, _) in enumerate(entries):
        if compare(k) in seen:
            if policy == "Reject":
                raise Rejected("core.projection.duplicate-key@1")
            fidelity = loss
            if policy == "FirstWins":
                continue
        seen[compare(k)] = at
    kept = [(entries[at][0], as_object(entries[at][1], policy, loss, compare)) for at in sorted(seen.values())]
    return Value("Object", tuple((k, x) for k, (x, _) in kept)), worst(fidelity, *[f for _, (_, f) in kept])


def worst(*found: str) -> str:
    return FIDELITY[max((FIDELITY.index(f) for f in found), default=0)]


def _kids(tree) -> dict[int | None, list[int]]:
    out: dict[int | None, list[int]] = {}
    for k, r in enumerate(tree.rows, 1):
        out.setdefault(r["parent_id"], []).append(k)
    return out


def xml_text(tree, node: int | None = None, include: str = "TextAndCdata") -> tuple[Value, str]:
    """Character data below an element, or of the whole document, in order. Always a transformation."""
    if include not in ("TextAndCdata", "TextOnly"):
        raise ValueError(include)
    kids, out, stack = _kids(tree), [], [node]
    roles = ("XmlText", "XmlCdata") if include == "TextAndCdata" else ("XmlText",)
    if node is None:
        stack = [k for k, r in enumerate(tree.rows, 1) if r["role"] == "XmlElement" and tree[r["parent_id"]]["role"] != "XmlElement"]
    while stack:
        k = stack.pop()
        if tree[k]["role"] in roles:
            out.append(tree[k]["text"] or "")
        elif tree[k]["role"] == "XmlElement":
            stack += reversed(kids.get(k, []))
    return string("".join(out)), "Transformed"


def xml_entries(tree, node: int, attributes: str = "Reject", text: str = "Reject", repeated: str = "Reject", names: str = "UriBracketed", collision: str = "Reject") -> tuple[Value, str]:
    """An element as an object of its child elements, each a text or again an object.

    attributes: Reject, Ignore, or Prefix (keys that start with @). text beside child elements: Reject or Ignore (white space
    never counts). repeated children of one expanded name: Reject, First or Last. names: LocalOnly, Prefixed or UriBracketed.
    collision: what becomes of different names with one key. What is dropped makes the result Lossy, else it is Transformed.
    """
    kids, fidelity = _kids(tree), "Transformed"

    def key(r: dict) -> str:
        if names == "LocalOnly":
            return r["name"]
        if names == "Prefixed":
            return f"{r['tag']}:{r['name']}" if r.get("tag") else r["name"]
        return f"{{{r.get('cmp_name') or ''}}}{r['name']}"

    def one(at: int) -> Value:
        nonlocal fidelity
        rows = [(k, tree[k]) for k in kids.get(at, [])]
        own = [r for _, r in rows if r["role"] == "XmlAttribute"]
        below = [(k, r) for k, r in rows if r["role"] == "XmlElement"]
        said = "".join(r["text"] or "" for _, r in rows if r["role"] in ("XmlText", "XmlCdata"))
        if own and attributes == "Reject":
            raise Rejected("xml.projection.attribute@1")
        if own and attributes == "Ignore":
            fidelity, own = "Lossy", []
        if not below and not own:
            return string(said)
        if said.strip():
            if text == "Reject":
                raise Rejected("xml.projection.text@1")
            fidelity = "Lossy"
        found: dict[str, tuple[tuple, object]] = {"@" + key(r): (("@", r["name"], r.get("cmp_name")), string(r["text"] or "")) for r in own}
        for k, r in below:
            name, who = key(r), ("", r["name"], r.get("cmp_name"))
            if name in found:
                rule = repeated if found[name][0] == who else collision
                if rule == "Reject":
                    raise Rejected("xml.projection.repeated-child@1" if found[name][0] == who else "xml.projection.collision@1")
                fidelity = "Lossy"
                if rule == "First":
                    continue
                del found[name]
            found[name] = (who, one(k))
        return Value("Object", tuple((n, v) for n, (_, v) in found.items()))

    value = one(node)
    return value, fidelity


def ini_value(tree, comparison: str = "OriginalExact", collision: str = "Reject") -> tuple[Value, str]:
    """Sections and entries as objects. Names that compare equal collide: Reject, First, or Last, which keeps its own place."""
    if comparison not in ("OriginalExact", "ProfileEquivalent") or collision not in ("Reject", "First", "Last"):
        raise ValueError(f"{comparison}, {collision}")
    fidelity = "Exact"

    def settled(rows: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
        nonlocal fidelity
        found: dict[str, tuple[int, dict]] = {}
        for k, r in rows:
            name = r["name"] if comparison == "OriginalExact" else r["cmp_name"]
            if name in found:
                if collision == "Reject":
                    raise Rejected("core.projection.duplicate-key@1")
                fidelity = "Transformed"
                if collision == "First":
                    continue
                del found[name]
            found[name] = (k, r)
        return list(found.values())

    numbered = list(enumerate(tree.rows, 1))
    entries = lambda k: [(n, r) for n, r in numbered if r["role"] == "IniEntry" and r["parent_id"] == k]
    sections = settled([(k, r) for k, r in numbered if r["role"] == "IniSection"])
    value = Value("Object", tuple((s["name"], Value("Object", tuple((e["name"], string(e["text"] or "")) for _, e in settled(entries(k))))) for k, s in sections))
    return value, fidelity


# Tags whose content a portable value can hold.
KNOWN_TAGS = {f"tag:yaml.org,2002:{t}" for t in ("null", "bool", "int", "float", "str", "seq", "map", "timestamp", "binary")}


def yaml_value(tree, document: int = 0, sharing: str = "Reject", tags: str = "RequireKnown", mapping: str = "BestExact") -> tuple[Value, str]:
    """The value of a document of a stream.

    sharing: Reject aliases, or DuplicateAcyclic. tags: RequireKnown, or Strip to what the node's kind holds. mapping:
    BestExact gives an object where all keys are distinct strings, else an entry mapping; RequireObject; RequireEntryMapping.
    """
    from docloom.functions.values import sequence

    old = getattr(tree, "old", False)
    docs = [r for r in tree.rows if r["role"] == "YamlDocument"]
    if document >= len(docs):
        raise Rejected("core.projection.unavailable@1")
    kids, fidelity, seen, path = _kids(tree), "Exact", set(), set()

    def one(node: int) -> Value:
        nonlocal fidelity
        if node in path:
            raise Rejected("yaml.projection.cycle@1")
        if node in seen:
            if sharing == "Reject":
                raise Rejected("yaml.projection.sharing@1")
            fidelity = worst(fidelity, "Transformed")
        seen.add(node)
        r = tree[node]
        tag = r["tag"]
        if tag not in KNOWN_TAGS:
            if tags == "RequireKnown":
                raise Rejected("yaml.projection.unknown-tag@1")
            fidelity = "Lossy"
        path.add(node)
        try:
            own = sorted((tree[k] for k in kids.get(node, []) if tree[k]["role"] in ("YamlSequenceElement", "YamlMappingEntry")), key=lambda x: x["ordinal"])
            if r["kind"] == "Sequence":
                return sequence([one(e["value_id"]) for e in own])
            if r["kind"] == "Mapping":
                pairs = [(one(e["key_id"]), one(e["value_id"])) for e in own]
                names = [k.data for k, _ in pairs if k.kind == "String"]
                plain = len(names) == len(pairs) == len(set(names))
                if mapping == "RequireObject" and not plain:
                    raise Rejected("yaml.projection.not-an-object@1")
                if plain and mapping != "RequireEntryMapping":
                    return Value("Object", tuple((k.data, v) for k, v in pairs))
                return Value("EntryMapping", tuple(pairs))
            return tree.scalars[node] if tag in KNOWN_TAGS and node in tree.scalars else string(r["text"] or "")
        finally:
            path.discard(node)

    value = one(docs[document]["value_id"])
    return value, fidelity


def hcl_value(tree, expressions: str = "Fail") -> tuple[Value, str]:
    """The body of a document as a record. Expressions that are no literals fail, or are Projected as records of their kind
    and text."""
    from docloom.functions.values import sequence

    if expressions not in ("Fail", "Project"):
        raise ValueError(expressions)
    kids, fidelity = _kids(tree), "Exact"

    def expression(node: int) -> Value:
        nonlocal fidelity
        r = tree[node]
        if node in tree.scalars:
            return tree.scalars[node]
        if expressions == "Fail":
            raise Rejected("hcl.projection.non-literal@1")
        fidelity = "Transformed"
        return Value("Object", (("record", string("hcl.expression@1")), ("kind", string(r["kind"])), ("text", string(tree.text[r["start_byte"] : r["end_byte"]]))))

    def body(node: int) -> Value:
        out = []
        for k in sorted((k for k in kids.get(node, []) if tree[k]["role"] in ("HclAttribute", "HclBlock")), key=lambda k: tree[k]["ordinal"]):
            r = tree[k]
            if r["role"] == "HclAttribute":
                out.append(Value("Object", (("kind", string("attribute")), ("name", string(r["name"])), ("value", expression(r["value_id"])))))
            else:
                labels = [string(tree[x]["text"]) for x in kids.get(k, []) if tree[x]["role"] == "HclBlockLabel"]
                out.append(Value("Object", (("kind", string("block")), ("type", string(r["name"])), ("labels", sequence(labels)), ("body", body(r["value_id"])))))
        return sequence(out)

    root = next(k for k, r in enumerate(tree.rows, 1) if r["role"] == "HclBody" and r["parent_id"] is None)
    value = Value("Object", (("record", string("hcl.body@1")), ("body", body(root))))
    return value, fidelity


def project_with(docs, profile: str, make, **policies):
    """doc_id, status, fidelity and transport JSON of each document under one of the projections above."""
    from docloom.functions.values import transport
    from docloom.sources.scan import each

    def run(tree) -> tuple:
        if isinstance(tree, str):
            return tree, None, None
        if any(not c.endswith("duplicate-member@1") for c, _, _ in tree.diagnostics):
            return "core.projection.unavailable@1", None, None
        try:
            value, fidelity = make(tree, **policies)
        except Rejected as e:
            return e.code, None, None
        return "Ok", fidelity, transport(value)

    return each(docs, profile, run, "status string, fidelity string, value string")
