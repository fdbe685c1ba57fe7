"""Edit operations of each family, planned as replacements in the source and committed all or nothing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.materialize import STYLES, _point, _toml_key, _toml_value, _xml_text, quoted, write_json, write_properties, write_yaml
from docloom.functions.values import Value, decode
from docloom.sources.scan import formed
from docloom.sources.tree import Failure, Tree

Change = tuple[int, int, str]


def _refuse(code: str):
    raise Failure(f"core.edit.{code}@1")


class Source:
    """A tree with what planners ask of it. Offsets are in characters."""

    def __init__(self, tree: Tree):
        self.tree, self.text = tree, tree.text

    def row(self, node: int, *roles: str) -> dict:
        if not 1 <= node <= len(self.tree.rows) or (roles and self.tree[node]["role"] not in roles):
            _refuse("target-role")
        return self.tree[node]

    def kids(self, node: int, *roles: str) -> list[int]:
        found = [k for k, r in enumerate(self.tree.rows, 1) if r["parent_id"] == node and r["role"] in roles]
        return sorted(found, key=lambda k: (self.tree[k]["ordinal"], k))

    def span(self, node: int) -> tuple[int, int]:
        r = self.tree[node]
        more = [self.tree[r[c]]["end_byte"] for c in ("value_id",) if r.get(c)]
        return r["start_byte"], max([r["end_byte"], *more])

    def lines(self, node: int) -> tuple[int, int]:
        """The whole lines of a node, the break after them included."""
        s, e = self.span(node)
        start = self.text.rfind("\n", 0, s) + 1
        end = e if self.text[e - 1 : e] == "\n" else self.text.find("\n", e) + 1
        return start, end or len(self.text)

    def newline(self) -> str:
        return "\r\n" if "\r\n" in self.text else "\n"

    def insert_in_list(self, node: int, items: list[int], new: str, args: dict) -> Change:
        """Into items with commas between brackets: Start, End, Before or After an anchor."""
        place, anchor = args.get("placement", "End"), args.get("anchor")
        if place in ("Before", "After") and anchor not in items:
            _refuse("placement-anchor")
        if not items:
            at = self.tree[node]["start_byte"] + 1
            return at, at, new
        if place in ("Start", "Before"):
            at = self.span(items[0] if place == "Start" else anchor)[0]
            return at, at, new + ", "
        at = self.span(items[-1] if place == "End" else anchor)[1]
        return at, at, ", " + new

    def remove_from_list(self, items: list[int], node: int) -> Change:
        k = items.index(node)
        if k + 1 < len(items):
            return self.span(node)[0], self.span(items[k + 1])[0], ""
        if k:
            return self.span(items[k - 1])[1], self.span(node)[1], ""
        return *self.span(node), ""

    def insert_line(self, items: list[int], new: str, args: dict, empty: int) -> Change:
        """A line among the lines of items; `empty` is where it goes if there are none."""
        place, anchor = args.get("placement", "End"), args.get("anchor")
        if place in ("Before", "After") and anchor not in items:
            _refuse("placement-anchor")
        if not items:
            at = empty
        elif place in ("Start", "Before"):
            at = self.lines(items[0] if place == "Start" else anchor)[0]
        else:
            at = self.lines(items[-1] if place == "End" else anchor)[1]
        lead = self.newline() if at and self.text[at - 1] != "\n" else ""
        return at, at, lead + new + self.newline()

    def first_line_end(self, node: int) -> int:
        at = self.text.find("\n", self.tree[node]["start_byte"])
        return at + 1 if at >= 0 else len(self.text)

    def name(self, node: int, old: str, new: str) -> Change:
        """Replace the first spelling of a name inside a node."""
        s, e = self.span(node)
        at = self.text.find(old, s, e)
        return (at, at + len(old), new) if at >= 0 else _refuse("name-not-found")


def _value(args: dict) -> Value:
    return args["value"] if isinstance(args["value"], Value) else decode(bytes.fromhex(args["value"]))


def _flow(v: Value) -> str:
    return write_yaml(v, True)


def _hcl(v: Value) -> str:
    if v.kind == "Decimal":
        return _point(v) if v.data[1] < 0 else f"{v.data[0]}e{v.data[1]}"
    if v.kind == "Sequence":
        return "[" + ", ".join(map(_hcl, v.data)) + "]"
    return quoted(v.data).replace("${", "$${").replace("%{", "%%{") if v.kind == "String" else write_json(v)


def _plist(v: Value) -> str:
    tree = Value("Object", (("record", Value("String", "plist.value-tree@1")), ("root", v)))
    return re.search(r'<plist version="1.0">\n(.*)</plist>', STYLES["plist.xml-canonical@1"][0](tree), re.S)[1].strip()


def _plain(v: Value) -> str:
    return v.data if v.kind == "String" else _refuse("value-kind")


def _comma(kind: str, role: str, holder: str, write: Callable) -> dict[str, Callable]:
    def insert(s: Source, n: int, a: dict) -> list[Change]:
        s.row(n, holder)
        head = write(Value("String", a["name"])) + ": " if kind == "member" else ""
        return [s.insert_in_list(n, s.kids(n, role), head + write(_value(a)), a)]

    def remove(s: Source, n: int, a: dict) -> list[Change]:
        return [s.remove_from_list(s.kids(s.row(n, role)["parent_id"], role), n)]

    return {f"insert-{kind}": insert, f"remove-{kind}": remove}


def _scalar(role: str, write: Callable) -> dict[str, Callable]:
    def semantic(s: Source, n: int, a: dict) -> list[Change]:
        s.row(n, role)
        return [(*s.span(n), write(_value(a)))]

    def literal(s: Source, n: int, a: dict) -> list[Change]:
        s.row(n, role)
        return [(*s.span(n), a["literal"])]

    return {"replace-scalar-semantic": semantic, "replace-scalar-literal": literal}


def _move_member(s: Source, n: int, a: dict) -> list[Change]:
    items = s.kids(s.row(n, "JsonObjectMember")["parent_id"], "JsonObjectMember")
    text = s.text[slice(*s.span(n))]
    if a.get("anchor") == n:
        _refuse("placement-anchor")
    gone, rest = s.remove_from_list(items, n), [i for i in items if i != n]
    return [gone, s.insert_in_list(s.tree[n]["parent_id"], rest, text, a)] if rest else []


def _rename(role: str, write: Callable) -> Callable:
    def act(s: Source, n: int, a: dict) -> list[Change]:
        r = s.row(n, role)
        m = re.compile(r'"(?:[^"\\]|\\.)*"|\'[^\']*\'|[^\s=:\[\]{}]+').match(s.text, r["start_byte"])
        return [(m.start(), m.end(), write(a["name"]))]

    return act


def _toml_insert(s: Source, n: int, a: dict) -> list[Change]:
    kind, items = s.row(n, "TomlItem")["kind"], s.kids(n, "TomlEntry")
    new = f"{_toml_key(a['name'])} = {_toml_value(_value(a))}"
    if kind == "InlineTable":
        return [s.insert_in_list(n, items, new, a)]
    own = [i for i in items if s.tree[s.tree[i]["value_id"]]["kind"] not in ("Table", "ImplicitTable", "ArrayOfTables", "DottedTable")]
    return [s.insert_line(own, new, a, 0 if s.tree[n]["parent_id"] is None else s.first_line_end(n))]


def _toml_remove(s: Source, n: int, a: dict) -> list[Change]:
    parent = s.row(n, "TomlEntry")["parent_id"]
    if s.tree[parent]["kind"] == "InlineTable":
        return [s.remove_from_list(s.kids(parent, "TomlEntry"), n)]
    if s.tree[s.tree[n]["value_id"]]["kind"] in ("Table", "ImplicitTable", "ArrayOfTables", "DottedTable"):
        _refuse("table-entry")
    return [(*s.lines(n), "")]


def _line(role: str) -> Callable:
    return lambda s, n, a: [(*s.lines(n), "")] if s.row(n, role) else []


def _yaml_insert(kind: str) -> Callable:
    role = "YamlSequenceElement" if kind == "sequence-element" else "YamlMappingEntry"

    def act(s: Source, n: int, a: dict) -> list[Change]:
        holder = s.row(n, "YamlNode")
        if holder["kind"] != ("Sequence" if kind == "sequence-element" else "Mapping"):
            _refuse("target-role")
        body = "*" + a["alias"] if "alias" in a else _flow(_value(a))
        new = body if kind == "sequence-element" else f"{_flow(Value('String', a['name']))}: {body}"
        items = s.kids(n, role)
        if s.text[holder["start_byte"]] in "[{":
            return [s.insert_in_list(n, items, new, a)]
        lead = " " * (s.tree[items[0]]["start_byte"] - s.text.rfind("\n", 0, s.tree[items[0]]["start_byte"]) - 1)
        return [s.insert_line(items, lead + ("- " if kind == "sequence-element" else "") + new, a, holder["start_byte"])]

    return act


def _yaml_remove(role: str) -> Callable:
    def act(s: Source, n: int, a: dict) -> list[Change]:
        parent = s.row(n, role)["parent_id"]
        items = s.kids(parent, role)
        if s.text[s.tree[parent]["start_byte"]] in "[{":
            return [s.remove_from_list(items, n)]
        return [(*s.lines(n), "")] if len(items) > 1 else [(*s.span(parent), "[]" if role == "YamlSequenceElement" else "{}")]

    return act


def _rename_anchor(s: Source, n: int, a: dict) -> list[Change]:
    r = s.row(n, "YamlAnchorDefinition")
    uses = [k for k, x in enumerate(s.tree.rows, 1) if x["role"] == "YamlAliasOccurrence" and x["target_id"] == r["target_id"]]
    return [s.name(n, "&" + r["name"], "&" + a["name"]), *[(*s.span(k), "*" + a["name"]) for k in uses]]


def _ini_insert_section(s: Source, n: int, a: dict) -> list[Change]:
    s.row(n, "IniDocument")
    at = len(s.text)
    return [(at, at, ("" if not s.text or s.text.endswith("\n") else s.newline()) + f"[{a['name']}]{s.newline()}")]


def _ini_remove_section(s: Source, n: int, a: dict) -> list[Change]:
    s.row(n, "IniSection")
    later = [r["start_byte"] for r in s.tree.rows if r["role"] == "IniSection" and r["start_byte"] > s.tree[n]["start_byte"]]
    return [(s.lines(n)[0], min(later, default=len(s.text)), "")]


def _ini_insert(s: Source, n: int, a: dict) -> list[Change]:
    s.row(n, "IniSection")
    return [s.insert_line(s.kids(n, "IniEntry"), f"{a['name']}={_plain(_value(a))}", a, s.first_line_end(n))]


def _ini_value(s: Source, n: int, a: dict) -> list[Change]:
    start, end = s.row(n, "IniEntry")["start_byte"], s.span(n)[1]
    m = re.compile("[^=:\r\n]*[=:][ \t]*").match(s.text, start)
    return [(m.end(), end, a["literal"] if "literal" in a else _plain(_value(a)))] if m else _refuse("no-delimiter")


def _property_parts(s: Source, n: int) -> tuple[int, int, int]:
    start, end = s.span(n)
    key = re.compile(r"(?:[^\\=: \t\f\r\n]|\\.)*", re.S).match(s.text, start).end()
    return start, key, re.compile(r"[ \t\f]*[=:]?[ \t\f]*").match(s.text, key).end()


def _properties(key: str, value: str) -> tuple[str, str]:
    """A key and a value with their escapes."""
    empty, whole = (write_properties(Value("Object", ((key, Value("String", x)),))).rstrip("\n") for x in ("", value))
    return empty[:-1], whole[len(empty) :]


def _property_insert(s: Source, n: int, a: dict) -> list[Change]:
    s.row(n, "PropertiesDocument")
    return [s.insert_line(s.kids(n, "PropertiesProperty"), "=".join(_properties(a["name"], _plain(_value(a)))), a, len(s.text))]


def _property_rename(s: Source, n: int, a: dict) -> list[Change]:
    start, key, _ = _property_parts(s, n)
    return [(start, key, _properties(a["name"], "")[0])]


def _property_value(s: Source, n: int, a: dict) -> list[Change]:
    _, key, value = _property_parts(s, n)
    new = a["literal"] if "literal" in a else _properties("k", _plain(_value(a)))[1]
    return [(value, s.span(n)[1], new if value > key else "=" + new)]


def _xml_name(s: Source, n: int, a: dict) -> list[Change]:
    r = s.row(n, "XmlElement")
    old = (r["tag"] + ":" if r["tag"] else "") + r["name"]
    start = r["start_byte"] + 1
    close = s.text.rfind("</" + old, start, r["end_byte"])
    return [(start, start + len(old), a["name"]), *([(close + 2, close + 2 + len(old), a["name"])] if close >= 0 and s.text[r["end_byte"] - 2] != "/" else [])]


def _xml_insert_attribute(s: Source, n: int, a: dict) -> list[Change]:
    r = s.row(n, "XmlElement")
    at = re.compile(r"<[^\s/>]+").match(s.text, r["start_byte"]).end()
    last = [s.tree[k]["end_byte"] for k in s.kids(n, "XmlAttribute", "XmlNamespaceBinding")]
    at = max([at, *last])
    return [(at, at, f' {a["name"]}="{_xml_text(_plain(_value(a)), True)}"')]


def _xml_insert_element(s: Source, n: int, a: dict) -> list[Change]:
    r = s.row(n, "XmlElement")
    new = f"<{a['name']}>{_xml_text(_plain(_value(a)))}</{a['name']}>"
    if s.text[r["end_byte"] - 2] == "/":
        old = re.compile(r"<([^\s/>]+)").match(s.text, r["start_byte"])[1]
        return [(r["end_byte"] - 2, r["end_byte"], f">{new}</{old}>")]
    kids = s.kids(n, "XmlElement")
    place, anchor = a.get("placement", "End"), a.get("anchor")
    at = s.text.rfind("</", 0, r["end_byte"])
    if place in ("Before", "After"):
        at = s.span(anchor)[place == "After"] if anchor in kids else _refuse("placement-anchor")
    elif place == "Start" and kids:
        at = s.span(kids[0])[0]
    return [(at, at, new)]


def _xml_remove_element(s: Source, n: int, a: dict) -> list[Change]:
    r = s.row(n, "XmlElement")
    return _refuse("root-element") if s.tree[r["parent_id"]]["role"] == "XmlDocument" else [(*s.span(n), "")]


def _plist_entry(s: Source, n: int, a: dict) -> list[Change]:
    r, entry = s.row(n, "PlistValue"), f"<key>{_xml_text(a['name'])}</key>{_plist(_value(a))}"
    return _plist_insert(s, n, r, s.kids(n, "PlistDictEntry"), entry, a, "dict")


def _plist_element(s: Source, n: int, a: dict) -> list[Change]:
    return _plist_insert(s, n, s.row(n, "PlistValue"), s.kids(n, "PlistArrayElement"), _plist(_value(a)), a, "array")


def _plist_insert(s: Source, n: int, r: dict, items: list[int], new: str, a: dict, kind: str) -> list[Change]:
    if r["kind"] != kind:
        _refuse("target-role")
    if s.text[r["end_byte"] - 2] == "/":
        return [(r["start_byte"], r["end_byte"], f"<{kind}>{new}</{kind}>")]
    place, anchor = a.get("placement", "End"), a.get("anchor")
    if place in ("Before", "After") and anchor not in items:
        _refuse("placement-anchor")
    at = s.text.rfind("</", 0, r["end_byte"]) if place == "End" or not items else s.span(items[0] if place == "Start" else anchor)[place == "After"]
    return [(at, at, new)]


def _plist_rename(s: Source, n: int, a: dict) -> list[Change]:
    m = re.compile(r"<key>([^<]*)</key>").match(s.text, s.row(n, "PlistDictEntry")["start_byte"])
    return [(m.start(1), m.end(1), _xml_text(a["name"]))]


def _hcl_insert(block: bool) -> Callable:
    def act(s: Source, n: int, a: dict) -> list[Change]:
        r, items = s.row(n, "HclBody"), s.kids(n, "HclAttribute", "HclBlock")
        pad = "" if r["parent_id"] is None else "  "
        new = f"{pad}{a['name']}{''.join(' ' + quoted(x) for x in a.get('labels', []))} {{{s.newline()}{pad}}}" if block else f"{pad}{a['name']} = {_hcl(_value(a))}"
        return [s.insert_line(items, new, a, len(s.text) if r["parent_id"] is None else s.first_line_end(r["parent_id"]))]

    return act


def _hcl_set(s: Source, n: int, a: dict) -> list[Change]:
    return [(*s.span(s.row(n, "HclAttribute")["value_id"]), _hcl(_value(a)))]


def _drop(role: str, before: str = "") -> Callable:
    def act(s: Source, n: int, a: dict) -> list[Change]:
        s.row(n, role)
        start, end = s.span(n)
        while before and s.text[start - 1] in before:
            start -= 1
        return [(start, end, "")]

    return act


def _xml_value(s: Source, n: int, a: dict) -> list[Change]:
    r = s.row(n, "XmlAttribute")
    m = re.compile(r"[^=]*=\s*").match(s.text, r["start_byte"])
    return [(m.end(), r["end_byte"], f'"{_xml_text(_plain(_value(a)), True)}"')]


def _replace(role: str, write: Callable) -> Callable:
    return lambda s, n, a: [(*s.span(n), write(_value(a)))] if s.row(n, role) else []


# The edit operations of each family.
OPERATIONS: dict[str, dict[str, Callable]] = {
    "json": {**_comma("member", "JsonObjectMember", "JsonValue", write_json), "move-member": _move_member, "rename-member": _rename("JsonObjectMember", quoted), **_comma("array-element", "JsonArrayElement", "JsonValue", write_json), **_scalar("JsonValue", write_json)},
    "toml": {"insert-entry": _toml_insert, "remove-entry": _toml_remove, "rename-entry": _rename("TomlEntry", _toml_key), **_comma("array-element", "TomlArrayElement", "TomlItem", _toml_value), **_scalar("TomlItem", _toml_value)},
    "yaml": {"insert-alias": _yaml_insert("sequence-element"), "insert-mapping-entry": _yaml_insert("mapping-entry"), "insert-sequence-element": _yaml_insert("sequence-element"), "remove-mapping-entry": _yaml_remove("YamlMappingEntry"), "remove-sequence-element": _yaml_remove("YamlSequenceElement"), "rename-anchor": _rename_anchor, **_scalar("YamlNode", _flow)},
    "ini": {"insert-section": _ini_insert_section, "remove-section": _ini_remove_section, "rename-section": lambda s, n, a: [s.name(n, s.row(n, "IniSection")["name"], a["name"])], "insert-entry": _ini_insert, "remove-entry": _line("IniEntry"), "rename-entry": lambda s, n, a: [s.name(n, s.row(n, "IniEntry")["name"], a["name"])], "replace-semantic-value": _ini_value, "replace-literal-value": _ini_value},
    "java-properties": {"insert-property": _property_insert, "remove-property": _line("PropertiesProperty"), "rename-property": _property_rename, "replace-literal-value": _property_value, "replace-semantic-value": _property_value},
    "xml": {"replace-text": _replace("XmlText", lambda v: _xml_text(_plain(v))), "insert-attribute": _xml_insert_attribute, "remove-attribute": _drop("XmlAttribute", " \t\r\n"), "rename-attribute": _rename("XmlAttribute", str), "set-attribute-value": _xml_value, "insert-element": _xml_insert_element, "remove-element": _xml_remove_element, "rename-element": _xml_name},
    "plist": {"set-value": _replace("PlistValue", _plist), "insert-dict-entry": _plist_entry, "remove-dict-entry": _drop("PlistDictEntry"), "rename-dict-key": _plist_rename, "insert-array-element": _plist_element, "remove-array-element": _drop("PlistArrayElement")},
    "hcl": {"set-attribute-value": _hcl_set, "insert-attribute": _hcl_insert(False), "remove-attribute": _line("HclAttribute"), "rename-attribute": _rename("HclAttribute", str), "insert-block": _hcl_insert(True), "remove-block": _line("HclBlock")},
}


def family_of(profile: str) -> str:
    family = profile.split(".")[0]
    return "json" if family.startswith("json") else family


# How a new value may be spelled in place of an old one.
POLICIES = ("ExactLiteral", "PreserveCompatible", "CanonicalForProfile", "PreserveElseCanonical")


def _category(kind: str | None) -> str:
    low = (kind or "").lower()
    return "number" if low in ("integer", "decimal", "float", "real", "number", "binaryfloat64") else "string" if low in ("string", "template") else low


def represented(tree: Tree, operation: str, node: int, args: dict) -> tuple[dict, bool]:
    """The arguments without their representation policy, and whether a value is spelled canonically though the old one was of
    another category. ExactLiteral takes literals only; PreserveCompatible keeps the category; CanonicalForProfile (the
    default) takes any value; PreserveElseCanonical keeps the category or says that it did not."""
    policy = args.get("policy", "CanonicalForProfile")
    rest = {k: v for k, v in args.items() if k != "policy"}
    if policy not in POLICIES:
        _refuse("policy")
    replaces = operation.startswith(("replace", "set")) and "value" in args
    if not replaces or policy == "CanonicalForProfile":
        return rest, False
    if policy == "ExactLiteral":
        _refuse("representation")
    if not 0 < node <= len(tree.rows):
        return rest, False
    row = tree[node]
    held = row if row.get("value_id") is None else tree[row["value_id"]]
    kept = _category(held.get("kind")) == _category(decode(bytes.fromhex(args["value"])).kind)
    if not kept and policy == "PreserveCompatible":
        _refuse("representation")
    return rest, not kept


def commit(text: str, profile: str, edits: list[tuple[str, int, dict]]) -> dict:
    """Plan all edits on one source, splice them, parse the result; status, text, replacements, digests, and how many values
    fell back to their canonical spelling."""
    base = formed(text, profile)
    out = {"status": "Ok", "base_digest": sha256(text.encode()).hexdigest(), "target_digest": None, "text": None, "replacements": [], "fallbacks": 0}
    if isinstance(base, str) or any(not c.endswith("duplicate-member@1") for c, _, _ in base.diagnostics):
        return out | {"status": "core.edit.incomplete-base@1"}
    try:
        asked = [(op, node, *represented(base, op, node, args)) for op, node, args in edits]
        out["fallbacks"] = sum(fell for *_, fell in asked)
        changes = [c for op, node, args, _ in asked for c in OPERATIONS[family_of(profile)][op](Source(base), node, args)]
        changes.sort(key=lambda c: (c[0], c[1]))
        new, at = "", 0
        for k, (s, e, put) in enumerate(changes):
            if s < at or (k and changes[k - 1][:2] == (s, e)):
                _refuse("overlap")
            new, at = new + text[at:s] + put, e
        new += text[at:]
    except Failure as e:
        return out | {"status": e.code}
    except KeyError as e:
        return out | {"status": "core.edit.unknown-operation@1" if e.args[0] in [o for o, _, _ in edits] else "core.edit.arguments@1"}
    after = formed(new, profile)
    if isinstance(after, str) or any(not c.endswith("duplicate-member@1") for c, _, _ in after.diagnostics):
        return out | {"status": "core.edit.reparse@1"}
    return out | {"target_digest": sha256(new.encode()).hexdigest(), "text": new, "replacements": changes}


def splice(text: str, replacements: list[tuple[int, int, str]]) -> str:
    """Replace byte ranges of a text; overlaps and two insertions at one place are refused."""
    data, out, at = text.encode(), bytearray(), 0
    last = (-1, -1)
    for s, e, new in sorted(replacements, key=lambda r: (r[0], r[1])):
        if s < at or (s, e) == last or not s <= e <= len(data):
            raise Failure("core.edit.overlap@1", s)
        out += data[at:s] + new.encode()
        at, last = e, (s, e)
    return bytes(out + data[at:]).decode()


def patch_documents(docs: DataFrame, edits: DataFrame, profile: str) -> DataFrame:
    """Commit byte edits (doc_id, start_byte, end_byte, replacement) all or nothing for each document.

    Gives doc_id, status, base_digest, target_digest, text and untouched (bytes kept, which must equal those of the base).
    Overlapping edits, or a result that can't be formed completely where the base could, fail the whole document.
    """
    packed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "replacement"))).alias("edits"))
    rows = docs.join(packed, "doc_id").select("doc_id", F.to_json(F.struct("text", "edits")).alias("text"))

    def make_rows(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, packed_row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = json.loads(packed_row)
                out.append((doc, *patch(row.get("text", ""), [(e["start_byte"], e["end_byte"], e.get("replacement", "")) for e in row["edits"]], profile)))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], names=["doc_id", "status", "base_digest", "target_digest", "text", "untouched"])

    return rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(make_rows, "doc_id long, status string, base_digest string, target_digest string, text string, untouched long")


def patch(text: str, replacements: list[tuple[int, int, str]], profile: str) -> tuple:
    base = sha256(text.encode()).hexdigest()
    try:
        new = splice(text, replacements)
    except Failure as e:
        return e.code, base, None, None, None
    before, after = formed(text, profile), formed(new, profile)
    if isinstance(before, str) or any(not d[0].endswith("duplicate-member@1") for d in before.diagnostics):
        return "core.edit.incomplete-base@1", base, None, None, None
    if isinstance(after, str) or any(d not in before.diagnostics and not d[0].endswith("duplicate-member@1") for d in after.diagnostics):
        return "core.edit.reparse@1", base, None, None, None
    kept = len(text.encode()) - sum(e - s for s, e, _ in replacements)
    if not untouched(text, new, replacements):
        return "core.edit.untouched-bytes@1", base, None, None, None
    return "Ok", base, sha256(new.encode()).hexdigest(), new, kept


def gaps(size: int, replacements: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """What a patch keeps: start and end in the base, and start in the target."""
    out, at, shift = [], 0, 0
    for s, e, new in sorted(replacements, key=lambda r: (r[0], r[1])):
        if s > at:
            out.append((at, s, at + shift))
        shift += len(new.encode()) - (e - s)
        at = e
    return out + ([(at, size, at + shift)] if size > at else [])


def untouched(base: str, target: str, replacements: list[tuple[int, int, str]]) -> bool:
    """Does the target hold all bytes of the base outside the replacements, and nothing else but what they put?"""
    old, new = base.encode(), target.encode()
    kept = gaps(len(old), replacements)
    return all(old[s:e] == new[t : t + e - s] for s, e, t in kept) and len(new) == sum(e - s for s, e, _ in kept) + sum(len(r.encode()) for _, _, r in replacements)


def plan_documents(docs: DataFrame, requests: DataFrame, profile: str) -> DataFrame:
    """A batch plan for documents (doc_id, path, text): path, status (planned or failed), code, base_digest, target_digest and
    target, which apply_plan() takes. Nothing is written; documents without requests are not in the plan."""
    done = edit_documents(docs, requests, profile)
    fine = F.col("status") == "Ok"
    return docs.select("doc_id", "path").join(done, "doc_id").select(
        "path", F.when(fine, "planned").otherwise("failed").alias("status"), F.when(~fine, F.col("status")).alias("code"), "base_digest", "target_digest", F.col("text").alias("target")
    )


def edit_documents(docs: DataFrame, requests: DataFrame, profile: str, dry_run: bool = False) -> DataFrame:
    """Commit requests (doc_id, operation, node_id, args: JSON with values in hex of their binary form) to documents.

    All edits of a document are committed, or none: doc_id, status, base_digest, target_digest, text (null in a dry run) and
    patch (JSON of start, end, replacement in characters).
    """
    packed = requests.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("operation", "node_id", "args")))).alias("edits"))
    rows = docs.join(packed, "doc_id").select(F.col("doc_id").cast("long"), "text", "edits")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, text, edits in zip(*[c.to_pylist() for c in batch.columns]):
                r = commit(text or "", profile, [(e["operation"], e["node_id"], json.loads(e.get("args") or "{}")) for e in json.loads(edits)])
                out.append((doc, r["status"], r["base_digest"], r["target_digest"], None if dry_run else r["text"], json.dumps(r["replacements"])))
            types = [pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], names=["doc_id", "status", "base_digest", "target_digest", "text", "patch"])

    return rows.mapInArrow(run, "doc_id long, status string, base_digest string, target_digest string, text string, patch string")
