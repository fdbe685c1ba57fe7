import json

import pytest

from docloom.functions import values as V
from docloom.functions.edits import OPERATIONS, commit, edit_documents
from docloom.functions.values import Value, encode, integer, sequence, string
from docloom.sources.scan import formed, parse

ONE, TEXT = integer(1), string("n w")


def node(text, profile, role, name=None, kind=None):
    rows = parse(text, profile).rows
    return next(k for k, r in enumerate(rows, 1) if r["role"] == role and (name is None or r.get("name") == name) and (kind is None or r["kind"] == kind))


J, T, Y = ("json.strict@1", '{"a": 1, "b": [2, 3], "c": {}}'), ("toml.1.0@1", "a = 1\nb = [2, 3]\n[t]\nc = 4\n"), ("yaml.1.2-core@1", "a: &x 1\nb:\n  - 2\n  - *x\nc: {d: 4}\n")
I, P = ("ini.windows@1", "[A]\r\nx=1\r\ny=2\r\n[B]\r\nz=3\r\n"), ("java-properties.reader@1", "a=1\nb = 2\nempty\n")
X, L, H = ("xml.1.0-safe@1", '<r a="1"><b>t</b><c/></r>'), ("plist.xml@1", '<plist version="1.0"><dict><key>a</key><integer>1</integer><key>b</key><array><true/></array></dict></plist>'), ("hcl.native@1", 'a = 1\nb "l" {\n  c = 2\n}\n')
CASES = [
    (J, "insert-member", ("JsonValue",), {"name": "d", "value": ONE}, '{"a": 1, "b": [2, 3], "c": {}, "d": 1}'),
    (J, "insert-member", ("JsonValue",), {"name": "d", "value": ONE, "placement": "Start"}, '{"d": 1, "a": 1, "b": [2, 3], "c": {}}'),
    (J, "remove-member", ("JsonObjectMember", "a"), {}, '{"b": [2, 3], "c": {}}'),
    (J, "remove-member", ("JsonObjectMember", "c"), {}, '{"a": 1, "b": [2, 3]}'),
    (J, "move-member", ("JsonObjectMember", "a"), {"placement": "End"}, '{"b": [2, 3], "c": {}, "a": 1}'),
    (J, "rename-member", ("JsonObjectMember", "a"), {"name": "z"}, '{"z": 1, "b": [2, 3], "c": {}}'),
    (J, "insert-array-element", ("JsonValue", None, "Array"), {"value": ONE}, '{"a": 1, "b": [2, 3, 1], "c": {}}'),
    (J, "remove-array-element", ("JsonArrayElement",), {}, '{"a": 1, "b": [3], "c": {}}'),
    (J, "replace-scalar-semantic", ("JsonValue", None, "Integer"), {"value": TEXT}, '{"a": "n w", "b": [2, 3], "c": {}}'),
    (J, "replace-scalar-literal", ("JsonValue", None, "Integer"), {"literal": "1.0"}, '{"a": 1.0, "b": [2, 3], "c": {}}'),
    (T, "insert-entry", ("TomlItem",), {"name": "n", "value": ONE}, "a = 1\nb = [2, 3]\nn = 1\n[t]\nc = 4\n"),
    (T, "remove-entry", ("TomlEntry", "a"), {}, "b = [2, 3]\n[t]\nc = 4\n"),
    (T, "rename-entry", ("TomlEntry", "c"), {"name": "d e"}, 'a = 1\nb = [2, 3]\n[t]\n"d e" = 4\n'),
    (T, "insert-array-element", ("TomlItem", None, "Array"), {"value": ONE, "placement": "Start"}, "a = 1\nb = [1, 2, 3]\n[t]\nc = 4\n"),
    (T, "remove-array-element", ("TomlArrayElement",), {}, "a = 1\nb = [3]\n[t]\nc = 4\n"),
    (T, "replace-scalar-semantic", ("TomlItem", None, "Integer"), {"value": TEXT}, 'a = "n w"\nb = [2, 3]\n[t]\nc = 4\n'),
    (Y, "insert-mapping-entry", ("YamlNode", None, "Mapping"), {"name": "e", "value": ONE}, 'a: &x 1\nb:\n  - 2\n  - *x\nc: {d: 4}\n"e": 1\n'),
    (Y, "insert-sequence-element", ("YamlNode", None, "Sequence"), {"value": ONE, "placement": "Start"}, "a: &x 1\nb:\n  - 1\n  - 2\n  - *x\nc: {d: 4}\n"),
    (Y, "insert-alias", ("YamlNode", None, "Sequence"), {"alias": "x"}, "a: &x 1\nb:\n  - 2\n  - *x\n  - *x\nc: {d: 4}\n"),
    (Y, "remove-mapping-entry", ("YamlMappingEntry", "b"), {}, "a: &x 1\nc: {d: 4}\n"),
    (Y, "remove-sequence-element", ("YamlSequenceElement",), {}, "a: &x 1\nb:\n  - *x\nc: {d: 4}\n"),
    (Y, "rename-anchor", ("YamlAnchorDefinition",), {"name": "k"}, "a: &k 1\nb:\n  - 2\n  - *k\nc: {d: 4}\n"),
    (I, "insert-section", ("IniDocument",), {"name": "C"}, "[A]\r\nx=1\r\ny=2\r\n[B]\r\nz=3\r\n[C]\r\n"),
    (I, "remove-section", ("IniSection", "A"), {}, "[B]\r\nz=3\r\n"),
    (I, "rename-section", ("IniSection", "B"), {"name": "C"}, "[A]\r\nx=1\r\ny=2\r\n[C]\r\nz=3\r\n"),
    (I, "insert-entry", ("IniSection", "A"), {"name": "n", "value": TEXT}, "[A]\r\nx=1\r\ny=2\r\nn=n w\r\n[B]\r\nz=3\r\n"),
    (I, "remove-entry", ("IniEntry", "y"), {}, "[A]\r\nx=1\r\n[B]\r\nz=3\r\n"),
    (I, "rename-entry", ("IniEntry", "y"), {"name": "q"}, "[A]\r\nx=1\r\nq=2\r\n[B]\r\nz=3\r\n"),
    (I, "replace-semantic-value", ("IniEntry", "z"), {"value": TEXT}, "[A]\r\nx=1\r\ny=2\r\n[B]\r\nz=n w\r\n"),
    (P, "insert-property", ("PropertiesDocument",), {"name": "n k", "value": TEXT}, "a=1\nb = 2\nempty\nn\\ k=n w\n"),
    (P, "remove-property", ("PropertiesProperty", "b"), {}, "a=1\nempty\n"),
    (P, "rename-property", ("PropertiesProperty", "b"), {"name": "q"}, "a=1\nq = 2\nempty\n"),
    (P, "replace-semantic-value", ("PropertiesProperty", "empty"), {"value": TEXT}, "a=1\nb = 2\nempty=n w\n"),
    (P, "replace-literal-value", ("PropertiesProperty", "b"), {"literal": "\\u0041"}, "a=1\nb = \\u0041\nempty\n"),
    (X, "replace-text", ("XmlText",), {"value": string("a<b")}, '<r a="1"><b>a&lt;b</b><c/></r>'),
    (X, "insert-attribute", ("XmlElement", "r"), {"name": "n", "value": TEXT}, '<r a="1" n="n w"><b>t</b><c/></r>'),
    (X, "remove-attribute", ("XmlAttribute",), {}, "<r><b>t</b><c/></r>"),
    (X, "rename-attribute", ("XmlAttribute",), {"name": "q"}, '<r q="1"><b>t</b><c/></r>'),
    (X, "set-attribute-value", ("XmlAttribute",), {"value": string('"')}, '<r a="&quot;"><b>t</b><c/></r>'),
    (X, "insert-element", ("XmlElement", "c"), {"name": "n", "value": TEXT}, '<r a="1"><b>t</b><c><n>n w</n></c></r>'),
    (X, "remove-element", ("XmlElement", "b"), {}, '<r a="1"><c/></r>'),
    (X, "rename-element", ("XmlElement", "b"), {"name": "q"}, '<r a="1"><q>t</q><c/></r>'),
    (L, "set-value", ("PlistValue", None, "integer"), {"value": TEXT}, L[1].replace("<integer>1</integer>", "<string>n w</string>")),
    (L, "insert-dict-entry", ("PlistValue", None, "dict"), {"name": "n", "value": ONE}, L[1].replace("</dict>", "<key>n</key><integer>1</integer></dict>")),
    (L, "remove-dict-entry", ("PlistDictEntry", "a"), {}, L[1].replace("<key>a</key><integer>1</integer>", "")),
    (L, "rename-dict-key", ("PlistDictEntry", "a"), {"name": "q"}, L[1].replace(">a<", ">q<")),
    (L, "insert-array-element", ("PlistValue", None, "array"), {"value": ONE, "placement": "Start"}, L[1].replace("<true/>", "<integer>1</integer><true/>")),
    (L, "remove-array-element", ("PlistArrayElement",), {}, L[1].replace("<true/>", "")),
    (H, "set-attribute-value", ("HclAttribute", "c"), {"value": sequence([ONE, TEXT])}, 'a = 1\nb "l" {\n  c = [1, "n w"]\n}\n'),
    (H, "insert-attribute", ("HclBody",), {"name": "n", "value": ONE, "placement": "Start"}, 'n = 1\na = 1\nb "l" {\n  c = 2\n}\n'),
    (H, "remove-attribute", ("HclAttribute", "c"), {}, 'a = 1\nb "l" {\n}\n'),
    (H, "rename-attribute", ("HclAttribute", "a"), {"name": "q"}, 'q = 1\nb "l" {\n  c = 2\n}\n'),
    (H, "insert-block", ("HclBody",), {"name": "k", "labels": ["m"]}, 'a = 1\nb "l" {\n  c = 2\n}\nk "m" {\n}\n'),
    (H, "remove-block", ("HclBlock",), {}, "a = 1\n"),
]


@pytest.mark.parametrize("source, operation, target, args, expected", CASES)
def test_operations(source, operation, target, args, expected):
    profile, text = source
    got = commit(text, profile, [(operation, node(text, profile, *target), args)])
    assert (got["status"], got["text"]) == ("Ok", expected)


def test_every_operation_has_a_case():
    done = {(c[0][0].split(".")[0], c[1]) for c in CASES}
    rest = {(f, o) for f, ops in OPERATIONS.items() for o in ops} - done
    assert rest <= {("toml", "replace-scalar-literal"), ("yaml", "replace-scalar-literal"), ("yaml", "replace-scalar-semantic"), ("ini", "replace-literal-value")}


@pytest.mark.parametrize(
    "source, edits, status",
    [
        (J, [("remove-member", 1, {})], "core.edit.target-role@1"),
        (J, [("no-such", 1, {})], "core.edit.unknown-operation@1"),
        (J, [("insert-member", 1, {"name": "x", "value": ONE, "placement": "After", "anchor": 99})], "core.edit.placement-anchor@1"),
        (J, [("replace-scalar-literal", 3, {"literal": "{"})], "core.edit.reparse@1"),
        (J, [("replace-scalar-literal", 3, {"literal": "1"}), ("replace-scalar-literal", 3, {"literal": "2"})], "core.edit.overlap@1"),
        (X, [("remove-element", 2, {})], "core.edit.root-element@1"),
        (("json.strict@1", "{"), [("insert-member", 1, {"name": "x", "value": ONE})], "core.edit.incomplete-base@1"),
    ],
)
def test_refused(source, edits, status):
    assert commit(source[1], source[0], edits)["status"] == status


def test_edits_over_a_table(spark):
    docs = spark.createDataFrame([(k, f'{{"a": {k}}}') for k in range(5)], "doc_id long, text string")
    requests = spark.createDataFrame([(k, "insert-member", 1, '{"name": "b", "value": "%s"}' % encode(Value("Boolean", True)).hex()) for k in range(3)] + [(3, "remove-member", 1, "{}")], "doc_id long, operation string, node_id int, args string")
    got = {r.doc_id: r for r in edit_documents(docs, requests, "json.strict@1").collect()}
    assert got[2].text == '{"a": 2, "b": true}' and got[3].status == "core.edit.target-role@1" and got[3].text is None and 4 not in got
    assert all(r.text is None and r.patch for r in edit_documents(docs, requests, "json.strict@1", dry_run=True).collect())


def test_representation_policies():
    text, profile = '{"a": 1, "b": "x"}', "json.strict@1"
    number, word = (V.encode(v).hex() for v in (integer(5), string("y")))
    at = next(k for k, r in enumerate(formed(text, profile).rows, 1) if r["role"] == "JsonValue" and r["kind"] == "Integer")
    operation = next(o for o in OPERATIONS["json"] if o.startswith("replace") and "semantic" in o or o == "replace-value" or o == "replace-scalar")
    one = lambda value, policy: commit(text, profile, [(operation, at, {"value": value, "policy": policy})])
    assert one(number, "PreserveCompatible")["text"] == '{"a": 5, "b": "x"}' and one(number, "PreserveElseCanonical")["fallbacks"] == 0
    assert one(word, "PreserveCompatible")["status"] == "core.edit.representation@1" == one(number, "ExactLiteral")["status"]
    assert one(word, "PreserveElseCanonical")["fallbacks"] == 1 and one(word, "CanonicalForProfile")["text"] == '{"a": "y", "b": "x"}'
    assert one(word, "Anything")["status"] == "core.edit.policy@1"


def test_documents_are_planned_and_applied(spark):
    from docloom.functions.convert import apply_plan
    from docloom.functions.edits import plan_documents

    docs = spark.createDataFrame([(1, "a.json", '{"a":1}'), (2, "b.json", "[1"), (3, "c.json", "{}")], "doc_id long, path string, text string")
    args = json.dumps({"name": "n", "value": V.encode(V.integer(2)).hex()})
    requests = spark.createDataFrame([(1, "insert-member", 1, args), (2, "insert-member", 1, args)], "doc_id long, operation string, node_id int, args string")
    plan = plan_documents(docs, requests, "json.strict@1")
    got = {r.path: (r.status, r.code) for r in plan.collect()}
    assert got == {"a.json": ("planned", None), "b.json": ("failed", "core.edit.incomplete-base@1")}
    files = docs.select("path", docs.text.alias("content"))
    after = {r.path: (r.status, r.content) for r in apply_plan(files, plan.filter("status = 'planned'")).collect()}
    assert after["a.json"][0] == "completed" and json.loads(after["a.json"][1]) == {"a": 1, "n": 2}
