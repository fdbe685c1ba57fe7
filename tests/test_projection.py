import json

import pytest

from docloom.functions import project as P
from docloom.functions.values import transport
from docloom.plans.algebra import InvalidQuery, chain
from docloom.plans.cursor import Budget, Cursor, bind, capabilities
from docloom.plans.inline import Failed
from docloom.sources.scan import parse


def plain(v):
    if v.kind == "Object":
        return {k: plain(x) for k, x in v.data}
    if v.kind == "EntryMapping":
        return [(plain(k), plain(x)) for k, x in v.data]
    return [plain(x) for x in v.data] if v.kind == "Sequence" else v.data


def code(make, *args, **policies):
    with pytest.raises(P.Rejected) as e:
        make(*args, **policies)
    return e.value.code


def test_xml_entries():
    tree = parse('<r xmlns:p="u"><a>1</a><p:a>2</p:a><b k="v">t</b><c><d/><d>x</d></c></r>', "xml.1.0-safe@1")
    root = next(k for k, r in enumerate(tree.rows, 1) if r["role"] == "XmlElement")
    assert code(P.xml_entries, tree, root) == "xml.projection.attribute@1"
    assert code(P.xml_entries, tree, root, attributes="Ignore") == "xml.projection.repeated-child@1"
    assert code(P.xml_entries, tree, root, attributes="Ignore", repeated="Last", names="LocalOnly") == "xml.projection.collision@1"
    value, fidelity = P.xml_entries(tree, root, attributes="Ignore", repeated="Last")
    assert plain(value) == {"{}a": "1", "{u}a": "2", "{}b": "t", "{}c": {"{}d": "x"}} and fidelity == "Lossy"
    value, _ = P.xml_entries(tree, root, attributes="Ignore", repeated="First", names="LocalOnly", collision="Last")
    assert plain(value) == {"a": "2", "b": "t", "c": {"d": ""}}
    assert code(P.xml_entries, tree, root, attributes="Prefix", repeated="First") == "xml.projection.text@1"
    value, _ = P.xml_entries(tree, root, attributes="Prefix", text="Ignore", repeated="First", names="Prefixed")
    assert plain(value) == {"a": "1", "p:a": "2", "b": {"@k": "v"}, "c": {"d": ""}}


def test_xml_text():
    tree = parse("<r>a<b>c<![CDATA[d]]></b><!-- no -->e</r>", "xml.1.0-safe@1")
    assert plain(P.xml_text(tree)[0]) == "acde" and plain(P.xml_text(tree, include="TextOnly")[0]) == "ace"


def test_ini_collisions():
    tree = parse("[S]\nk=1\nK=2\n[s]\nz=3\n", "ini.windows@1")
    assert plain(P.ini_value(tree)[0]) == {"S": {"k": "1", "K": "2"}, "s": {"z": "3"}}
    assert code(P.ini_value, tree, "ProfileEquivalent") == "core.projection.duplicate-key@1"
    assert plain(P.ini_value(tree, "ProfileEquivalent", "First")[0]) == {"S": {"k": "1"}} and P.ini_value(tree, "ProfileEquivalent", "Last")[1] == "Transformed"
    assert plain(P.ini_value(tree, "ProfileEquivalent", "Last")[0]) == {"s": {"z": "3"}}


def test_yaml_policies():
    tree = parse("a: &x [1, 2]\nb: *x\n", "yaml.1.2-core@1")
    assert code(P.yaml_value, tree) == "yaml.projection.sharing@1"
    value, fidelity = P.yaml_value(tree, sharing="DuplicateAcyclic")
    assert plain(value) == {"a": [1, 2], "b": [1, 2]} and fidelity == "Transformed"
    assert code(P.yaml_value, parse("&x [*x]\n", "yaml.1.2-core@1"), sharing="DuplicateAcyclic") == "yaml.projection.cycle@1"
    tagged = parse("k: !c [x]\n1: ~\n", "yaml.1.2-core@1")
    assert code(P.yaml_value, tagged) == "yaml.projection.unknown-tag@1"
    value, fidelity = P.yaml_value(tagged, tags="Strip")
    assert plain(value) == [("k", ["x"]), (1, None)] and fidelity == "Lossy"
    assert code(P.yaml_value, tagged, tags="Strip", mapping="RequireObject") == "yaml.projection.not-an-object@1"
    assert P.yaml_value(parse("a: 1\n", "yaml.1.2-core@1"), mapping="RequireEntryMapping")[0].kind == "EntryMapping"
    assert plain(P.yaml_value(parse("1\n---\n2\n", "yaml.1.2-core@1"), 1)[0]) == 2


def test_hcl_expressions():
    tree = parse('a = 1\nb "l" {\n  c = a + 1\n}\n', "hcl.native@1")
    assert code(P.hcl_value, tree) == "hcl.projection.non-literal@1"
    value, fidelity = P.hcl_value(tree, "Project")
    assert fidelity == "Transformed" and '"hcl.expression@1"' in transport(value) and "a + 1" in transport(value)
    assert transport(P.hcl_value(parse("a = 1\n", "hcl.native@1"))[0]) == transport(parse("a = 1\n", "hcl.native@1").value)


def test_projections_over_tables(spark):
    docs = spark.createDataFrame([(1, "a: &x 1\nb: *x\n"), (2, "a: [\n"), (3, "c: 2\n")], "doc_id long, text string")
    got = {r.doc_id: (r.status, r.fidelity) for r in P.project_with(docs, "yaml.1.2-core@1", P.yaml_value).collect()}
    assert got[1][0] == "yaml.projection.sharing@1" and got[2][0].startswith("yaml.parse") and got[3] == ("Ok", "Exact")


MEMBERS = chain("json.native-semantic-query@1", "json.try-object-members", "json.member-value", "json.try-array-elements", "json.array-element-value")


def test_cursor_is_lazy_and_bounded():
    tree = parse(json.dumps({"a": list(range(1000)), "b": [7]}), "json.strict@1")
    budget = Budget(steps=20)
    cursor = Cursor(MEMBERS, tree, budget)
    assert [next(cursor)["text"] for _ in range(3)] == ["0", "1", "2"] and budget.steps > 5
    with pytest.raises(Failed, match="resource-limit"):
        list(cursor)
    assert len(list(Cursor(MEMBERS, tree))) == 1001
    with pytest.raises(Failed, match="resource-limit"):
        list(Cursor(MEMBERS, tree, Budget(results=10)))
    asked = []
    with pytest.raises(Failed, match="cancelled"):
        list(Cursor(MEMBERS, tree, Budget(cancelled=lambda: asked.append(1) or len(asked) > 5)))
    one = Cursor(chain("json.native-semantic-query@1", "json.try-object-members", selection="RequireOne"), tree)
    with pytest.raises(Failed, match="cardinality"):
        next(one)
    cursor = Cursor(MEMBERS, tree)
    next(cursor)
    cursor.close()
    assert list(cursor) == []


def test_binding_asks_for_capabilities():
    assert bind(MEMBERS, capabilities()) is MEMBERS
    with pytest.raises(InvalidQuery) as e:
        bind(MEMBERS, capabilities() - {"json.member-value"})
    assert e.value.code == "core.query.missing-capability@1"
