import pytest
from hypothesis import given
from hypothesis import strategies as st

from docloom.functions import graphs as G
from docloom.functions import values as V
from docloom.functions.paths import Path, paths
from docloom.functions.project import Rejected, as_object
from docloom.sources import yaml_doc
from docloom.sources.scan import parse

leaf = st.one_of(
    st.just(V.NULL), st.booleans().map(lambda b: V.Value("Boolean", b)), st.integers().map(V.integer), st.floats().map(V.float64),
    st.tuples(st.integers(), st.integers(-50, 50)).map(lambda t: V.decimal(*t)), st.text(st.characters(exclude_categories=["Cs"])).map(V.string), st.binary().map(lambda b: V.Value("Bytes", b)),
)
tree = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=4).map(V.sequence), st.lists(st.tuples(leaf, x), max_size=4).map(V.mapping)), max_leaves=12)


@pytest.mark.parametrize(
    "value, expected",
    [(V.Value("Object", (("a", V.integer(1)),)), "5056434501410a01200201611003010101"), (V.NULL, "50564345010000"), (V.integer(-256), "5056434501100402020100")],
)
def test_golden_bytes(value, expected):
    assert V.encode(value).hex() == expected


@given(tree)
def test_round_trip(value):
    data = V.encode(value)
    assert V.decode(data) == value
    assert V.encode(V.decode(data)) == data


def test_other_spellings_are_refused():
    with pytest.raises(ValueError):
        V.decode(bytes.fromhex("5056434501100402020001"))  # a leading zero byte
    with pytest.raises(ValueError):
        V.decode(b"PVCE\x01\x7f\x00")


def test_numbers_keep_their_identity():
    assert V.decimal_text("1.0") == V.decimal_text("1") == V.decimal_text("10e-1")
    assert V.integer(1) != V.decimal(1, 0)
    assert V.float64(0.0) != V.float64(-0.0) and V.float64(float("nan")) == V.float64(float("nan"))


def test_duplicate_policies():
    v = V.Value("EntryMapping", tuple((V.string(k), V.integer(n)) for n, k in enumerate("aba")))
    assert as_object(v, "FirstWins")[0].data == (("a", V.integer(0)), ("b", V.integer(1)))
    assert as_object(v, "LastWins") == (V.Value("Object", (("b", V.integer(1)), ("a", V.integer(2)))), "Lossy")
    with pytest.raises(Rejected):
        as_object(v)


@given(tree)
def test_transport_round_trip(value):
    text = V.transport(value)
    if "nan" not in text:
        assert V.from_transport(text) == value


@pytest.mark.parametrize("text", ['{"kind":"Integer","value":"01"}', '{"kind":"Integer","value":1}', '{"kind":"Null","value":""}', '{"kind":"Tree"}', '{"kind":"Bytes","value":"0A"}', "[]", '{"kind":"Date","value":"2020-1-1"}'])
def test_other_transport_spellings_are_refused(text):
    with pytest.raises((ValueError, KeyError, TypeError)):
        V.from_transport(text)


def test_moments_round_trip():
    for v in (V.Value("Date", (2020, 2, 29)), V.Value("Time", (1, 2, 3, (5, -3))), V.Value("LocalDateTime", (2020, 1, 2, 3, 4, 5, (0, 0))), V.Value("OffsetDateTime", (2020, 1, 2, 3, 4, 5, (25, -2), -5400))):
        assert V.from_transport(V.transport(v)) == v and V.decode(V.encode(v)) == v


def yaml_graph(text):
    return G.of_tree(yaml_doc.graph(parse(text, "yaml.1.2-core@1")))


def test_graph_golden_bytes():
    assert G.encode(G.Graph((), ())).hex() == "50474345010000"
    b = G.Builder()
    b.root(b.node("Scalar", "t", "x"))
    assert G.encode(b.build()).hex() == "504743450101010020" + "0174" + "0178"


def test_graphs_are_equal_by_shape_and_content():
    a, b = yaml_graph("- &x {k: 1}\n- *x\n"), yaml_graph("[&other {k: 1}, *other]\n")
    assert a == b and G.hash64(a) == G.hash64(b) and G.decode(G.encode(a)) == a
    assert a != yaml_graph("- {k: 1}\n- {k: 1}\n") and a != yaml_graph("- &x {k: 2}\n- *x\n")
    many = yaml_graph("a: 1\n---\n- b\n---\n~\n")
    assert len(many.roots) == 3 and G.decode(G.encode(many)) == many


def test_graph_builder_refuses():
    def code(make):
        b = G.Builder(G.Limits(nodes=3, edges=3, depth=2))
        with pytest.raises(G.GraphError) as e:
            make(b)
            b.build()
        return e.value.code

    def cycle(b):
        x = b.reserve()
        b.define(x, "Sequence", "t", [x])
        b.root(x)
        return b.build()

    assert G.decode(G.encode(cycle(G.Builder()))).nodes[0].content == (0,)
    assert code(lambda b: b.reserve()) == "core.graph.undefined-node@1"
    assert code(lambda b: b.node("Scalar", "t", "x")) == "core.graph.unreachable-node@1"
    assert code(lambda b: b.node("Sequence", "t", [4])) == "core.graph.unknown-node@1"
    assert code(lambda b: [b.reserve() for _ in range(4)]) == "core.graph.resource-limit@1"
    assert code(lambda b: [b.define(b.reserve(), "Scalar", "t", "x"), b.define(0, "Scalar", "t", "y")]) == "core.graph.redefined-node@1"


@given(st.binary(max_size=30), st.integers(0, 60), st.integers(0, 255))
def test_other_graph_spellings_are_refused(tail, at, byte):
    good = G.encode(yaml_graph("a: [1, &x b, *x]\n"))
    for data in (good + tail, good[: at % len(good)], good[: at % len(good)] + bytes([byte]) + good[at % len(good) + 1 :], G.MAGIC + tail):
        try:
            found = G.decode(data)
        except G.GraphError:
            continue
        assert G.encode(found) == data


@given(tree)
def test_paths_lead_to_their_values(value):
    found = paths(value)
    assert all(p.of(value) == v or "Object" in {s[0][:6] for s in p.steps} for p, v in found)
    assert sorted(p for p, _ in found)[0] == Path() and Path().child("ObjectValue", "a") < Path().child("SequenceElement", 0)
    assert not Path() < Path() and Path().child("SequenceElement", 2) < Path().child("SequenceElement", 10)
    with pytest.raises(ValueError):
        Path().child("ObjectValue", 1)


@pytest.mark.parametrize("text", ["a: 1\nb: [x, ~, 1.5, true]\n", "- &x {k: 1}\n- *x\n", "&r [1, *r]\n", "a\n---\n- b\n", "? [1, 2]\n: {x: y}\n", '- "tab\\t\\u0085 é𝄞 \\\\ \\""\n- !custom z\n', "{}\n", "&a {&b k: *b, z: *a}\n"])
def test_graphs_are_written_and_read_back(text):
    graph = yaml_graph(text)
    assert yaml_graph(G.write_yaml(graph)) == graph


def test_graphs_that_documents_share_are_refused():
    b = G.Builder()
    x = b.node("Scalar", "tag:yaml.org,2002:str", "x")
    b.root(x)
    b.root(x)
    with pytest.raises(G.GraphError):
        G.write_yaml(b.build())
