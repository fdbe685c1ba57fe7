import os

import duckdb
import pytest

from docloom import registry
from docloom.plans.algebra import Apply, Concat, Input, InvalidQuery, Query, StructureOrderMerge, chain, from_wire, to_wire, validate
from docloom.plans.catalog import DOMAINS
from docloom.plans.compile import run
from docloom.plans.inline import query_documents
from docloom.sources.files import save_nodes
from docloom.sources.scan import scan
from docloom.sources.tree import NAMES

ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_every_operator_has_a_query():
    used = set()

    def walk(node):
        if isinstance(node, Apply):
            used.add(node.operator)
            walk(node.input)
        for b in getattr(node, "branches", ()):
            walk(b)

    for query, _, _ in registry.QUERIES.values():
        walk(query.root)
    assert {o.name for _, ops in DOMAINS.values() for o in ops} - used == set()


@pytest.mark.parametrize(
    "query, code",
    [
        (Query("nowhere@1", Input()), "core.query.unknown-domain@1"),
        (chain("json.native-semantic-query@1", "json.member-value"), "core.query.role-mismatch@1"),
        (chain("json.native-semantic-query@1", ("core.take", {"count": -1})), "core.query.argument-kind@1"),
        (chain("json.native-semantic-query@1", "json.try-object-members", ("json.member-name-equals", {})), "core.query.arguments@1"),
        (chain("yaml.native-semantic-query@1", "yaml.documents", "yaml.document-root", ("yaml.where-node-kind", {"kind": "Tree"})), "core.query.argument-vocabulary@1"),
        (chain("ini.native-semantic-query@1", "ini.document-sections", ("ini.section-name-equals", {"name": "a", "comparison": "bogus"})), "core.query.argument-vocabulary@1"),
        (chain("java-properties.lossless-syntax-query@1", ("properties.syntax-utf16be-equals", {"code_units": b"abc"})), "core.query.argument-vocabulary@1"),
        (chain("json.native-semantic-query@1", ("core.take", {"count": 1 << 64})), "core.query.argument-vocabulary@1"),
        (Query("core.portable-value-query@1", StructureOrderMerge((Input(),))), "core.query.target-unavailable@1"),
        (Query("json.native-semantic-query@1", Concat(())), "core.query.empty-branches@1"),
    ],
)
def test_validation(query, code):
    with pytest.raises(InvalidQuery) as e:
        validate(query)
    assert e.value.code == code


def test_wire_form():
    query = chain("java-properties.native-semantic-query@1", "properties.document-properties", ("properties.property-key-equals", {"key": b"\0a"}), selection="First")
    assert from_wire(to_wire(query)) == query
    with pytest.raises(InvalidQuery):
        from_wire(to_wire(query).replace('"version":1', '"version":2'))


def test_one_bad_document_fails_alone(spark):
    docs = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a"'), (3, None), (4, ""), (5, "[" * 400)], "doc_id long, text string")
    nodes = scan(docs, "json.strict@1")
    status = {r.doc_id: r.kind for r in nodes.filter("role = 'Document'").collect()}
    assert status == {1: "Complete", 2: "Recovered", 3: "Recovered", 4: "Recovered", 5: "Failed"}
    found = run(chain("json.native-semantic-query@1", "json.try-object-members", "json.member-value", selection="RequireOne"), nodes)
    assert [r.doc_id for r in found.matches.collect()] == [1]
    assert {r.doc_id for r in found.failures.collect()} == {2, 3, 4}


def test_order_survives_many_partitions(spark):
    docs = spark.createDataFrame([(k, "[" + ",".join(map(str, range(50))) + "]") for k in range(20)], "doc_id long, text string")
    found = run(chain("json.native-semantic-query@1", "json.try-array-elements", "json.array-element-value", ("core.take", {"count": 30})), scan(docs, "json.strict@1", partitions=7))
    assert all(r.text == str(r.pos) for r in found.ordered("text").collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run(chain("ini.native-semantic-query@1", "ini.all-entries"), scan(docs, "ini.portable@1")).matches.count() == 0


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """Node tables of a few documents of each set, kept as a user would keep them."""
    held, old = {}, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def get(source, pieces, view):
        if (source, pieces, view) not in held:
            docs = registry.documents(spark, sf_dir, source).orderBy("doc_id").limit(12).persist()
            held[source, pieces, view] = docs, scan(docs, registry.profile_of(source), pieces, view, partitions=1).persist()
        return held[source, pieces, view]

    yield get
    for k, v in old.items():
        spark.conf.set(k, v)
    for docs, nodes in held.values():
        docs.unpersist()
        nodes.unpersist()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_scan_and_joins_agree(spark, kept, name):
    query, source, view = registry.QUERIES[name]
    docs, nodes = kept(source, "syntax" in query.domain or "hcl." in query.domain, view)
    one, other = query_documents(query, docs, registry.profile_of(source), view), run(query, nodes)
    shown = ["doc_id", *NAMES, "ord"]
    rows = lambda r: sorted(map(repr, r.matches.select(*shown).collect()))
    assert rows(one) == rows(other)
    assert sorted(map(tuple, one.failures.collect())) == (sorted(map(tuple, other.failures.collect())) if other.failures is not None else [])


FIVE = chain("json.native-semantic-query@1", "json.try-object-members", ("json.member-name-equals", {"name": "tags"}), "json.member-value", "json.try-array-elements", "json.array-element-value")


def operators_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: plan.count(k) for k in ("MapInArrow", "MapInPandas", "Exchange", "Join", "InMemoryTableScan")}


def test_a_chain_over_documents_parses_once_and_shuffles_nothing(spark, sf_dir):
    found = query_documents(FIVE, registry.documents(spark, sf_dir, "json"), "json.strict@1")
    assert operators_of(found.ordered("text")) == {"MapInArrow": 1, "MapInPandas": 0, "Exchange": 0, "Join": 0, "InMemoryTableScan": 0}


def test_a_chain_over_a_kept_table_shuffles_nothing(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        save_nodes(registry.nodes(spark, sf_dir, "json"), "kept_nodes", 4)
        found = operators_of(run(FIVE, spark.table("kept_nodes")).matches)
        assert found["Exchange"] == 0 and found["MapInArrow"] == 0 and found["Join"] >= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql("DROP TABLE IF EXISTS kept_nodes")


@pytest.mark.parametrize("profile, section, key, found", [("ini.windows@1", "MAIN", "ID", ["1", "2"]), ("ini.portable@1", "Main", "Id", ["1"]), ("ini.portable@1", "MAIN", "Id", []), ("ini.python-configparser@1", "Main", "ID", ["1", "2"]), ("ini.python-configparser@1", "MAIN", "ID", [])])
def test_names_compare_as_their_profile_says(spark, profile, section, key, found):
    docs = spark.createDataFrame([(1, "[Main]\nId=1\niD=2\n[other]\nId=3\n")], "doc_id long, text string")
    like = {"comparison": "ProfileEquivalent"}
    query = chain("ini.native-semantic-query@1", "ini.document-sections", ("ini.section-name-equals", {"name": section, **like}), "ini.section-entries", ("ini.entry-key-equals", {"key": key, **like}))
    assert [r.text for r in query_documents(query, docs, profile).ordered("text").collect()] == found
    assert [r.text for r in run(query, scan(docs, profile)).ordered("text").orderBy("pos").collect()] == found


def test_arguments_that_look_like_others_stay_what_they_are(spark):
    docs = spark.createDataFrame([(1, "<a><{local}/></a>".replace("{local}", "b")), (2, "<r/>")], "doc_id long, text string")
    query = chain("xml.native-semantic-query@1", "xml.document-root", ("xml.name-equals", {"prefix": "{local}", "local": "a", "namespace": "", "comparison": "OriginalExact"}))
    assert run(query, scan(docs, "xml.1.0-safe@1")).matches.count() == 0 == query_documents(query, docs, "xml.1.0-safe@1").matches.count()
