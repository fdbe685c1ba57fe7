"""Registered queries: one for each operator, over documents rendered from whole tables, each with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.algebra import Apply, Concat, Input, Query, StructureOrderMerge, chain
from docloom.plans.inline import query_documents
from docloom.sources.scan import scan
from docloom.sources.tree import NAMES

#: Every fifth customer's document repeats a key.
DUP = "c_custkey % 5 = 0"
#: Documents of a customer: @k@ key, @n@ name, @g@ segment, @m@ nation; @+...@ only where DUP holds.
TEXTS = {
    "json": ("json.strict@1", '{"id":@k@,"name":"@n@","tags":["@g@",@m@],"sub":{"x":1.50}@+,"id":0@}'),
    "toml": ("toml.1.0@1", 'id = @k@\nname = "@n@"\ntags = ["@g@", @m@]\n[[line]]\nno = 1\n[[line]]\nno = 2\n[sub]\nx = 1.5\n'),
    "yaml": ("yaml.1.2-core@1", 'id: @k@\nname: "@n@"\ntags: [@g@, 0x10]\nbase: &b {x: @g@}\ncopy: *b\n---\nsecond: true\n'),
    "ini": ("ini.windows@1", "[Main]\r\nId=@k@\r\nname=@n@\r\n@+ID=2\r\n@[Other]\r\nempty=\r\n; note\r\n"),
    "properties": ("java-properties.reader@1", "# c\nid=@k@\na\\ key=@n@\nempty\nexplicit=\nlong=a\\\n  b\n@+id=0\n@"),
    "xml": ("xml.1.0-safe@1", '<?xml version="1.0"?>\n<!DOCTYPE c:cust [<!ENTITY e "E">]><!-- c --><c:cust xmlns:c="urn:c" id="@k@"><name xmlns:d="urn:d">@n@ &amp; &#65;&e;</name><tags><tag v="@g@"/><tag v="@m@"/></tags><![CDATA[raw]]><!--in--><?pi go?></c:cust>\n<!-- end -->\n'),
    "plist": ("plist.xml@1", '<?xml version="1.0"?>\n<plist version="1.0"><dict><key>id</key><integer>@k@</integer><key>name</key><string>@n@</string><key>tags</key><array><string>@g@</string><real>1.5</real><true/><data>AQI=</data><date>2001-01-02T00:00:00Z</date></array>@+<key>id</key><integer>0</integer>@</dict></plist>\n'),
    "hcl": ("hcl.native@1", 'id = @k@\nname = "@n@"\ntags = ["@g@", 3]\nobj = { a = 1 }\nsum = 1 + 2\ntpl = "v-${var.x}"\nresource "cust" "@n@" {\n  inner = -1\n}\n'),
    "json5": ("json5.standard@1", "{id: @k@, x: 0x10, /* c */}"),
    "broken": ("json.strict@1", '{"id":@k@@+,"x":@}'),
}
COLUMNS = {"k": "c_custkey", "n": "c_name", "g": "c_mktsegment", "m": "c_nationkey"}


def rendered(customer: DataFrame, name: str) -> DataFrame:
    """doc_id and text of each customer's document."""
    out: list[Column] = []
    for part in re.split(r"(@\+[^@]*@|@[kngm]@)", TEXTS[name][1]):
        if part.startswith("@+"):
            out.append(F.when(F.expr(DUP), F.lit(part[2:-1])).otherwise(F.lit("")))
        elif part.startswith("@"):
            out.append(F.col(COLUMNS[part[1]]).cast("string"))
        elif part:
            out.append(F.lit(part))
    return customer.select(F.col("c_custkey").alias("doc_id"), F.concat(*out).alias("text"))


def _binary(customer: DataFrame) -> DataFrame:
    """Binary property lists of customers."""

    def make(batches):
        import plistlib

        import pyarrow as pa

        for batch in batches:
            ids, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data = [plistlib.dumps({"id": k, "tags": [g, True, plistlib.UID(3)]}, fmt=plistlib.FMT_BINARY, sort_keys=False) for k, g in zip(ids, names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "content"])

    return customer.select("c_custkey", "c_mktsegment").mapInArrow(make, "doc_id long, content binary")


def documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SETS:
        return SETS[name][1](spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rendered(customer, name)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))


#: Further document sets: profile, and documents from whole tables.
SETS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {"events": ("json.strict@1", _events), "binary": ("plist.binary@1", lambda spark, sf_dir: _binary(spark.read.parquet(f"{sf_dir}/customer.parquet")))}


def _per_order(make: str, text: str, where: str = "true") -> Callable:
    """Documents of orders: `make` renders a line, `text` the document, with lines in the order of their numbers."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
        line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", F.expr(make).alias("line"))
        lines = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line).alias("lines"))
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).filter(where).select(F.col("o_orderkey").alias("doc_id"), F.expr(text).alias("text"))

    return read


def _yaml_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    one = F.expr("struct(n_nationkey, concat('  - name: ', n_name, '\n    of: *r', n_regionkey, '\n    open: yes\n') AS line)").alias("x")
    lists = nation.select("n_regionkey", one).groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "").alias("body"))
    text = F.expr("concat('%TAG !e! tag:example.org,2000:\n---\nregion: &r', r_regionkey, ' !e!region {name: ', r_name, ', größe: ', r_regionkey, '}\nnations:\n', body, '---\nlast: ~\n')")
    return region.join(lists, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text"))


def _parts(text: str, where: str = "true") -> Callable:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").filter(where).select(F.col("p_partkey").alias("doc_id"), F.expr(text).alias("text"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"concat('! caf\u00e9\ncaf\\u00e9\\ ', s_suppkey, ' = ', s_name, '\n', CASE WHEN s_suppkey % 4 = 0 THEN 'nation: 1\n' ELSE '' END, 'nation:', s_nationkey, '\n', 'long = a\\\n   b\\\n   c\n')"
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), F.expr(text).alias("text"))


#: Orders whose id is repeated in their document, and orders whose document is cut off before its end.
TWICE, CUT = "o_orderkey % 7 = 0", "o_orderkey % 11 = 0"
SETS |= {
    "json_orders": ("json.strict@1", _per_order(
        """concat('{"no":', l_linenumber, ',"qty":', CAST(l_quantity AS INT), '}')""",
        f"""concat('{{"id":', o_orderkey, ',"prio":"', o_orderpriority, '","lines":[', array_join(lines, ','), ']', CASE WHEN {TWICE} THEN ',"id":0' ELSE '' END, CASE WHEN {CUT} THEN '' ELSE '}}' END)""",
    )),
    "toml_orders": ("toml.1.0@1", _per_order(
        """concat('[[line]]\nno = ', l_linenumber, '\nship = ', date_format(l_shipdate, 'yyyy-MM-dd'), '\nitem.part = ', l_partkey, '\n')""",
        f"""concat('id = ', o_orderkey, '\n', CASE WHEN {CUT} THEN 'zero = \n' ELSE 'zero = -0.0\n' END, array_join(lines, ''))""",
    )),
    "xml_orders": ("xml.1.0-safe@1", _per_order(
        """concat('<l:line no="', l_linenumber, '"><!-- n --><qty>', CAST(l_quantity AS INT), '&#x20;&amp;</qty><![CDATA[<', l_partkey, '>]]></l:line>')""",
        f"""concat('<o:order xmlns:o="urn:o" xmlns:l="urn:l" id="', o_orderkey, '">', array_join(lines, ''), CASE WHEN {CUT} THEN '' ELSE '</o:order>' END)""",
    )),
    "yaml_regions": ("yaml.1.1-compat@1", _yaml_regions),
    "hcl_parts": ("hcl.native@1", _parts("""concat('resource "part" "', p_partkey, '" {\n  name = "', p_name, '"\n', CASE WHEN p_partkey % 13 = 0 THEN '  lost = [1,\n' ELSE '' END, '  size = ', p_size, '\n  tags = ["', p_type, '", "$', '{var.x}-', p_brand, '"]\n}\n', CASE WHEN p_partkey % 17 = 0 THEN 'bad = \n' ELSE '' END, 'last = true\n')""")),
    "properties_suppliers": ("java-properties.reader@1", _suppliers),
    "ini_portable": ("ini.portable@1", _parts("concat('[Part]\nName=', p_name, '\nname=', p_type, '\n[part]\nName=other\n', CASE WHEN p_partkey % 5 = 0 THEN 'broken\n' ELSE '' END)")),
    "ini_python": ("ini.python-configparser@1", _parts("concat('[Part]\nName: ', p_name, '\n  more\nSIZE = ', p_size, '\n[part]\nname=other\n')")),
}


def profile_of(name: str) -> str:
    return SETS[name][0] if name in SETS else TEXTS[name][0]


def nodes(spark: SparkSession, sf_dir: str, name: str, pieces: bool = False, view: str | None = None) -> DataFrame:
    """The node table of a document set."""
    return scan(documents(spark, sf_dir, name), profile_of(name), pieces, view)


Row = tuple  # pos, SQL of the value, condition
REGISTERED: dict[str, tuple[Callable, str | None]] = {}
#: The registered queries that are query trees: the query, its document set and view.
QUERIES: dict[str, tuple[Query, str, str | None]] = {}


def _sql(rows: list[Row], table: str = "customer", key: str = "c_custkey") -> str:
    parts = [f"SELECT {key}::BIGINT AS doc_id, {pos}::BIGINT AS pos, ({value})::VARCHAR AS value FROM {table}" + (f" WHERE {cond[0]}" if cond else "") for pos, value, *cond in rows]
    return " UNION ALL ".join(parts)


def _default(operator: str) -> str:
    domain = {"core": "core.portable-value-query@1", "graph": "core.portable-graph-query@1", "properties": "java-properties.native-semantic-query@1"}
    family = operator.split(".")[0]
    return domain.get(family, f"{family}.native-semantic-query@1")


def add(name: str, source: str, steps, column: str, rows: list[Row] | str, *, selection: str = "All", domain: str | None = None, view: str | None = None, failures: bool = False) -> None:
    """Register a query: steps one after another, or a tree; what it shows of each match; and the rows SQL must give."""
    first = steps[0] if isinstance(steps, list) else None
    domain = domain or _default(first if isinstance(first, str) else first[0])
    query = chain(domain, *steps, selection=selection) if isinstance(steps, list) else Query(domain, steps, selection)
    QUERIES[name] = (query, source, view)

    def act(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = tuple(n for n in NAMES if re.search(rf"\b{n}\b", column))
        result = query_documents(query, documents(spark, sf_dir, source), profile_of(source), view, columns=shown)
        if failures:
            return result.failures.select("doc_id", F.lit(0).cast("long").alias("pos"), F.col("code").alias("value"))
        return result.ordered(F.expr(column).cast("string").alias("value"))

    REGISTERED[name] = (act, _sql(rows) if isinstance(rows, list) else rows)


K, N, G, M_ = "c_custkey", "c_name", "c_mktsegment", "c_nationkey"


def _json() -> None:
    top = "json.try-object-members"
    names = [(0, "'id'"), (1, "'name'"), (2, "'tags'"), (3, "'sub'"), (4, "'id'", DUP)]
    add("json_try_object_members", "json", [top], "name", names)
    add("json_member_name_equals", "json", [top, ("json.member-name-equals", {"name": "id"})], "ordinal", [(0, "0"), (1, "4", DUP)])
    ids = [top, ("json.member-name-equals", {"name": "id"}), "json.member-value"]
    add("json_member_value", "json", ids, "text", [(0, K), (1, "0", DUP)])
    tags = [top, ("json.member-name-equals", {"name": "tags"}), "json.member-value", "json.try-array-elements"]
    add("json_try_array_elements", "json", tags, "ordinal", [(0, "0"), (1, "1")])
    add("json_array_element_value", "json", [*tags, "json.array-element-value"], "text", [(0, G), (1, M_)])
    add("core_take", "json", [top, ("core.take", {"count": 2})], "name", names[:2])
    both = Concat((chain("json.native-semantic-query@1", *ids).root, chain("json.native-semantic-query@1", *ids).root))
    add("core_distinct_by_identity", "json", Apply(both, "core.distinct-by-identity"), "text", [(0, K), (1, "0", DUP)], domain="json.native-semantic-query@1")
    name = chain("json.native-semantic-query@1", top, ("json.member-name-equals", {"name": "name"}), "json.member-value").root
    first = chain("json.native-semantic-query@1", *ids, ("core.take", {"count": 1})).root
    add("concat", "json", Concat((name, first)), "text", [(0, N), (1, K)], domain="json.native-semantic-query@1")
    add("json_structure_order_merge", "json", StructureOrderMerge((name, first)), "text", [(0, K), (1, N)], domain="json.native-semantic-query@1")
    add("select_first", "json", [top], "name", [(0, "'id'")], selection="First")
    add("select_last", "json", [top], "name", [(0, f"CASE WHEN {DUP} THEN 'id' ELSE 'sub' END")], selection="Last")
    add("select_all", "json", [top], "kind IS NULL", [(p, "'true'", *c) for p, _, *c in names])
    add("select_zero_or_one", "json", ids, "text", [(0, K, f"NOT {DUP}")], selection="ZeroOrOne")
    add("select_require_one", "json", ids, "text", [(0, K, f"NOT {DUP}")], selection="RequireOne")
    add("select_require_one_failures", "json", ids, "text", [(0, "'core.query.cardinality-violation@1'", DUP)], selection="RequireOne", failures=True)
    add("json_syntax_kind_is", "json", [("json.syntax-kind-is", {"kind": "Number"})], "text", [(0, K), (1, M_), (2, "'1.50'"), (3, "'0'", DUP)], domain="json.lossless-syntax-query@1")
    add("json_syntax_text_equals", "json", [("json.syntax-text-equals", {"text": ","})], "ordinal > 0", [(p, "'true'", *c) for p, *c in [(0,), (1,), (2,), (3,), (4, DUP)]], domain="json.lossless-syntax-query@1")
    add("json5_syntax_identifiers", "json5", [("json.syntax-kind-is", {"kind": "Identifier"})], "text", [(0, "'id'"), (1, "'x'")], domain="json.lossless-syntax-query@2")
    add("json5_member_value", "json5", [top, "json.member-value"], "text", [(0, K), (1, "'16'")], domain="json.native-semantic-query@2")
    REGISTERED["json_event_values"] = (
        lambda spark, sf_dir: query_documents(chain("json.native-semantic-query@1", top, ("json.member-name-equals", {"name": "k"}), "json.member-value"), documents(spark, sf_dir, "events"), "json.strict@1", columns=("kind", "text")).ordered(F.col("kind"), F.expr("CAST(text AS BIGINT)").alias("v")),
        "SELECT event_id AS doc_id, 0::BIGINT AS pos, 'Integer' AS kind, json_extract(props, '$.k')::BIGINT AS v FROM events",
    )


def _values() -> None:
    d = {"view": "value"}
    top = "core.try-object-entries"
    add("core_try_object_entries", "json", [top], "name", [(p, v, f"NOT {DUP}") for p, v in enumerate(["'id'", "'name'", "'tags'", "'sub'"])], **d)
    by = [top, ("core.object-entry-name-equals", {"name": "name"})]
    add("core_object_entry_name_equals", "json", by, "ordinal", [(0, "1", f"NOT {DUP}")], **d)
    add("core_object_entry_value", "json", [*by, "core.object-entry-value"], "text", [(0, N, f"NOT {DUP}")], **d)
    many = "core.try-entry-mapping-entries"
    five = ["'id'", "'name'", "'tags'", "'sub'", "'id'"]
    add("core_try_entry_mapping_entries", "json", [many], "ordinal", [(p, str(p), DUP) for p in range(5)], **d)
    add("core_entry_key", "json", [many, "core.entry-key"], "text", [(p, v, DUP) for p, v in enumerate(five)], **d)
    add("core_entry_value", "json", [many, "core.entry-value"], "kind", [(p, v, DUP) for p, v in enumerate(["'Integer'", "'String'", "'Sequence'", "'Object'", "'Integer'"])], **d)
    seq = [top, ("core.object-entry-name-equals", {"name": "tags"}), "core.object-entry-value", "core.try-sequence-elements"]
    add("core_try_sequence_elements", "json", seq, "text", [(0, G, f"NOT {DUP}"), (1, M_, f"NOT {DUP}")], **d)
    add("core_where_type", "json", [*seq, ("core.where-type", {"kind": "Integer"})], "text", [(0, M_, f"NOT {DUP}")], **d)
    add("core_require_type", "json", [("core.require-type", {"kind": "Object"})], "kind", [(0, "'Object'", f"NOT {DUP}")], **d)
    add("core_require_type_failures", "json", [("core.require-type", {"kind": "Object"})], "kind", [(0, "'core.query.required-type-mismatch@1'", DUP)], failures=True, **d)


def _graph() -> None:
    d = {"view": "graph"}
    # Depth-first: root, id, value, name, value, tags, its sequence and two items, base, its mapping, x, value, copy; then the second document.
    kinds = ["Mapping", *["Scalar"] * 5, "Sequence", "Scalar", "Scalar", "Scalar", "Mapping", *["Scalar"] * 3, "Mapping", "Scalar", "Scalar"]
    add("graph_reachable_nodes", "yaml", ["graph.reachable-nodes"], "kind", [(p, f"'{k}'") for p, k in enumerate(kinds)], **d)
    add("graph_where_kind", "yaml", ["graph.reachable-nodes", ("graph.where-kind", {"kind": "Sequence"})], "kind", [(0, "'Sequence'")], **d)
    add("graph_where_tag", "yaml", ["graph.reachable-nodes", ("graph.where-tag", {"tag": "tag:yaml.org,2002:int"})], "text", [(0, K), (1, "'16'")], **d)
    add("graph_try_mapping_entries", "yaml", ["graph.try-mapping-entries"], "ordinal", [(p, str(v)) for p, v in enumerate([0, 1, 2, 3, 4, 0])], **d)
    add("graph_mapping_entry_key", "yaml", ["graph.try-mapping-entries", "graph.mapping-entry-key"], "text", [(p, f"'{v}'") for p, v in enumerate(["id", "name", "tags", "base", "copy", "second"])], **d)
    values = ["graph.try-mapping-entries", "graph.mapping-entry-value"]
    add("graph_mapping_entry_value", "yaml", values, "coalesce(text, kind)", [(0, K), (1, N), (2, "'Sequence'"), (3, "'Mapping'"), (4, "'Mapping'"), (5, "'true'")], **d)
    add("graph_try_sequence_elements", "yaml", [*values, "graph.try-sequence-elements"], "ordinal", [(0, "0"), (1, "1")], **d)
    add("graph_sequence_element_node", "yaml", [*values, "graph.try-sequence-elements", "graph.sequence-element-node"], "text", [(0, G), (1, "'16'")], **d)


def _toml() -> None:
    top = "toml.try-table-entries"
    add("toml_try_table_entries", "toml", [top], "name", [(p, f"'{v}'") for p, v in enumerate(["id", "name", "tags", "line", "sub"])])
    by = lambda n: [top, ("toml.entry-name-equals", {"name": n})]
    add("toml_entry_name_equals", "toml", by("line"), "ordinal", [(0, "3")])
    add("toml_entry_item", "toml", [*by("id"), "toml.entry-item"], "text", [(0, K)])
    add("toml_try_array_elements", "toml", [*by("line"), "toml.entry-item", "toml.try-array-elements"], "ordinal", [(0, "0"), (1, "1")])
    add("toml_array_element_item", "toml", [*by("tags"), "toml.entry-item", "toml.try-array-elements", "toml.array-element-item"], "text", [(0, G), (1, M_)])
    d = "toml.native-semantic-query@1"
    add("toml_structure_order_merge", "toml", StructureOrderMerge((chain(d, *by("name"), "toml.entry-item").root, chain(d, *by("id"), "toml.entry-item").root)), "text", [(0, K), (1, N)], domain=d)
    add("toml_syntax_kind_is", "toml", [("toml.syntax-kind-is", {"kind": "String"})], "text", [(0, f"'\"' || {N} || '\"'"), (1, f"'\"' || {G} || '\"'")], domain="toml.lossless-syntax-query@1")
    add("toml_syntax_text_equals", "toml", [("toml.syntax-text-equals", {"text": "="})], "kind", [(p, "'Equals'") for p in range(6)], domain="toml.lossless-syntax-query@1")


def _yaml() -> None:
    docs = ["yaml.documents"]
    root = [*docs, "yaml.document-root"]
    entries = [*root, "yaml.try-mapping-entries"]
    values = [*entries, "yaml.mapping-entry-value"]
    add("yaml_documents", "yaml", docs, "ordinal", [(0, "0"), (1, "1")])
    add("yaml_document_root", "yaml", root, "kind", [(0, "'Mapping'"), (1, "'Mapping'")])
    add("yaml_try_mapping_entries", "yaml", entries, "name", [(p, f"'{v}'") for p, v in enumerate(["id", "name", "tags", "base", "copy", "second"])])
    add("yaml_mapping_entry_key", "yaml", [*entries, "yaml.mapping-entry-key"], "text", [(p, f"'{v}'") for p, v in enumerate(["id", "name", "tags", "base", "copy", "second"])])
    add("yaml_mapping_entry_value", "yaml", values, "coalesce(text, kind)", [(0, K), (1, N), (2, "'Sequence'"), (3, "'Mapping'"), (4, "'Mapping'"), (5, "'true'")])
    add("yaml_where_node_kind", "yaml", [*values, ("yaml.where-node-kind", {"kind": "Scalar"})], "text", [(0, K), (1, N), (2, "'true'")])
    add("yaml_where_tag", "yaml", [*values, ("yaml.where-tag", {"tag": "tag:yaml.org,2002:bool"})], "text", [(0, "'true'")])
    items = [*values, "yaml.try-sequence-elements"]
    add("yaml_try_sequence_elements", "yaml", items, "ordinal", [(0, "0"), (1, "1")])
    nodes_ = [*items, "yaml.sequence-element-node"]
    add("yaml_sequence_element_node", "yaml", nodes_, "text", [(0, G), (1, "'16'")])
    add("yaml_scalar_canonical_equals", "yaml", [*nodes_, ("yaml.scalar-canonical-equals", {"canonical": "16"})], "text", [(0, "'16'")])
    add("yaml_anchor_definition", "yaml", [*values, "yaml.anchor-definition"], "name", [(0, "'b'"), (1, "'b'")])
    add("yaml_anchor_node", "yaml", [*values, "yaml.anchor-definition", "yaml.anchor-node"], "kind", [(0, "'Mapping'"), (1, "'Mapping'")])
    add("yaml_alias_occurrences", "yaml", ["yaml.alias-occurrences"], "name", [(0, "'b'")])
    add("yaml_alias_target", "yaml", ["yaml.alias-occurrences", "yaml.alias-target", "yaml.try-mapping-entries", "yaml.mapping-entry-value"], "text", [(0, G)])
    d = "yaml.native-semantic-query@1"
    add("yaml_structure_order_merge", "yaml", StructureOrderMerge((chain(d, *values, ("yaml.where-tag", {"tag": "tag:yaml.org,2002:bool"})).root, chain(d, *values, ("yaml.where-tag", {"tag": "tag:yaml.org,2002:int"})).root)), "text", [(0, K), (1, "'true'")], domain=d)
    add("yaml_syntax_kind_is", "yaml", [("yaml.syntax-kind-is", {"kind": "Alias"})], "text", [(0, "'*b'")], domain="yaml.lossless-syntax-query@1")
    add("yaml_syntax_text_equals", "yaml", [("yaml.syntax-text-equals", {"text": "---"})], "kind", [(0, "'DocumentStart'")], domain="yaml.lossless-syntax-query@1")


def _ini() -> None:
    sections = ["ini.document-sections"]
    main = [*sections, ("ini.section-name-equals", {"name": "MAIN", "comparison": "ProfileEquivalent"})]
    add("ini_document_sections", "ini", sections, "name", [(0, "'Main'"), (1, "'Other'")])
    add("ini_section_name_equals", "ini", main, "name", [(0, "'Main'")])
    add("ini_section_entries", "ini", [*main, "ini.section-entries"], "name", [(0, "'Id'"), (1, "'name'"), (2, "'ID'", DUP)])
    every = ["ini.all-entries"]
    keys = [(0, "'Id'"), (1, "'name'"), (2, f"CASE WHEN {DUP} THEN 'ID' ELSE 'empty' END"), (3, "'empty'", DUP)]
    add("ini_all_entries", "ini", every, "name", keys)
    add("ini_entry_section", "ini", [*every, "ini.entry-section"], "name", [(0, "'Main'"), (1, "'Main'"), (2, f"CASE WHEN {DUP} THEN 'Main' ELSE 'Other' END"), (3, "'Other'", DUP)])
    equal = [*every, ("ini.entry-key-equals", {"key": "id", "comparison": "ProfileEquivalent"})]
    add("ini_entry_key_equals", "ini", equal, "text", [(0, K), (1, "2", DUP)])
    add("ini_entry_value_state_is", "ini", [*every, ("ini.entry-value-state-is", {"state": "Empty"})], "name", [(0, "'empty'")])
    add("ini_duplicate_group", "ini", [*equal, "ini.duplicate-group"], "text", [(0, K, DUP), (1, "2", DUP), (2, K, DUP), (3, "2", DUP)])
    add("ini_physical_lines", "ini", ["ini.physical-lines"], "text", [(0, "'[Main]'"), (1, f"'Id=' || {K}"), (2, f"'name=' || {N}"), (3, f"CASE WHEN {DUP} THEN 'ID=2' ELSE '[Other]' END"), (4, f"CASE WHEN {DUP} THEN '[Other]' ELSE 'empty=' END"), (5, f"CASE WHEN {DUP} THEN 'empty=' ELSE '; note' END"), (6, "'; note'", DUP)])
    add("ini_logical_lines", "ini", ["ini.logical-lines"], "ordinal", [(p, str(p), *([DUP] if p == 6 else [])) for p in range(7)])
    d = "ini.native-semantic-query@1"
    other = chain(d, *sections, ("ini.section-name-equals", {"name": "Other", "comparison": "OriginalExact"})).root
    add("ini_structure_order_merge", "ini", StructureOrderMerge((other, chain(d, *main).root)), "name", [(0, "'Main'"), (1, "'Other'")], domain=d)
    add("ini_syntax_kind_is", "ini", [("ini.syntax-kind-is", {"kind": "SectionName"})], "text", [(0, "'Main'"), (1, "'Other'")], domain="ini.lossless-syntax-query@1")
    add("ini_syntax_text_equals", "ini", [("ini.syntax-text-equals", {"text": "="})], "kind", [(0, "'Delimiter'"), (1, "'Delimiter'"), (2, "'Delimiter'"), (3, "'Delimiter'", DUP)], domain="ini.lossless-syntax-query@1")


def _properties() -> None:
    every = ["properties.document-properties"]
    add("properties_document_properties", "properties", every, "name || '=' || text", [(0, f"'id=' || {K}"), (1, f"'a key=' || {N}"), (2, "'empty='"), (3, "'explicit='"), (4, "'long=ab'"), (5, "'id=0'", DUP)])
    add("properties_natural_lines", "properties", ["properties.natural-lines"], "ordinal", [(p, str(p), *([DUP] if p == 7 else [])) for p in range(8)])
    logical = ["properties.logical-lines"]
    add("properties_logical_lines", "properties", logical, "ordinal", [(p, str(p), *([DUP] if p == 6 else [])) for p in range(7)])
    add("properties_logical_line_natural_lines", "properties", [*logical, "properties.logical-line-natural-lines"], "ordinal", [(p, str(p), *([DUP] if p == 7 else [])) for p in range(8)])
    by = [*every, ("properties.property-key-equals", {"key": "id".encode("utf-16-be")})]
    add("properties_property_key_equals", "properties", by, "text", [(0, K), (1, "0", DUP)])
    add("properties_property_value_state_is", "properties", [*every, ("properties.property-value-state-is", {"state": "ImplicitEmpty"})], "name", [(0, "'empty'")])
    add("properties_property_escapes", "properties", [*every, "properties.property-escapes"], "'[' || text || ']'", [(0, "'[ ]'")])
    add("properties_duplicate_group", "properties", [*by, ("core.take", {"count": 1}), "properties.duplicate-group"], "text", [(0, K, DUP), (1, "0", DUP)])
    d = "java-properties.native-semantic-query@1"
    empty = chain(d, *every, ("properties.property-value-state-is", {"state": "ExplicitEmpty"})).root
    add("properties_structure_order_merge", "properties", StructureOrderMerge((empty, chain(d, *by, ("core.take", {"count": 1})).root)), "name", [(0, "'id'"), (1, "'explicit'")], domain=d)
    s = {"domain": "java-properties.lossless-syntax-query@1"}
    add("properties_syntax_kind_is", "properties", [("properties.syntax-kind-is", {"kind": "Value"})], "text", [(0, K), (1, N), (2, "'a\\' || chr(10) || '  b'"), (3, "'0'", DUP)], **s)
    add("properties_syntax_text_equals", "properties", [("properties.syntax-text-equals", {"text": "id"})], "kind", [(0, "'Key'"), (1, "'Key'", DUP)], **s)
    add("properties_syntax_raw_bytes_equals", "properties", [("properties.syntax-raw-bytes-equals", {"bytes": b"empty"})], "kind", [(0, "'Key'")], **s)
    add("properties_syntax_utf16be_equals", "properties", [("properties.syntax-utf16be-equals", {"code_units": "explicit".encode("utf-16-be")})], "kind", [(0, "'Key'")], **s)


def _xml() -> None:
    root = ["xml.document-root"]
    add("xml_document_root", "xml", root, "name", [(0, "'cust'")])
    add("xml_document_declaration", "xml", ["xml.document-declaration"], "name", [(0, "'1.0'")])
    add("xml_document_doctype", "xml", ["xml.document-doctype"], "name", [(0, "'c:cust'")])
    add("xml_document_prolog", "xml", ["xml.document-prolog"], "text", [(0, "' c '")])
    add("xml_document_epilog", "xml", ["xml.document-epilog"], "text", [(0, "' end '")])
    add("xml_element_children", "xml", [*root, "xml.element-children"], "kind", [(p, f"'{v}'") for p, v in enumerate(["element", "element", "cdata", "comment", "processing-instruction"])])
    kids = [*root, "xml.element-child-elements"]
    add("xml_element_child_elements", "xml", kids, "name", [(0, "'name'"), (1, "'tags'")])
    below = [*root, "xml.element-descendants"]
    add("xml_element_descendants", "xml", below, "name", [(0, "'name'"), (1, "'tags'"), (2, "'tag'"), (3, "'tag'")])
    text = [*kids, "xml.element-child-text"]
    add("xml_element_child_text", "xml", text, "text", [(0, f"{N} || ' & AE'")])
    add("xml_element_child_cdata", "xml", [*root, "xml.element-child-cdata"], "text", [(0, "'raw'")])
    add("xml_element_child_comments", "xml", [*root, "xml.element-child-comments"], "text", [(0, "'in'")])
    pi = [*root, "xml.element-child-pi"]
    add("xml_element_child_pi", "xml", pi, "text", [(0, "'go'")])
    add("xml_pi_target_equals", "xml", [*pi, ("xml.pi-target-equals", {"target": "pi"})], "name", [(0, "'pi'")])
    attributes = [*below, "xml.element-attributes"]
    add("xml_element_attributes", "xml", attributes, "text", [(0, G), (1, M_)])
    add("xml_attribute_value_equals", "xml", [*attributes, ("xml.attribute-value-equals", {"value": "BUILDING"})], "text", [(0, G, f"{G} = 'BUILDING'")])
    add("xml_attribute_element", "xml", [*root, "xml.element-attributes", "xml.attribute-element"], "name", [(0, "'cust'")])
    add("xml_content_parent", "xml", [*attributes, "xml.content-parent"], "name", [(0, "'tag'"), (1, "'tag'")])
    add("xml_element_namespace_bindings", "xml", [*root, "xml.element-namespace-bindings"], "name || text", [(0, "'curn:c'")])
    add("xml_element_in_scope_namespaces", "xml", [*kids, "xml.element-in-scope-namespaces"], "name", [(0, "'c'"), (1, "'d'"), (2, "'c'")])
    refs = [*text, "xml.text-references"]
    add("xml_text_references", "xml", refs, "kind", [(0, "'Predefined'"), (1, "'Character'"), (2, "'General'")])
    add("xml_reference_text", "xml", [*refs, "xml.reference-text"], "name", [(0, "'name'"), (1, "'name'"), (2, "'name'")])
    add("xml_reference_kind_is", "xml", [*refs, ("xml.reference-kind-is", {"kind": "General"})], "name", [(0, "'e'")])
    add("xml_reference_name_equals", "xml", [*refs, ("xml.reference-name-equals", {"name": "&#x41;"})], "text", [(0, "'&#65;'")])
    add("xml_name_equals", "xml", [*below, ("xml.name-equals", {"prefix": "", "local": "tag", "namespace": "", "comparison": "ExpandedName"})], "name", [(0, "'tag'"), (1, "'tag'")])
    add("xml_node_kind_is", "xml", [*root, "xml.element-children", ("xml.node-kind-is", {"kind": "comment"})], "text", [(0, "'in'")])
    d = "xml.native-semantic-query@1"
    add("xml_structure_order_merge", "xml", StructureOrderMerge((chain(d, *below).root, chain(d, *kids).root)), "name", [(p, f"'{v}'") for p, v in enumerate(["name", "name", "tags", "tags", "tag", "tag"])], domain=d)
    add("xml_syntax_kind_is", "xml", [("xml.syntax-kind-is", {"kind": "attribute-value"})], "text", [(0, "'urn:c'"), (1, K), (2, "'urn:d'"), (3, G), (4, M_)], domain="xml.lossless-syntax-query@1")
    add("xml_syntax_text_equals", "xml", [("xml.syntax-text-equals", {"text": "raw"})], "kind", [(0, "'cdata-text'")], domain="xml.lossless-syntax-query@1")


def _plist() -> None:
    root = ["plist.document-root"]
    entries = [*root, "plist.dict-entries"]
    names = [(0, "'id'"), (1, "'name'"), (2, "'tags'"), (3, "'id'", DUP)]
    add("plist_document_root", "plist", root, "kind", [(0, "'dict'")])
    add("plist_dict_entries", "plist", entries, "name", names)
    add("plist_dict_entry_key", "plist", [*entries, "plist.dict-entry-key"], "text", names)
    values = [*entries, "plist.dict-entry-value"]
    add("plist_dict_entry_value", "plist", values, "coalesce(text, kind)", [(0, K), (1, N), (2, "'array'"), (3, "'0'", DUP)])
    by = lambda n: [*entries, ("plist.dict-key-equals", {"key": n})]
    add("plist_dict_key_equals", "plist", by("id"), "ordinal", [(0, "0"), (1, "3", DUP)])
    add("plist_duplicate_key_group", "plist", [*by("id"), ("core.take", {"count": 1}), "plist.duplicate-key-group"], "ordinal", [(0, "0"), (1, "3", DUP)])
    items = [*values, "plist.array-elements"]
    add("plist_array_elements", "plist", items, "kind", [(p, f"'{v}'") for p, v in enumerate(["string", "real", "boolean", "data", "date"])])
    kind = lambda k: [*items, ("plist.value-type-is", {"kind": k})]
    add("plist_value_type_is", "plist", kind("real"), "kind", [(0, "'real'")])
    add("plist_value_as_integer", "plist", [*by("id"), "plist.dict-entry-value", "plist.value-as-integer"], "text", [(0, K), (1, "0", DUP)])
    add("plist_value_as_string", "plist", [*by("name"), "plist.dict-entry-value", "plist.value-as-string"], "text", [(0, N)])
    for k in ("real", "data", "date"):
        add(f"plist_value_as_{k}", "plist", [*kind(k), f"plist.value-as-{k}"], "kind", [(0, f"'{k}'")])
    add("plist_value_as_string_failures", "plist", [*values, "plist.value-as-string"], "text", [(0, "'core.query.required-type-mismatch@1'")], failures=True)
    tags = [*entries, ("plist.dict-key-equals", {"key": "tags"}), "plist.dict-entry-value", "plist.array-elements"]
    add("plist_value_as_uid", "binary", [*tags, ("plist.value-type-is", {"kind": "uid"}), "plist.value-as-uid"], "kind", [(0, "'uid'")])
    # An element is a match of its own, so the boolean is read from a dict value.
    add("plist_value_as_boolean_is_failures", "plist", [*by("id"), "plist.dict-entry-value", ("plist.value-as-boolean-is", {"value": True})], "kind", [(0, "'core.query.required-type-mismatch@1'")], failures=True)
    # Objects in the order written: dict, its keys and values, then what the array holds.
    add("plist_object_table", "binary", ["plist.object-table"], "kind", [(p, f"'{v}'") for p, v in enumerate(["dict", "string", "string", "integer", "array", "string", "boolean", "uid"])], domain="plist.binary-structure-query@1")
    add("plist_object_offset", "binary", ["plist.object-offset"], "ordinal", [(p, str(p)) for p in range(8)], domain="plist.binary-structure-query@1")
    add("plist_offset_table", "binary", ["plist.offset-table"], "ordinal", [(p, str(p)) for p in range(8)], domain="plist.binary-structure-query@1")
    add("plist_object_refs", "binary", ["plist.object-refs"], "name || '>' || text", [(p, f"'{v}'") for p, v in enumerate(["0>1", "0>2", "0>3", "0>4", "4>5", "4>6", "4>7"])], domain="plist.binary-structure-query@1")
    add("plist_trailer_facts", "binary", ["plist.trailer-facts"], "split(text, ',')[2]", [(0, "'8'")], domain="plist.binary-structure-query@1")
    add("plist_top_object", "binary", ["plist.top-object"], "kind", [(0, "'dict'")], domain="plist.binary-structure-query@1")
    d = "plist.native-semantic-query@1"
    add("plist_structure_order_merge", "plist", StructureOrderMerge((chain(d, *by("name")).root, chain(d, *by("id"), ("core.take", {"count": 1})).root)), "name", [(0, "'id'"), (1, "'name'")], domain=d)
    add("plist_syntax_kind_is", "plist", [("plist.syntax-kind-is", {"kind": "key-open"})], "text", [(0, "'<key>'"), (1, "'<key>'"), (2, "'<key>'"), (3, "'<key>'", DUP)], domain="plist.lossless-syntax-query@1")
    add("plist_syntax_text_equals", "plist", [("plist.syntax-text-equals", {"text": "<true/>"})], "kind", [(0, "'true'")], domain="plist.lossless-syntax-query@1")


def _hcl() -> None:
    body = ["hcl.document-body"]
    names = ["id", "name", "tags", "obj", "sum", "tpl"]
    add("hcl_document_body", "hcl", body, "role", [(0, "'HclBody'")])
    items = [*body, "hcl.body-items"]
    add("hcl_body_items", "hcl", items, "name", [(p, f"'{v}'") for p, v in enumerate([*names, "resource"])])
    attributes = [*body, "hcl.body-attributes"]
    add("hcl_body_attributes", "hcl", attributes, "name", [(p, f"'{v}'") for p, v in enumerate(names)])
    blocks = [*body, "hcl.body-blocks"]
    add("hcl_body_blocks", "hcl", blocks, "name", [(0, "'resource'")])
    add("hcl_body_block_type_equals", "hcl", [*body, ("hcl.body-block-type-equals", {"type": "resource"})], "name", [(0, "'resource'")])
    add("hcl_attribute_name", "hcl", [*items, "hcl.attribute-name"], "name", [(p, f"'{v}'") for p, v in enumerate(names)])
    by = lambda n: [*attributes, ("hcl.attribute-name-equals", {"name": n})]
    add("hcl_attribute_name_equals", "hcl", by("sum"), "ordinal", [(0, "4")])
    add("hcl_attribute_expression", "hcl", [*by("id"), "hcl.attribute-expression"], "text", [(0, K)])
    add("hcl_attribute_literal_value", "hcl", [*by("id"), ("hcl.attribute-literal-value", {"accessor": "as-integer"})], "name", [(0, "'id'")])
    add("hcl_attribute_literal_value_failures", "hcl", [*by("sum"), ("hcl.attribute-literal-value", {"accessor": "as-integer"})], "name", [(0, "'core.query.target-unavailable@1'")], failures=True)
    add("hcl_block_type", "hcl", [*items, "hcl.block-type"], "name", [(0, "'resource'")])
    add("hcl_block_type_equals", "hcl", [*items, ("hcl.block-type-equals", {"type": "resource"})], "name", [(0, "'resource'")])
    labels = [*blocks, "hcl.block-labels"]
    add("hcl_block_labels", "hcl", labels, "text", [(0, "'cust'"), (1, N)])
    add("hcl_block_label_equals", "hcl", [*labels, ("hcl.block-label-equals", {"label": "cust"})], "text", [(0, "'cust'")])
    add("hcl_block_nested_body", "hcl", [*blocks, "hcl.block-nested-body", "hcl.body-attributes"], "name", [(0, "'inner'")])
    expressions = [*attributes, "hcl.attribute-expression"]
    add("hcl_expression_kind_is", "hcl", [*expressions, ("hcl.expression-kind-is", {"kind": "binary"})], "name", [(0, "'+'")])
    add("hcl_expression_is_literal", "hcl", [*expressions, "hcl.expression-is-literal"], "kind", [(p, f"'{v}'") for p, v in enumerate(["number", "template", "tuple", "object"])])
    add("hcl_expression_text", "hcl", [*expressions, "hcl.expression-text"], "kind", [(p, f"'{v}'") for p, v in enumerate(["number", "template", "tuple", "object", "binary", "template"])])
    add("hcl_expression_children", "hcl", [*by("sum"), "hcl.attribute-expression", "hcl.expression-children"], "text", [(0, "'1'"), (1, "'2'")])
    add("hcl_template_parts", "hcl", [*by("tpl"), "hcl.attribute-expression", "hcl.template-parts"], "kind || ' ' || text", [(0, "'literal v-'"), (1, "'interpolation ${var.x}'")])
    add("hcl_tuple_elements", "hcl", [*expressions, "hcl.tuple-elements"], "text", [(0, G), (1, "'3'")])
    add("hcl_object_entries", "hcl", [*expressions, "hcl.object-entries"], "text", [(0, "'1'")])
    add("hcl_error_regions", "hcl", [*body, "hcl.error-regions"], "text", "SELECT c_custkey::BIGINT AS doc_id, 0::BIGINT AS pos, ''::VARCHAR AS value FROM customer WHERE false")
    d = "hcl.native-semantic-query@1"
    add("hcl_structure_order_merge", "hcl", StructureOrderMerge((chain(d, *by("sum")).root, chain(d, *by("id")).root)), "name", [(0, "'id'"), (1, "'sum'")], domain=d)
    add("hcl_syntax_kind_is", "hcl", [("hcl.syntax-kind-is", {"kind": "Operator"})], "text", [(0, "'+'"), (1, "'-'")], domain="hcl.lossless-syntax-query@1")
    add("hcl_syntax_text_equals", "hcl", [("hcl.syntax-text-equals", {"text": "resource"})], "kind", [(0, "'Identifier'")], domain="hcl.lossless-syntax-query@1")


def _sql_lines(value: str, where: str = "true", more: str = "") -> str:
    """A row for each line of an order, in the order of numbers."""
    lines = f"SELECT o_orderkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS pos, ({value})::VARCHAR AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {where}"
    return lines + more


def _sets() -> None:
    """Operators over documents of whole orders, regions and parts: nested, repeated, cut off, and in other scripts."""
    d = "json.native-semantic-query@1"
    lines = ["json.try-object-members", ("json.member-name-equals", {"name": "lines"}), "json.member-value", "json.try-array-elements", "json.array-element-value"]
    qty = [*lines, "json.try-object-members", ("json.member-name-equals", {"name": "qty"}), "json.member-value"]
    add("json_orders_quantities", "json_orders", qty, "text", _sql_lines("l_quantity::INT"))
    add("json_orders_last_line", "json_orders", [*lines, "json.try-object-members", ("json.member-name-equals", {"name": "no"}), "json.member-value"], "text", "SELECT l_orderkey::BIGINT AS doc_id, 0::BIGINT AS pos, max(l_linenumber)::VARCHAR AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1", selection="Last")
    one = chain(d, "json.try-object-members", ("json.member-name-equals", {"name": "id"}), "json.member-value").root
    add("json_orders_ids_distinct", "json_orders", Apply(Concat((one, one)), "core.distinct-by-identity"), "text", f"SELECT DISTINCT o_orderkey::BIGINT AS doc_id, 0::BIGINT AS pos, o_orderkey::VARCHAR AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT DISTINCT o_orderkey::BIGINT, 1::BIGINT, '0' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {TWICE}", domain=d)
    add("json_orders_two_ids_failures", "json_orders", ["json.try-object-members", ("json.member-name-equals", {"name": "id"})], "name", f"SELECT DISTINCT o_orderkey::BIGINT AS doc_id, 0::BIGINT AS pos, 'core.query.cardinality-violation@1' AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {TWICE}", selection="RequireOne", failures=True)
    add("core_orders_numbers", "json_orders", ["core.try-object-entries", ("core.object-entry-name-equals", {"name": "lines"}), "core.object-entry-value", "core.try-sequence-elements", "core.try-object-entries", "core.object-entry-value"], "text", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS pos, CASE k WHEN 0 THEN l_linenumber::VARCHAR ELSE q END AS value FROM (SELECT o_orderkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS pos, l_linenumber, l_quantity::INT::VARCHAR AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE NOT ({TWICE}) AND NOT ({CUT})), (SELECT unnest([0, 1]) AS k)", view="value")
    tables = ["toml.try-table-entries", ("toml.entry-name-equals", {"name": "line"}), "toml.entry-item", "toml.try-array-elements", "toml.array-element-item", "toml.try-table-entries"]
    add("toml_orders_parts", "toml_orders", [*tables, ("toml.entry-name-equals", {"name": "item"}), "toml.entry-item", "toml.try-table-entries", "toml.entry-item"], "text", _sql_lines("l_partkey", f"NOT ({CUT})"))
    add("toml_orders_dates", "toml_orders", [*tables, ("toml.entry-name-equals", {"name": "ship"}), "toml.entry-item"], "kind", _sql_lines("'LocalDate'", f"NOT ({CUT})"))
    below = ["xml.document-root", "xml.element-descendants"]
    add("xml_orders_quantities", "xml_orders", [*below, ("xml.name-equals", {"prefix": "", "local": "qty", "namespace": "", "comparison": "ExpandedName"}), "xml.element-child-text"], "text", _sql_lines("l_quantity::INT || ' &'"))
    add("xml_orders_parts", "xml_orders", [*below, ("xml.name-equals", {"prefix": "l", "local": "line", "namespace": "", "comparison": "OriginalExact"}), "xml.element-child-cdata"], "text", _sql_lines("'<' || l_partkey || '>'"))
    add("xml_orders_numbers", "xml_orders", [*below, "xml.element-attributes"], "text", _sql_lines("l_linenumber"))
    mapping = ["yaml.documents", "yaml.document-root", "yaml.try-mapping-entries"]
    items = [*mapping, "yaml.mapping-entry-value", "yaml.try-sequence-elements", "yaml.sequence-element-node", "yaml.try-mapping-entries", "yaml.mapping-entry-value"]
    nations = "SELECT n_regionkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, {} AS value FROM nation JOIN region ON n_regionkey = r_regionkey"
    add("yaml_regions_names", "yaml_regions", [*items, ("yaml.where-tag", {"tag": "tag:yaml.org,2002:str"})], "text", nations.format("n_name"))
    add("yaml_regions_booleans", "yaml_regions", [*items, ("yaml.where-tag", {"tag": "tag:yaml.org,2002:bool"})], "text", nations.format("'true'"))
    add("yaml_regions_aliases", "yaml_regions", ["yaml.alias-occurrences", "yaml.alias-target", "yaml.try-mapping-entries", "yaml.mapping-entry-value", ("yaml.where-tag", {"tag": "tag:yaml.org,2002:str"})], "text", nations.format("r_name"))
    add("yaml_regions_tag", "yaml_regions", [*mapping, "yaml.mapping-entry-value", ("yaml.where-tag", {"tag": "tag:example.org,2000:region"})], "kind", "SELECT r_regionkey::BIGINT AS doc_id, 0::BIGINT AS pos, 'Mapping' AS value FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
    block = ["hcl.document-body", "hcl.body-blocks", "hcl.block-nested-body", "hcl.body-attributes"]
    broken = "p_partkey % 13 = 0"
    add("hcl_parts_sizes", "hcl_parts", [*block, ("hcl.attribute-name-equals", {"name": "size"}), "hcl.attribute-expression"], "text", f"SELECT p_partkey::BIGINT AS doc_id, 0::BIGINT AS pos, p_size::VARCHAR AS value FROM part WHERE NOT ({broken})")
    add("hcl_parts_names", "hcl_parts", [*block, ("hcl.attribute-name-equals", {"name": "name"}), "hcl.attribute-expression"], "text", "SELECT p_partkey::BIGINT AS doc_id, 0::BIGINT AS pos, p_name AS value FROM part")
    add("hcl_parts_error_regions", "hcl_parts", ["hcl.document-body", "hcl.error-regions"], "text", f"""SELECT p_partkey::BIGINT AS doc_id, 0::BIGINT AS pos, 'lost = [1,' || chr(10) || '  size = ' || p_size || chr(10) || '  tags = ["' || p_type || '", "${{var.x}}-' || p_brand || '"]' || chr(10) || '}}' AS value FROM part WHERE {broken} UNION ALL SELECT p_partkey::BIGINT, (CASE WHEN {broken} THEN 1 ELSE 0 END)::BIGINT, 'bad = ' FROM part WHERE p_partkey % 17 = 0""")
    add("hcl_parts_last", "hcl_parts", ["hcl.document-body", "hcl.body-attributes", ("hcl.attribute-name-equals", {"name": "last"}), ("hcl.attribute-literal-value", {"accessor": "as-boolean-is"})], "name", f"SELECT p_partkey::BIGINT AS doc_id, 0::BIGINT AS pos, 'last' AS value FROM part WHERE NOT ({broken})")
    add("properties_suppliers", "properties_suppliers", ["properties.document-properties"], "name || '=' || text", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, value FROM (SELECT s_suppkey::BIGINT AS doc_id, 0 AS k, 'caf' || chr(233) || ' ' || s_suppkey || '=' || s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 1, 'nation=1' FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 2, 'nation=' || s_nationkey FROM supplier UNION ALL SELECT s_suppkey, 3, 'long=abc' FROM supplier)")
    for name, key, section, rows in (("ini_portable", "Name", "Part", [(0, "p_name")]), ("ini_python", "NAME", "Part", [(0, "p_name || chr(10) || 'more'")])):
        steps = ["ini.document-sections", ("ini.section-name-equals", {"name": section, "comparison": "ProfileEquivalent"}), "ini.section-entries", ("ini.entry-key-equals", {"key": key, "comparison": "ProfileEquivalent"})]
        add(f"{name}_names", name, steps, "text", _sql(rows, "part", "p_partkey"))
        add(f"{name}_other_case", name, [("ini.document-sections"), ("ini.section-name-equals", {"name": "PART", "comparison": "ProfileEquivalent"})], "name", "SELECT p_partkey::BIGINT AS doc_id, 0::BIGINT AS pos, '' AS value FROM part WHERE false")

    def status(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for name in ("json_orders", "toml_orders", "xml_orders", "hcl_parts", "ini_portable"):
            part = nodes(spark, sf_dir, name).filter("role = 'Document'").groupBy(F.lit(name).alias("source"), F.col("kind").alias("status")).agg(F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
        return out

    orders = "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
    rows = [f"SELECT '{s}' AS source, CASE WHEN {CUT} THEN '{bad}' ELSE 'Complete' END AS status, count(*) AS n FROM ({orders}) GROUP BY 2" for s, bad in (("json_orders", "Recovered"), ("toml_orders", "Failed"), ("xml_orders", "Recovered"))]
    rows += [f"SELECT '{s}', CASE WHEN {bad} THEN 'Recovered' ELSE 'Complete' END, count(*) FROM part GROUP BY 2" for s, bad in (("hcl_parts", "p_partkey % 13 = 0 OR p_partkey % 17 = 0"), ("ini_portable", "p_partkey % 5 = 0"))]
    REGISTERED["formation_of_sets"] = (status, " UNION ALL ".join(rows))


def _formation() -> None:
    def status(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nodes(spark, sf_dir, "broken").filter("role = 'Document'").groupBy(F.col("kind").alias("status")).agg(F.count(F.lit(1)).alias("n"))

    REGISTERED["formation_status"] = (status, f"SELECT CASE WHEN {DUP} THEN 'Recovered' ELSE 'Complete' END AS status, count(*) AS n FROM customer GROUP BY 1")

    def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nodes(spark, sf_dir, "json").filter("role LIKE 'Json%'").groupBy("role").agg(F.count(F.lit(1)).alias("n"))

    REGISTERED["inspect_structure_counts"] = (structure, f"SELECT role, sum(n)::BIGINT AS n FROM (SELECT unnest(['JsonValue', 'JsonObjectMember', 'JsonArrayElement']) AS role, unnest([8, 5, 2]) + unnest([1, 1, 0]) * CASE WHEN {DUP} THEN 1 ELSE 0 END AS n FROM customer) GROUP BY role")


def _function(name: str, act: Callable, sql: str | None) -> None:
    REGISTERED[name] = (act, sql)


def _conversion() -> None:
    from docloom.functions.convert import apply_plan, codes, convert, project
    from docloom.functions.edits import patch_documents
    from docloom.functions.source import detect, digest, encoding, exit_class, redacted

    def docs(name: str):
        return lambda spark, sf_dir: documents(spark, sf_dir, name)

    def converted(name: str, source: str, style: str, policy: str | None, status: str, fidelity: str, text: str) -> None:
        _function(name, lambda spark, sf_dir: convert(docs(source)(spark, sf_dir), TEXTS[source][0], style, policy), f"SELECT c_custkey::BIGINT AS doc_id, {status} AS status, {fidelity} AS fidelity, {text} AS text FROM customer")

    dup = lambda x: f"CASE WHEN {DUP} THEN {x} ELSE '' END"
    converted("convert_json_to_json", "json", "json.canonical-compact@1", None, "'Ok'", "'Exact'", f"""'{{"id":' || {K} || ',"name":"' || {N} || '","tags":["' || {G} || '",' || {M_} || '],"sub":{{"x":15e-1}}' || {dup("',\"id\":0'")} || '}}' || chr(10)""")
    first = f"""'"id": ' || {K} || chr(10) || '"name": "' || {N} || '"' || chr(10) || '"tags":' || chr(10) || '  - "' || {G} || '"' || chr(10) || '  - ' || {M_} || chr(10) || '"sub":' || chr(10) || '  "x": 15e-1' || chr(10)"""
    converted("convert_json_to_yaml_first_wins", "json", "yaml.canonical-block@1", "FirstWins", "'Ok'", f"CASE WHEN {DUP} THEN 'Lossy' ELSE 'Exact' END", first)
    converted("convert_json_reject", "json", "json.canonical-compact@1", "Reject", f"CASE WHEN {DUP} THEN 'core.projection.duplicate-key@1' ELSE 'Ok' END", f"CASE WHEN NOT {DUP} THEN 'Exact' END", f"""CASE WHEN NOT {DUP} THEN '{{"id":' || {K} || ',"name":"' || {N} || '","tags":["' || {G} || '",' || {M_} || '],"sub":{{"x":15e-1}}}}' || chr(10) END""")
    converted("convert_json_to_toml_refused", "json", "toml.canonical-document@1", None, "'core.materialization.unrepresentable@1'", "NULL::VARCHAR", "NULL::VARCHAR")
    converted("convert_ini_to_json", "ini", "json.canonical-compact@1", None, "'Ok'", "'Exact'", f"""'{{"Main":{{"Id":"' || {K} || '","name":"' || {N} || '"' || {dup("',\"ID\":\"2\"'")} || '}},"Other":{{"empty":""}}}}' || chr(10)""")
    converted("convert_properties_last_wins", "properties", "java-properties.reader-canonical@1", "LastWins", "'Ok'", f"CASE WHEN {DUP} THEN 'Lossy' ELSE 'Exact' END", f"""CASE WHEN {DUP} THEN '' ELSE 'id=' || {K} || chr(10) END || 'a\\ key=' || {N} || chr(10) || 'empty=' || chr(10) || 'explicit=' || chr(10) || 'long=ab' || chr(10) || {dup("'id=0' || chr(10)")}""")
    converted("convert_toml_to_toml", "toml", "toml.canonical-document@1", None, "'Ok'", "'Exact'", f"""'id = ' || {K} || chr(10) || 'name = "' || {N} || '"' || chr(10) || 'tags = ["' || {G} || '", ' || {M_} || ']' || chr(10) || 'line = [{{no = 1}}, {{no = 2}}]' || chr(10) || 'sub = {{x = 1.5}}' || chr(10)""")
    converted("convert_xml_to_json_refused", "xml", "json.canonical-compact@1", None, "'core.conversion.record-family@1'", "NULL::VARCHAR", "NULL::VARCHAR")
    for source, style in (("xml", "xml.safe-canonical-document@1"), ("plist", "plist.xml-canonical@1")):
        _function(f"convert_{source}_closure", lambda spark, sf_dir, s=source, t=style: convert(docs(s)(spark, sf_dir), TEXTS[s][0], t).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT 'Ok' AS status, count(*) AS n FROM customer")
    _function("plist_convert_to_binary", lambda spark, sf_dir: convert(docs("plist")(spark, sf_dir), "plist.xml@1", "plist.binary-canonical@1").groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN {DUP} THEN 'core.materialization.unrepresentable@1' ELSE 'Ok' END AS status, count(*) AS n FROM customer GROUP BY 1")
    _function("project_json_fidelity", lambda spark, sf_dir: project(docs("json")(spark, sf_dir), "json.strict@1").groupBy("status", "fidelity").agg(F.count(F.lit(1)).alias("n")), f"SELECT 'Ok' AS status, CASE WHEN {DUP} THEN 'Transformed' ELSE 'Exact' END AS fidelity, count(*) AS n FROM customer GROUP BY 2")
    _function("project_recovered_refused", lambda spark, sf_dir: project(docs("broken")(spark, sf_dir), "json.strict@1").groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN {DUP} THEN 'core.projection.unavailable@1' ELSE 'Ok' END AS status, count(*) AS n FROM customer GROUP BY 1")
    _function("value_codes", lambda spark, sf_dir: codes(docs("json")(spark, sf_dir), "json.strict@1").select("doc_id", F.hex("pvce").alias("pvce"), "hash", "transport"), None)

    def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = chain("json.native-semantic-query@1", "json.try-object-members", ("json.member-name-equals", {"name": "name"}), "json.member-value")
        at = query_documents(query, documents(spark, sf_dir, "json"), "json.strict@1").matches.select("doc_id", "start_byte", "end_byte", F.lit('"renamed"').alias("replacement"))
        return patch_documents(docs("json")(spark, sf_dir), at, "json.strict@1").select("doc_id", "status", "text", "untouched", (F.sha2(F.col("text"), 256) == F.col("target_digest")).alias("verified"))

    text = f"""'{{"id":' || {K} || ',"name":"renamed","tags":["' || {G} || '",' || {M_} || '],"sub":{{"x":1.50}}' || {dup("',\"id\":0'")} || '}}'"""
    _function("edit_replace_value", renamed, f"SELECT c_custkey::BIGINT AS doc_id, 'Ok' AS status, {text} AS text, (length({text}) - 9)::BIGINT AS untouched, true AS verified FROM customer")

    def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
        from docloom.functions.edits import edit_documents
        from docloom.functions.values import Value, encode

        args = '{"name": "new", "value": "%s"}' % encode(Value("Boolean", True)).hex()
        base = docs("json")(spark, sf_dir)
        asked = base.select("doc_id", F.lit("insert-member").alias("operation"), F.lit(1).alias("node_id"), F.lit(args).alias("args"))
        return edit_documents(base, asked, "json.strict@1").select("doc_id", "status", "text")

    body = f"""'{{"id":' || {K} || ',"name":"' || {N} || '","tags":["' || {G} || '",' || {M_} || '],"sub":{{"x":1.50}}' || {dup("',\"id\":0'")} || ', "new": true}}'"""
    _function("edit_insert_member", inserted, f"SELECT c_custkey::BIGINT AS doc_id, 'Ok' AS status, {body} AS text FROM customer")

    def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = documents(spark, sf_dir, "ini").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
        target = F.concat(F.col("text"), F.lit("; done\r\n"))
        plan = base.select("path", F.sha2("text", 256).alias("base_digest"), F.sha2(target, 256).alias("target_digest"), target.alias("target"))
        now = base.select("path", F.when(F.col("doc_id") % 3 == 0, target).when(F.col("doc_id") % 3 == 1, F.lit("changed")).otherwise(F.col("text")).cast("binary").alias("content"))
        return apply_plan(now, plan).groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    _function("apply_plan", planned, "SELECT CASE WHEN c_custkey % 3 = 1 THEN 'skipped-stale' ELSE 'completed' END AS status, count(*) AS n FROM customer GROUP BY 1")
    _function("source_digest", lambda spark, sf_dir: documents(spark, sf_dir, "ini").select("doc_id", digest(F.col("text")).alias("digest")), f"SELECT c_custkey::BIGINT AS doc_id, sha256('[Main]' || chr(13) || chr(10) || 'Id=' || {K} || chr(13) || chr(10) || 'name=' || {N} || chr(13) || chr(10) || {dup("'ID=2' || chr(13) || chr(10)")} || '[Other]' || chr(13) || chr(10) || 'empty=' || chr(13) || chr(10) || '; note' || chr(13) || chr(10)) AS digest FROM customer")
    kinds = {"json": "json", "toml": "toml", "yaml": "yaml", "ini": "ini", "properties": "java-properties", "xml": "xml", "plist": "plist", "hcl": "hcl"}

    def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for name, end in (("json", "json"), ("toml", "toml"), ("yaml", "yaml"), ("ini", "ini"), ("properties", "properties"), ("xml", "xml"), ("plist", "plist"), ("hcl", "tf")):
            part = documents(spark, sf_dir, name).select(F.lit(name).alias("source"), F.array_join(detect(F.col("text"), F.lit(f"a.{end}")), ",").alias("families"))
            out = part if out is None else out.unionByName(part)
        return out.groupBy("source", "families").agg(F.count(F.lit(1)).alias("n"))

    rows = " UNION ALL ".join(f"SELECT '{k}' AS source, '{v}' AS families, count(*) AS n FROM customer" for k, v in kinds.items())
    _function("detect_families", detected, rows)
    _function("redact_values", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), redacted(F.when(F.expr(DUP), F.lit("db_Password")).otherwise(F.lit("name")), F.col("c_name")).alias("value")), f"SELECT c_custkey AS doc_id, CASE WHEN {DUP} THEN '***' ELSE c_name END AS value FROM customer")
    _function("resolve_encoding", lambda spark, sf_dir: documents(spark, sf_dir, "ini").select(encoding(F.concat(F.when(F.expr("doc_id % 2 = 0"), F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.col("text").cast("binary")), "utf-8", declaration=F.when(F.expr("doc_id % 3 = 0"), F.lit("latin-1"))).alias("e")).groupBy(F.col("e.selected").alias("selected"), F.col("e.code").alias("code")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'latin-1' ELSE 'utf-8' END AS selected, CASE WHEN c_custkey % 6 = 0 THEN 'core.source.encoding-conflict@1' END AS code, count(*) AS n FROM customer GROUP BY 1, 2")
    _function("exit_classes", lambda spark, sf_dir: convert(docs("json")(spark, sf_dir), "json.strict@1", "json.canonical-compact@1", "Reject").select(exit_class(F.when(F.col("status") != "Ok", F.col("status"))).cast("long").alias("exit")).groupBy("exit").agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN {DUP} THEN 4 ELSE 0 END::BIGINT AS exit, count(*) AS n FROM customer GROUP BY 1")

    def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
        from docloom.plans.catalog import DOMAINS

        return spark.createDataFrame([(d, len(ops)) for d, (_, ops) in DOMAINS.items()], "domain string, operators long")

    # How many operators each domain has.
    counts = [
        ("core.portable-value-query@1", 9), ("core.portable-graph-query@1", 8), ("json.native-semantic-query@1", 5), ("json.native-semantic-query@2", 5), ("toml.native-semantic-query@1", 5), ("yaml.native-semantic-query@1", 14),
        ("ini.native-semantic-query@1", 10), ("java-properties.native-semantic-query@1", 8), ("xml.native-semantic-query@1", 25), ("plist.native-semantic-query@1", 15), ("plist.binary-structure-query@1", 6), ("hcl.native-semantic-query@1", 22),
        *[(f"{f}.lossless-syntax-query@1", 4 if f == "java-properties" else 2) for f in ("json", "toml", "yaml", "ini", "java-properties", "xml", "plist", "hcl")], ("json.lossless-syntax-query@2", 2),
    ]
    _function("registry_domains", catalogue, "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {n}::BIGINT)" for d, n in counts) + ") t(domain, operators)")

    # The binary forms of one small value and one small graph for each customer, spelled out in SQL.
    def small(text: str) -> Callable:
        return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.format_string(text, "c_custkey").alias("text"))

    def value_form(spark: SparkSession, sf_dir: str) -> DataFrame:
        return codes(small('{"id":%d}')(spark, sf_dir), "json.strict@1").select("doc_id", F.lower(F.hex("pvce")).alias("form"), "transport")

    def graph_form(spark: SparkSession, sf_dir: str) -> DataFrame:
        from docloom.functions.graphs import codes as graph_codes

        return graph_codes(small("id: %d\n")(spark, sf_dir), "yaml.1.2-core@1").select("doc_id", "status", F.lower(F.hex("pgce")).alias("form"))

    byte = lambda x: f"printf('%02x', ({x})::BIGINT)"
    size = "CASE WHEN c_custkey = 0 THEN 0 WHEN c_custkey < 256 THEN 1 WHEN c_custkey < 65536 THEN 2 ELSE 3 END"
    whole = f"CASE WHEN c_custkey = 0 THEN '0000' ELSE '01' || {byte(size)} || substr(printf('%06x', c_custkey::BIGINT), 7 - 2 * ({size})) END"
    body = f"'01200302' || '6964' || '10' || {byte(f'2 + ({size})')} || ({whole})"
    _function("value_binary_form", value_form, f"""SELECT c_custkey AS doc_id, '505643450141' || {byte(f"length({body}) / 2")} || {body} AS form, '{{"kind":"Object","entries":[["id",{{"kind":"Integer","value":"' || c_custkey || '"}}]]}}' AS transport FROM customer""")
    tag = lambda x: f"'15' || lower(hex('tag:yaml.org,2002:{x}'))"
    _function("graph_binary_form", graph_form, f"SELECT c_custkey AS doc_id, 'Ok' AS status, '504743450101030041' || {tag('map')} || '010102' || '20' || {tag('str')} || '026964' || '20' || {tag('int')} || {byte('length(c_custkey::VARCHAR)')} || lower(hex(c_custkey::VARCHAR)) AS form FROM customer")


for _part in (_conversion, _json, _values, _graph, _toml, _yaml, _ini, _properties, _xml, _plist, _hcl, _sets, _formation):
    _part()


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTERED.items() if s}
