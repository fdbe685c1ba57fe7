import json
import subprocess
import sys

from docloom.__main__ import main
from docloom.functions.convert import apply_plan
from docloom.plans.algebra import chain, to_wire
from docloom.plans.compile import run
from docloom.sources.files import read_documents, save_nodes, write_documents
from docloom.sources.scan import scan
from docloom.streaming.ingest import ingest


def test_files_in_and_out(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.json", '{"a":1}'), ("y.json", "[2]"), ("../evil", "no")], "path string, text string")
    status = {r.path: r.status for r in write_documents(docs, str(tmp_path / "out")).collect()}
    assert status == {"a/x.json": "completed", "y.json": "completed", "../evil": "core.write.refused@1"}
    back = read_documents(spark, str(tmp_path / "out"), "*.json")
    assert sorted(bytes(r.content).decode() for r in back.collect()) == ["[2]", '{"a":1}']
    assert read_documents(spark, str(tmp_path / "out"), max_bytes=3).filter("content IS NULL").count() == 1


def test_arriving_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target, mark = str(tmp_path / "nodes"), str(tmp_path / "mark")
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text('{"k": 1}')
        ingest(spark, str(tmp_path / "in"), "json.strict@1", target, mark, "*.json").awaitTermination(120)
    nodes = spark.read.parquet(target)
    assert nodes.filter("role = 'Document'").count() == 2
    assert run(chain("json.native-semantic-query@1", "json.try-object-members"), nodes.drop("batch")).matches.count() == 2


def test_bucketed_nodes_join_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(k, f'{{"a":[{k}]}}') for k in range(30)], "doc_id long, text string")
    save_nodes(scan(docs, "json.strict@1"), "nodes_kept", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        found = run(chain("json.native-semantic-query@1", "json.try-object-members", "json.member-value", "json.try-array-elements", "json.array-element-value"), spark.table("nodes_kept")).matches
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", old[1])
        spark.sql("DROP TABLE nodes_kept")


def test_plans_are_applied_once(spark):
    from hashlib import sha256

    d = lambda s: sha256(s.encode()).hexdigest()
    plan = spark.createDataFrame([(p, d("old"), d("new"), "new") for p in "abcd"], "path string, base_digest string, target_digest string, target string")
    files = spark.createDataFrame([("a", "old"), ("b", "new"), ("c", "other")], "path string, content string")
    assert {r.path: (r.status, r.content) for r in apply_plan(files, plan).collect()} == {"a": ("completed", "new"), "b": ("completed", "new"), "c": ("skipped-stale", "other"), "d": ("failed", None)}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text('{"a": [1, 2]}')
    assert main(["capabilities"]) == 0 and len(json.loads(capsys.readouterr().out)["profiles"]) == 16
    query = to_wire(chain("json.native-semantic-query@1", "json.try-object-members"))
    assert main(["query", str(tmp_path), "--profile", "json.strict@1", "--query", query]) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "a"
    assert main(["convert", str(tmp_path), "--profile", "json.strict@1", "--style", "yaml.canonical-flow@1"]) == 0
    assert json.loads(capsys.readouterr().out)["text"] == '{"a": [1, 2]}\n'


def test_files_are_edited_planned_and_applied(tmp_path, capsys):
    import json

    from docloom.functions.values import integer, encode

    said = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    (tmp_path / "in").mkdir()
    for name, text in (("a", '{"x":1}'), ("b", '{"x":2}'), ("c", "[1"), ("d", '{"x":4}')):
        (tmp_path / "in" / f"{name}.json").write_text(text)
    new = json.dumps([{"operation": "insert-member", "node_id": 1, "args": {"name": "y", "value": encode(integer(5)).hex()}}])
    (tmp_path / "edit.json").write_text(new)
    one, many, plan, out = (str(tmp_path / x) for x in ("in/d.json", "in", "plan.json", "result.json"))
    common = ["--profile", "json.strict@1", "--requests", str(tmp_path / "edit.json")]
    assert main(["edit", one, *common, "--dry-run"]) == 0 and json.loads(said()[0]["target"]) == {"x": 4, "y": 5} and (tmp_path / "in/d.json").read_text() == '{"x":4}'
    assert main(["edit", one, *common]) == 0 and said()[0]["status"] == "completed" and json.loads((tmp_path / "in/d.json").read_text()) == {"x": 4, "y": 5}
    assert main(["plan", many, *common, "--output", plan]) > 0
    assert [x["status"] for x in said()] == ["planned", "planned", "failed", "planned"]
    (tmp_path / "in/b.json").write_text('{"x":3}')
    assert main(["apply", plan, "--output", out]) > 0
    assert [x["status"] for x in said()] == ["completed", "skipped-stale", "failed", "completed"]
    assert json.loads((tmp_path / "in/a.json").read_text()) == {"x": 1, "y": 5} and (tmp_path / "in/b.json").read_text() == '{"x":3}'
    assert [x["status"] for x in json.loads((tmp_path / "result.json").read_text())["files"]] == ["completed", "skipped-stale", "failed", "completed"]
    main(["apply", plan, "--output", out])
    assert [x["status"] for x in said()] == ["completed", "skipped-stale", "failed", "completed"]


def test_values_are_materialized_and_cases_checked(spark, sf_dir, tmp_path, capsys):
    (tmp_path / "v.json").write_text('{"kind":"Object","entries":[["a",{"kind":"Integer","value":"1"}]]}')
    assert main(["materialize", str(tmp_path / "v.json"), "--style", "yaml.canonical-block@1"]) == 0
    assert json.loads(capsys.readouterr().out)["text"] == '"a": 1\n'
    assert main(["conformance", sf_dir, "--only", "json_member_value"]) == 0
    assert json.loads(capsys.readouterr().out) == {"case": "json_member_value", "status": "passed"}


def test_the_library_does_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['docloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    from pathlib import Path

    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
