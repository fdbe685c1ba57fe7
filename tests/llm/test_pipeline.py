from collections import Counter, defaultdict

import pytest

import corpus_pipeline
import plain
from docloom.llm import quality

NAMES = ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.fixture(scope="module")
def written(spark, sf_dir, tmp_path_factory):
    """The table before the first stage and after each."""
    folder, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def listed(df):
    return [r.asDict() for r in df.select("doc_id", "text", "source").collect()]


def test_stages_return_the_columns_of_documents(written):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(df.columns == written[0].columns for df in written[:-1])
    counts = [df.count() for df in written]
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[5] == counts[4]


def test_quality_equals_the_plain_version(written):
    assert Counter(d["doc_id"] for d in plain.good_documents(listed(written[0]))) == Counter(d["doc_id"] for d in listed(written[1]))


def test_near_duplicates_equal_the_plain_version(written):
    want = {d["doc_id"] for d in plain.without_near_copies(listed(written[1]))}
    got = {d["doc_id"] for d in listed(written[2])}
    gone = {d["doc_id"] for d in listed(written[1])} - want
    assert want <= got and len(gone - got) >= 0.9 * len(gone) and len(gone) > 3


def test_decontamination_equals_the_plain_version(spark, sf_dir, written):
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {d["doc_id"] for d in plain.without_benchmark(listed(written[2]), bench)} == {d["doc_id"] for d in listed(written[3])}


def test_mixing_and_sharding_equal_the_plain_version(written):
    want = plain.mixed(listed(written[3]), corpus_pipeline.WEIGHTS)
    last = written[5].collect()
    assert Counter((r.doc_id, r.text) for r in last) == want == Counter((d["doc_id"], d["text"]) for d in listed(written[4]))
    slots, shard = defaultdict(list), {}
    for r in last:
        slots[r.shard].append(r.slot)
        assert shard.setdefault(r.doc_id, r.shard) == r.shard and r.grown_shard in (r.shard, corpus_pipeline.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_last_stage(spark, sf_dir, written):
    key = lambda r: (r.doc_id, r.shard, r.slot, r.text_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, written[5].collect()))


def test_clean_documents_stay(spark, sf_dir, written):
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & {d["doc_id"] for d in listed(written[1])}) >= 0.9 * len(good)


ODD = [(None, None, None, None, None), (1, None, "en", "src0", 0), (2, "", "en", None, 0), (3, " \n", None, "src1", 2), (4, "short", "en", "src1", 5), (5, "same words again " * 400, "en", "src0", 6800)]


def test_odd_rows_pass_through_all_stages(spark, sf_dir, tmp_path):
    text = " ".join(f"word{k} and more" for k in range(80))
    rows = [*ODD, (6, text, "en", "src0", len(text)), (6, text, "en", "src0", len(text)), (7, text + " end", "en", None, len(text) + 4), (None, text + " of it all", "en", "src1", 9), (8, " ".join("".join(chr(97 + int(c)) for c in str(k)) for k in range(60000)), "en", "src1", 9)]
    for n, docs in enumerate((rows, [])):
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{n}{name}")
            df = spark.read.parquet(f"{tmp_path}/{n}{name}")
            if docs and name == "near_duplicates":
                assert sorted(str(r.doc_id) for r in df.collect()) == ["6", "8", "None"]
        assert {"shard", "slot"} <= set(df.columns) and (docs or df.count() == 0)
