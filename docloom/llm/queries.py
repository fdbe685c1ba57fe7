"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = {"src0": 4.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_char_lstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op3_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.chunks import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.tokens import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op8_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.mixing import replicate

    return replicate(table(spark, sf_dir, "documents"), MIX)


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.common import stored
    from docloom.llm.quality import judge, measures

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, measured=stored(measures(docs).drop("text"), "measures"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *names, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def oracle_sql() -> dict[str, str]:
    from docloom.llm import mixing

    return {"op9_poisson_mixing": mixing.sql(MIX, 1.0, 42)}


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
