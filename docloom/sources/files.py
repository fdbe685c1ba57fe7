"""Files in, files out, and node tables kept for later queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.scan import MAX_BYTES


def read_documents(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id (a hash of the path), path, content and digest; larger files have no content and fail when parsed."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    content = F.when(F.col("length") <= max_bytes, F.col("content"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", content.alias("content"), F.sha2(content, 256).alias("digest"))


def save_nodes(nodes: DataFrame, table: str, buckets: int) -> None:
    """Keep a node table bucketed by doc_id: every later join of an operator finds its sides together, without a shuffle."""
    nodes.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "node_id").mode("overwrite").saveAsTable(table)


def write_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Write text (or content) of each row to folder/path by a temporary name and a rename; path and status of each.

    Refuses paths that leave the folder, links, folders and files that can't be written; reads back what it wrote.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append((path, write_one(folder, path, content)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())], names=["path", "status"])

    column = "content" if "content" in docs.columns else "text"
    return docs.select("path", F.col(column).cast("binary").alias("content")).mapInArrow(run, "path string, status string")


def write_one(folder: str, path: str, content: bytes) -> str:
    root = os.path.realpath(folder)
    target = os.path.join(root, path)
    if os.path.commonpath([root, os.path.realpath(os.path.dirname(target))]) != root or os.path.islink(target) or os.path.isdir(target):
        return "core.write.refused@1"
    if os.path.exists(target) and not os.access(target, os.W_OK):
        return "core.write.read-only@1"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, target)
    with open(target, "rb") as back:
        return "completed" if back.read() == content else "core.write.read-back@1"
