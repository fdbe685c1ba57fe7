"""Files as they arrive: each is parsed on its own, so the stream keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.scan import scan


def files(spark: SparkSession, folder: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """A stream of path, content and digest of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)
    return rows.select("path", "content", F.sha2("content", 256).alias("digest"))


def ingest(spark: SparkSession, folder: str, profile: str, target: str, checkpoint: str, glob: str = "*"):
    """Append the node tables of arriving files to a Parquet table, each file once; gives the running query.

    doc_id is a hash of path and digest, so a batch that is repeated after a failure writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.xxhash64("path", "digest").alias("doc_id"), "content")
        scan(docs, profile).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files(spark, folder, glob).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
