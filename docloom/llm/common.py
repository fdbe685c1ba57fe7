"""Helpers the operators of this subpackage share: stored intermediate tables, partition counts, group streams."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this machine where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        app = spark.sparkContext.applicationId
        if not known.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not known.isDefined() and app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="docloom-")
        found = known.get() if known.isDefined() else _LOCAL[app]
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below one folder for each application, which clear() deletes."""
    return f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored: call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by stored() that is not read again."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame, mb_each: int = 64) -> int:
    """The session's shuffle partitions, or more where the input's estimated size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, math.ceil(size / (mb_each << 20))), 200_000) if size < 1 << 62 else least


def unit(*parts) -> F.Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts; missing parts count as empty strings."""
    said = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, F.Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *said)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def filesystem(path: str):
    """pyarrow's file system and the path in it, for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_file(path: str, *chunks: bytes) -> None:
    """Write under another name and rename, so that a repeated task leaves one whole file."""
    files, at = filesystem(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(part := f"{at}.{uuid.uuid4().hex}") as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(part, at)


def read_file(path: str) -> bytes:
    files, at = filesystem(path)
    with files.open_input_stream(at) as source:
        return source.read()
