"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset and one machine does all work."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster, it must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def on_disk(spark: SparkSession, path: str) -> str | None:
    """``path`` as Python's ``open`` takes it, where Spark finds it on a disk; None in any other store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit; nothing depends on this
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later losses of executors recompute nothing above it. It goes at exit."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read any more; only what is itself written may depend on it."""
    remove(table.sparkSession, table._written_to)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows dealt evenly over as many tasks as shuffles have: for work that costs far more than sending its rows.

    Texts are mined at about a megabyte a second; a file of one row group, or a few very long texts, would leave most cores idle. by: a key of the
    rows to deal them by, so that what groups or numbers a document's parts later needs no shuffle of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
