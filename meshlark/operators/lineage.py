"""Cutting a plan's lineage in loops, by a table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, local mode takes a folder of its own (one process has
    it), and a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="meshlark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows up to which a cut table may be broadcast.
SMALL = 20_000


def cut(df: DataFrame, joined: bool = True) -> DataFrame:
    """df written as Parquet and read again: computed once, and of a known size, so that joins with it
    need no shuffle where it is small. Spark takes the size of the files for that of the rows, but cells
    and their values compress a hundredfold: a table of more than SMALL rows asks for sort-merge joins. They
    are counted for that, unless the table meets nothing in joins."""
    path = f"{shared_dir(df.sparkSession)}/meshlark/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if joined and out.count() > SMALL:  # from the files' footers
        out = out.hint("merge")
    out._cut_at = path
    return out


def uncut(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_cut_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
