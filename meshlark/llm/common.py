"""Shared helpers of the corpus operators: shared-folder tables, hashing, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the C library has it: what returns freed memory.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: ASCII letters, for lower-casing exactly A-Z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only in local mode, where the session has none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="meshlark-")  # driver and executors are one process here
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, label: str, fewer: int = 1, codec: str | None = None) -> DataFrame:
    """df cut from its lineage: written as Parquet to the shared folder and read again.

    Losing an executor afterwards costs a reread of files, not a recomputation. ``fewer``: a table that
    is small beside what it is made from goes to that many times fewer files than there are shuffle
    partitions, so that they are not many tiny ones. ``codec``: a Parquet compression other than the session's.
    """
    spark = df.sparkSession
    if fewer > 1:
        df = df.coalesce(max(1, shuffle_partitions(spark) // fewer))
    path = f"{shared_dir(spark)}/meshlark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshlark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    path = getattr(df, "_meshlark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go now rather than when the driver next collects its memory."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (id, component) per vertex with an edge.

    component is the smallest id reachable. Alternating large-star and small-star steps; each
    step is a min-aggregation (combined before its shuffle) and a join back, so a hub vertex is
    never gathered into one row, and AQE splits its skewed join. Every round is written to the
    shared folder, and rounds go on until nothing changes. Null ends and self loops are ignored.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", 8)
    last = None
    while True:
        # large star: every larger neighbour of u, and u's own tree, points to u's least neighbour
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        then = written(small, "cc", 8)
        mark = then.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = then
        if last is not None and (mark["n"], mark["h"]) == last:
            break
        last = (mark["n"], mark["h"])
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


#: Emptied when another operator takes over the worker: name -> what empties its memory.
_MEMORIES: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Say how the module ``name`` empties what it keeps between a worker's tasks."""
    _MEMORIES[name] = forget


def only(name: str) -> None:
    """Called when a task of ``name`` begins: a worker, which Spark reuses over jobs, keeps one operator's memory."""
    if _OWNER[0] != name:
        for other, forget in _MEMORIES.items():
            if other != name:
                forget()
        _OWNER[0] = name
        give_back()


def give_back() -> None:
    """Return freed memory to the system: called where a task ends, as its worker then waits for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: whatever they are called, they clash with nothing."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """The name that numbered() gives a column: the exact one, else the one that differs in case only."""
    names = df.columns
    found = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return f"c{found[0]}"
