"""Sources and sinks for snapshots, traces and reports."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_npz(spark: SparkSession, pattern: str, fields: list[str] | None = None) -> DataFrame:
    """(path, field, height, width, values) of the 2-D arrays of .npz files: one row a field, row-major.

    Files come through Spark's reader, so any store will do; only the named arrays are decoded.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for f in fields or z.files:
                        a = np.asarray(z[f], np.float64)
                        rows.append({"path": path, "field": f, "height": a.shape[0], "width": a.shape[1], "values": a.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("field", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("values", pa.list_(pa.float64()))]))

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(run, "path string, field string, height int, width int, values array<double>")


def pixels(arrays: DataFrame) -> DataFrame:
    """(path, field, x, y, v) from read_npz's rows; row 0 is the lowest y."""
    from pyspark.sql import functions as F

    long = arrays.select("path", "field", "width", F.posexplode("values").alias("k", "v"))
    return long.select("path", "field", (F.col("k") % F.col("width")).alias("x"), F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), "v")


TRACE = "key string, cache_hit boolean, start_ns bigint, source_ready_ns bigint, normalize_ready_ns bigint, end_ns bigint, pid int, thread_id bigint, rank int, source_position bigint, epoch int, rank_sequence bigint, sample_index bigint, traj_idx int, frame_idx int"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Access events of a folder of JSON lines, with a fixed schema."""
    return spark.read.schema(TRACE).json(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(field, mean, std) of a JSON object {field: {mean, std}}."""
    from pyspark.sql import functions as F

    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, struct<mean: double, std: double>>")).alias("field", "s")).select("field", "s.mean", "s.std")


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write, and refuse to overwrite what is there."""
    df.write.mode("errorifexists").option("header", True).format(kind).save(path)


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows, in either direction."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def add_topologies(spark: SparkSession, path: str, rows: DataFrame, key: str = "frame_key", digest: str = "digest") -> int:
    """Append the rows whose key the store lacks; a stored key with another digest is an error. Returns how many were added."""
    from meshlark.operators.selection import conflicts, require_empty

    rows = rows.dropDuplicates([key, digest])
    require_empty(conflicts(rows, key, digest), "one key, two contents")
    try:
        store = spark.read.parquet(path)
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.write.parquet(path)
        return rows.count()
    require_empty(conflicts(rows.select(key, digest).unionByName(store.select(key, digest)), key, digest), "stored with another content")
    new = rows.join(store.select(key), key, "left_anti").persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n
