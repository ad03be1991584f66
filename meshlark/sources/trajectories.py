"""Discovering and ordering simulation snapshots by their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.operators.windows import global_rank

SLICE = ":::"


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, modified) of the files of a glob, in any store Spark reads; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def single(paths: DataFrame) -> DataFrame:
    """One trajectory: its paths in lexicographic order."""
    return global_rank(paths.select("path"), ["path"]).select(F.lit(0).alias("traj_idx"), F.col("rank").cast("int").alias("pos"), "path")


def grouped(paths: DataFrame, pattern: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Trajectories by the two integers (simulation, time) a pattern captures; other paths are left out.

    Simulations are ordered and sliced [start:stop]; a stop beyond their number is an error.
    """
    sim, at = (F.expr(f"try_cast(regexp_extract(path, {pattern!r}, {k}) as bigint)") for k in (1, 2))
    found = paths.select("path", sim.alias("sim"), at.alias("at")).where("sim is not null and at is not null")
    n = found.select("sim").distinct().count()
    if stop is not None and stop > n:
        raise ValueError(f"stop {stop} is beyond the {n} trajectories found")
    order = global_rank(found.select("sim").distinct(), ["sim"]).withColumn("traj_idx", F.col("rank").cast("int")).drop("rank")
    kept = order.where(F.col("traj_idx").between(start, (stop or n) - 1)).withColumn("traj_idx", F.col("traj_idx") - start)
    out = found.join(kept, "sim")
    return out.select("traj_idx", (F.row_number().over(Window.partitionBy("traj_idx").orderBy("at", "path")) - 1).alias("pos"), "at", "path")


def listed(globs: list[DataFrame]) -> DataFrame:
    """Each listing is one trajectory, in order; an empty one or a path in two is an error."""
    out = None
    for k, g in enumerate(globs):
        if g.isEmpty():
            raise ValueError(f"trajectory {k} has no files")
        one = single(g).withColumn("traj_idx", F.lit(k))
        out = one if out is None else out.unionByName(one)
    twice = out.groupBy("path").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"{twice[0]['path']} is in more than one trajectory")
    return out


def virtual_paths(files: DataFrame) -> DataFrame:
    """path:::trajectory:::frame for each frame of files(path, trajectories, frames)."""
    t = files.select("path", "frames", F.explode(F.sequence(F.lit(0), F.col("trajectories") - 1)).alias("traj_idx"))
    t = t.select("path", "traj_idx", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("pos"))
    return t.select("traj_idx", "pos", F.concat_ws(SLICE, "path", "traj_idx", "pos").alias("path"))


def parse_virtual(path):
    """Column: struct(path, traj, frame) of a virtual path, read from the right."""
    parts = F.regexp_extract
    pattern = f"^(.*){SLICE}([0-9]+){SLICE}([0-9]+)$"
    return F.struct(parts(path, pattern, 1).alias("path"), parts(path, pattern, 2).cast("int").alias("traj"), parts(path, pattern, 3).cast("int").alias("frame"))


def clock(frames: DataFrame, step: float) -> DataFrame:
    """time = index * step; the step must be finite and positive."""
    if not 0 < step < float("inf"):
        raise ValueError("the step must be finite and positive")
    return frames.withColumn("time", F.col("pos") * F.lit(step))


def native_clock(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """frames(path) with the time that their own header tells; a frame without one raises when it is read."""
    met = frames.join(headers.select("path", F.col("time").alias("told")), "path", "left")
    return met.withColumn("time", F.when(F.col("told").isNotNull(), F.col("told")).otherwise(F.raise_error(F.concat(F.lit("no time in "), F.col("path"))).cast("double"))).drop("told")


def clock_faults(frames: DataFrame, traj: str = "traj_idx", pos: str = "pos", time: str = "time") -> DataFrame:
    """Frames whose time is not finite or not later than that of the frame before."""
    t = F.col(time)
    before = F.lag(time).over(Window.partitionBy(traj).orderBy(pos))
    return frames.where(t.isNotNull()).withColumn("earlier", before).where(F.isnan(t) | (F.abs(t) == float("inf")) | (t <= F.col("earlier"))).drop("earlier")


def identity(files: DataFrame, dataset: str) -> DataFrame:
    """sha256 over the data set, path, size and change time: the key of what is built from a file."""
    return files.withColumn("frame_key", F.sha2(F.to_json(F.struct(F.lit(dataset).alias("dataset"), "path", "size", "modified")), 256))
