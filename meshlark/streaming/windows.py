"""Sliding windows over a stream of frames, as an extra: the batch operator on each micro-batch's trajectories.

State is each trajectory's last span - 1 frames, kept in a table beside the sink, so a window is
written once, when its last frame arrives, and an available-now run over all files equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.windows import sliding


def write_windows(frames: DataFrame, path: str, checkpoint: str, t_in: int, t_out: int, step: int = 1):
    """Stream frames(traj_idx, pos, frame_id), in order of pos within a trajectory, to windows at ``path``.

    Each batch writes its own folder, and its tail in another, so a batch that is run again replaces
    what it wrote. Returns the started query.
    """
    span = (t_in + t_out - 1) * step + 1

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.select("traj_idx", "pos", "frame_id")
        if number:
            df = df.unionByName(spark.read.schema(df.schema).parquet(f"{path}/tail/{number - 1}"))
        df = df.persist()
        sliding(df, t_in, t_out, step).write.mode("overwrite").parquet(f"{path}/windows/{number}")
        last = Window.partitionBy("traj_idx").orderBy(F.desc("pos"))
        df.withColumn("_k", F.row_number().over(last)).where(F.col("_k") < span).drop("_k").write.mode("overwrite").parquet(f"{path}/tail/{number}")
        df.unpersist()

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
