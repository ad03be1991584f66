"""The stream's windows equal the batch operator's."""

from conftest import DATA

from meshlark.operators.windows import sliding
from meshlark.plans import views
from meshlark.sources.npz import same_table
from meshlark.streaming.windows import write_windows


def test_stream_equals_batch(spark, tmp_path):
    frames = views.frames(spark, f"{DATA}/sf0.001").select("traj_idx", "pos", "frame_id")
    for k in range(3):
        frames.where(f"pos >= {k * 25} and pos < {k * 25 + 25}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_windows(stream, str(tmp_path / "out"), str(tmp_path / "state"), 3, 2, 2).awaitTermination(180)
    assert same_table(spark.read.parquet(str(tmp_path / "out/windows/*")), sliding(seen, 3, 2, 2))
