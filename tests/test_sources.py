"""Sources and sinks on files that the tests write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import mesh as M
from meshlark.sources import npz, trajectories


def test_paths_and_trajectories(spark, tmp_path):
    for sim in (10, 2, 7):
        for t in (3, 1, 12):
            (tmp_path / f"run_id{sim}_idx{t}.npz").write_bytes(b"x")
    (tmp_path / "notes.npz").write_bytes(b"x")
    files = trajectories.list_files(spark, f"{tmp_path}/*.npz")
    got = trajectories.grouped(files, r"id([0-9]+)_idx([0-9]+)", 1, 3).orderBy("traj_idx", "pos").collect()
    assert [(r.traj_idx, r.pos, r.at, r.path.rsplit("/", 1)[1]) for r in got] == [(i, k, t, f"run_id{s}_idx{t}.npz") for i, s in enumerate((7, 10)) for k, t in enumerate((1, 3, 12))]
    with pytest.raises(ValueError):
        trajectories.grouped(files, r"id([0-9]+)_idx([0-9]+)", 0, 4)
    with pytest.raises(ValueError):
        trajectories.listed([files, files])
    assert trajectories.listed([files.where("path like '%id2_%'"), files.where("path like '%id7_%'")]).groupBy("traj_idx").count().count() == 2
    assert trajectories.identity(files, "d").select("frame_key").distinct().count() == 10


def test_virtual_paths(spark):
    files = spark.createDataFrame([("a:::b.h5", 2, 3)], "path string, trajectories int, frames int")
    out = trajectories.virtual_paths(files).select("traj_idx", "pos", trajectories.parse_virtual("path").alias("p")).collect()
    assert len(out) == 6 and all((r.p.path, r.p.traj, r.p.frame) == ("a:::b.h5", r.traj_idx, r.pos) for r in out)


def test_npz_pixels(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    np.savez(tmp_path / "s.npz", u=a, w=-a)
    rows = npz.pixels(npz.read_npz(spark, f"{tmp_path}/*.npz", ["u"])).collect()
    assert {(r.x, r.y): r.v for r in rows} == {(x, y): a[y, x] for y in range(3) for x in range(4)} and {r.field for r in rows} == {"u"}


def test_statistics_trace_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"u": {"mean": 1.0, "std": 2.0}, "w": {"mean": 0.0, "std": 1.0}}, indent=1))
    assert {tuple(r) for r in npz.read_statistics(spark, str(tmp_path / "s.json")).collect()} == {("u", 1.0, 2.0), ("w", 0.0, 1.0)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/0.jsonl").write_text('{"key":"a","cache_hit":true,"start_ns":1,"end_ns":4,"rank":0}\n')
    assert npz.read_trace(spark, str(tmp_path / "t")).first().end_ns == 4
    df = spark.range(3)
    npz.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        npz.write_new(df, str(tmp_path / "out"))
    assert npz.same_table(spark.read.parquet(str(tmp_path / "out")), df) and not npz.same_table(df, df.union(df))


def test_topology_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "frame_key string, digest string")
    at = str(tmp_path / "store")
    assert npz.add_topologies(spark, at, rows) == 2 and npz.add_topologies(spark, at, rows) == 0
    with pytest.raises(ValueError):
        npz.add_topologies(spark, at, rows.withColumn("digest", F.lit("9")))


def test_mesh_round_trips(spark):
    from meshlark.plans import registry

    _, inner, base = registry.smooth_mesh(spark, "/root/testdata/sf0.01", True)
    leaf = M.leaves(inner, base, ["tree"])
    assert npz.same_table(M.internals(leaf, ["tree"]), inner)
    near = M.neighbours(leaf, ["tree"], 3)
    assert near.where("abs(level - nlevel) > 1").isEmpty()
    assert M.uncovered(leaf, ["tree"], 2, 2, 3).isEmpty()
    assert not M.uncovered(leaf.where("level < 3"), ["tree"], 2, 2, 3).isEmpty()
