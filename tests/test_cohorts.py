"""Cohorts, lookups, reports and global order: errors, and small cases by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import cohorts as C
from meshlark.operators import metrics as E
from meshlark.operators import selection as S
from meshlark.operators import windows as W


def windows(spark, starts, traj=0):
    return spark.createDataFrame([(traj, s, s, [s, s + 1], [s + 2]) for s in starts], "traj_idx int, start long, window long, input_pos array<long>, target_pos array<long>")


def test_policies(spark):
    w = windows(spark, range(10))
    known = spark.createDataFrame([(0, 3)], "traj_idx int, frontier long")
    starts = lambda df: sorted(r.start for r in df.collect())
    assert starts(C.evaluation_windows(w, [known], steps=3)) == [4, 7, 9]
    assert starts(C.evaluation_windows(w, [known], steps=3, tail=False)) == [4, 7]
    assert starts(C.evaluation_windows(w, [known], full=True)) == [4, 5, 6, 7, 8, 9]
    assert starts(C.evaluation_windows(w, [known], full=True, inputs=False)) == [2, 3, 4, 5, 6, 7, 8, 9]
    assert starts(C.evaluation_windows(w, [known], full=True, trajectories=True)) == []
    assert starts(C.evaluation_windows(w, [], policy="prepartitioned", steps=4)) == [0, 4, 8]
    with pytest.raises(ValueError):
        C.evaluation_windows(w, [], policy="prepartitioned", steps=4, stride=2)
    with pytest.raises(ValueError):
        C.evaluation_windows(w, [], policy="other")
    assert C.saved_membership(w.where("start > 3"), {"a": known, "b": None, "c": known.withColumn("frontier", F.lit(5))}) == {"a": "verified", "b": "unavailable", "c": "unverified"}


def test_roles_and_manifest(spark):
    frames = spark.createDataFrame([(t, p, t * 100 + p) for t in range(2) for p in range(6)], "traj_idx int, pos long, frame_id long")
    regions = C.explicit_roles({"train": frames.where("traj_idx = 0"), "test": frames.where("traj_idx = 1 and pos > 2")}).withColumn("segment", F.col("traj_idx"))
    C.check_partition(regions)
    with pytest.raises(ValueError):
        C.check_partition(regions.unionByName(regions.where("pos = 4").withColumn("role", F.lit("val"))))
    with pytest.raises(ValueError):
        C.explicit_roles({"other": frames})
    manifest = C.partition_manifest(regions, frames)
    assert {r.traj_idx: (r.frames, r.frontier, r.train, r.test, r.mixed) for r in manifest.collect()} == {0: (6, 5, 6, 0, False), 1: (6, -1, 0, 3, False)}
    assert C.changed_membership(manifest, manifest).isEmpty()
    assert not C.changed_membership(manifest, C.partition_manifest(regions.where("pos <> 5"), frames)).isEmpty()
    found = C.role_windows(regions.withColumn("source_index", F.col("pos")), 3, 1)
    assert {r.role for r in found.collect()} == {"train"} and [r.role for r in C.roles_without_windows(regions, found).collect()] == ["test"]


def test_lookup_that_must_match(spark):
    left, store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, 10)], "k int, w int")
    assert C.must_join(left.where("k = 1"), store, "k").collect()[0].w == 10
    with pytest.raises(Exception, match="no k 2"):
        C.must_join(left, store, "k").collect()


def test_report_schema(spark):
    assert E.report_schema(["uniform_RMSE_adaptive_p", "uniform_RMSE_regular_p"]) == "combined"
    assert E.report_schema(["level_0_RMSE_adaptive_p", "level_0_RMSE_regular_p"]) == "combined"
    assert E.report_schema(["uniform_RMSE_p", "level_1_RMSE_p"]) == "adaptive_only"
    assert E.report_schema(["uniform_RMSE_p"]) == "regular_only" and E.report_schema(["x", "level_1_RMSE_p"]) == "unknown"
    assert E.report_column("combined", "regular", "RMSE", "level_2", "p") == "level_2_RMSE_regular_p"
    assert E.report_column("regular_only", "regular", "RMSE", "level_2", "p") is None and E.report_column("adaptive_only", "regular", "RMSE", "uniform", "p") is None
    wide = spark.createDataFrame([(1, 0.5, 0.25, None)], "Step int, uniform_RMSE_adaptive_p_x double, level_2_MAE_regular_q double, level_2_count double")
    assert sorted((r.scope, r.metric, r.model, r.field, r.value) for r in E.long_report(wide).collect()) == [("level_2", "MAE", "regular", "q", 0.25), ("uniform", "RMSE", "adaptive", "p_x", 0.5)]
    long = E.long_report(wide)
    assert E.field_mean(long, ["step"]).collect()[0]["mean"] == 0.375


def test_order_over_ranges(spark):
    rng = np.random.default_rng(4)
    v = rng.permutation(3000)
    df = spark.createDataFrame([(int(x) % 3 if x % 7 else None, f"k{x:05d}", int(x)) for x in v], "g int, name string, x long")
    assert [r["rank"] for r in W.global_rank(df, ["name"]).orderBy("name").collect()] == list(range(3000))
    run = W.running_sum(df, ["g"], ["name"], "x", "upto").collect()
    own: dict = {}
    for r in sorted(run, key=lambda r: r.name):
        own[r.g] = own.get(r.g, 0) + r.x
        assert r.upto == own[r.g]
    got = {r.g: (r.a, r.b) for r in W.quantiles(df, ["g"], {"a": 0.3, "b": 0.95}, "x").collect()}
    for g, (a, b) in got.items():
        mine = [r.x for r in run if r.g == g]
        assert np.allclose((a, b), np.quantile(mine, [0.3, 0.95]))
    assert W.global_rank(df.limit(0), ["name"]).count() == 0


def test_greedy_choices_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    items = [(k, int(rng.integers(1, 20)), float(rng.integers(1, 60))) for k in range(200)]
    left, want = 500.0, set()
    for k, refs, size in sorted(items, key=lambda i: (-i[1] / i[2], -i[1], i[0])):
        if size <= left:
            want.add(k)
            left -= size
    df = spark.createDataFrame(items, "key long, refs int, size double")
    assert {r.key for r in S.greedy_knapsack(df, 500.0, "key", "refs", "size").collect()} == want
    starts = sorted(rng.choice(500, 120, replace=False).tolist())
    kept = []
    for s in starts:
        if not kept or s - kept[-1] >= 9:
            kept.append(s)
    kept = sorted({*kept, starts[-1]})
    assert sorted(r.start for r in W.greedy_starts(windows(spark, starts), 9).collect()) == kept
    assert W.greedy_starts(windows(spark, starts).limit(0), 9).count() == 0
