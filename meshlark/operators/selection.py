"""Selecting, splitting and sampling trajectories and windows, with seeded hashes instead of state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.lineage import cut
from meshlark.operators.windows import global_rank, running_sum


def stride_fraction(frames: DataFrame, stride: int, start: float, stop: float, traj: str = "traj_idx", pos: str = "pos") -> DataFrame:
    """Every stride-th frame, then the part from int(n * start) to int(n * stop), per trajectory."""
    if stride < 1 or not 0 <= start < stop <= 1:
        raise ValueError("stride must be positive and 0 <= start < stop <= 1")
    kept = frames.where(F.col(pos) % stride == 0)
    by = Window.partitionBy(traj)
    kept = kept.withColumn("_k", F.row_number().over(by.orderBy(pos)) - 1).withColumn("_n", F.count("*").over(by))
    return kept.where((F.col("_k") >= F.floor(F.col("_n") * start)) & (F.col("_k") < F.floor(F.col("_n") * stop))).drop("_k", "_n")


def prefix_split(windows: DataFrame, frames: DataFrame, ratio: float, traj: str = "traj_idx", start: str = "start", stop: str = "stop", pos: str = "pos") -> DataFrame:
    """role of each frame: the first floor(windows * ratio) windows in trajectory order are training,
    each trajectory is cut after its last such window; ratio 1 makes everything training.

    Whole trajectories come first, so per-trajectory counts and their running sum over ranges decide; no global sort of windows.
    """
    if ratio >= 1:
        return frames.withColumn("role", F.lit("train"))
    counts = windows.groupBy(traj).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    upto = running_sum(counts, [], [traj], "n", "upto")
    take = upto.select(traj, F.greatest(F.lit(0), F.least(F.col("n"), F.lit(int(total * ratio)) - F.col("upto") + F.col("n"))).alias("take"))
    ranked = windows.withColumn("_k", F.row_number().over(Window.partitionBy(traj).orderBy(start)))
    cut = ranked.join(take, traj).where(F.col("_k") <= F.col("take")).groupBy(traj).agg(F.max(stop).alias("cut"))
    return frames.join(cut, traj, "left").withColumn("role", F.when(F.col(pos) <= F.col("cut"), "train").otherwise("val")).drop("cut")


def suffix_cohort(windows: DataFrame, ratio: float, stride: int, order: list[str]) -> DataFrame:
    """windows[int(n * ratio):][::stride] in the given order."""
    first = int(windows.count() * ratio)
    ranked = global_rank(windows, order)
    return ranked.where((F.col("rank") >= first) & ((F.col("rank") - first) % stride == 0)).drop("rank")


def seeded_key(seed: str, *columns: str):
    """A sort key that is the same in every run and engine: md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def seeded_sample(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows without replacement; top-n by a seeded hash."""
    return rows.orderBy(seeded_key(seed, key)).limit(n)


def seeded_part(rows: DataFrame, keys: list[str], ratio: float, seed: str, key: str) -> DataFrame:
    """max(1, int(n * ratio)) rows of each group by a seeded hash."""
    by = Window.partitionBy(*keys)
    marked = rows.withColumn("_k", F.row_number().over(by.orderBy(seeded_key(seed, key)))).withColumn("_n", F.count("*").over(by))
    return marked.where(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_k", "_n")


def greedy_knapsack(items: DataFrame, budget: float, key: str, refs: str, size: str) -> DataFrame:
    """Keys taken by references per byte (then references, then key) while they fit; what does not fit is skipped.

    Skipping rules out one prefix sum. Each pass takes the items up to the first that does not fit, by
    a running sum over ranges; that one is skipped, and so are all that are larger than what is left.
    """
    order = items.select(key, (-F.col(refs) / F.col(size)).alias("gain"), (-F.col(refs)).alias("most"), F.col(size).cast("double").alias("need"))
    ranked = cut(global_rank(order, ["gain", "most", key]))
    left, after, taken = float(budget), -1, []
    while True:
        run = cut(running_sum(ranked.where((F.col("rank") > after) & (F.col("need") <= left)), [], ["rank"], "need", "total"))
        edge = run.agg(F.min(F.when(F.col("total") > left, F.col("rank"))).alias("stop"), F.max(F.when(F.col("total") <= left, F.col("total"))).alias("used")).first()
        taken.append(run.where(F.col("total") <= left).select(key))
        if edge["stop"] is None:
            return reduce(DataFrame.unionByName, taken)
        left, after = left - (edge["used"] or 0.0), edge["stop"]


def channels(field: DataFrame, wanted: list, channel: str = "channel") -> DataFrame:
    """The wanted channels; those that there are not are left out silently."""
    return field.where(F.col(channel).isin(*wanted))


def duplicates(rows: DataFrame, key: str, role: str) -> DataFrame:
    """Keys that occur in more than one role: empty where the partition is disjoint."""
    return rows.groupBy(key).agg(F.countDistinct(role).alias("roles")).where("roles > 1")


def beyond_frontier(windows: DataFrame, frontiers: DataFrame, traj: str = "traj_idx", positions: str = "positions") -> DataFrame:
    """Windows that use no frame training has seen: every position is past the trajectory's frontier."""
    return windows.join(frontiers, traj, "left").where(F.array_min(positions) > F.coalesce("frontier", F.lit(-1))).drop("frontier")


def missing(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the store lacks."""
    return wanted.select(key).distinct().join(store.select(key), key, "left_anti")


def conflicts(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys stored with more than one content."""
    return rows.groupBy(key).agg(F.count_distinct(digest).alias("contents")).where("contents > 1")


def require_empty(rows: DataFrame, message: str) -> None:
    """Raise with one example where a validation query finds something."""
    bad = rows.take(1)
    if bad:
        raise ValueError(f"{message}: {bad[0].asDict()}")
