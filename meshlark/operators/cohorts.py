"""Roles of source regions, windows within them, and evaluation cohorts that training has not seen.

Regions are rows, one for each frame: (role, segment, traj, pos, source_index, frame). All checks are
queries that return the offending rows, so they run where the data are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators import windows as W
from meshlark.operators.selection import require_empty

#: The roles, in the order in which their segments are numbered.
ROLES = ("train", "val", "test")


def role_rank(role: str | Column = "role") -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role) if isinstance(role, str) else role), F.lit(0))


def explicit_roles(sources: dict[str, DataFrame]) -> DataFrame:
    """The frames of each role's own sources with their role; a role that is not given has none.

    Sources of a role stand in place of a split by ratio, so every frame of ``train`` is training.
    """
    unknown = set(sources) - set(ROLES)
    if unknown:
        raise ValueError(f"unknown roles {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [sources[r].withColumn("role", F.lit(r)) for r in ROLES if r in sources])


def shared_frames(regions: DataFrame, traj: str = "traj_idx", pos: str = "pos") -> DataFrame:
    """Frames that stand in more than one segment or role: none, where regions are disjoint."""
    return regions.groupBy(traj, pos).agg(F.count("*").alias("times"), F.count_distinct("role").alias("roles")).where("times > 1")


def segment_windows(regions: DataFrame, t_in: int, t_out: int, push_forward: int = 1, step: int = 1, interval: int = 1, segment: str = "segment") -> DataFrame:
    """Windows within each segment, with ``push_forward`` times t_out targets; gaps are judged by the
    original indices, and frame_idx is that of the first input."""
    return W.gap_free(regions, t_in, t_out * push_forward, step, interval, traj=segment)


def role_windows(regions: DataFrame, t_in: int, t_out: int, push_forward: int = 1, step: int = 1, interval: int = 1) -> DataFrame:
    """segment_windows() of all roles; traj_idx numbers the segments over the roles in their order.

    Segments are few beside frames; their numbers come from a ranking over ranges.
    """
    named = regions.select("role", "segment").distinct().withColumn("order", role_rank())
    numbers = W.global_rank(named, ["order", "segment"]).select("role", "segment", F.col("rank").alias("traj_idx"))
    keyed = regions.withColumn("both", F.struct("role", "segment"))
    found = segment_windows(keyed, t_in, t_out, push_forward, step, interval, segment="both")
    return found.select(F.col("both.role").alias("role"), F.col("both.segment").alias("segment"), "frame_idx", "inputs", "targets").join(numbers, ["role", "segment"])


def roles_without_windows(regions: DataFrame, windows: DataFrame) -> DataFrame:
    """Roles that have segments and no window."""
    return regions.select("role").distinct().join(windows.select("role").distinct(), "role", "left_anti")


def invalid_windows(windows: DataFrame, inventory: DataFrame, key: str = "window", frames: str = "frames", frame: str = "frame_id", traj: str = "traj_idx", pos: str = "pos") -> DataFrame:
    """Windows whose frames are unknown, of several trajectories, or not strictly chronological, with the reason.

    windows has an array of frames in order, inventory a row a frame.
    """
    each = windows.select(key, F.posexplode(frames).alias("slot", frame)).join(inventory.select(frame, F.col(traj).alias("t"), F.col(pos).alias("p")), frame, "left")
    before = F.lag("p").over(Window.partitionBy(key).orderBy("slot"))
    each = each.withColumn("back", F.col("p") <= before)
    out = each.groupBy(key).agg(F.count_if(F.col("t").isNull()).alias("unknown"), F.min("t").alias("low"), F.max("t").alias("high"), F.bool_or(F.coalesce("back", F.lit(False))).alias("back"))
    reason = F.when(F.col("unknown") > 0, "unknown frame").when(F.col("low") < F.col("high"), "several trajectories").when(F.col("back"), "not chronological")
    return out.select(key, reason.alias("reason")).where("reason is not null")


def training_frontiers(regions: DataFrame, inventory: DataFrame, traj: str = "traj_idx", pos: str = "pos") -> DataFrame:
    """Last position of a training region in each trajectory of the inventory, -1 where there is none."""
    return W.frontier(inventory, regions.where("role = 'train'"), traj, pos)


def partition_manifest(regions: DataFrame, inventory: DataFrame, traj: str = "traj_idx", pos: str = "pos", frame: str = "frame_id") -> DataFrame:
    """A row a trajectory: its frames, frontier, frames by role, and whether a segment has frames that the
    inventory lacks (``external``) beside ones that it has."""
    held = regions.join(inventory.select(traj, pos, F.lit(True).alias("known")), [traj, pos], "left")
    mixed = held.groupBy(traj, "role", "segment").agg(F.count_if("known").alias("k"), F.count("*").alias("n"))
    mixed = mixed.groupBy(traj).agg(F.bool_or((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("mixed"))
    counts = regions.groupBy(traj).agg(*[F.count_if(F.col("role") == r).alias(r) for r in ROLES])
    sizes = inventory.groupBy(traj).agg(F.count("*").alias("frames"), F.bit_xor(F.xxhash64(pos, frame)).alias("content"))
    out = sizes.join(training_frontiers(regions, inventory, traj, pos), traj).join(counts, traj, "left").join(mixed, traj, "left")
    return out.select(traj, "frames", "content", "frontier", *[F.coalesce(r, F.lit(0)).alias(r) for r in ROLES], F.coalesce("mixed", F.lit(False)).alias("mixed"))


def changed_membership(saved: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of either manifest that the other lacks: empty where membership is as recorded."""
    return saved.exceptAll(now).withColumn("side", F.lit("saved")).unionByName(now.exceptAll(saved).withColumn("side", F.lit("now")))


def unseen(windows: DataFrame, frontiers: list[DataFrame], inputs: bool = True, trajectories: bool = False, regions: DataFrame | None = None, key: str = "window", traj: str = "traj_idx", pos: str = "pos") -> DataFrame:
    """Windows beyond the training frontier of every manifest, or within one of the given regions.

    windows has traj, input_pos and target_pos, arrays of positions. With ``inputs`` the inputs must be
    unseen too, with ``trajectories`` no frame of the trajectory may be training. With regions
    (traj, segment, pos) all frames must lie in one segment instead.
    """
    most = reduce(DataFrame.unionByName, frontiers).groupBy(traj).agg(F.max("frontier").alias("frontier"))
    out = windows.join(most, traj, "left").withColumn("frontier", F.coalesce("frontier", F.lit(-1)))
    checked = F.concat("input_pos", "target_pos") if inputs or regions is not None else F.col("target_pos")
    if regions is None:
        out = out.where(F.array_min(checked) > F.col("frontier"))
    else:
        each = windows.select(key, traj, F.size(checked).alias("n"), F.explode(checked).alias(pos)).join(regions.select(traj, pos, "segment"), [traj, pos])
        inside = each.groupBy(key, "segment").agg(F.count("*").alias("k"), F.max("n").alias("n")).where("k = n")
        out = out.join(inside.select(key), key, "left_semi")
    if trajectories:
        out = out.where("frontier < 0")
    return out.drop("frontier")


def evaluation_windows(windows: DataFrame, frontiers: list[DataFrame], *, policy: str = "internal", steps: int = 1, sampling: int = 1, interval: int = 1, stride: int | None = None, tail: bool = True, full: bool = False, cohort_ratio: float | None = None, key: str = "window", traj: str = "traj_idx", start: str = "start", **safety) -> DataFrame:
    """The windows that an evaluation uses.

    internal: the unseen ones, each trajectory sampled by its starts (every ``stride`` source positions,
    by default the horizon steps * sampling * interval, and its last one), or with cohort_ratio the
    suffix of all windows by that ratio, every steps-th of those that are unseen. prepartitioned: every
    steps-th of all windows, which training then must not know. full takes all of them.
    """
    order = [traj, start]
    if policy == "prepartitioned":
        if cohort_ratio or stride is not None:
            raise ValueError("windows of a given partition are taken by their horizon alone")
        return windows if full else every(windows, steps, order)
    if policy != "internal":
        raise ValueError(f"unknown policy {policy}")
    if cohort_ratio is not None:
        from meshlark.operators.selection import suffix_cohort

        found = unseen(suffix_cohort(windows, cohort_ratio, 1, order), frontiers, key=key, traj=traj, **safety)
        return found if full else every(found, steps, order)
    found = unseen(windows, frontiers, key=key, traj=traj, **safety)
    if full:
        return found
    kept = W.greedy_starts(found, stride or steps * sampling * interval, tail, traj, start)
    return found.join(kept, [traj, start], "left_semi")


def every(windows: DataFrame, steps: int, order: list[str]) -> DataFrame:
    """windows[::steps] in the given order."""
    return W.global_rank(windows, order).where(F.col("rank") % steps == 0).drop("rank")


def saved_membership(selected: DataFrame, manifests: dict[str, DataFrame | None], key: str = "window", **safety) -> dict[str, str]:
    """Of each checkpoint, whether the selected windows are unseen by its recorded frontiers: verified,
    unverified, or unavailable where nothing is recorded. Only tells; changes no selection."""
    total, out = selected.count(), {}
    for name, recorded in manifests.items():
        out[name] = "unavailable" if recorded is None else "verified" if unseen(selected, [recorded], key=key, **safety).count() == total else "unverified"
    return out


def must_join(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """rows with the columns of their key in the store; a key that the store lacks raises when it is read."""
    found = rows.join(store.withColumn("held", F.lit(True)), key, "left")
    checked = F.when(F.col("held"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string"))))
    return found.withColumn(key, checked.cast(rows.schema[key].dataType)).drop("held")


def in_order_of(rows: DataFrame, exported: DataFrame, key: str, position: str) -> DataFrame:
    """exported's rows with the position that their key has in rows."""
    return exported.join(rows.select(key, position), key)


def first_in_order(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows, for a dry run."""
    return rows.orderBy(*order).limit(n)


def check_partition(regions: DataFrame) -> None:
    """Raise where a frame is in two segments or roles."""
    require_empty(shared_frames(regions), "frames in more than one segment or role")
