"""Windows over ordered trajectories: sliding, gap-aware, strided, and the positional window functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.lineage import cut


def sliding(frames: DataFrame, t_in: int, t_out: int, step: int = 1, traj: str = "traj_idx", pos: str = "pos", frame: str = "frame_id") -> DataFrame:
    """(traj, start, inputs, targets): every window of t_in inputs and t_out targets, ``step`` apart.

    One window function over (traj, pos); trajectories shorter than the span give no rows.
    """
    span = (t_in + t_out - 1) * step + 1
    ahead = Window.partitionBy(traj).orderBy(pos).rowsBetween(0, span - 1)
    whole = frames.select(traj, F.col(pos).alias("start"), F.collect_list(F.col(frame)).over(ahead).alias("_all")).where(F.size("_all") == span)
    picked = whole.withColumn("_all", F.filter("_all", lambda _, i: i % step == 0))
    return picked.select(traj, "start", F.slice("_all", 1, t_in).alias("inputs"), F.slice("_all", t_in + 1, t_out).alias("targets"))


def gap_free(frames: DataFrame, t_in: int, t_out: int, step: int = 1, interval: int = 1, traj: str = "traj_idx", pos: str = "pos", frame: str = "frame_id", index: str = "source_index") -> DataFrame:
    """sliding(), but only windows whose original indices differ by exactly interval * step."""
    marked = frames.withColumn("_pair", F.struct(F.col(index).alias("i"), F.col(frame).alias("f")))
    out = sliding(marked, t_in, t_out, step, traj, pos, "_pair")
    every = F.transform(F.concat("inputs", "targets"), lambda p: p["i"])
    even = F.forall(F.zip_with(F.slice(every, 1, t_in + t_out - 1), F.slice(every, 2, t_in + t_out - 1), lambda a, b: b - a == interval * step), lambda x: x)
    take = lambda c: F.transform(c, lambda p: p["f"])
    return out.where(even).select(traj, "start", F.col("inputs")[0]["i"].alias("frame_idx"), take("inputs").alias("inputs"), take("targets").alias("targets"))


def greedy_starts(windows: DataFrame, stride: int, tail: bool = True, traj: str = "traj_idx", start: str = "start") -> DataFrame:
    """Starts kept one after another where at least ``stride`` from the last one kept; with tail also the last.

    The choice depends on the one before, so each trajectory's starts stream in order through its
    task, which holds the last kept one only. Repeated starts count once.
    """
    kind = windows.schema[traj].dataType.simpleString()

    def run(batches):
        now, kept, last = None, None, None
        for batch in batches:
            out: tuple = [], []
            for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (t,) != now:
                    if tail and now and kept != last:
                        out[0].append(now[0])
                        out[1].append(last)
                    now, kept = (t,), None
                if kept is None or s - kept >= stride:
                    out[0].append(t)
                    out[1].append(s)
                    kept = s
                last = s
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64())], [traj, start])
            ids = batch.schema.field(0).type
        if tail and now and kept != last:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], ids), pa.array([last], pa.int64())], [traj, start])

    starts = windows.select(traj, F.col(start).cast("long").alias(start)).repartition(traj).sortWithinPartitions(traj, start)
    return starts.mapInArrow(run, f"`{traj}` {kind}, `{start}` long")


def gradient_location(profile: DataFrame, keys: list[str], x: str, v: str, dx: float = 1.0) -> DataFrame:
    """Per keys, the x of the first largest absolute central difference (one-sided at the ends), times dx."""
    w = Window.partitionBy(*keys).orderBy(x)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    d = F.when(before.isNull(), after - F.col(v)).when(after.isNull(), F.col(v) - before).otherwise((after - before) / 2)
    slopes = profile.withColumn("_d", F.coalesce(F.abs(d), F.lit(0.0)))
    return slopes.groupBy(*keys).agg((F.min_by(x, F.struct(-F.col("_d"), F.col(x))) * F.lit(dx)).alias("location"))


def adjacent_gaps(frames: DataFrame, traj: str, order: str, value: str) -> DataFrame:
    """Difference to the frame before; null for the first of a trajectory."""
    w = Window.partitionBy(traj).orderBy(order)
    return frames.withColumn("gap", F.col(value) - F.lag(value).over(w))


def reuse_distance(accesses: DataFrame, keys: list[str], sequence: str, tie: str) -> DataFrame:
    """Accesses since the same key was last read, from the running sequence number; null for the first."""
    w = Window.partitionBy(*keys).orderBy(sequence, tie)
    return accesses.withColumn("reuse", F.col(sequence) - F.lag(sequence).over(w))


def equal_shards(rows: DataFrame, order: list[str], world: int) -> DataFrame:
    """(shard, slot) of each row dealt round robin over ``world`` shards; the remainder is dropped.

    The row number is global and exact without one task: ranks within range partitions plus the sizes
    of the partitions before.
    """
    numbered = global_rank(rows, order)
    n = rows.count() // world * world
    return numbered.where(F.col("rank") < n).withColumn("shard", F.pmod("rank", F.lit(world)).cast("int")).withColumn("slot", F.floor(F.col("rank") / world)).drop("rank")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with ``name``, the sum of value up to and with each row of its keys in the order, which has no ties.

    Rows are dealt over ranges of (keys, order), as many as there are shuffle partitions; the ranges'
    sums (a row for each range and key in it) give each range its offset, so no task holds a whole key.
    """
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("range_no", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "range_no").agg(F.sum(value).alias("range_sum"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(k).alias(f"range_{k}") for k in keys], F.col("range_no").alias("number"), F.coalesce(F.sum("range_sum").over(earlier), F.lit(0)).alias("range_before"))
    on = [F.col("range_no") == F.col("number"), *[F.col(k).eqNullSafe(F.col(f"range_{k}")) for k in keys]]
    within = Window.partitionBy(*keys, "range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn(name, F.sum(value).over(within)).join(before, on)
    return out.withColumn(name, F.col(name) + F.col("range_before")).select(*rows.columns, name)


def global_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """rank (from 0) in the total order of ``order``, which must have no ties."""
    one = rows.withColumn("rank_one", F.lit(1).cast("long"))
    return running_sum(one, [], order, "rank_one", "rank").withColumn("rank", F.col("rank") - 1).drop("rank_one")


def quantiles(values: DataFrame, keys: list[str], at: dict[str, float], v: str = "v") -> DataFrame:
    """Linearly interpolated quantiles of v by keys, one column for each name of ``at``; nulls do not count.

    Equal values are counted first; a running sum of the counts finds the two values around each
    place, so no task holds a key's values.
    """
    counted = values.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("times"))
    run = running_sum(counted, keys, [v], "times", "upto")
    sizes = counted.groupBy(*keys).agg(F.sum("times").alias("size"))
    if keys:
        run = run.join(sizes.withColumnsRenamed({k: f"of_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    else:
        run = run.crossJoin(sizes)  # one row
    place = lambda q: (F.col("size") - 1) * F.lit(float(q))
    value = lambda where: F.min(F.when(F.col("upto") > where, F.col(v)))
    out = run.groupBy(*keys).agg(*[F.struct(value(F.floor(place(q))).alias("a"), value(F.ceil(place(q))).alias("b"), F.max(place(q) - F.floor(place(q))).alias("w")).alias(n) for n, q in at.items()])
    return out.select(*keys, *[(F.col(n)["a"] + (F.col(n)["b"] - F.col(n)["a"]) * F.col(n)["w"]).alias(n) for n in at])


def position_in(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Row number from 0 within keys."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def unique_labels(rows: DataFrame, label: str, order: str) -> DataFrame:
    """label, label#2, label#3 ... for repeated labels in order."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return rows.withColumn("unique_label", F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit("#"), n)))


def frontier(trajectories: DataFrame, used: DataFrame, traj: str = "traj_idx", pos: str = "pos") -> DataFrame:
    """Largest position used for training per trajectory, -1 where none was."""
    most = used.groupBy(traj).agg(F.max(pos).alias("frontier"))
    return trajectories.select(traj).distinct().join(most, traj, "left").select(traj, F.coalesce("frontier", F.lit(-1)).cast("long").alias("frontier"))


def advance(inputs, predicted, t_in: int):
    """Column: the next input window, the last t_in of inputs followed by the predicted frames."""
    both = F.concat(inputs, predicted)
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - t_in + 1), t_in)


def extrapolate(windows: DataFrame, steps: int, t_in: int, linear: bool = False, inputs: str = "inputs") -> DataFrame:
    """Autoregressive rollout of a built-in predictor: persistence, or the line through the last two.

    Adds ``forecast``, the ``steps`` predicted values; each prediction is fed back as an input.
    """
    state = F.struct(F.col(inputs).cast("array<double>").alias("w"), F.array().cast("array<double>").alias("out"))

    def one(acc, _):
        last = F.try_element_at(acc["w"], F.lit(-1))
        nxt = last + (last - F.try_element_at(acc["w"], F.lit(-2))) if linear else last
        return F.struct(advance(acc["w"], F.array(nxt), t_in).alias("w"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    return windows.withColumn("forecast", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, one, lambda acc: acc["out"]))
