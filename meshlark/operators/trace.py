"""Access-trace analytics: hits, stage times, concurrency, contention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.windows import quantiles, running_sum


def summary(access: DataFrame) -> DataFrame:
    """Hits, misses and stage times, in all and for each rank and each epoch."""
    ms = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    timed = access.select("rank", "epoch", "key", "cache_hit", ms("start_ns", "end_ns").alias("total"), ms("start_ns", "source_ready_ns").alias("source"))
    views = F.array(F.struct(F.lit("rank").alias("by"), F.col("rank"), F.lit(None).cast(access.schema["epoch"].dataType).alias("epoch")), F.struct(F.lit("epoch").alias("by"), F.lit(None).cast(access.schema["rank"].dataType).alias("rank"), F.col("epoch")), F.struct(F.lit("all").alias("by"), F.lit(None).cast(access.schema["rank"].dataType).alias("rank"), F.lit(None).cast(access.schema["epoch"].dataType).alias("epoch")))
    rows = timed.select(F.explode(views).alias("view"), "key", "cache_hit", "total", "source").select("view.*", "key", "cache_hit", "total", "source")
    by = ["by", "rank", "epoch"]
    out = rows.groupBy(*by).agg(
        F.count("*").alias("reads"),
        F.sum(F.col("cache_hit").cast("long")).alias("hits"),
        F.count_distinct(F.when(~F.col("cache_hit"), F.col("key"))).alias("missed_keys"),
        F.avg("total").alias("mean_ms"),
        F.max("source").alias("max_source_ms"),
    )
    p95 = quantiles(rows, by, {"p95_ms": 0.95}, "total").withColumnsRenamed({k: f"of_{k}" for k in by})
    return out.join(p95, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in by], "left").select("rank", "epoch", "reads", "hits", "missed_keys", "mean_ms", "p95_ms", "max_source_ms")


def open_spans(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """At each instant at which spans start or end: how many start (up), were open before, and are open then.

    Ends close before starts at the same time open; spans without length count themselves alone.
    Starts and ends are +1 and -1 in one order, and a running sum over ranges of it is the level; no
    self-join of spans.
    """
    empty = F.col(start) == F.col(end)
    opened = spans.select(*keys, F.col(start).alias("at"), F.when(empty, 1).otherwise(2).alias("turn"), F.lit(1).alias("step"))
    closed = spans.select(*keys, F.col(end).alias("at"), F.when(empty, 1).otherwise(0).alias("turn"), F.lit(-1).alias("step"))
    both = opened.unionByName(closed).groupBy(*keys, "at", "turn").agg(F.sum("step").alias("step"), F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("up"))
    level = running_sum(both, keys, ["at", "turn"], "step", "run").withColumn("before", F.col("run") - F.col("step"))
    return level.withColumn("open", F.when(F.col("turn") == 1, F.col("before") + F.least(F.col("up"), F.lit(1))).otherwise(F.col("run")))


def max_concurrency(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Most spans open at once."""
    return open_spans(spans, keys, start, end).groupBy(*keys).agg(F.max("open").cast("long").alias("most"))


def contention(reads: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """By keys, how many reads began while another of the same key was open, and most open at once."""
    while_open = F.when(F.col("before") > 0, F.col("up")).when(F.col("turn") == 2, F.greatest(F.col("up") - 1, F.lit(0))).otherwise(0)
    return open_spans(reads, keys, start, end).groupBy(*keys).agg(F.sum(while_open).cast("long").alias("duplicates"), F.max("open").cast("long").alias("most"))


def costliest_stage(stages: DataFrame, totals: DataFrame, bucket: str, stage: str, seconds: str, total: str) -> DataFrame:
    """By bucket its mean total, the stage of the largest mean and its share, and what no stage accounts for."""
    each = stages.groupBy(bucket, stage).agg(F.avg(seconds).alias("mean"))
    top = each.groupBy(bucket).agg(F.max(F.struct("mean", stage)).alias("top"), F.sum("mean").alias("known"))
    out = totals.groupBy(bucket).agg(F.avg(total).alias("total_s")).where("total_s > 0").join(top, bucket)
    return out.select(bucket, "total_s", F.col(f"top.{stage}").alias("top_stage"), (F.col("top.mean") / F.col("total_s")).alias("top_share"), F.greatest(F.lit(0.0), F.col("total_s") - F.col("known")).alias("unaccounted_s"))


def stage_profile(stages: DataFrame, bucket: str, stage: str, seconds: str) -> DataFrame:
    """Mean and sum per stage and its share of its bucket."""
    out = stages.groupBy(bucket, stage).agg(F.avg(seconds).alias("mean_s"), F.sum(seconds).alias("sum_s"))
    return out.withColumn("share", F.col("sum_s") / F.sum("sum_s").over(Window.partitionBy(bucket)))


def recent(values: DataFrame, order: str, v: str, slots: int = 1024) -> DataFrame:
    """Count, sum and maximum of all values, and the 95th percentile of the last ``slots``."""
    last = values.orderBy(F.desc(order)).limit(slots).agg(F.expr(f"percentile({v}, 0.95d)").alias("p95"))
    return values.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.max(v).alias("most")).crossJoin(last)  # one row each


def benchmark_summary(runs: DataFrame, total: str, regrid: str) -> DataFrame:
    """Mean, population std, median, interquartile range and extremes of totals; regrid share of the sum."""
    whole = runs.agg(
        F.avg(total).alias("mean"), F.stddev_pop(total).alias("std"), F.min(total).alias("least"), F.max(total).alias("most"),
        F.avg(F.when(F.col(regrid) > 0, F.col(regrid))).alias("regrid_mean"), (F.sum(regrid) / F.greatest(F.sum(total), F.lit(1e-12))).alias("regrid_share"),
    )
    cuts = quantiles(runs, [], {"median": 0.5, "low": 0.25, "high": 0.75}, total)
    return whole.crossJoin(cuts).select("mean", "std", "median", (F.col("high") - F.col("low")).alias("iqr"), "least", "most", "regrid_mean", "regrid_share")  # one row each
