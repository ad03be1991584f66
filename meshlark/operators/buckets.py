"""Batches by level: a tree's leaves in one order, dealt into a bucket for each level, and back.

A mapping holds a row for each leaf: keys, leaf (its place in the tree's order), level and position
(its place in that level's bucket). A slot is a place in the buckets laid end to end, shallowest first.
Nothing is gathered: places are counts, and values move by equality on (keys, leaf) or (keys, level,
position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.mesh import CELL, morton


def mapping(leaf: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """keys, level, ix, iy, leaf, position: both places count in Z-order. A tree's leaves, which its finest
    grid bounds, are ordered in one task; trees are spread over all."""
    tree = Window.partitionBy(*keys).orderBy("_z")
    bucket = Window.partitionBy(*keys, "level").orderBy("_z")
    out = leaf.select(*keys, *CELL, morton("level", "ix", "iy", max_level).alias("_z"))
    return out.select(*keys, *CELL, (F.row_number().over(tree) - 1).cast("long").alias("leaf"), (F.row_number().over(bucket) - 1).cast("long").alias("position"))


def sizes(mapped: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """keys and sizes, an array with the leaves of every level from 0 to max_level, 0 where it has none."""
    each = [F.count(F.when(F.col("level") == k, 1)) for k in range(max_level + 1)]
    return mapped.groupBy(*keys).agg(F.array(*each).alias("sizes"))


def inverse(mapped: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """mapped and slot: ordered by it, column leaf is the inverse permutation."""
    before = F.aggregate(F.slice("sizes", 1, F.col("level").cast("int")), F.lit(0).cast("long"), lambda a, n: a + n)
    return mapped.join(sizes(mapped, keys, max_level), keys).withColumn("slot", before + F.col("position")).drop("sizes")


def to_buckets(values: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """values by (keys, leaf) to values by (keys, level, position)."""
    return values.join(mapped.select(*keys, "leaf", "level", "position"), [*keys, "leaf"]).drop("leaf")


def to_leaves(buckets: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """values by (keys, level, position) to values by (keys, leaf)."""
    return buckets.join(mapped.select(*keys, "leaf", "level", "position"), [*keys, "level", "position"]).drop("level", "position")


def mapping_faults(mapped: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """keys, fault, rows: why a mapping is no bijection between leaves and slots; none where it is one.

    invalid: a null, a level outside 0 to max_level or a negative place; such rows take no further part.
    shared leaf, shared slot: rows beyond the first of a place. missing leaf, missing slot: places that
    a row beyond them implies and none holds. Counts are added up before every shuffle.
    """
    ok = F.coalesce(F.col("level").between(0, max_level) & (F.col("position") >= 0) & (F.col("leaf") >= 0), F.lit(False))
    wrong = mapped.where(~ok).groupBy(*keys).agg(F.lit("invalid").alias("fault"), F.count("*").alias("rows"))
    good = mapped.where(ok)

    def uneven(place: str, within: list[str], name: str) -> DataFrame:
        taken = good.groupBy(*keys, *within, place).agg(F.count("*").alias("n"))
        group = taken.groupBy(*keys, *within).agg(F.sum(F.col("n") - 1).alias("shared"), (F.max(place) + 1 - F.count("*")).alias("missing"))
        tree = group.groupBy(*keys).agg(F.sum("shared").alias("shared"), F.sum("missing").alias("missing"))
        return tree.select(*keys, F.explode(F.array(*[F.struct(F.lit(f"{kind} {name}").alias("fault"), F.col(kind).cast("long").alias("rows")) for kind in ("shared", "missing")])).alias("f")).select(*keys, "f.*").where("rows > 0")

    return wrong.unionByName(uneven("leaf", [], "leaf")).unionByName(uneven("position", ["level"], "slot"))


def payload_faults(inputs: DataFrame, targets: DataFrame, keys: list[str], max_level: int, patch: int | None = None) -> DataFrame:
    """keys, level, fault, rows: where buckets of inputs and targets (keys, level, position, channel, t, px, py)
    disagree in leaves, channels or pixels, whatever their numbers of times; none where they agree.

    no target, no input: (position, channel, px, py) of one side only. ragged times: places that have fewer
    times than another of their bucket. With ``patch``, the side of a leaf at max_level: wrong side, places
    outside patch * 2 ** (max_level - level), and missing pixels, those of a leaf and channel short of the whole square.
    """
    place = [*keys, "level", "position", "channel", "px", "py"]
    sides = [rows.groupBy(*place).agg(F.count("*").alias(n)) for rows, n in ((inputs, "n_in"), (targets, "n_out"))]
    both = sides[0].join(sides[1], place, "full").select(*place, F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    lone = [("no target", F.col("n_out") == 0), ("no input", F.col("n_in") == 0)]
    if patch is not None:
        side = F.expr(f"shiftleft({patch}, cast({max_level} - level as int))")
        lone.append(("wrong side", (F.col("px") < 0) | (F.col("py") < 0) | (F.col("px") >= side) | (F.col("py") >= side)))
    stats = [F.count(F.when(is_fault, 1)).alias(name) for name, is_fault in lone]
    # a bucket's places by their number of times: few groups, added up before the shuffle
    per = both.groupBy(*keys, "level", "n_in", "n_out").agg(F.count("*").alias("n"), *stats)
    top = per.groupBy(*keys, "level").agg(F.max("n_in").alias("most_in"), F.max("n_out").alias("most_out"))
    ragged = F.sum(F.when(((F.col("n_in") > 0) & (F.col("n_in") < F.col("most_in"))) | ((F.col("n_out") > 0) & (F.col("n_out") < F.col("most_out"))), F.col("n")).otherwise(0))
    found = per.join(top, [*keys, "level"]).groupBy(*keys, "level").agg(*[F.sum(name).alias(name) for name, _ in lone], ragged.alias("ragged times"))
    names = [name for name, _ in lone] + ["ragged times"]
    if patch is not None:
        full = both.groupBy(*keys, "level", "position", "channel").agg(F.count("*").alias("n"))
        short = full.groupBy(*keys, "level").agg(F.sum(F.greatest(side * side - F.col("n"), F.lit(0))).alias("missing pixels"))
        found, names = found.join(short, [*keys, "level"]), [*names, "missing pixels"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("fault"), F.col(n).cast("long").alias("rows")) for n in names])).alias("f")
    return found.select(*keys, "level", each).select(*keys, "level", "f.*").where("rows > 0")
