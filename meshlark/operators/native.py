"""Regridding of meshes whose leaves keep their pixels as they are.

A leaf of level k holds the (tile >> k) x (tile >> k) pixels under it, so a split is an exact slice and a
merge a lossless stitch: pixels never change, only the set of leaves does. The pixels of the deciding
frame are therefore read once, into what passes ask of each cell of each level (``cells``), and passes go
over these bits. Pixels meet their leaves again once, at the end (``stitched``), all frames and channels
alike; where only their sums are wanted (``summed``), they are added up before they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators import mesh as M
from meshlark.operators import passes as P
from meshlark.operators.lineage import cut, uncut

CELL = M.CELL


def pyramid(pixels: DataFrame, keys: list[str], channel: list[str], tile: int, max_level: int) -> DataFrame:
    """(keys, channel, cell, lo, hi, mid, inner) of every cell of every level, from pixels(keys, channel, x, y, v).

    mid is the value at the cell's centre, between the four pixels around it; inner the pixel up and
    right of the centre, which a point there gets from leaves that are finer than the cell. Pixels are
    added up over the cells of the finest level, and these write themselves to each cell above them.
    """
    layers = [*keys, *channel]
    side = tile >> max_level
    cell = lambda c: F.floor(F.col(c) / side).cast("int")
    off = {a: (F.col(a) - F.floor(F.col(a) / side) * side) for a in "xy"}
    around = [side // 2 - 1, side // 2] if side % 2 == 0 else [side // 2]
    pick = lambda at: F.max(F.when(at, F.col("v")))
    corner = {"sw": (0, 0), "se": (side - 1, 0), "nw": (0, side - 1), "ne": (side - 1, side - 1)}
    finest = pixels.groupBy(*layers, cell("x").alias("ix"), cell("y").alias("iy")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg(F.when(off["x"].isin(around) & off["y"].isin(around), F.col("v"))).alias("mid"),
        *[pick((off["x"] == a) & (off["y"] == b)).alias(n) for n, (a, b) in corner.items()],
    )
    up = finest.repartition(*keys).withColumn("_d", F.explode(F.array(*[F.lit(d) for d in range(max_level + 1)])))
    up = up.withColumn("_half", F.when(F.col("_d") > 0, F.expr("shiftleft(1, greatest(_d - 1, 0))")))
    rest = lambda c: F.expr(f"{c} - shiftleft(shiftright({c}, _d), _d)")
    # the four finest cells around a coarser one's centre, each with its pixel next to it
    around = {"ne": (-1, -1), "nw": (0, -1), "se": (-1, 0), "sw": (0, 0)}
    meets = {n: F.max(F.when((rest("ix") == F.col("_half") + a) & (rest("iy") == F.col("_half") + b), F.col(n))) for n, (a, b) in around.items()}
    above = up.groupBy(*layers, (max_level - F.col("_d")).alias("level"), F.expr("shiftright(ix, _d)").alias("ix"), F.expr("shiftright(iy, _d)").alias("iy"))
    out = above.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.when(F.col("_d") == 0, F.col("mid"))).alias("_mid"), *[v.alias(f"_{n}") for n, v in meets.items()])
    mid = F.when(F.col("level") == max_level, F.col("_mid")).otherwise((F.col("_ne") + F.col("_nw") + F.col("_se") + F.col("_sw")) / 4)
    return out.select(*layers, *CELL, "lo", "hi", mid.alias("mid"), F.col("_sw").alias("inner"))


def cells(pixels: DataFrame, keys: list[str], channel: list[str], tile: int, max_level: int, tol: float) -> DataFrame:
    """What passes ask of each cell: its range, and the differences between its centre and the values one
    cell width to the west, east, south and north (0 outside the domain), against tol times the range of
    the channel; any channel over it is enough, to be flat takes all."""
    layers = [*keys, *channel]
    at = pyramid(pixels, keys, channel, tile, max_level)
    frame = Window.partitionBy(*layers)
    met = at.withColumn("limit", (F.max("hi").over(frame) - F.min("lo").over(frame)) * tol).where("limit is not null")

    def far(there: str) -> Column:
        over = lambda v: F.coalesce(F.abs(F.col("mid") - F.coalesce(F.col(f"{there}.{v}"), F.lit(0.0))) > F.col("limit"), F.lit(False))
        return P.bit(over("mid"), (1 << max_level + 1) - 1 | P.NONE).bitwiseOR(P.bit(over("inner"), P.FINER))

    met = P.beside(met, layers, ["mid", "inner"], far)
    spread = F.col("hi") - F.col("lo")
    rough = spread >= 0.25 * F.col("limit")
    tag = F.bit_or(P.bit(spread > F.col("limit"), P.OWN).bitwiseOR(P.bit(rough, P.ROUGH))).bitwiseOR(F.lit(P.GIVEN)).bitwiseOR(P.bit(~F.bool_or(rough), P.FLAT))
    return met.groupBy(*keys, *CELL).agg(tag.alias("tag"), *[F.bit_or(s).alias(s) for s in P.SIDES])


def regrid_native(pixels: DataFrame, leaf: DataFrame, keys: list[str], channel: list[str], tile: int, nx: int, ny: int, max_level: int, tol: float, nearby: int = 0, max_passes: int = 10, coarsen: bool = True) -> DataFrame:
    """The new leaves of each tree, from the pixels(keys, channel, x, y, v) that decide: as a rule the
    last frame of a window, in the channels to watch.

    Leaves whose error exceeds tol times a channel's value range, in any channel, split; the mesh is
    balanced after every pass. With nearby > 0, leaves of a quarter of that range and their neighbours
    are protected and coarser ones among them step up. Complete unprotected siblings whose joint range
    stays under a quarter in every channel merge, pass by pass; a merge never leaves a face neighbour
    two levels finer. At most max_passes passes of splitting and of merging; a warning says where they end
    early. Each pass writes the internal cells, a few bytes each, and no pixels.
    """
    given = cut(leaf.select(*keys, *CELL).distinct())
    asked = cut(cells(pixels, keys, channel, tile, max_level, tol), False)
    start = cut(M.internals(given, keys), False)
    inner = P.refine(asked, start, keys, nx, ny, max_level, max_passes)
    marked = None
    if nearby > 0:
        inner, marked = P.protect(asked, inner, keys, nx, ny, max_level, nearby)
    if coarsen:
        inner = P.coarsen(asked, asked.limit(0), inner, marked, keys, max_level, max_passes)
    if inner is start:
        out = given
    else:
        out = cut(M.leaves(inner, M.roots(given.select(*keys).distinct(), keys, nx, ny), keys))
        uncut(given)
    for old in (asked, start, inner, marked):
        if old is not None:
            uncut(old)
    return out


def stitched(pixels: DataFrame, leaf: DataFrame, keys: list[str], tile: int, max_level: int) -> DataFrame:
    """pixels, of any frames and channels, on their leaves: level, ix, iy and the place px, py in the leaf's
    patch of tile >> level pixels a side. Every pixel is in exactly one leaf, with its value untouched."""
    held = M.covering(pixels, leaf, keys, tile, max_level)
    side = F.expr(f"shiftright({tile}, level)")
    place = lambda c, i: (F.col(c) - F.col(i) * side).cast("int")
    return held.select(*[c for c in pixels.columns if c not in ("x", "y", "v")], *CELL, place("x", "ix").alias("px"), place("y", "iy").alias("py"), "v")


def summed(pixels: DataFrame, leaf: DataFrame, keys: list[str], more: list[str], tile: int, max_level: int) -> DataFrame:
    """(keys, more, cell, pixels, total): how many of the pixels each leaf holds, and the sum of their values, for
    each of more (frames, channels). They are added up over the cells of the finest level before they meet the leaves."""
    if tile % (1 << max_level):
        return stitched(pixels, leaf, keys, tile, max_level).groupBy(*keys, *more, *CELL).agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))
    finest = lambda c: F.floor(F.col(c) / (tile >> max_level)).cast("int")
    sums = pixels.groupBy(*keys, *more, finest("x").alias("_fx"), finest("y").alias("_fy")).agg(F.count("*").alias("_n"), F.sum("v").alias("_s"))
    held = sums.join(M.finest_cells(leaf, keys, max_level).hint("merge"), [*keys, "_fx", "_fy"])
    return held.groupBy(*keys, *more, *CELL).agg(F.sum("_n").alias("pixels"), F.sum("_s").alias("total"))
