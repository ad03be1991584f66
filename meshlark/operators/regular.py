"""Patches of several levels on one regular grid, for all frames of a window on the grid of its last input.

Patches are (frame columns, level, order, x0, y0, x1, y1, v): boxes of cells at their own level, corners in that
level's cells, half open; a level-k cell is 2^k times finer than a level-0 cell per side. v is a value for
the whole box, or explode a box to one row a cell. Everything is an equi-join or an aggregation on target
cells; no overlap is found by comparing boxes with boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.mesh import precedence


def geometry(patches: DataFrame, frame: list[str], target_level: int, box_from: str = "domain") -> DataFrame:
    """(frame, gx0, gy0, gx1, gy1): the grid over a frame's boxes, in cells of the target level.

    box_from: ``domain`` takes all boxes, ``finest`` those of the frame's finest level. A frame without a
    box of the target level has no grid: its rows are missing, as the cell size is not known.
    """
    if box_from not in ("domain", "finest"):
        raise ValueError(f"unknown box_from {box_from}")
    # first the corners of each level, few rows; within one, scaling keeps the order
    ends = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    scale = F.pow(F.lit(2.0), F.lit(target_level) - F.col("level"))
    levels = patches.groupBy(*frame, "level").agg(*[end(c).alias(c) for c, end in ends.items()])
    pick = (lambda c, end: end(F.col(c) * scale)) if box_from == "domain" else (lambda c, end: F.max_by(F.col(c) * scale, "level"))
    out = levels.groupBy(*frame).agg(F.bool_or(F.col("level") == target_level).alias("_has"), *[F.round(pick(c, end)).cast("int").alias(f"g{c}") for c, end in ends.items()])
    return out.where("_has").drop("_has")


def boxes(patches: DataFrame, frame: list[str], order: str, v: str) -> DataFrame:
    """(frame, level, x0, y0, x1, y1, _last, v): of a frame's patches with the same box the one that wins its cells."""
    ranked = patches.withColumn("_last", precedence(patches, order, last=True))
    return ranked.groupBy(*frame, "level", "x0", "y0", "x1", "y1").agg(F.max_by(v, "_last").alias(v), F.max("_last").alias("_last"))


def on_grid(patches: DataFrame, grid: DataFrame, frame: list[str], target_level: int, order: str = "patch_id", v: str = "v") -> DataFrame:
    """(frame, x, y, v): every target cell that a patch covers, from the grid's corner.

    grid(frame, gx0, gy0, gx1, gy1) names the target of each frame. A patch at the target level is
    copied, one of a coarser level repeats each cell over 2^d x 2^d target cells, one of a finer level
    gives the mean of whole 2^d x 2^d blocks that begin at its corner; cells of a block that the patch
    does not fill give nothing. Where several patches cover a cell, the finest wins, and of equals the
    last in ``order``. Cells that none covers are not returned.
    """
    return placed(boxes(patches, frame, order, v), grid, frame, target_level, v)


def placed(won: DataFrame, grid: DataFrame, frame: list[str], target_level: int, v: str = "v") -> DataFrame:
    """on_grid() for boxes() of patches."""
    cells = won.join(grid, frame)
    d = F.col("level") - F.lit(target_level)
    finer, coarser = F.expr(f"shiftleft(1, greatest(0, level - {target_level}))"), F.expr(f"shiftleft(1, greatest(0, {target_level} - level))")

    def span(a: str, b: str):
        """First and last target cell along an axis: where blocks of a finer patch begin at its corner."""
        first = F.when(d >= 0, F.floor(F.col(a) / finer)).otherwise(F.col(a) * coarser)
        count = F.when(d >= 0, F.floor((F.col(b) - F.col(a)) / finer)).otherwise((F.col(b) - F.col(a)) * coarser)
        return first.cast("int"), (first + count - 1).cast("int")

    (ax, bx), (ay, by) = span("x0", "x1"), span("y0", "y1")
    keep = cells.withColumns({
        "_ax": F.greatest(ax, F.col("gx0")), "_bx": F.least(bx, F.col("gx1") - 1), "_ay": F.greatest(ay, F.col("gy0")), "_by": F.least(by, F.col("gy1") - 1),
    }).where("_bx >= _ax and _by >= _ay")
    rows = keep.select(*frame, "_last", v, "gx0", "gy0", "_ay", "_by", F.explode(F.sequence("_ax", "_bx")).alias("_x"))
    rows = rows.select(*frame, "_last", v, (F.col("_x") - F.col("gx0")).alias("x"), F.explode(F.sequence("_ay", "_by")).alias("_y"), "gy0")
    rows = rows.withColumn("y", F.col("_y") - F.col("gy0"))
    return rows.groupBy(*frame, "x", "y").agg(F.max_by(v, "_last").alias(v))


def cells_on_grid(cells: DataFrame, grid: DataFrame, frame: list[str], target_level: int, order: str = "patch_id", v: str = "v") -> DataFrame:
    """on_grid() for patches with a value in each cell: cells(frame, order, level, x0, y0, x, y, v) with the
    patch's corner x0, y0 and size x1, y1 beside each of its cells x, y, in the patch's level.

    A block of a finer patch is the mean of its cells, taken before patches compete for a target cell.
    """
    finer, coarser = F.expr(f"shiftleft(1, greatest(0, level - {target_level}))"), F.expr(f"shiftleft(1, greatest(0, {target_level} - level))")
    at = lambda c, a: F.floor((F.col(c) - F.col(a)) / finer).cast("int")
    whole = lambda c, a, b: (at(c, a) + 1) * finer <= F.col(b) - F.col(a)
    blocks = cells.where(whole("x", "x0", "x1") & whole("y", "y0", "y1"))
    first = lambda a: F.floor(F.col(a) / finer).cast("int")
    blocks = blocks.groupBy(*frame, order, "level", (first("x0") + at("x", "x0")).alias("_bx"), (first("y0") + at("y", "y0")).alias("_by")).agg(F.avg(v).alias(v))
    spread = lambda c: F.explode(F.sequence(F.col(c) * coarser, F.col(c) * coarser + coarser - 1))
    # cells compete before they meet the grid: what is joined has a row for each cell, however many patches cover it
    rows = blocks.withColumn("_last", precedence(blocks, order, last=True)).withColumn("_x", spread("_bx")).withColumn("_y", spread("_by"))
    won = rows.groupBy(*frame, "_x", "_y").agg(F.max_by(v, "_last").alias(v))
    kept = won.join(grid, frame).where("_x >= gx0 and _x < gx1 and _y >= gy0 and _y < gy1")
    return kept.select(*frame, (F.col("_x") - F.col("gx0")).alias("x"), (F.col("_y") - F.col("gy0")).alias("y"), v)


def window_frames(windows: DataFrame, patches: DataFrame, target_level: int, frame: str = "frame_id", order: str = "patch_id", v: str = "v", box_from: str = "domain") -> DataFrame:
    """(window, role, slot, x, y, v): every frame of every window on the grid of the window's last input.

    windows(window, inputs, targets) list frames in order; patches(frame, level, order, x0, y0, x1, y1, v)
    belong to frames. Grids are made once for each distinct last input, and a frame that several windows
    with the same one share is remapped once. Cells that no patch covers are 0. Windows whose last input
    has no grid at that level have no rows.
    """
    listed = lambda role: windows.select("window", F.try_element_at("inputs", F.lit(-1)).alias("reference"), F.lit(role[:-1]).alias("role"), F.posexplode(role).alias("slot", frame))
    slots = listed("inputs").unionByName(listed("targets"))
    references = windows.select(F.try_element_at("inputs", F.lit(-1)).alias(frame)).distinct()
    grid = geometry(patches, [frame], target_level, box_from).join(references, frame, "left_semi").withColumnRenamed(frame, "reference")
    pairs = slots.select("reference", frame).distinct()
    held = placed(boxes(patches, [frame], order, v).join(pairs, frame), grid.join(pairs, "reference"), ["reference", frame], target_level, v)
    every = grid.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("gx1") - F.col("gx0") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("gy1") - F.col("gy0") - 1)))
    full = slots.join(every.select("reference", "x", "y"), "reference").join(held, ["reference", frame, "x", "y"], "left")
    return full.select("window", "role", "slot", "x", "y", F.coalesce(v, F.lit(0.0)).alias(v))
