"""Quadtree meshes as relational key sets.

A cell is (level, ix, iy), counted over the whole domain at its level; its tile is (ix >> level,
iy >> level). A topology is its set of internal cells per tree; leaves are derived. Every operator
takes ``keys``, the columns that name a tree, and works on any number of trees at once. Levels are
few, so loops over levels build one plan each; nothing iterates over cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["level", "ix", "iy"]


def inlined(*values: str) -> str:
    """SQL of a struct whose fields go by place, so that it fits an array with others of any values."""
    return f"named_struct({', '.join(f"'_{k}', {v}" for k, v in enumerate(values))})"


def roots(trees: DataFrame, keys: list[str], nx: int, ny: int) -> DataFrame:
    return trees.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix"), F.lit(0).alias("level")).select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("iy")).select(*keys, *CELL)


def children(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The four children of each cell; quadrant 0 to 3 is SW, SE, NW, NE."""
    out = cells.select(*keys, *CELL, F.explode(F.array(*[F.lit(q) for q in range(4)])).alias("quadrant"))
    return out.select(*keys, (F.col("level") + 1).alias("level"), (F.col("ix") * 2 + F.col("quadrant") % 2).alias("ix"), (F.col("iy") * 2 + F.floor(F.col("quadrant") / 2).cast("int")).alias("iy"), "quadrant")


def leaves(internal: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Roots and children of internal cells that are not internal."""
    nodes = base.select(*keys, *CELL).unionByName(children(internal, keys).select(*keys, *CELL))
    return nodes.join(internal.select(*keys, *CELL), [*keys, *CELL], "left_anti")


def internals(leaf: DataFrame, keys: list[str]) -> DataFrame:
    """All proper ancestors of the leaves."""
    return ancestors(leaf, keys).select(*keys, F.col("alevel").alias("level"), F.col("ax").alias("ix"), F.col("ay").alias("iy")).distinct()


def ancestors(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell beside each proper ancestor (alevel, ax, ay): keys shifted right by the level difference."""
    up = F.when(F.col("level") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("level") - 1)))
    out = cells.select(*keys, *CELL, F.explode(up).alias("alevel"))
    shift = lambda c: F.expr(f"shiftright({c}, level - alevel)")
    return out.withColumns({"ax": shift("ix"), "ay": shift("iy")})


def adapt(field: DataFrame, keys: list[str], tile: int, max_level: int, tol: float, v: str = "v") -> DataFrame:
    """Internal cells of the mesh refined where a cell's value range exceeds tol times its tree's.

    The range only grows with the cell, so a cell is internal exactly if its own range passes: one
    aggregation of the pixels at the finest level that can split, then one per coarser level.
    """
    whole = field.groupBy(*keys).agg((F.max(v) - F.min(v)).alias("_r"))
    side = tile >> (max_level - 1)
    cell = lambda c: F.floor(F.col(c) / side).cast("int")
    level = field.groupBy(*keys, cell("x").alias("ix"), cell("y").alias("iy")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    out = []
    for k in range(max_level - 1, -1, -1):
        out.append(level.withColumn("level", F.lit(k)))
        level = level.groupBy(*keys, F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cells = reduce(DataFrame.unionByName, out)
    return cells.join(whole, keys).where((F.col("hi") - F.col("lo") > F.lit(tol) * F.col("_r")) & ~F.isnan("hi") & ~F.isnan("lo")).select(*keys, *CELL)


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The coarsest mesh as fine as both."""
    return a.select(*keys, *CELL).unionByName(b.select(*keys, *CELL)).distinct()


def balance(internal: DataFrame, keys: list[str], nx: int, ny: int, max_level: int, periodic: bool = False, flag: str | None = None) -> DataFrame:
    """The least refinement in which face neighbours differ by one level at most.

    An internal cell's children are at level + 1, so its face neighbours must exist at its own level,
    i.e. their parents be internal. Each cell writes those parents, as often as there are levels to climb:
    one chain over the cells, which no step reads twice; there is no fixpoint loop. ``flag``: a column of
    whole numbers, 0 for cells that are added; of equal cells the largest stays.
    """
    out = internal.select(*keys, *CELL, *([flag] if flag else []))
    zero = ["0"] if flag else []
    up = []
    for x, y in (("ix + 1", "iy"), ("ix - 1", "iy"), ("ix", "iy + 1"), ("ix", "iy - 1")):
        w, h = f"shiftleft({nx}, level)", f"shiftleft({ny}, level)"
        if periodic:
            x, y = f"pmod({x}, {w})", f"pmod({y}, {h})"
        up.append(f"IF(level BETWEEN 1 AND {max_level - 1} AND {x} >= 0 AND {x} < {w} AND {y} >= 0 AND {y} < {h}, {inlined('level - 1', f'shiftright({x}, 1)', f'shiftright({y}, 1)', *zero)}, NULL)")
    columns = [*CELL, *([flag] if flag else [])]
    for _ in range(max_level - 1):
        out = out.select(*keys, F.expr(f"inline(array({', '.join([inlined(*columns), *up])}))").alias(*columns)).where("level IS NOT NULL")
        out = out.groupBy(*keys, *CELL).agg(F.max(flag).alias(flag)) if flag else out.distinct()
    return out


def neighbours(leaf: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """Pairs of face neighbours: (keys, cell, nlevel, nx, ny, side), sides W, E, S, N of the cell.

    Each leaf writes its faces as unit edges at the finest level, and equal edges meet in an equi-join:
    no range or nested-loop join.
    """
    s = F.expr(f"shiftleft(1, {max_level} - level)")
    faces = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(axis).alias("axis"), line.alias("line"), low.alias("low")) for side, axis, line, low in (("W", 0, F.col("ix") * s, F.col("iy") * s), ("E", 0, (F.col("ix") + 1) * s, F.col("iy") * s), ("S", 1, F.col("iy") * s, F.col("ix") * s), ("N", 1, (F.col("iy") + 1) * s, F.col("ix") * s))])
    edge = leaf.select(*keys, *CELL, s.alias("_s"), F.explode(faces).alias("f")).select(*keys, *CELL, "f.side", "f.axis", "f.line", F.explode(F.sequence(F.col("f.low"), F.col("f.low") + F.col("_s") - 1)).alias("at"))
    met = {"W": "E", "E": "W", "S": "N", "N": "S"}
    other = edge.select(*keys, F.col("level").alias("nlevel"), F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.create_map(*[F.lit(x) for kv in met.items() for x in kv])[F.col("side")].alias("side"), "axis", "line", "at")
    return edge.join(other.hint("merge"), [*keys, "side", "axis", "line", "at"]).select(*keys, *CELL, "nlevel", "nx", "ny", "side").distinct()


def expand_fine(internal: DataFrame, base: DataFrame, keys: list[str], nx: int, ny: int, max_level: int, layers: int) -> DataFrame:
    """Layers of coarser face neighbours around refined leaves, refined by one level; balanced before and after each."""
    out = balance(internal, keys, nx, ny, max_level)
    for _ in range(layers):
        near = neighbours(leaves(out, base, keys), keys, max_level)
        coarse = near.where("nlevel < level").select(*keys, F.col("nlevel").alias("level"), F.col("nx").alias("ix"), F.col("ny").alias("iy")).distinct()
        out = balance(merge(out, coarse, keys), keys, nx, ny, max_level)
    return out


def diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves of b that a lacks; op 1 (refine) where an ancestor is a leaf of a, else 2 (coarsen)."""
    new = b.select(*keys, *CELL).join(a.select(*keys, *CELL), [*keys, *CELL], "left_anti")
    up = ancestors(new, keys).join(a.select(*keys, F.col("level").alias("alevel"), F.col("ix").alias("ax"), F.col("iy").alias("ay")), [*keys, "alevel", "ax", "ay"]).select(*keys, *CELL).distinct().withColumn("_r", F.lit(1))
    return new.join(up, [*keys, *CELL], "left").select(*keys, *CELL, F.when(F.col("_r") == 1, 1).otherwise(2).alias("op"))


def apply_diff(a: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """a's leaves without those above or below a changed one, and the changed ones. Never balances."""
    above = ancestors(change, keys).select(*keys, F.col("alevel").alias("level"), F.col("ax").alias("ix"), F.col("ay").alias("iy")).distinct()
    below = ancestors(a, keys).join(change.select(*keys, F.col("level").alias("alevel"), F.col("ix").alias("ax"), F.col("iy").alias("ay")), [*keys, "alevel", "ax", "ay"], "left_semi").select(*keys, *CELL).distinct()
    kept = a.select(*keys, *CELL).join(above, [*keys, *CELL], "left_anti").join(below, [*keys, *CELL], "left_anti")
    return kept.unionByName(change.select(*keys, *CELL)).distinct()


def siblings(leaf: DataFrame, keys: list[str]) -> DataFrame:
    """Parents of which all four children are leaves."""
    bit = F.expr("shiftleft(1, (ix & 1) + 2 * (iy & 1))")
    up = leaf.where("level > 0").groupBy(*keys, (F.col("level") - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).agg(F.count("*").alias("_n"), F.bit_or(bit).alias("_b"))
    return up.where("_n = 4 and _b = 15").select(*keys, *CELL)


def morton(level: str, ix: str, iy: str, max_level: int) -> Column:
    """Z-order of the cell's lower corner at the finest level; a corner beyond 31 bits is an error."""
    fine = lambda c: F.expr(f"shiftleft(cast({c} as bigint), {max_level} - {level})")

    def spread(v: Column) -> Column:
        """Bit k to place 2 k: the upper halves move apart, step by step."""
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    fits = (fine(ix) >= 0) & (fine(ix) < F.lit(1 << 31)) & (fine(iy) >= 0) & (fine(iy) < F.lit(1 << 31))
    return F.when(fits, spread(fine(ix)).bitwiseOR(F.shiftleft(spread(fine(iy)), 1))).otherwise(F.raise_error(F.lit("a cell's corner is beyond 31 bits")).cast("bigint"))


def uid(level: str, ix: str, iy: str, max_level: int) -> Column:
    """Bits of x and y within the tile, level (6), tile x and tile y (12 each): an error where a tile or
    level needs more, or all of them together more than 63 bits."""
    if 2 * max_level + 30 > 63:
        raise ValueError(f"a mesh of {max_level} levels has no 63-bit uids")
    tx, ty = F.expr(f"cast(shiftright({ix}, {level}) as bigint)"), F.expr(f"cast(shiftright({iy}, {level}) as bigint)")
    x, y = F.col(ix) - F.expr(f"shiftleft(shiftright({ix}, {level}), {level})"), F.col(iy) - F.expr(f"shiftleft(shiftright({iy}, {level}), {level})")
    w = max_level
    fits = (tx >= 0) & (tx < 4096) & (ty >= 0) & (ty < 4096) & (F.col(level) >= 0) & (F.col(level) <= max_level)
    packed = x.cast("bigint") + F.shiftleft(y.cast("bigint"), w) + F.shiftleft(F.col(level).cast("bigint"), 2 * w) + F.shiftleft(tx, 2 * w + 6) + F.shiftleft(ty, 2 * w + 18)
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("a cell has no uid: its level is too deep or its tile beyond 4,095")).cast("bigint"))


def uid_parts(u: Column, max_level: int) -> dict[str, Column]:
    """level, ix, iy from a uid."""
    w, m = max_level, (1 << max_level) - 1
    level = F.shiftright(u, 2 * w).bitwiseAND(F.lit(63)).cast("int")
    tx, ty = F.shiftright(u, 2 * w + 6).bitwiseAND(F.lit(4095)).cast("int"), F.shiftright(u, 2 * w + 18).bitwiseAND(F.lit(4095)).cast("int")
    power = F.pow(F.lit(2.0), level).cast("int")
    return {"level": level, "ix": u.bitwiseAND(F.lit(m)).cast("int") + tx * power, "iy": F.shiftright(u, w).bitwiseAND(F.lit(m)).cast("int") + ty * power}


def export(leaf: DataFrame, keys: list[str], nx: int, ny: int, max_level: int) -> DataFrame:
    """Per leaf its uid, Z-order, tile, centre in [0, 1], half widths, and whether it touches the domain's edge."""
    n = F.pow(F.lit(2.0), F.col("level"))
    touch = (F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") + 1 == n * nx) | (F.col("iy") + 1 == n * ny)
    return leaf.select(*keys, *CELL, uid("level", "ix", "iy", max_level).alias("uid"), morton("level", "ix", "iy", max_level).alias("morton"), F.expr("shiftright(ix, level)").alias("tile_ix"), F.expr("shiftright(iy, level)").alias("tile_iy"), ((F.col("ix") + 0.5) / (n * nx)).alias("cx"), ((F.col("iy") + 0.5) / (n * ny)).alias("cy"), (0.5 / (n * nx)).alias("hx"), (0.5 / (n * ny)).alias("hy"), touch.alias("boundary"))


def covering(points: DataFrame, leaf: DataFrame, keys: list[str], tile: int, max_level: int) -> DataFrame:
    """Each pixel (x, y) with the leaf that holds it, joined by equality; exactly one meets a leaf.

    Leaves write the cells of the finest level under them, and both sides meet on those: a pixel stays one
    row, and leaves have no more rows than the finest grid. Where the tile does not divide into the finest
    level, pixels are written once a level instead and meet on the cell at each. The join is sort-merge:
    both sides are written out here or by the caller, and Spark would take their sizes before that.
    """
    if tile % (1 << max_level):
        side = F.expr(f"shiftright({tile}, level)")
        at = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_level)))).withColumns({"ix": F.floor(F.col("x") / side).cast("int"), "iy": F.floor(F.col("y") / side).cast("int")})
        return at.join(leaf.select(*keys, *CELL).hint("merge"), [*keys, *CELL])
    finest = lambda c: F.floor(F.col(c) / (tile >> max_level)).cast("int")
    at = points.withColumns({"_fx": finest("x"), "_fy": finest("y")})
    return at.join(finest_cells(leaf, keys, max_level).hint("merge"), [*keys, "_fx", "_fy"]).drop("_fx", "_fy")


def finest_cells(leaf: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """(keys, cell, _fx, _fy): leaves with each cell of the finest level under them."""
    n = F.expr(f"shiftleft(1, {max_level} - level)")
    span = lambda c: F.sequence(F.col(c) * n, F.col(c) * n + n - 1)
    out = leaf.where(F.col("level").between(0, max_level)).select(*keys, *CELL, F.explode(span("ix")).alias("_fx"))
    return out.select("*", F.explode(span("iy")).alias("_fy"))


def leaf_means(field: DataFrame, leaf: DataFrame, keys: list[str], tile: int, max_level: int, patch: int = 1, v: str = "v", more: list[str] | None = None) -> DataFrame:
    """Block means of each leaf over patch x patch sub-pixels (px, py); ``more`` names frames and channels.

    Where the finest leaf divides into sub-pixels, pixels are added up over those before they meet the leaves.
    """
    more = more or []
    finest = tile >> max_level
    if tile % (1 << max_level) or finest % patch:
        held = covering(field, leaf, keys, tile, max_level)
        sums = [F.avg(v).alias(v)]
    else:
        unit = finest // patch
        part = lambda c: (F.floor(F.col(c) / unit) * unit).cast("int")
        held = field.groupBy(*keys, *more, part("x").alias("x"), part("y").alias("y")).agg(F.sum(v).alias("_s"), F.count(v).alias("_n"))
        held = covering(held, leaf, keys, tile, max_level)
        sums = [F.try_divide(F.sum("_s"), F.sum("_n")).alias(v)]
    sub = F.expr(f"shiftright({tile}, level) / {patch}")
    place = lambda c, i: F.floor((F.col(c) - F.col(i) * F.expr(f"shiftright({tile}, level)")) / sub).cast("int")
    return held.groupBy(*keys, *more, *CELL, place("x", "ix").alias("px"), place("y", "iy").alias("py")).agg(*sums)


def paint(values: DataFrame, keys: list[str], tile: int, patch: int = 1, v: str = "v") -> DataFrame:
    """Leaf patches to the full grid by repetition: (keys, x, y, v)."""
    sub = F.expr(f"cast(shiftright({tile}, level) / {patch} as int)")
    x0 = F.col("ix") * F.expr(f"shiftright({tile}, level)") + F.col("px") * sub
    y0 = F.col("iy") * F.expr(f"shiftright({tile}, level)") + F.col("py") * sub
    span = lambda a: F.sequence(a, a + sub - 1)
    out = values.select(*keys, v, y0.alias("_y"), sub.alias("_s"), F.explode(span(x0)).alias("x"))
    return out.select(*keys, "x", F.explode(F.sequence(F.col("_y"), F.col("_y") + F.col("_s") - 1)).alias("y"), v)


def uncovered(leaf: DataFrame, keys: list[str], nx: int, ny: int, max_level: int) -> DataFrame:
    """Trees whose leaves do not cover the domain exactly once: by area, and by leaves above others."""
    area = leaf.groupBy(*keys).agg(F.sum(F.expr(f"cast(shiftleft(1, 2 * ({max_level} - level)) as bigint)")).alias("area"))
    twice = ancestors(leaf, keys).join(leaf.select(*keys, F.col("level").alias("alevel"), F.col("ix").alias("ax"), F.col("iy").alias("ay")), [*keys, "alevel", "ax", "ay"], "left_semi").select(*keys).distinct()
    return area.where(F.col("area") != (nx * ny) << (2 * max_level)).select(*keys).unionByName(twice).distinct()


def refine_bilinear(values: DataFrame, keys: list[str], n: int, v: str = "v") -> DataFrame:
    """n x n patches of leaves to those of their four children: align-corners bilinear upsampling.

    Child pixel k of quadrant side q sits at (q * n + k) * (n - 1) / (2n - 1) of the parent's pixels.
    """
    near = [(q, k, (q * n + k) * (n - 1) / (2 * n - 1)) for q in (0, 1) for k in range(n)]
    taps = [(q, k, i, w) for q, k, at in near for i, w in ((int(at), 1 - (at - int(at))), (min(int(at) + 1, n - 1), at - int(at))) if w > 0]
    table = values.sparkSession.createDataFrame(taps, "q int, k int, i int, w double")
    tx, ty = (F.broadcast(table.select(*[F.col(c).alias(f"{c}{a}") for c in ("q", "k", "i", "w")])) for a in "xy")  # 4 n rows each
    met = values.withColumnsRenamed({"ix": "_ix", "iy": "_iy"}).join(tx, F.col("px") == F.col("ix")).join(ty, F.col("py") == F.col("iy"))
    return met.groupBy(*keys, (F.col("level") + 1).alias("level"), (F.col("_ix") * 2 + F.col("qx")).alias("ix"), (F.col("_iy") * 2 + F.col("qy")).alias("iy"), F.col("kx").alias("px"), F.col("ky").alias("py")).agg(F.sum(F.col(v) * F.col("wx") * F.col("wy")).alias(v))


def coarsen_mean(values: DataFrame, keys: list[str], n: int, v: str = "v") -> DataFrame:
    """n x n patches of four siblings to their parent's: 2 x 2 block means of the stitched children; a missing child counts as zeros."""
    px = F.floor((F.col("ix") % 2 * n + F.col("px")) / 2).cast("int")
    py = F.floor((F.col("iy") % 2 * n + F.col("py")) / 2).cast("int")
    return values.groupBy(*keys, (F.col("level") - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"), px.alias("px"), py.alias("py")).agg((F.sum(v) / 4).alias(v))


def protected(values: DataFrame, keys: list[str], tol: float, v: str = "v") -> DataFrame:
    """Leaves with a value range of at least a quarter of tol."""
    return values.groupBy(*keys, *CELL).agg((F.max(v) - F.min(v)).alias("_r")).where(F.col("_r") >= 0.25 * tol).select(*keys, *CELL)


def dilate(marked: DataFrame, leaf: DataFrame, keys: list[str], max_level: int, rounds: int) -> DataFrame:
    """Marked leaves and their face neighbours, ``rounds`` times; levels do not matter."""
    near = neighbours(leaf, keys, max_level)
    for _ in range(rounds):
        more = near.join(marked, [*keys, *CELL], "left_semi").select(*keys, F.col("nlevel").alias("level"), F.col("nx").alias("ix"), F.col("ny").alias("iy"))
        marked = marked.unionByName(more).distinct()
    return marked


def coarsenable(values: DataFrame, leaf: DataFrame, marked: DataFrame, keys: list[str], max_level: int, tol: float, v: str = "v") -> DataFrame:
    """Parents of complete, unprotected siblings with a joint range under tol and no outside face neighbour two levels finer than them."""
    up = lambda df: df.select(*keys, (F.col("level") - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"))
    whole = siblings(leaf, keys)
    flat = values.where("level > 0").groupBy(*keys, (F.col("level") - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).agg((F.max(v) - F.min(v)).alias("_r")).where(F.col("_r") < tol).select(*keys, *CELL)
    fine = up(neighbours(leaf, keys, max_level).where("nlevel > level"))
    return whole.join(flat, [*keys, *CELL], "left_semi").join(up(marked.where("level > 0")), [*keys, *CELL], "left_anti").join(fine, [*keys, *CELL], "left_anti")


def info(leaf: DataFrame, keys: list[str]) -> DataFrame:
    return leaf.groupBy(*keys).agg(F.count("*").alias("leaves"), F.max("level").cast("long").alias("deepest"), F.count_distinct(F.expr("shiftright(ix, level)"), F.expr("shiftright(iy, level)")).alias("tiles"))


def fingerprint(leaf: DataFrame, keys: list[str]) -> DataFrame:
    """sha256 over the sorted cell keys; a tree's keys are bounded by its finest grid."""
    wide = lambda c: F.when(F.length(F.col(c).cast("string")) > 8, F.col(c).cast("string")).otherwise(F.lpad(F.col(c).cast("string"), 8, "0"))
    cell = F.concat_ws(",", "level", wide("ix"), wide("iy"))
    return leaf.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(cell)), ";"), 256).alias("digest"))


def bucket_layout(leaf: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """Position of each leaf in its level's bucket, in Z-order."""
    w = Window.partitionBy(*keys, "level").orderBy(morton("level", "ix", "iy", max_level))
    return leaf.select(*keys, *CELL, (F.row_number().over(w) - 1).cast("long").alias("position"))


def patch_internals(patches: DataFrame, keys: list[str], tile: int, max_level: int) -> DataFrame:
    """Cells that a finer rectangle overlaps: patches(level, x0, x1, y0, y1) in finest pixels, half open.

    Each patch writes the cells it touches at every coarser level; no range join.
    """
    at = patches.where("level > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.least(F.col("level"), F.lit(max_level)) - 1)).alias("k"), "x0", "x1", "y0", "y1")
    side = F.expr(f"shiftright({tile}, k)")
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / side).cast("int"), F.floor((F.col(b) - 1) / side).cast("int"))
    out = at.select(*keys, F.col("k").alias("level"), F.explode(cells("x0", "x1")).alias("ix"), cells("y0", "y1").alias("_ys"))
    return out.select(*keys, "level", "ix", F.explode("_ys").alias("iy")).distinct()


def precedence(rows: DataFrame, tie: str, last: bool = False) -> Column:
    """What the winner among rows has most of: the finest level, of equals the least tie, or the last.

    Where level and tie are whole numbers this is one decimal, so that max_by runs in a hash table with a
    row a group; a struct, which takes any type, makes Spark sort all rows that compete. Nulls lose.
    """
    kinds = dict(rows.dtypes)
    if not {kinds["level"], kinds[tie]} <= {"tinyint", "smallint", "int", "bigint"}:
        return F.struct(F.col("level"), F.col(tie) if last else -F.col(tie))
    at = F.col(tie).cast("decimal(19,0)") * (1 if last else -1)
    deep = F.coalesce(F.col("level").cast("decimal(17,0)"), F.lit(-(10**17) + 1).cast("decimal(17,0)"))
    return (deep * F.lit("20000000000000000000").cast("decimal(20,0)") + F.coalesce(at, F.lit("-9300000000000000000").cast("decimal(19,0)"))).cast("decimal(38,0)")


def finest_wins(patches: DataFrame, keys: list[str], tie: str = "patch_id", v: str = "v") -> DataFrame:
    """Every pixel that patches cover with the value of the finest patch, the first of equals: (keys, x, y, v).

    Of patches with the same box one wins everywhere, so these compete before pixels are written; max_by
    keeps one for each pixel, combined before the shuffle.
    """
    box = ["x0", "x1", "y0", "y1"]
    won = patches.withColumn("_first", precedence(patches, tie)).groupBy(*keys, *box).agg(F.max_by(v, "_first").alias(v), F.max("_first").alias("_first"))
    out = won.select(*keys, "_first", v, "y0", "y1", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    out = out.select(*keys, "_first", v, "x", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    return out.groupBy(*keys, "x", "y").agg(F.max_by(v, "_first").alias(v))


def refine_where(leaf: DataFrame, predicate: Column, keys: list[str]) -> DataFrame:
    """Leaves after one pass over the leaves as they are: those the predicate holds for become their children."""
    chosen = leaf.where(predicate)
    return leaf.select(*keys, *CELL).join(chosen.select(*keys, *CELL), [*keys, *CELL], "left_anti").unionByName(children(chosen, keys).select(*keys, *CELL))


def coarsen_where(leaf: DataFrame, predicate: Column, keys: list[str], max_level: int) -> DataFrame:
    """Leaves after merging, from fine to coarse, every complete set of siblings whose parent the predicate
    holds for; what one level merges the next may merge again."""
    out = leaf.select(*keys, *CELL)
    for k in range(max_level, 0, -1):
        up = siblings(out.where(F.col("level") == k), keys).where(predicate)
        gone = children(up, keys).select(*keys, *CELL)
        out = out.join(gone, [*keys, *CELL], "left_anti").unionByName(up)
    return out


def refine_only(change: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """The mesh of a diff against bare roots that only refines: its rows and the roots none of them is under."""
    tiles = change.select(*keys, F.lit(0).alias("level"), F.expr("shiftright(ix, level)").alias("ix"), F.expr("shiftright(iy, level)").alias("iy")).distinct()
    return change.select(*keys, *CELL).unionByName(base.select(*keys, *CELL).join(tiles, [*keys, *CELL], "left_anti"))


def repair_overlaps(leaf: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that lie over others go where finer ones cover them whole and are refined around them
    elsewhere. Closed form: what is over a cell is internal, and the leaves follow from that."""
    base = leaf.select(*keys, F.lit(0).alias("level"), F.expr("shiftright(ix, level)").alias("ix"), F.expr("shiftright(iy, level)").alias("iy")).distinct()
    return leaves(internals(leaf, keys), base, keys)


def from_centres(rows: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells from centres (cx, cy in [0, 1]) and levels, the inverse of export()."""
    n = F.pow(F.lit(2.0), F.col("level"))
    back = lambda c, m: F.round(F.col(c) * n * m - 0.5).cast("int")
    return rows.withColumns({"ix": back("cx", nx), "iy": back("cy", ny)})


def regular_centres(spark, nx: int, ny: int) -> DataFrame:
    """Centres of an nx by ny grid of patches in [0, 1]."""
    cells = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    return cells.withColumns({"cx": (F.col("ix") + 0.5) / nx, "cy": (F.col("iy") + 0.5) / ny})


def rasterize(field: DataFrame, keys: list[str], n: int, most: int) -> DataFrame:
    """Nearest samples of an n by n grid on at most ``most`` pixels a side."""
    m = min(n, most)
    hit = lambda c: F.floor(F.col(c) * m / n)
    own = lambda c: F.floor((hit(c) + 0.5) * n / m) == F.col(c)
    return field.where(own("x") & own("y")).select(*keys, hit("x").cast("int").alias("x"), hit("y").cast("int").alias("y"), "v")


def patches_to_grid(patches: DataFrame, keys: list[str], ratio: int, tie: str = "patch_id", v: str = "v") -> DataFrame:
    """Patches on a coarser grid of blocks of ``ratio`` pixels: the finest value of each pixel, then block means."""
    fine = finest_wins(patches, keys, tie, v)
    return fine.groupBy(*keys, F.floor(F.col("x") / ratio).cast("int").alias("x"), F.floor(F.col("y") / ratio).cast("int").alias("y")).agg(F.avg(v).alias(v))
