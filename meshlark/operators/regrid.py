"""Adapting a mesh to its own values: error metric, refinement, protection, coarsening, lineage replay.

Values are (keys, level, ix, iy, px, py, v): patches of n x n pixels on leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators import mesh as M
from meshlark.operators import passes as P
from meshlark.operators.lineage import cut, uncut

CELL = M.CELL


def sample(points: DataFrame, values: DataFrame, keys: list[str], n: int, tile: int, max_level: int, nx: int, ny: int) -> DataFrame:
    """points(keys, id, sx, sy) in finest pixels with ``sample``, the bilinear value at pixel centres of
    the leaf that holds them; 0 outside the domain. Equi-joins on the cell only."""
    leaf = values.select(*keys, *CELL).distinct()
    inside = points.where((F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") <= nx * tile) & (F.col("sy") <= ny * tile))
    inside = inside.withColumns({"x": F.least(F.floor("sx"), F.lit(nx * tile - 1)).cast("int"), "y": F.least(F.floor("sy"), F.lit(ny * tile - 1)).cast("int")})
    held = M.covering(inside, leaf, keys, tile, max_level)
    side = F.expr(f"shiftright({tile}, level)")
    at = lambda s, i: (F.col(s) - F.col(i) * side) / side * n - 0.5
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
    taps = lambda c: F.array(F.struct(clamp(F.floor(c)).alias("p"), (1 - (c - F.floor(c))).alias("w")), F.struct(clamp(F.floor(c) + 1).alias("p"), (c - F.floor(c)).alias("w")))
    held = held.withColumn("tx", F.explode(taps(at("sx", "ix")))).withColumn("ty", F.explode(taps(at("sy", "iy"))))
    held = held.select(*keys, "id", *CELL, F.col("tx.p").alias("px"), F.col("ty.p").alias("py"), (F.col("tx.w") * F.col("ty.w")).alias("_w"))
    got = held.join(values, [*keys, *CELL, "px", "py"]).groupBy(*keys, "id").agg(F.sum(F.col("v") * F.col("_w")).alias("sample"))
    return points.join(got, [*keys, "id"], "left").withColumn("sample", F.coalesce("sample", F.lit(0.0)))


def error_metric(values: DataFrame, keys: list[str], n: int, tile: int, max_level: int, nx: int, ny: int) -> DataFrame:
    """(keys, cell, error): the larger of the patch's range and of the differences between its centre
    and the values one cell width to the west, east, south and north."""
    leaf = values.groupBy(*keys, *CELL).agg((F.max("v") - F.min("v")).alias("_range"))
    side = F.expr(f"shiftright({tile}, level)")
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for k, (a, b) in enumerate(((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)))])
    points = leaf.select(*keys, *CELL, F.explode(steps).alias("s"))
    points = points.select(*keys, F.struct(*CELL, F.col("s.k").alias("k")).alias("id"), ((F.col("ix") + 0.5 + F.col("s.dx")) * side).alias("sx"), ((F.col("iy") + 0.5 + F.col("s.dy")) * side).alias("sy"))
    got = sample(points, values, keys, n, tile, max_level, nx, ny).select(*keys, *[F.col(f"id.{c}").alias(c) for c in CELL], F.col("id.k").alias("k"), "sample")
    centre = F.max(F.when(F.col("k") == 0, F.col("sample")))
    worst = got.groupBy(*keys, *CELL).agg(centre.alias("_c"), F.max(F.when(F.col("k") > 0, F.col("sample"))).alias("_hi"), F.min(F.when(F.col("k") > 0, F.col("sample"))).alias("_lo"))
    return leaf.join(worst, [*keys, *CELL]).select(*keys, *CELL, F.greatest("_range", F.col("_hi") - F.col("_c"), F.col("_c") - F.col("_lo")).alias("error"))


def patches(values: DataFrame, by: list[str], n: int, arrays: dict[str, Column]) -> DataFrame:
    """(by, cell, arrays): a row for each patch, its n x n pixels an array, row after row; a missing pixel is
    null. arrays: for each column, the values it takes, null where a row has none for it."""
    place = [(px, py) for py in range(n) for px in range(n)]
    pixel = lambda v, px, py: F.max(F.when((F.col("px") == px) & (F.col("py") == py), v))
    return values.groupBy(*by, *CELL).agg(*[F.array(*[pixel(v, *at) for at in place]).alias(c) for c, v in arrays.items()])


def pixels(rows: DataFrame, by: list[str], p: str, n: int) -> DataFrame:
    """(by, cell, px, py, v) from patches p."""
    at = rows.select(*by, *CELL, F.posexplode(p).alias("_q", "v"))
    return at.select(*by, *CELL, (F.col("_q") % n).alias("px"), F.floor(F.col("_q") / n).cast("int").alias("py"), "v")


def _refined(n: int, d: int, r: int) -> list[list[float]]:
    """Weights of a patch's pixels, along one axis, in those of the cell r d levels under it: d steps of
    align-corners upsampling, as M.refine_bilinear."""
    out = [[float(i == k) for i in range(n)] for k in range(n)]
    for step in range(1, d + 1):
        side, rows = (r >> (d - step)) & 1, []
        for k in range(n):
            at = (side * n + k) * (n - 1) / (2 * n - 1)
            low, w = int(at), at - int(at)
            rows.append([(1 - w) * a + w * b for a, b in zip(out[low], out[min(low + 1, n - 1)], strict=True)])
        out = rows
    return out


def _sampled(n: int, d: int, r: int, j: int) -> list[float]:
    """The same for the value at the centre of that cell, bilinear at pixel centres of the patch j levels over it."""
    u = ((r & ((1 << j) - 1)) + 0.5) / (1 << j) * n - 0.5
    low, rows = math.floor(u), _refined(n, d - j, r >> j)
    taps = [(max(0, min(n - 1, i)), w) for i, w in ((low, 1 - (u - low)), (low + 1, u - low))]
    return [sum(w * rows[i][k] for i, w in taps) for k in range(n)]


def _weights(name: str, axis: str, n: int, max_level: int, of: Callable[[int, int], list[float]]) -> Column:
    """Column name: the weights for the cell (_rx, _ry) _d levels below, looked up in a table of all."""
    rows = [of(0, 0), *[of(d, r) for d in range(max_level + 1) for r in range(1 << d)]]
    table = ", ".join(f"array({', '.join(f'{w!r}D' for w in row)})" for row in rows)
    return F.expr(f"array({table})[shiftleft(1, _d) + _r{axis}]").alias(name)


def _sum(p: str, n: int, wx: str, wy: str, kx: str = "0", ky: str = "0") -> str:
    """SQL of a weighted sum of p's pixels, by rows ky and kx of the weights. Null pixels count as zeros; where
    all are null so is the sum."""
    taps = [(f"{p}[{j * n + i}]", f"{wy}[{ky} * {n} + {j}] * {wx}[{kx} * {n} + {i}]") for j in range(n) for i in range(n)]
    return f"IF(array_max({p}) IS NULL, NULL, {' + '.join(f'IF({w} > 0, coalesce({v}, 0D) * ({w}), 0D)' for v, w in taps)})"


def descend(rows: DataFrame, ps: list[str], n: int, max_level: int) -> DataFrame:
    """Patches ps as those of the cell (_rx, _ry) _d levels under their own. Sums go over the pixels as a lambda,
    so that the code grows with the pixels of a patch and not with their square."""
    flat = lambda d, r: [w for row in _refined(n, d, r) for w in row]
    at = rows.select("*", *[_weights(f"_w{a}", a, n, max_level, flat) for a in "xy"])
    each = f"sequence(0, {n - 1})"
    return at.withColumns({p: F.expr(f"IF(_d = 0, {p}, flatten(transform({each}, ky -> transform({each}, kx -> {_sum(p, n, '_wx', '_wy', 'kx', 'ky')}))))") for p in ps}).drop("_wx", "_wy")


def asked(seen: DataFrame, keys: list[str], layers: list[str], n: int, max_level: int, tol: float) -> DataFrame:
    """What passes ask (``passes``) of each cell at or under a leaf, from patches seen(layers, cell, p) on leaves.

    Splitting a leaf settles the patches of all cells under it, whatever splits when. So does it the values
    beside a cell: from a leaf of its level the centre of the patch, from a finer one its first pixel, which
    refinement keeps, and from a coarser one a bilinear value in that one's patch."""
    frame = Window.partitionBy(*layers)
    at = seen.repartition(*keys).withColumn("limit", F.abs(F.max(F.array_max("p")).over(frame) - F.min(F.array_min("p")).over(frame)) * tol)
    at = at.where("limit is not null").withColumn("_d", F.explode(F.sequence(F.lit(0), max_level - F.col("level"))))
    for r in ("_rx", "_ry"):
        at = at.withColumn(r, F.explode(F.expr("sequence(0, shiftleft(1, _d) - 1)")))
    looks = [f"up{j}" for j in range(max_level + 1)]  # the value at its centre in the patch j levels over it
    of = lambda j: lambda d, r: _sampled(n, d, r, j) if d >= j else [0.0] * n
    at = at.select("*", *[_weights(f"_{c}{a}", a, n, max_level, of(j)) for j, c in enumerate(looks) for a in "xy"])
    pairs = ", ".join(f"named_struct('x', _{c}x, 'y', _{c}y)" for c in looks)
    at = at.withColumn("_looks", F.expr(f"transform(array({pairs}), w -> {_sum('p', n, 'w.x', 'w.y')})"))
    at = at.select(*[c for c in at.columns if not c.startswith("_up")], *[F.expr(f"IF(_d < {j}, NULL, _looks[{j}])").alias(c) for j, c in enumerate(looks)])
    at = descend(at, ["p"], n, max_level)
    at = at.select(*layers, "limit", (F.col("level") + F.col("_d")).alias("level"), F.expr("shiftleft(ix, _d) + _rx").alias("ix"), F.expr("shiftleft(iy, _d) + _ry").alias("iy"), (F.array_max("p") - F.array_min("p")).alias("spread"), F.col("p")[0].alias("first"), (F.col("_d") == 0).alias("_top"), *looks)
    # a leaf whose lower corner is the centre of a cell over it tells that one its first pixel
    low = lambda c: F.col(c).bitwiseAND(-F.col(c))
    z = F.bit_count(low("ix") - 1).cast("int")
    corner = (F.col("ix") > 0) & (low("ix") == low("iy")) & (z < F.col("level")) & (F.col("_top") | (z == 0))
    at = at.withColumn("_z", F.when(corner, z))
    values = ["spread", "limit", *looks]
    own = M.inlined("level", "ix", "iy", "true", *values, "cast(null AS double)")
    over = M.inlined("level - 1 - _z", "shiftright(ix, _z + 1)", "shiftright(iy, _z + 1)", "false", *["cast(null AS double)"] * len(values), "first")
    at = at.select(*layers, F.expr(f"inline(array({own}, IF(_z IS NULL, NULL, {over})))").alias(*CELL, "_own", *values, "inner")).where("level is not null")
    at = at.groupBy(*layers, *CELL).agg(F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in (*values, "inner")])

    def far(there: str) -> Column:
        def over(v: Column) -> Column:
            other = F.coalesce(v, F.lit(0.0))
            return F.coalesce((other - F.col("up0") > F.col("limit")) | (F.col("up0") - other > F.col("limit")), F.lit(False))

        bits = {**{c: 1 << j for j, c in enumerate(looks)}, "inner": P.FINER}
        return reduce(lambda x, y: x.bitwiseOR(y), [P.bit(over(F.col(f"{there}.{c}")), b) for c, b in bits.items()], P.bit(over(F.lit(None).cast("double")), P.NONE))

    met = P.beside(at, layers, ["inner", *looks], far).where("_own")
    tag = F.bit_or(P.bit(F.col("spread") > F.col("limit"), P.OWN).bitwiseOR(P.bit(F.col("spread") >= 0.25 * F.col("limit"), P.ROUGH))).bitwiseOR(F.lit(P.GIVEN))
    return met.groupBy(*keys, *CELL).agg(tag.alias("tag"), *[F.bit_or(s).alias(s) for s in P.SIDES])


def under(leaf: DataFrame, inner: DataFrame, keys: list[str], nx: int, ny: int) -> DataFrame:
    """(keys, cell, tl, tx, ty): the leaves t of the mesh ``inner`` at or under each of the leaves given."""
    new = M.leaves(inner, M.roots(leaf.select(*keys).distinct(), keys, nx, ny), keys)
    up = new.select(*keys, F.col("level").alias("tl"), F.col("ix").alias("tx"), F.col("iy").alias("ty"), F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    up = up.withColumns({"ix": F.expr("shiftright(tx, tl - level)"), "iy": F.expr("shiftright(ty, tl - level)")})
    return up.join(leaf.hint("merge"), [*keys, *CELL]).select(*keys, *CELL, "tl", "tx", "ty")


def with_end(to: DataFrame, end: DataFrame, keys: list[str]) -> DataFrame:
    """to(keys, cell, tl, tx, ty) with el, the level of the leaf of the mesh ``end`` at or over t: as many of
    t's ancestors are internal there."""
    at = [*keys, *CELL, "tl", "tx", "ty"]
    up = to.select(*at, F.explode(F.sequence(F.lit(0), F.col("tl"))).alias("al")).withColumns({"ax": F.expr("shiftright(tx, tl - al)"), "ay": F.expr("shiftright(ty, tl - al)")})
    known = end.select(*keys, F.col("level").alias("al"), F.col("ix").alias("ax"), F.col("iy").alias("ay"), F.lit(1).alias("_i")).hint("merge")
    return up.join(known, [*keys, "al", "ax", "ay"], "left").groupBy(*at).agg(F.count("_i").cast("int").alias("el"))


def lowered(rows: DataFrame, to: DataFrame, keys: list[str], ps: list[str], n: int, max_level: int) -> DataFrame:
    """Patches ps of rows on the leaves t under their cells; the rows' cells go, other columns stay."""
    at = rows.join(to.hint("merge"), [*keys, *CELL]).withColumn("_d", F.col("tl") - F.col("level"))
    at = at.withColumns({f"_r{c}": F.col(f"t{c}") - F.expr(f"shiftleft(i{c}, _d)") for c in "xy"})
    at = descend(at, ps, n, max_level)
    return at.drop("_d", "_rx", "_ry", *CELL)


def raised(rows: DataFrame, by: list[str], ps: list[str], n: int) -> DataFrame:
    """(by, cell, px, py, ps): pixels of patches on leaves t (tl, tx, ty) as those of the cells of level el at or over
    them, by 2 x 2 block means level by level; what is missing counts as zeros."""
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("_q")).withColumn("_e", F.col("tl") - F.col("el"))
    part = lambda c, q: F.expr(f"shiftright((t{c} & (shiftleft(1, _e) - 1)) * {n} + {q}, _e)")
    at = at.select(*by, F.col("el").alias("level"), F.expr("shiftright(tx, _e)").alias("ix"), F.expr("shiftright(ty, _e)").alias("iy"), part("x", f"_q % {n}").alias("px"), part("y", f"cast(floor(_q / {n}) AS int)").alias("py"), *[(F.col(p)[F.col("_q")] * F.pow(F.lit(0.25), F.col("_e"))).alias(p) for p in ps])
    return at.groupBy(*by, *CELL, "px", "py").agg(*[F.sum(p).alias(p) for p in ps])


def flat_cells(seen: DataFrame, keys: list[str], layers: list[str], n: int) -> DataFrame:
    """(keys, cell, tag) of every cell over the leaves t of patches seen(layers, limit, tl, tx, ty, p): FLAT where the
    joint range of its four children, merged as far as they can be, stays under a quarter of each layer's limit."""
    up = seen.where("tl > 0").withColumn("el", F.explode(F.sequence(F.lit(1), F.col("tl"))))
    child = raised(up, [*layers, "limit"], ["p"], n)
    over = child.groupBy(*layers, (F.col("level") - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).agg((F.max("p") - F.min("p") - 0.25 * F.max("limit")).alias("_over"))
    return over.groupBy(*keys, *CELL).agg(F.lit(P.GIVEN).bitwiseOR(P.bit(F.max("_over") < 0, P.FLAT)).alias("tag"))


def decide(rows: DataFrame, seen: DataFrame, keys: list[str], layers: list[str], n: int, nx: int, ny: int, max_level: int, tol: float, nearby: int, max_passes: int, coarsen: bool) -> DataFrame | None:
    """Where patches go: (keys, cell, tl, tx, ty, el), for each cell of rows(keys, cell) the leaves t it is refined to
    and the level of the cell these are merged to; None, if no mesh changes. seen(layers, cell, p) decides."""
    leaf = cut(rows.select(*keys, *CELL).distinct())
    cells = cut(asked(seen, keys, layers, n, max_level, tol), False)
    start = cut(M.internals(leaf, keys), False)
    fine, marked = P.refine(cells, start, keys, nx, ny, max_level, max_passes), None
    if nearby > 0:
        old = fine
        fine, marked = P.protect(cells, fine, keys, nx, ny, max_level, nearby)
        if fine is not old and old is not start:
            uncut(old)
    same = leaf.select("*", F.col("level").alias("tl"), F.col("ix").alias("tx"), F.col("iy").alias("ty"))
    to = same if fine is start else cut(under(leaf, fine, keys, nx, ny))
    end, flat = fine, None
    if coarsen:
        frame = Window.partitionBy(*layers)
        limited = seen.repartition(*keys).withColumn("limit", F.abs(F.max(F.array_max("p")).over(frame) - F.min(F.array_min("p")).over(frame)) * tol).where("limit is not null")
        on = limited.withColumnsRenamed({"level": "tl", "ix": "tx", "iy": "ty"}) if fine is start else lowered(limited, to, keys, ["p"], n, max_level).repartition(*keys)
        flat = cut(flat_cells(on, keys, layers, n), False)
        end = P.coarsen(cells, flat, fine, marked, keys, max_level, max_passes)
    out = None
    if end is not start:
        out = cut(to.withColumn("el", F.col("tl")) if end is fine else with_end(to, end, keys))
    for old in {id(df): df for df in (leaf, cells, start, fine, marked, to, flat, end) if df is not None}.values():
        uncut(old)
    return out


def moved(rows: DataFrame, to: DataFrame, keys: list[str], more: list[str], ps: list[str], n: int, max_level: int) -> DataFrame:
    """Patches ps of rows(keys, more, cell) where decide() wants them."""
    by = [*keys, *more]
    stay = lowered(rows, to.where("el = tl"), keys, ps, n, max_level).withColumnsRenamed({"tl": "level", "tx": "ix", "ty": "iy"})
    means = raised(lowered(rows, to.where("el < tl"), keys, ps, n, max_level).repartition(*keys), by, ps, n)
    return stay.select(*by, *CELL, *ps).unionByName(patches(means, by, n, {p: F.col(p) for p in ps}))


def regrid(
    values: DataFrame, keys: list[str], n: int, tile: int, nx: int, ny: int, max_level: int, tol: float, nearby: int = 0, max_passes: int = 99,
    more: list[str] | None = None, watch: Column | None = None, coarsen: bool = True,
) -> DataFrame:
    """Refine where the error exceeds tol times the value range, protect, then coarsen where it is flat.

    ``more`` names the columns (frames, channels) whose layers share a tree's mesh and move with it;
    ``watch`` says which of them decide, all if None. Each layer has its own range and tolerance; one
    that asks for a split, or against a merge, is enough. A pixel that a patch lacks is null, and as zero in those made from it.

    Phases are set operations: a pass refines all leaves over the tolerance at once and balances;
    with nearby > 0 leaves of a quarter of the tolerance and their neighbours are protected and step
    up; complete unprotected siblings of a joint range under a quarter of the tolerance are merged,
    pass by pass. Passes go on until one changes nothing; each refines or merges some leaf, so they
    end, and a warning says so where max_passes ends them before. Passes go over bits of cells (``asked``,
    ``flat_cells``); values move once, to the refined leaves and on to the merged ones, after the last.
    """
    more = more or []
    layers = [*keys, *more]
    rows = cut(patches(values, layers, n, {"p": F.col("v")}), False)
    to = decide(rows, rows if watch is None else rows.where(watch), keys, layers, n, nx, ny, max_level, tol, nearby, max_passes, coarsen)
    if to is None:
        return pixels(rows, layers, "p", n).select(*values.columns)
    out = cut(pixels(moved(rows, to, keys, more, ["p"], n, max_level), layers, "p", n).select(*values.columns))
    uncut(rows)
    uncut(to)
    return out


def corner_neighbours(leaf: DataFrame, keys: list[str], nx: int, ny: int, max_level: int) -> DataFrame:
    """The leaf diagonally across each corner: (keys, cell, corner, nlevel, nx, ny)."""
    s = F.expr(f"shiftleft(1, {max_level} - level)")
    corners = F.array(*[F.struct(F.lit(name).alias("corner"), x.alias("x"), y.alias("y")) for name, x, y in (("SW", F.col("ix") * s - 1, F.col("iy") * s - 1), ("SE", (F.col("ix") + 1) * s, F.col("iy") * s - 1), ("NW", F.col("ix") * s - 1, (F.col("iy") + 1) * s), ("NE", (F.col("ix") + 1) * s, (F.col("iy") + 1) * s))])
    points = leaf.select(*keys, F.struct(*CELL).alias("cell"), F.explode(corners).alias("c")).select(*keys, "cell", "c.*")
    points = points.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < nx << max_level) & (F.col("y") < ny << max_level))
    met = M.covering(points, leaf, keys, 1 << max_level, max_level)
    return met.select(*keys, *[F.col(f"cell.{c}").alias(f"_{c}") for c in CELL], "corner", F.col("level").alias("nlevel"), F.col("ix").alias("nx"), F.col("iy").alias("ny")).withColumnsRenamed({f"_{c}": c for c in CELL})


def copy_values(source: DataFrame, target: DataFrame, keys: list[str], tile: int, max_level: int, fill: float = 0.0) -> DataFrame:
    """target's leaves with the value v of source's leaf that holds their centre; fill where there is none."""
    side = F.expr(f"shiftright({tile}, level)")
    points = target.select(*keys, F.struct(*CELL).alias("cell"), F.floor((F.col("ix") + 0.5) * side).cast("int").alias("x"), F.floor((F.col("iy") + 0.5) * side).cast("int").alias("y"))
    held = M.covering(points, source, keys, tile, max_level).join(source.select(*keys, *CELL, "v"), [*keys, *CELL])
    held = held.select(*keys, *[F.col(f"cell.{c}").alias(f"_{c}") for c in CELL], "v").withColumnsRenamed({f"_{c}": c for c in CELL})
    return target.select(*keys, *CELL).join(held, [*keys, *CELL], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def replay(plan: DataFrame, payload: DataFrame, n: int, generations: int) -> DataFrame:
    """Values of a lineage plan's slots: plan(slot, generation, kind, parent, children, quadrant), payload(slot, px, py, v).

    A generation refines its parent's quadrant bilinearly or takes block means of four children, both
    joined from the generations before.
    """
    done = payload
    for g in range(1, generations + 1):
        now = plan.where(F.col("generation") == g)
        cells = now.where("kind = 'refine'").select("slot", F.col("parent").alias("_p"), "quadrant")
        split = M.refine_bilinear(done.join(cells.select(F.col("_p").alias("slot")).distinct(), "slot", "left_semi").select(F.col("slot").alias("_p"), F.lit(0).alias("level"), F.lit(0).alias("ix"), F.lit(0).alias("iy"), "px", "py", "v"), ["_p"], n)
        split = split.withColumn("quadrant", F.col("ix") + 2 * F.col("iy"))
        refined = cells.join(split, ["_p", "quadrant"]).select("slot", "px", "py", "v")
        four = now.where("kind = 'coarsen'").select(F.col("slot").alias("_s"), F.posexplode("children").alias("q", "slot")).join(done, "slot")
        merged = M.coarsen_mean(four.select("_s", F.lit(1).alias("level"), (F.col("q") % 2).alias("ix"), F.floor(F.col("q") / 2).cast("int").alias("iy"), "px", "py", "v"), ["_s"], n).select(F.col("_s").alias("slot"), "px", "py", "v")
        done = reduce(DataFrame.unionByName, [done, refined, merged])
    return done


def tree_equal(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 1e-8) -> bool:
    """The same cells, and values within tol."""
    on = [*keys, *CELL, "px", "py"]
    if not (a.select(*on).exceptAll(b.select(*on)).isEmpty() and b.select(*on).exceptAll(a.select(*on)).isEmpty()):
        return False
    far: Column = F.abs(F.col("v") - F.col("_v")) > tol
    return a.join(b.withColumnRenamed("v", "_v"), on).where(far).isEmpty()


def remap(values: DataFrame, target: DataFrame, keys: list[str], n: int, tile: int, max_level: int, how: str = "uniform") -> DataFrame:
    """Patches of a mesh on the leaves of another: through the finest grid and block means (uniform), or
    the values of the leaf that holds each target leaf's centre (center_copy)."""
    if how == "uniform":
        return M.leaf_means(M.paint(values, keys, tile, n), target, keys, tile, max_level, n)
    if how != "center_copy":
        raise ValueError(f"unknown way {how}")
    side = F.expr(f"shiftright({tile}, level)")
    centre = lambda i: F.floor((F.col(i) + 0.5) * side).cast("int")
    points = target.select(*keys, F.struct(*CELL).alias("cell"), centre("ix").alias("x"), centre("iy").alias("y"))
    held = M.covering(points, values.select(*keys, *CELL).distinct(), keys, tile, max_level).join(values, [*keys, *CELL])
    return held.select(*keys, *[F.col(f"cell.{c}").alias(f"to_{c}") for c in CELL], "px", "py", "v").withColumnsRenamed({f"to_{c}": c for c in CELL})


def build_topology(field: DataFrame, keys: list[str], tile: int, nx: int, ny: int, max_level: int, tol: float, nearby: int = 0) -> DataFrame:
    """The refine-only diff of each reference frame's mesh against bare roots: adapt, then expand around
    refined leaves where nearby > 0; keys name the frame."""
    base = M.roots(field.select(*keys).distinct(), keys, nx, ny)
    inner = M.adapt(field, keys, tile, max_level, tol)
    if nearby > 0:
        inner = M.expand_fine(inner, base, keys, nx, ny, max_level, nearby)
    return M.diff(base, M.leaves(inner, base, keys), keys)


def fill(topology: DataFrame, frames: DataFrame, base: DataFrame, keys: list[str], n: int, tile: int, max_level: int) -> DataFrame:
    """Patches of frames (keys, t, channel, x, y, v) on the leaves of the topology of their keys: one mesh
    serves all frames of a window."""
    leaf = M.refine_only(topology, base, keys)
    return M.leaf_means(frames, leaf, keys, tile, max_level, n, more=["t", "channel"])


def support(leaf: DataFrame, keys: list[str], width: float, height: float, nx: int, ny: int) -> DataFrame:
    """Physical width and height of each leaf in a domain of nx by ny roots."""
    n = F.pow(F.lit(2.0), F.col("level"))
    return leaf.select(*keys, *CELL, (width / nx / n).alias("support_x"), (height / ny / n).alias("support_y"))


def on_boundary(leaf: DataFrame, keys: list[str], nx: int, ny: int) -> DataFrame:
    """Leaves that touch the domain's edge."""
    n = F.pow(F.lit(2.0), F.col("level"))
    return leaf.where((F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") + 1 == n * nx) | (F.col("iy") + 1 == n * ny)).select(*keys, *CELL)
