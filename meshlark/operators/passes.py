"""Passes over many meshes at once, decided from a few bits a cell.

What a pass asks of values is the same in every pass: whether a cell's range, or the difference between
its centre and a point beside it, is over the limit. So it is asked once, of every cell that can become a
leaf (``cells``: keys, cell, tag and a mask for each side), and passes go over internal cells and these
bits only. A cell tells others what it is by rows that name them; one exchange by ``keys`` brings a mesh
together and all sums of a pass follow without another, as they are by keys and cell.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators import mesh as M
from meshlark.operators.lineage import cut, uncut

CELL = M.CELL
#: Bits of a tag: known cell, internal, child of an internal one, range over the limit, over a quarter of it,
#: protected, beside a finer leaf, children flat together, leaf; from QUADRANT on, four for children that may go.
GIVEN, INNER, NODE, OWN, ROUGH, MARKED, FINE, FLAT, LEAF, QUADRANT = (1 << k for k in range(10))
#: Bits of a side's mask: k, where the leaf there is k levels coarser; a finer leaf; none.
FINER, NONE = 1 << 29, 1 << 30
SIDES = {"w": (-1, 0), "e": (1, 0), "s": (0, -1), "n": (0, 1)}
FACING = {"w": "e", "e": "w", "s": "n", "n": "s"}


def has(bit: int, of: str = "tag") -> Column:
    return F.col(of).bitwiseAND(F.lit(bit)) != 0


def bit(on: Column, value: int) -> Column:
    return F.when(on, F.lit(value)).otherwise(F.lit(0))


def listed(rows: list[str]) -> str:
    return f"({', '.join(rows)})"


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cell, with the bits of all its rows."""
    return rows.groupBy(*keys, *CELL).agg(*[F.bit_or(c).alias(c) for c in rows.columns if c not in (*keys, *CELL)])


def nodes(parts: list[tuple[DataFrame, int | None]], inner: DataFrame, keys: list[str], more: list[str] | None = None) -> DataFrame:
    """Internal cells and leaves with their bits, a mesh in one partition. Parts are tables with a tag of
    their own (None) or cells with one bit; ``more`` are further masks of the tagged ones."""
    more = more or []
    zero = [F.lit(0).alias(c) for c in more]
    rows = [df.select(*keys, *CELL, "tag", *[c if c in df.columns else F.lit(0).alias(c) for c in more]) if tag is None else df.select(*keys, *CELL, F.lit(tag).alias("tag"), *zero) for df, tag in parts]
    family = [M.inlined("level", "ix", "iy", f"{INNER}")] + [M.inlined("level + 1", f"2 * ix + {q % 2}", f"2 * iy + {q // 2}", f"{NODE}") for q in range(4)]
    rows.append(inner.select(*keys, F.expr(f"inline(array{listed(family)})").alias(*CELL, "tag"), *zero))
    at = together(reduce(DataFrame.unionByName, rows).repartition(*keys), keys)
    leaf = has(GIVEN) & ~has(INNER) & (has(NODE) | (F.col("level") == 0))
    return at.withColumn("tag", F.col("tag").bitwiseOR(bit(leaf, LEAF))).where(has(INNER | LEAF))


def told(at: DataFrame, keys: list[str], max_level: int, says: Column, first: int, last: int, tag: int = 0, masks: bool = False) -> DataFrame:
    """at, after the leaves for which ``says`` holds told the cells that touch their faces, ``first`` to
    ``last`` levels finer (negative: coarser). These get ``tag``; with ``masks`` also what they have on that
    side, in w_ to n_, and internal cells tell those of their own level."""
    quiet = "('', 0, 0, 0)"
    said = lambda js: "array({})".format(", ".join([quiet, *[f"('{side}', {dx}, {dy}, {j})" for side, (dx, dy) in SIDES.items() for j in js]]))
    own = F.col("to") == ""
    at = at.withColumn("_says", has(LEAF) & says)
    by_level = " ".join(f"WHEN _says AND level = {k} THEN {said([j for j in range(first, last + 1) if 0 <= k + j <= max_level])}" for k in range(max_level + 1))
    inner = f"WHEN tag & {INNER} != 0 THEN {said([0])}" if masks else ""
    rows = at.select("*", F.expr(f"inline(CASE {by_level} {inner} ELSE {said([])} END)").alias("to", "dx", "dy", "j"))
    at = at.drop("_says")
    rows = rows.withColumn("_k", F.explode(F.expr("sequence(0, shiftleft(1, greatest(j, 0)) - 1)")))
    place = lambda c, d: F.expr(f"CASE WHEN j < 0 THEN shiftright({c} + {d}, -j) WHEN {d} < 0 THEN shiftleft({c}, j) - 1 WHEN {d} > 0 THEN shiftleft({c} + 1, j) ELSE shiftleft({c}, j) + _k END")
    out = [*keys, (F.col("level") + F.col("j")).alias("level"), place("ix", "dx").alias("ix"), place("iy", "dy").alias("iy"), F.when(own, F.col("tag")).otherwise(F.lit(tag)).alias("tag")]
    out += [F.when(own, F.col(c)).otherwise(F.lit(0)).alias(c) for c in at.columns if c not in (*keys, *CELL, "tag")]
    if masks:
        there = F.when(has(INNER), F.lit(FINER)).otherwise(F.expr("shiftleft(1, j)"))
        out += [F.when(F.col("to") == FACING[s], there).otherwise(F.lit(0)).alias(f"{s}_") for s in SIDES]
    return together(rows.select(*out).where("ix >= 0 and iy >= 0"), keys)


def beside(at: DataFrame, by: list[str], values: list[str], far: Callable[[str], Column]) -> DataFrame:
    """at(by, cell, values), a row a cell, with a mask for each side, w to n: far(c), which names a struct of
    the values of the next cell of the same level there, null where there is none."""
    row = Window.partitionBy(*by, "level")
    for across, along, sides in (("iy", "ix", "we"), ("ix", "iy", "sn")):
        there = F.struct(across, along, *values)
        for side, step, go in zip(sides, (-1, 1), (F.lag, F.lead), strict=True):
            at = at.withColumn(f"_{side}", go(there).over(row.orderBy(across, along)))
            next_to = (F.col(f"_{side}.{across}") == F.col(across)) & (F.col(f"_{side}.{along}") == F.col(along) + step)
            at = at.withColumn(f"_{side}", F.when(next_to, F.col(f"_{side}")))
        at = at.withColumns({side: far(f"_{side}") for side in sides}).drop(*[f"_{side}" for side in sides])
    return at


def split(at: DataFrame, chosen: Column, keys: list[str], nx: int, ny: int, max_level: int) -> tuple[DataFrame, bool]:
    """The balanced internal cells with the chosen leaves among them, and whether there were any."""
    now = at.where(has(INNER) | (has(LEAF) & chosen)).select(*keys, *CELL, bit(has(LEAF), 1).alias("tag"))
    out = cut(M.balance(now, keys, nx, ny, max_level, flag="tag"), False)
    return kept(out.select(*keys, *CELL), out), not out.where("tag = 1").isEmpty()


def refine(cells: DataFrame, inner: DataFrame, keys: list[str], nx: int, ny: int, max_level: int, max_passes: int) -> DataFrame:
    """inner after passes that each split every leaf over the limit and balance, until one splits none. Here and
    below the tables given stay; those of passes in between go."""
    given = inner
    for _ in range(max_passes):
        at = told(nodes([(cells, None)], inner, keys, list(SIDES)), keys, max_level, F.lit(True), 0, max_level, masks=True)
        there = lambda s: F.when(F.col(f"{s}_") == 0, F.lit(NONE)).otherwise(F.col(f"{s}_"))
        over = reduce(lambda a, b: a | b, [F.col(s).bitwiseAND(there(s)) != 0 for s in SIDES], has(OWN))
        out, some = split(at, over & (F.col("level") < max_level), keys, nx, ny, max_level)
        if not some:
            uncut(out)
            return inner
        if inner is not given:
            uncut(inner)
        inner = out
    warnings.warn(f"refinement did not end in {max_passes} passes", stacklevel=3)
    return inner


def protect(cells: DataFrame, inner: DataFrame, keys: list[str], nx: int, ny: int, max_level: int, nearby: int) -> tuple[DataFrame, DataFrame]:
    """Rough leaves and their neighbours, ``nearby`` times, are marked; then marked leaves with a finer marked
    neighbour split, as often, and their children are marked: (inner, marked)."""
    given = inner
    at = nodes([(cells, None)], inner, keys)
    at = at.withColumn("tag", F.col("tag").bitwiseOR(bit(has(LEAF) & has(ROUGH), MARKED)))
    for _ in range(nearby):
        at = told(at, keys, max_level, has(MARKED), -max_level, max_level, MARKED)
    marked = cut(at.where(has(LEAF) & has(MARKED)).select(*keys, *CELL), False)
    for _ in range(nearby):
        at = told(nodes([(cells, None), (marked, MARKED)], inner, keys), keys, max_level, has(MARKED), -max_level, -1, FINE)
        out, some = split(at, has(MARKED) & has(FINE), keys, nx, ny, max_level)
        if not some:
            uncut(out)
            break
        both = marked.withColumn("tag", F.lit(MARKED)).unionByName(out.withColumn("tag", F.lit(INNER)))
        gone = F.col("tag") == MARKED | INNER
        # what is under a marked cell that was split is marked, leaves among it
        under = together(both, keys).where(has(MARKED)).withColumn("_j", F.explode(F.when(gone, F.sequence(F.lit(1), F.greatest(F.lit(1), max_level - F.col("level")))).otherwise(F.array(F.lit(0)))))
        for c in ("ix", "iy"):
            under = under.withColumn(f"_{c}", F.explode(F.expr(f"sequence(shiftleft({c}, _j), shiftleft({c} + 1, _j) - 1)")))
        old, marked = marked, cut(under.select(*keys, (F.col("level") + F.col("_j")).alias("level"), F.col("_ix").alias("ix"), F.col("_iy").alias("iy")).distinct(), False)
        uncut(old)
        if inner is not given:
            uncut(inner)
        inner = out
    return inner, marked


def coarsen(cells: DataFrame, flat: DataFrame, inner: DataFrame, marked: DataFrame | None, keys: list[str], max_level: int, max_passes: int) -> DataFrame:
    """inner after passes that each merge the leaves under every flat cell with four of them, none marked or
    beside a finer one, until one merges none. ``flat`` has the tags of cells that may become leaves."""
    given = inner
    for _ in range(max_passes):
        at = nodes([(cells, None), (flat, None), *([(marked, MARKED)] if marked is not None else [])], inner, keys)
        at = told(at, keys, max_level, F.lit(True), -max_level, -1, FINE)
        free = has(LEAF) & ~has(MARKED) & ~has(FINE) & (F.col("level") > 0)
        up = F.struct((F.col("level") - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"), F.expr(f"shiftleft({QUADRANT}, (ix & 1) + 2 * (iy & 1))").alias("tag"))
        own = F.struct(*CELL, "tag")
        at = together(at.select(*keys, F.explode(F.when(free, F.array(own, up)).otherwise(F.array(own))).alias("_c")).select(*keys, "_c.*"), keys)
        four = 15 * QUADRANT
        goes = has(FLAT) & (F.col("tag").bitwiseAND(F.lit(four)) == four)
        out = cut(at.where(has(INNER)).select(*keys, *CELL, bit(goes, 1).alias("tag")), False)
        if out.where("tag = 1").isEmpty():
            uncut(out)
            return inner
        if inner is not given:
            uncut(inner)
        inner = kept(out.where("tag = 0").select(*keys, *CELL), out)
    warnings.warn(f"coarsening did not end in {max_passes} passes", stacklevel=3)
    return inner


def kept(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which reads a table of cut(): uncut() of df deletes that."""
    df._cut_at = table._cut_at
    return df
