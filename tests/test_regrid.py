"""Regridding against a plain Python version that keeps patches in a dict, and replay against plain arrays."""

import math

import numpy as np
import pytest

from meshlark.operators import mesh as M
from meshlark.operators import regrid as R
from meshlark.plans import registry

TILE, ROOTS, DEEPEST = 32, 2, 3
SIZE = TILE * ROOTS


class Plain:
    """One tree: leaf (level, ix, iy) -> 2 x 2 patch, rows by y."""

    def __init__(self, patches):
        self.p = patches

    def holder(self, x, y):
        return next(c for c in ((k, x // (TILE >> k), y // (TILE >> k)) for k in range(DEEPEST + 1)) if c in self.p)

    def sides(self, c):
        """Leaves across the faces of c."""
        s = TILE >> c[0]
        x0, y0 = c[1] * s, c[2] * s
        ring = [(x, y) for t in range(s) for x, y in ((x0 - 1, y0 + t), (x0 + s, y0 + t), (x0 + t, y0 - 1), (x0 + t, y0 + s))]
        return {self.holder(x, y) for x, y in ring if 0 <= x < SIZE and 0 <= y < SIZE}

    def sample(self, sx, sy):
        if not (0 <= sx <= SIZE and 0 <= sy <= SIZE):
            return 0.0
        c = self.holder(min(int(sx), SIZE - 1), min(int(sy), SIZE - 1))
        s = TILE >> c[0]
        out = 0.0
        u, w = (sx - c[1] * s) / s * 2 - 0.5, (sy - c[2] * s) / s * 2 - 0.5
        for i, a in ((math.floor(u), 1 - (u - math.floor(u))), (math.floor(u) + 1, u - math.floor(u))):
            for j, b in ((math.floor(w), 1 - (w - math.floor(w))), (math.floor(w) + 1, w - math.floor(w))):
                out += a * b * self.p[c][min(1, max(0, j)), min(1, max(0, i))]
        return out

    def error(self, c):
        s = TILE >> c[0]
        x, y = (c[1] + 0.5) * s, (c[2] + 0.5) * s
        mid = self.sample(x, y)
        return max(np.ptp(self.p[c]), *(abs(self.sample(x + a * s, y + b * s) - mid) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))

    def split(self, c):
        v, at = self.p.pop(c), np.linspace(0, 1, 4)
        fine = np.array([[(1 - b) * ((1 - a) * v[0, 0] + a * v[0, 1]) + b * ((1 - a) * v[1, 0] + a * v[1, 1]) for a in at] for b in at])
        for q in range(4):
            self.p[c[0] + 1, 2 * c[1] + q % 2, 2 * c[2] + q // 2] = fine[2 * (q // 2) :, 2 * (q % 2) :][:2, :2].copy()

    def refine(self, chosen):
        """Split the chosen leaves, then one at a time those with a neighbour of two levels more."""
        for c in chosen:
            self.split(c)
        while (c := next((c for c in sorted(self.p) if any(o[0] > c[0] + 1 for o in self.sides(c))), None)) is not None:
            self.split(c)

    def regrid(self, tol, nearby):
        every = np.concatenate([v.ravel() for v in self.p.values()])
        limit = tol * np.ptp(every)
        while chosen := [c for c in self.p if c[0] < DEEPEST and self.error(c) > limit]:
            self.refine(chosen)
        marked = set()
        if nearby:
            marked = {c for c in self.p if np.ptp(self.p[c]) >= 0.25 * limit}
            for _ in range(nearby):
                marked |= {o for c in marked for o in self.sides(c)}
            for _ in range(nearby):
                chosen = {o for c in marked for o in self.sides(c) if o[0] < c[0] and o in marked}
                if not chosen:
                    break
                self.refine(chosen)
                over = lambda c: {(k, c[1] >> (c[0] - k), c[2] >> (c[0] - k)) for k in range(c[0] + 1)}
                marked = {c for c in self.p if over(c) & marked}
        while True:
            merged = {}
            for c in self.p:
                up = (c[0] - 1, c[1] // 2, c[2] // 2)
                four = [(c[0], 2 * up[1] + q % 2, 2 * up[2] + q // 2) for q in range(4)]
                if c[0] and all(f in self.p and f not in marked and all(o[0] <= f[0] for o in self.sides(f)) for f in four):
                    if np.ptp([self.p[f] for f in four]) < 0.25 * limit:
                        merged[up] = four
            if not merged:
                return
            means = {up: np.array([self.p[f].mean() for f in four]).reshape(2, 2) for up, four in merged.items()}
            for four in merged.values():
                for f in four:
                    del self.p[f]
            self.p.update(means)


def patches(rows):
    out = {}
    for r in rows:
        out.setdefault(r.tree, {}).setdefault((r.level, r.ix, r.iy), np.zeros((2, 2)))[r.py, r.px] = r.v
    return out


@pytest.mark.parametrize(("tol", "nearby"), [(0.2, 1), (0.05, 0), (0.6, 2)])
def test_regrid_equals_the_plain_version(spark, tol, nearby):
    values = registry.patched(spark, "/root/testdata/sf0.01")[1].where("tree < 4")
    got = patches(R.regrid(values, ["tree"], 2, TILE, ROOTS, ROOTS, DEEPEST, tol, nearby=nearby).collect())
    start = patches(values.collect())
    assert len(start) > 1
    changed = 0
    for tree, own in start.items():
        plain = Plain(dict(own))
        plain.regrid(tol, nearby)
        assert got[tree].keys() == plain.p.keys()
        assert all(np.allclose(got[tree][c], plain.p[c], atol=1e-9) for c in plain.p)
        changed += plain.p.keys() != own.keys()
    assert changed or tol == 0.05


@pytest.mark.parametrize("tol", [0.3, 0.7])
def test_regrid_of_a_mesh_with_neighbours_three_levels_apart(spark, tol):
    rng = np.random.default_rng(5)
    inner = {(0, 0, 0), (1, 1, 1), (2, 3, 3)}
    cells = {(0, x, y) for x in (0, 1) for y in (0, 1)}
    for k, x, y in sorted(inner):
        cells = cells - {(k, x, y)} | {(k + 1, 2 * x + q % 2, 2 * y + q // 2) for q in range(4)}
    start = {c: rng.random((2, 2)) for c in cells}
    rows = [(7, *c, px, py, float(v[py, px])) for c, v in start.items() for py in (0, 1) for px in (0, 1)]
    values = spark.createDataFrame(rows, "tree int, level int, ix int, iy int, px int, py int, v double")
    got = patches(R.regrid(values, ["tree"], 2, TILE, ROOTS, ROOTS, DEEPEST, tol, nearby=1).collect())[7]
    plain = Plain(dict(start))
    plain.regrid(tol, 1)
    assert got.keys() == plain.p.keys() and got.keys() != start.keys()
    assert all(np.allclose(got[c], plain.p[c], atol=1e-9) for c in plain.p)


def test_regrid_covers_and_balances(spark):
    values = registry.patched(spark, "/root/testdata/sf0.01")[1].where("tree < 3")
    leaf = R.regrid(values, ["tree"], 2, TILE, ROOTS, ROOTS, DEEPEST, 0.2, nearby=1).select("tree", *M.CELL).distinct()
    assert M.uncovered(leaf, ["tree"], ROOTS, ROOTS, DEEPEST).isEmpty()
    assert M.neighbours(leaf, ["tree"], DEEPEST).where("abs(level - nlevel) > 1").isEmpty()


def test_flat_mesh_merges_to_its_tiles(spark):
    values = registry.patched(spark, "/root/testdata/sf0.01")[1].where("tree < 3").selectExpr("tree", "level", "ix", "iy", "px", "py", "case when level = 0 then 1.0d else 1.0d + 1e-9d * px end as v")
    out = R.regrid(values, ["tree"], 2, TILE, ROOTS, ROOTS, DEEPEST, 1e6)
    assert {(r.level, r.ix, r.iy) for r in out.collect()} == {(0, x, y) for x in range(ROOTS) for y in range(ROOTS)}


def test_tree_equal(spark):
    values = registry.patched(spark, "/root/testdata/sf0.01")[1].where("tree = 1")
    assert R.tree_equal(values, values.orderBy("v"), ["tree"])
    assert R.tree_equal(values, values.withColumn("v", values.v + 1e-10), ["tree"])
    assert not R.tree_equal(values, values.withColumn("v", values.v + 1e-3), ["tree"])
    assert not R.tree_equal(values, values.where("level > 0 or ix > 0 or iy > 0 or px > 0").where("not (level = 3 and px = 0)"), ["tree"])


def test_replay_refines_and_merges(spark):
    rng = np.random.default_rng(3)
    patch = rng.random((2, 2))
    payload = spark.createDataFrame([(0, x, y, float(patch[y, x])) for y in range(2) for x in range(2)], "slot int, px int, py int, v double")
    plan = spark.createDataFrame([(1 + q, 1, "refine", 0, None, q) for q in range(4)] + [(5, 2, "coarsen", None, [1, 2, 3, 4], None)], "slot int, generation int, kind string, parent int, children array<int>, quadrant int")
    got = {(r.slot, r.px, r.py): r.v for r in R.replay(plan, payload, 2, 2).collect()}
    at = np.linspace(0, 1, 4)
    fine = np.array([[patch[0, 0] * (1 - a) * (1 - b) + patch[0, 1] * (1 - a) * b + patch[1, 0] * a * (1 - b) + patch[1, 1] * a * b for b in at] for a in at])
    for q in range(4):
        for x in range(2):
            for y in range(2):
                assert abs(got[1 + q, x, y] - fine[2 * (q // 2) + y, 2 * (q % 2) + x]) < 1e-12
    for x in range(2):
        for y in range(2):
            assert abs(got[5, x, y] - fine[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean()) < 1e-12
