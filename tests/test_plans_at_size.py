"""What keeps queries within a task or the driver on larger tables, read off their plans; results are compared elsewhere."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from meshlark.operators.metrics import masked_mse
from meshlark.operators.mesh import precedence
from meshlark.operators import lineage
from meshlark.operators import mesh as M
from meshlark.operators import passes, regrid, rollout
from meshlark.plans import registry
from meshlark.plans import views


def plans(spark, name):
    """The optimized and the physical plan as text, where nothing is small enough to broadcast unasked."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = registry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution()
        return run.optimizedPlan().toString(), run.executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_steps_are_distinct_before_they_meet(spark):
    logical, _ = plans(spark, "j17_common_steps")
    assert logical[logical.index("Join") :].count("Aggregate") == 2


def test_masked_error_needs_no_join_on_its_keys(spark):
    assert "LeftSemi" not in plans(spark, "a39_masked_mse")[0]


def test_keys_with_nothing_under_the_mask_have_no_row(spark):
    pairs = spark.createDataFrame([("a", True, 1.0, 3.0), ("a", False, 9.0, 0.0), ("b", False, 1.0, 1.0)], "k string, m boolean, prediction double, target double")
    assert [tuple(r) for r in masked_mse(pairs, ["k"], "m").collect()] == [("a", 4.0)]


@pytest.mark.parametrize("name", ["p4_standardize", "p5_destandardize"])
def test_statistics_go_to_the_values(spark, name):
    assert "SortMergeJoin" not in plans(spark, name)[1]


@pytest.mark.parametrize("name", ["j6_finest_patch_wins", "j7_patches_to_grid"])
def test_pixels_compete_in_a_hash_table(spark, name):
    assert "SortAggregate" not in plans(spark, name)[1]


def test_precedence_by_level_then_tie_with_nulls_last(spark):
    rows = [(0, 9, 1.0), (2, 2**63 - 1, 2.0), (2, -(2**63), 3.0), (None, 5, 4.0), (2, None, 5.0)]
    df = spark.createDataFrame(rows, "level int, patch_id long, v double")
    for last in (False, True):
        got = [r["v"] for r in df.orderBy(precedence(df, "patch_id", last).desc()).collect()]
        assert got == ([2.0, 3.0, 5.0, 1.0, 4.0] if last else [3.0, 2.0, 5.0, 1.0, 4.0])


def test_patches_compete_in_a_hash_table(spark):
    assert "SortAggregate" not in plans(spark, "s10_frames_on_last_input")[1]


def test_cells_compete_before_they_meet_the_grid(spark):
    logical, physical = plans(spark, "j7_regular_grid")
    assert "SortAggregate" not in physical
    assert "max_by" in logical[logical.index("Join") :]


def test_frames_are_filled_without_a_join(spark):
    df = views.fields(spark, f"{DATA}/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    sizes = df.groupBy("tree", "t", "channel").agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("cells"))
    assert {(r["n"], r["cells"]) for r in sizes.collect()} == {(4096, 4096)}


@pytest.mark.parametrize("tile", [8, 6])
def test_pixels_meet_their_leaf_once(spark, tile):
    leaf = spark.createDataFrame([(0, 1, x, y) for x in (0, 1) for y in (0, 1) if (x, y) != (1, 1)] + [(0, 2, x, y) for x in (2, 3) for y in (2, 3)], "tree int, level int, ix int, iy int")
    pixels = spark.range(tile * tile).selectExpr("0 AS tree", f"cast(id % {tile} AS int) AS x", f"cast(id div {tile} AS int) AS y")
    got = {(r["x"], r["y"]): (r["level"], r["ix"], r["iy"]) for r in M.covering(pixels.where("x < 4 and y < 4"), leaf, ["tree"], tile, 2).collect()}
    side = [tile, tile >> 1, tile >> 2]
    want = {}
    for x in range(4):
        for y in range(4):
            for k, i, j in [tuple(r)[1:] for r in leaf.collect()]:
                if (x // side[k], y // side[k]) == (i, j):
                    want[x, y] = (k, i, j)
    assert got == want
    if tile == 8:
        plan = M.covering(pixels, leaf, ["tree"], tile, 2)._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0, 2" not in plan


def test_large_cut_tables_are_not_broadcast(spark):
    rows = spark.range(lineage.SMALL + 1).selectExpr("id", "0 AS v")
    small = lineage.cut(rows.limit(10))
    large = lineage.cut(rows)
    other = spark.range(10)
    assert "BroadcastHashJoin" not in other.join(large, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in rows.join(small, "id")._jdf.queryExecution().executedPlan().toString()


def scans(df, name: str) -> int:
    """How often the optimized plan reads the rows called so."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_balance_reads_its_cells_once(spark):
    cells = spark.range(8).selectExpr("0 AS tree", "3 AS level", "cast(id AS int) AS ix", "0 AS iy")
    assert scans(M.balance(cells, ["tree"], 1, 1, 4), "Range (") == 1


@pytest.fixture
def written(monkeypatch):
    """Names of the modules that write a table, in order."""
    out = []

    def counted(module):
        def cut(*args):
            out.append(module.__name__.rsplit(".", 1)[1])
            return lineage.cut(*args)

        monkeypatch.setattr(module, "cut", cut)

    for module in (passes, regrid, rollout):
        counted(module)
    return out


def patch_rows(spark, cells, frames=2, v="px + 2 * py + 10 * t"):
    at = spark.createDataFrame(cells, "level int, ix int, iy int").selectExpr("0 AS tree", "*", f"explode(sequence(0, {frames - 1})) AS t", "'c' AS channel")
    return at.selectExpr("*", "explode(array(0, 1)) AS px").selectExpr("*", "explode(array(0, 1)) AS py").selectExpr("*", f"cast({v} AS double) AS v")


def test_steps_without_a_regrid_write_no_table(spark, written):
    out = rollout.rollout(patch_rows(spark, [(0, 0, 0)]), ["tree"], 2, 20, rollout.linear(), n=2, nx=1, ny=1)
    got = {(r["step"], r["px"], r["py"]): r["v"] for r in out.collect()}
    assert got == {(k, x, y): x + 2 * y + 10 * (k + 2) for k in range(20) for x in (0, 1) for y in (0, 1)}
    assert written == ["rollout"]


def test_values_are_written_once_a_regrid(spark, written):
    start = patch_rows(spark, [(0, 0, 0), (0, 1, 0)], 1, "ix * (px + 2 * py)").drop("t", "channel")
    out = regrid.regrid(start, ["tree"], 2, 8, 2, 1, 3, 0.3)
    assert out.select("level", "ix", "iy").distinct().count() > 2
    assert written.count("regrid") <= 8  # patches, leaves, cells, start, where to, flat cells, its end, result: however many passes


def test_pixels_are_added_up_before_they_meet_leaves(spark):
    df = registry.queries()["t20_native_regrid"](spark, f"{DATA}/sf0.001")
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in logical[logical.index("Join") :] and "_fx" in logical
