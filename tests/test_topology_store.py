"""Digests, signatures and older layouts of stored topologies."""

import pytest
from pyspark.sql import functions as F

from meshlark.operators import mesh as M
from meshlark.sources import topology_store as S

ROWS = [(k, i, i % 3, i // 3, 2, 5 * i + k, 7 * i, 1 + i % 2) for k in (1, 2, 3) for i in range(40 if k < 3 else 0 + 7)]
SCHEMA = "key long, id int, tile_x int, tile_y int, level int, ix int, iy int, op int"


def test_digests_do_not_depend_on_order_or_partitions(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    a = S.column_digests(rows.repartition(1), ["key"], ["id"]).collect()
    b = S.column_digests(rows.orderBy(F.rand(1)).repartition(7), ["key"], ["id"]).collect()
    assert sorted(a) == sorted(b) and len(a) == 3 * 6 and {r.n for r in a} == {40, 7}


def test_digests_see_values_places_types_and_nulls(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    base = {(r.key, r.column): r.digest for r in S.column_digests(rows, ["key"], ["id"]).collect()}
    same = {(r.key, r.column): r.digest for r in S.column_digests(rows.where("key < 3 or id < 100"), ["key"], ["id"]).collect()}
    assert base == same and base[1, "ix"] != base[2, "ix"] and base[1, "iy"] == base[2, "iy"]
    for change, hit in (
        (rows.withColumn("op", F.when(F.expr("key = 1 and id = 3"), 9).otherwise(F.col("op"))), "op"),
        (rows.withColumn("op", F.when(F.expr("key = 1 and id = 3"), F.lit(None)).otherwise(F.col("op"))), "op"),
        (rows.withColumn("iy", F.expr("case when key = 1 and id = 3 then 28 when key = 1 and id = 4 then 21 else iy end")), "iy"),  # two values change places
        (rows.withColumn("level", F.col("level").cast("long")), "level"),
    ):
        now = {(r.key, r.column): r.digest for r in S.column_digests(change, ["key"], ["id"]).collect()}
        assert {c for (k, c), d in now.items() if k == 1 and base[k, c] != d} == {hit}
    more = {(r.key, r.column): r.digest for r in S.column_digests(rows.unionByName(rows.where("key = 1 and id = 0")), ["key"], ["id"]).collect()}
    assert all(more[1, c] != base[1, c] for _, c in base) and more[2, "ix"] == base[2, "ix"]


def test_new_keys_conflicts_and_repeats(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    store = rows.where("key < 3").withColumn("op", F.when(F.expr("key = 2 and id = 0"), 7).otherwise(F.col("op")))
    new, conflicts = S.new_and_conflicting(rows, store, ["key"], ["id"])
    assert {r.key for r in new.collect()} == {3} and new.count() == 7
    assert [r.key for r in conflicts.collect()] == [2]


def test_signature_follows_parameters_and_source():
    a = S.build_signature({"tol": 0.2, "nearby": 1}, M.adapt)
    assert a == S.build_signature({"nearby": 1, "tol": 0.2}, M.adapt)
    assert len({a, S.build_signature({"tol": 0.3, "nearby": 1}, M.adapt), S.build_signature({"tol": 0.2, "nearby": 1}, M.balance)}) == 3


@pytest.mark.parametrize("layout", ["flat", "nested", "struct"])
def test_layouts_round_trip(spark, layout, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("key", F.concat(F.lit("frame"), "key"))
    old = S.encoded(rows).withColumn("input_paths", F.concat(F.array(F.lit("before")), "input_paths"))
    if layout == "nested":
        old = old.withColumn("topo_tuples", F.transform(F.sequence(F.lit(0), F.size("topo_ids") - 1), lambda i: F.slice("topo_tuples", i * 5 + 1, 5)))
    if layout == "struct":
        for n in S.VECTORS:
            old = old.withColumn(n, F.struct(F.col(n).alias("data"), F.array(F.size(n)).alias("shape")))
    old.write.parquet(f"file://{tmp_path}/old")
    back = S.decoded(spark.read.parquet(f"file://{tmp_path}/old")).select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_faulty_tables_are_refused(spark):
    kind = "input_paths array<string>, topo_ids array<int>, topo_tuples array<int>, topo_ops array<int>"
    read = lambda *r: S.decoded(spark.createDataFrame([r], kind)).collect()
    assert read(["f"], [], [], []) == [] and len(read(["f"], [1], [0, 0, 1, 2, 3], [1])) == 1
    for bad, says in (
        ((["f"], [1, 2], [0, 0, 1, 2, 3], [1]), "different lengths"),
        ((["f"], [1], [0, 0, 1, 2], [1]), "different lengths"),
        ((["f"], [1], [0, 0, None, 2, 3], [1]), "null"),
        ((["f"], None, [0, 0, 1, 2, 3], [1]), "null"),
    ):
        with pytest.raises(Exception, match=says):
            read(*bad)
    with pytest.raises(ValueError, match="pickled"):
        S.decoded(spark.createDataFrame([(b"x", [1], [1], [1])], "input_paths binary, topo_ids array<int>, topo_tuples array<int>, topo_ops array<int>"))
    with pytest.raises(TypeError, match="neither"):
        S.decoded(spark.createDataFrame([(["f"], "1", [1], [1])], "input_paths array<string>, topo_ids string, topo_tuples array<int>, topo_ops array<int>"))


def test_z_order_and_uids_beyond_their_bits(spark):
    cells = spark.createDataFrame([(0, 1, 0), (0, 65_537, 0), (0, 0, 1), (0, (1 << 28) - 1, (1 << 28) - 1), (3, 5, 6)], "level int, ix int, iy int")
    got = {(r.level, r.ix, r.iy): r.m for r in cells.select("*", M.morton("level", "ix", "iy", 3).alias("m")).collect()}

    def plain(level, ix, iy):
        x, y = ix << (3 - level), iy << (3 - level)
        return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(32))

    assert got == {c: plain(*c) for c in got} and len(set(got.values())) == 5
    with pytest.raises(Exception, match="31 bits"):
        spark.createDataFrame([(0, 1 << 29, 0)], "level int, ix int, iy int").select(M.morton("level", "ix", "iy", 3)).collect()
    fine = spark.createDataFrame([(0, 4095, 0), (0, 0, 1)], "level int, ix int, iy int").select(M.uid("level", "ix", "iy", 3).alias("u")).collect()
    assert len({r.u for r in fine}) == 2
    with pytest.raises(Exception, match="no uid"):
        spark.createDataFrame([(0, 4096, 0)], "level int, ix int, iy int").select(M.uid("level", "ix", "iy", 3)).collect()
