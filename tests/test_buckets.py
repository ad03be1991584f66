"""Batches by level: a round trip, the inverse permutation against plain arrays, and faults."""

import numpy as np
import pytest

from meshlark.operators import buckets as K

LEAVES = [(1, 0, 0), (2, 2, 0), (2, 3, 0), (2, 2, 1), (2, 3, 1), (1, 0, 1), (1, 1, 1)]


@pytest.fixture(scope="module")
def mapped(spark):
    rows = [(t, *c) for t in (1, 2) for c in LEAVES] + [(3, 0, 0, 0)]
    return K.inverse(K.mapping(spark.createDataFrame(rows, "tree int, level int, ix int, iy int"), ["tree"], 3), ["tree"], 3)


def test_inverse_permutation(mapped):
    for tree, n in ((1, 7), (3, 1)):
        rows = [r for r in mapped.collect() if r.tree == tree]
        order = sorted(rows, key=lambda r: (r.level, r.position))
        assert [r.slot for r in order] == list(range(n))
        inverse = np.argsort([r.slot for r in sorted(rows, key=lambda r: r.leaf)])
        assert [r.leaf for r in order] == inverse.tolist()
    first = sorted((r for r in mapped.collect() if r.tree == 2), key=lambda r: r.leaf)
    assert [(r.level, r.ix, r.iy) for r in first] == LEAVES


def test_round_trip(spark, mapped):
    values = spark.createDataFrame([(t, i, k, float(10 * i + k)) for t in (1, 2) for i in range(7) for k in range(3)], "tree int, leaf long, t int, v double")
    back = K.to_leaves(K.to_buckets(values, mapped, ["tree"]), mapped, ["tree"]).select(*values.columns)
    assert sorted(back.collect()) == sorted(values.collect())


def test_mapping_faults(spark, mapped):
    assert K.mapping_faults(mapped, ["tree"], 3).count() == 0
    rows = [(1, 0, 0, 0), (1, 0, 1, 0), (1, 0, 3, 2), (1, 1, 3, 0), (2, None, 0, 0), (2, 9, 0, 0), (2, 0, -1, 0), (3, 0, 0, 0)]
    got = K.mapping_faults(spark.createDataFrame(rows, "tree int, level int, leaf long, position long"), ["tree"], 3)
    assert {tuple(r) for r in got.collect()} == {(1, "shared leaf", 1), (1, "missing leaf", 1), (1, "shared slot", 1), (1, "missing slot", 1), (2, "invalid", 3)}
    assert K.mapping_faults(mapped.limit(0), ["tree"], 3).count() == 0


def test_payload_faults(spark):
    def bucket(level, side, times, channels=("u", "v"), skip=()):
        return [(1, level, 0, c, t, x, y) for c in channels for t in range(times) for x in range(side) for y in range(side) if (c, x, y) not in skip]

    of = lambda rows: spark.createDataFrame(rows, "tree int, level int, position long, channel string, t int, px int, py int")
    fine = of(bucket(1, 2, 3) + bucket(0, 4, 3))
    assert K.payload_faults(fine, of(bucket(1, 2, 5) + bucket(0, 4, 5)), ["tree"], 1, patch=2).count() == 0
    wrong = of(bucket(1, 2, 5, channels=("u",)) + bucket(0, 4, 5, skip={("u", 3, 3)}))
    got = {tuple(r) for r in K.payload_faults(fine, wrong, ["tree"], 1, patch=2).collect()}
    assert got == {(1, 1, "no target", 4), (1, 0, "no target", 1)}
    got = {tuple(r) for r in K.payload_faults(of(bucket(1, 4, 1)), of(bucket(1, 4, 1)), ["tree"], 1, patch=2).collect()}
    assert got == {(1, 1, "wrong side", 24)}
    small = of(bucket(0, 2, 1))
    assert {tuple(r) for r in K.payload_faults(small, small, ["tree"], 1, patch=2).collect()} == {(1, 0, "missing pixels", 24)}
    ragged = of(bucket(0, 4, 2)[:-1])
    assert {tuple(r) for r in K.payload_faults(ragged, of(bucket(0, 4, 1)), ["tree"], 1).collect()} == {(1, 0, "ragged times", 1)}
