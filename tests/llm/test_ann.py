"""Recall of the graph search against brute force, and odd rows."""

import math

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from meshlark.llm.ann import nearest


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    got = nearest(df, F.col("vec_id") % 20 == 0, shard_size=700).toPandas()
    found, wanted = 0, 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        s = x @ x[np.flatnonzero(ids == q)[0]]
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, s[np.searchsorted(ids, own.vec_id)], atol=1e-12)
        assert sorted(zip(-own.score, own.vec_id, strict=True)) == list(zip(-own.score, own.vec_id, strict=True))
        s[ids == q] = -9
        want = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
        found, wanted = found + len(want & set(own.vec_id)), wanted + 20
    assert wanted == 20 * sum(ids % 20 == 0) and found >= 0.95 * wanted


def test_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0, float(i == 3)], "a") for i in range(12)] + [(20, None, "a"), (40, [0.0, 0.0, 0.0], "a"), (60, [1.0, None, 1.0], "a"), (80, [1.0, math.nan, 0.0], "a"), (None, [1.0, 1.0, 1.0], "a"), (100, [1.0], "a"), (0, [0.0, 1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).collect())
    vectors = {i: v for i, v, _ in rows[:12]}
    want = sorted((-sum(a * b for a, b in zip(vectors[0], v, strict=True)), i) for i, v in vectors.items() if i)
    assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_groups_of_equal_vectors(spark):
    """A third of the rows are copies of one vector: queries on it get the least ids of all."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1800, 16))
    x[rng.permutation(1800)[:600]] = x[7] / np.linalg.norm(x[7]) * 20  # nearest to itself
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, shard_size=900).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    copies = np.flatnonzero((x == x[np.flatnonzero(np.linalg.norm(x, axis=1) > 19.9)[0]]).all(1))
    asked = [q for q in copies.tolist() if q % 20 == 0]
    assert len(copies) >= 600 and len(asked) >= 15
    for q in asked:
        assert [got[q][k] for k in range(1, 21)] == [i for i in copies.tolist() if i != q][:20]


def test_searches_side_by_side():
    """Queries in one call find what each finds alone; one without a row of its own, too."""
    from meshlark.llm.ann import _search

    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6))
    near = np.argsort(-(x @ x.T), axis=1)[:, :12]
    both = np.unique(np.concatenate([np.repeat(np.arange(600), 12) * 600 + near.reshape(-1), near.reshape(-1) * 600 + np.repeat(np.arange(600), 12)]))
    starts, links, entries = np.searchsorted(both, np.arange(601) * 600), both % 600, np.arange(0, 600, 30)
    q, own = np.vstack([x[:40], rng.normal(size=(5, 6))]), np.append(np.arange(40), np.full(5, -1))
    together = _search(x, starts, links, q, own, entries, 60)
    found = 0
    for v, o, (at, score) in zip(q, own, together, strict=True):
        alone = _search(x, starts, links, v[None], o[None], entries, 60)[0]
        assert sorted(at.tolist()) == sorted(alone[0].tolist()) and len(set(at.tolist())) == len(at) == 60
        assert np.allclose(score, x[at] @ v, atol=1e-12)
        found += len({*at[np.argsort(-score)[:20]].tolist()} & {*np.argsort(-(x @ v))[:20].tolist()})
    assert found >= 0.95 * 20 * len(q)
