"""Embedding near-dedup against all pairs."""

import math

import numpy as np
from conftest import DATA

from meshlark.llm.embed_dedup import BLOCK, embedding_duplicates


def brute(rows, least=0.93):
    ok = [i for i, (d, v, lab) in enumerate(rows) if d is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ok):
        for j in ok[k + 1 :]:
            (_, u, la), (_, v, lb) = rows[i], rows[j]
            if la == lb and len(u) == len(v):
                u, v = np.array(u, np.float64), np.array(v, np.float64)
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[root(j)] = root(i)
    smallest = {}
    for i, (d, _, _) in enumerate(rows):
        smallest[root(i)] = d if d is None else min(d, smallest.get(root(i), d))
    return sorted(((d, links[i], smallest[root(i)]) for i, (d, _, _) in enumerate(rows)), key=repr)


def run(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_duplicates(df).collect()), key=repr)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows, k = [], 0
    for b in base:
        for _ in range(int(rng.integers(1, 6))):
            v = b + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])
            rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1.0, 4.0])], int(k % 7 == 0)))
            k += 1
    good = rows[0][1]
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, good[:-1] + [None], 0), (k + 3, good[:-1] + [math.nan], 0), (k + 4, good[:-1] + [math.inf], 0), (k + 5, good, None), (None, good, 0), (k + 6, good[:8], 0), (k + 7, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert run(df) == brute(rows)
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_bucket_beyond_a_block(spark):
    rng = np.random.default_rng(6)
    b = rng.standard_normal(16)
    n = 2 * BLOCK + 100
    rows = [(i, (b + rng.standard_normal(16) * 0.01).astype(np.float32).tolist(), 1) for i in range(n)] + [(n + i, rows_v, 1) for i, rows_v in enumerate([b.astype(np.float32).tolist()] * 5)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got == [(i, n + 4, 0) for i in sorted(range(n + 5), key=lambda i: repr((i, n + 4, 0)))]


def test_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding", "label").toPandas()
    x = np.stack(rows.embedding).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (rows.label.to_numpy()[:, None] == rows.label.to_numpy()[None, :])
    np.fill_diagonal(near, False)
    want = dict(zip(rows.vec_id.tolist(), near.sum(1).tolist(), strict=True))
    assert {i: n for i, n, _ in run(df)} == want


def test_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(8)
    v, w, u = ([float(np.float32(x)) for x in rng.standard_normal(16)] for _ in range(3))
    near = [float(np.float32(x + 0.01)) for x in v]
    rows = [(5, v, 1), (5, v, 1), (7, w, 1), (9, u, 1), (9, w, 1), (3, near, 1), (5, u, 2), (4, None, 1), (4, near, 1), (4, near, 1), (None, v, 1)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")) == brute(rows)


def test_columns_with_the_names_used_inside(spark):
    rows = [("x", 1, [1.0, 0.0], 1, 2, "k", 3, 4), ("y", 2, [1.0, 0.01], 1, 2, "k", 3, 4), ("z", 3, [0.0, 1.0], 1, 2, "k", 3, 4)]
    df = spark.createDataFrame(rows, "id string, vec_id int, embedding array<double>, label int, vid int, vector string, n int, n_links int")
    got = embedding_duplicates(df)
    assert got.schema["vec_id"].dataType.simpleString() == "int" and run(df) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
