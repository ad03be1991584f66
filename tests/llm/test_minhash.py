"""Order MinHash groups against groups from all pairs, compared by a plain alignment."""

import re
from itertools import combinations

import numpy as np
from conftest import DATA

from meshlark.llm.minhash import SIMILARITY, SKETCHES, aligned, drop_near_duplicates, near_duplicates, shingles, sketches


def plain_similarity(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        diagonal = 0
        for j, b in enumerate(y):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if a == b else max(row[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1])


def brute(rows):
    grams = {}
    for d, t in rows:
        w = re.findall(r"\w+", t.lower())
        grams[d] = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    sets = {d: set(g) for d, g in grams.items()}
    seen, parent = {}, {d: d for d in grams}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for d in sorted(grams):
        if grams[d]:
            k = tuple(grams[d])
            if k in seen:
                join(seen[k], d)
            seen.setdefault(k, d)
    inverted = {}
    for d in seen.values():
        for g in sets[d]:
            inverted.setdefault(g, []).append(d)
    near = {p for ds in inverted.values() if len(ds) < 400 for p in combinations(sorted(ds), 2)}
    for a, b in near:
        if len(sets[a] & sets[b]) >= 0.6 * max(len(sets[a]), len(sets[b])) and plain_similarity(grams[a], grams[b]) >= SIMILARITY:
            join(a, b)
    return {d: root(d) for d in grams}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_aligned_is_exact_within_the_band():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
        y = np.delete(x, rng.integers(0, len(x), rng.integers(0, 3))) if rng.random() < 0.8 else rng.integers(0, 30, 40).astype(np.uint64)
        want = plain_similarity(x.tolist(), y.tolist())
        assert aligned(x, y, 0.8) == (want if want >= 0.8 else 0.0)


def test_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(300))
    b = a.replace("w150", "other")
    far = " ".join(f"w{299 - i}" for i in range(300))
    rows = [(8, a), (3, b), (5, a.upper()), (9, far), (1, None), (2, ""), (4, "..."), (6, "one two"), (7, "one, two!"), (None, a), (10, a + " x"), (10, a + " x"), (12, "many words " * 20_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect()), key=repr)
    want = {8: 3, 3: 3, 5: 3, 10: 3, 7: 6}
    assert got == sorted([(d, None if d is None else want.get(d, d), d is None or want.get(d, d) == d) for d, _ in rows], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 9, 12, None], key=repr)
    assert len(shingles("one two")) == 1


def test_large_group_and_frequent_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"d{i}x{k}" for k in range(40))) for i in range(300)]
    base = [f"n{k}" for k in range(200)]
    rows += [(1000 + i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == {d: d if d < 1000 else 1000 for d, _ in rows}


def changed(words, places, mark):
    return [f"{mark}{i}" if i in places else w for i, w in enumerate(words)]


def classes(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near_duplicates(df).collect()}


def test_pairs_behind_a_head_met_before(spark):
    """a is like neither b nor c; b and c share no early sketch, and a has all sketches that they share."""
    texts = []
    for k in range(9000):
        b = [f"k{k}w{i}" for i in range(200)]
        c = changed(b, (40, 80, 120, 160), f"c{k}")
        kb, kc = (sketches(shingles(" ".join(t)))[:SKETCHES] for t in (b, c))
        shared = np.flatnonzero(kb == kc)
        if len(shared) and shared[0] >= 6:
            a = changed(b, (20, 40, 80, 120, 160), f"a{k}")
            ka = sketches(shingles(" ".join(a)))[:SKETCHES]
            if (ka[shared] == kb[shared]).all() and (ka == kb)[:6].any() and (ka == kc)[:6].any():
                texts += [a, b, c]
    assert len(texts) >= 6
    got = classes(spark, texts)
    assert [i for i in range(0, len(texts), 3) if (got[i], got[i + 1], got[i + 2]) != (i, i + 1, i + 1)] == []


def test_pairs_in_a_large_family(spark):
    """Documents of a mutual similarity of 0.77 and, of greatest id, pairs of 0.81 with few sketches in common: groups as from all pairs."""
    passage = [f"p{i}" for i in range(174)]
    alone, pairs = [passage + [f"d{k}w{i}" for i in range(26)] for k in range(1000)], []
    for k in range(1000, 5000):
        b = passage + [f"d{k}w{i}" for i in range(26)]
        c = changed(b, (176, 182, 188, 194), f"c{k}")
        if (sketches(shingles(" ".join(b))) == sketches(shingles(" ".join(c))))[:SKETCHES].sum() in (1, 2, 3, 4):
            pairs += [b, c]
    texts = alone + pairs[:60]
    s = [shingles(" ".join(t)) for t in texts]
    sets, want = [set(x.tolist()) for x in s], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) > 174 and aligned(s[a], s[b], SIMILARITY):
            want[b] = want[a]
    assert len(texts) - len(set(want)) >= 15
    got = classes(spark, texts)
    assert [i for i, w in enumerate(want) if got[i] != w] == []


def test_documents_like_a_member_but_not_the_head(spark):
    """a and b are nearly equal; c is 0.81 like b and 0.77 like a, which has the least id."""
    texts = []
    for k in range(100):
        b = [f"k{k}w{i}" for i in range(200)]
        texts += [changed(b, (20,), f"a{k}"), b, changed(b, (40, 80, 120, 160), f"c{k}")]
    got = classes(spark, texts)
    assert [i for i in got if got[i] != i // 3 * 3] == []
