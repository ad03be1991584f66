"""Alignment against whole texts encoded by the libraries; odd rows."""

import random
from collections import Counter

import pytest

from meshlark.llm import alignment as A
from meshlark.llm.queries import tokenizer

PATHS = (tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def brute(texts):
    t = A.Tokenizers(*PATHS)
    docs = []
    for text in texts:
        groups = []
        if text:
            a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            raw = (" " + text).encode()
            if b"".join(t.a_bytes[i] for i in a) == raw == b"".join(t.b_bytes[i] for i in b):
                ends = []
                for ids, size in ((a, t.a_bytes), (b, t.b_bytes)):
                    at, mine = 0, []
                    for i in ids:
                        at += len(size[i])
                        mine.append(at)
                    ends.append(mine)
                last = (0, 0)
                for e in sorted(set(ends[0]) & set(ends[1])):
                    now = (ends[0].index(e) + 1, ends[1].index(e) + 1)
                    groups.append((a[last[0] : now[0]], b[last[1] : now[1]]))
                    last = now
        docs.append(groups)
    held = Counter()
    for groups in docs:
        held.update({(x, y) for a, b in groups for x in a for y in b})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        out.append(
            (
                sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links),
                ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups),
            )
        )
    return out


def texts_for(seed, n=250):
    rng = random.Random(seed)
    bits = ["the", "of", "and", "naïve", "café", "日本語", "🙂🙂", "don't", "we'll", "x" * 40, "a=b+c;", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "[INST]", "12345678", "été,", "end.", " ", "　x", "\u0085", "\xa0", "\u2003", "​", "ﬁ", "\x1c", "\x00", "tok\ten", "Zürich", "Ωmega", "é", "▁"]
    gaps = [" "] * 14 + ["  ", "\n", " \n", "\n\n", "\t", " \t ", "", "   ", "\r\n"]
    out = [rng.choice(["", " ", "  ", "\n"]) + "".join(rng.choice(bits[: rng.choice([10, len(bits) - 1, len(bits)])]) + rng.choice(gaps) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    return out + [None, "", " ", "  ", "\n", "▁", "a▁b", out[0], out[0], "word " * 5000, "aaaaaaa" * 3000, "é" * 2000, "x"]


def test_equals_whole_texts_encoded(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_DISTINCT", 40)
    texts = texts_for(11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = A.align(df, *PATHS).collect()
    want = brute(texts)
    assert sum(w[0] > 0 for w in want) > 150 and sum(w[0] == 0 for w in want) > 5
    assert {tuple(r[1:]) for r in got if want[r.doc_id] != tuple(r[1:])} == set() and sorted(r.doc_id for r in got) == list(range(len(texts)))


def test_chunks_spell_the_text_and_encode_alone():
    t = A.Tokenizers(*PATHS)
    for text in texts_for(12, 400):
        if not text or "▁" in text:  # the sign itself is never spelled
            continue
        chunks = A.chunks_of(text.encode())
        assert b" ".join(chunks) == text.encode()
        a, b = t.encode([c.decode() for c in chunks])
        assert sum(a, []) == t.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == t.b.encode(text)


def test_no_piece_crosses_a_space():
    t = A.Tokenizers(*PATHS)
    assert not [x for x in t.b_bytes if b" " in x.lstrip(b" ")]


def test_other_columns_ids_of_text_and_empty_tables(spark):
    schema = "block int, k string, value int, doc_id string, text string, n_a int"
    rows = [(1, "x", 2, i, "one two", 3) for i in ("b", None, "b")]
    got = A.align(spark.createDataFrame(rows, schema), *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((str(r.doc_id), r.n_a, r.n_links, r.n_best, r.count_sum) for r in got.collect()) == [("None", 2, 2, 2, 6), ("b", 2, 2, 2, 6), ("b", 2, 2, 2, 6)]
    assert A.align(spark.createDataFrame([], schema), *PATHS).count() == 0
    assert A.align(spark.createDataFrame([(1, "x", 2, "i", None, 3)], schema), *PATHS).first().groups == ""


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_whole_table(spark, sf):
    from conftest import DATA
    from meshlark.llm import queries

    import hashlib

    d = f"{DATA}/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for (i, _), w in zip(docs, brute([t for _, t in docs]), strict=True)}
    assert {r.doc_id: tuple(r[1:]) for r in queries.op11_alignment(spark, d).collect()} == want


def test_groups_by_number_and_large_groups(monkeypatch):
    """A batch's chunks are formed at once; a group of many links is held as its different pairs, with the same sums."""
    import numpy as np

    cid = np.array([7, 7, 7, 7, 7, 9, 9, 9, 9, 9, 9])
    is_b = np.array([False, True, False, False, True, False, True, False, True, False, True])
    ids, grp = np.array([1, 2, 3, 4, 5, 6, 7, 6, 8, 9, 7]), np.array([0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0])
    for most in (10_000, 3, 0):
        monkeypatch.setattr(A, "LARGE_GROUP", most)
        rows = A._summary(cid, is_b, ids, grp).to_pylist()
        assert [r["groups"] for r in rows] == ["1|2;3,4|5", "6,6,9|7,8,7"]
        assert [tuple(r[n] for n in A.NUMBERS[:4]) for r in rows] == [(3, 2, 2, 3), (3, 3, 1, 9)]
        got = []
        for r in rows:
            got.append(Counter())
            for p, n in zip(r["pairs"], r["times"], strict=True):
                got[-1][p >> 32, p & 0xFFFFFFFF] += n
        assert got == [{(1, 2): 1, (3, 5): 1, (4, 5): 1}, {(6, 7): 4, (6, 8): 2, (9, 7): 2, (9, 8): 1}]
