"""Packing: an exact round trip to the library's ids, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from conftest import DATA
from tokenizers import Tokenizer

from meshlark.llm.packing import Index, pack, pack_shard

PATH = P.path("word_bpe_49k.json")


def check(df, window=2048):
    library = Tokenizer.from_file(PATH)
    rows = pack(df, PATH, window=window, with_ids=True).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    docs = df.select("doc_id", "text").collect()
    for d in {d.doc_id for d in docs}:
        want = sorted(tuple(library.encode(x.text or "", add_special_tokens=False).ids + [1]) for x in docs if x.doc_id == d)
        got, now = [], []
        if len(want) == 1:
            for r in sorted(own[d], key=lambda r: r.start):
                assert r.start == len(now) and r.doc_tokens == len(want[0])
                now += r.ids
            got = [tuple(now)]
            assert got == want
        assert sum(r.length for r in own[d]) == sum(map(len, want))
    full = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        full += at == window
    return len(sequences), full


def test_whole_table(spark):
    n, full = check(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    assert full >= n - 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "It's <|endoftext|> here"), (4, "中文 tést 😀 x\x1cy \x85z"), (None, "a b c"), (5, "twice"), (5, "twice"), (6, "long word " * 20_000), (7, "it's IT'S don't 12 ½²"), (8, "é ́x ſ İ")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string")
    check(df, 256)
    assert pack(df.limit(0), PATH).count() == 0


def test_index_is_bm25_and_neighbours_fill_the_window():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, n).astype("<u4") for n in (30, 40, 25, 60)]
    index, mean = Index(docs), np.mean([30, 40, 25, 60])
    for i, q in enumerate(docs):
        want = np.zeros(4)
        for t in set(q.tolist()):
            df = sum(t in d for d in docs)
            for j, d in enumerate(docs):
                c = int((d == t).sum())
                want[j] += np.log1p((4 - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(i), want, rtol=1e-4)
    near, far = np.arange(100, 150, dtype="<u4"), np.arange(300, 350, dtype="<u4")
    order = [p[0] for p in pack_shard([near, far, near.copy(), far.copy()], 100)]
    assert order == [0, 2, 1, 3]
