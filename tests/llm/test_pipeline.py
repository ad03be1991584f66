"""The pipeline's stages against plain versions of their decisions, each on its own input."""

import hashlib
import math
from collections import Counter
from itertools import accumulate

import corpus_pipeline as pipeline
from conftest import DATA
from pyspark.sql import functions as F
from test_minhash import brute
from tokenizers import Tokenizer

from meshlark.llm import queries, toxicity
from meshlark.llm.common import written


def drawn(rows):
    """How often each document is drawn, one by one."""
    named = lambda s: s if s in queries.MIX_WEIGHTS else None
    size = Counter()
    for _, source, text in rows:
        size[named(source)] += len(text)
    weight = {**queries.MIX_WEIGHTS, None: 1 - sum(queries.MIX_WEIGHTS.values())}
    out = Counter()
    for i, source, _ in rows:
        rate = weight[named(source)] * sum(size.values()) / size[named(source)]
        u, k, p = int(hashlib.md5(f"{queries.MIX_SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        below = p
        while below <= u:
            k += 1
            p *= rate / k
            below += p
        if k:
            out[i] = k
    return out


def test_stages(spark):
    d = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    ordinary = written(pipeline.keep_ordinary(spark, docs, d), "t")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert {r.doc_id: r for r in ordinary.collect()} == {i: r for i, r in before.items() if model.score(r.text) < 0.5}

    single = written(pipeline.one_of_each_group(spark, ordinary, d), "t")
    classes = brute([(r.doc_id, r.text) for r in ordinary.collect()])
    assert {r.doc_id for r in single.collect()} == {i for i, c in classes.items() if i == c}

    cut = written(pipeline.without_repeats(spark, single, d), "t")
    least, split = {}, {r.doc_id: r.text.split() for r in single.collect()}
    for i in sorted(split):
        for s in range(len(split[i]) - 12):
            least.setdefault(tuple(split[i][s : s + 13]), i)
    for r in cut.collect():
        w, gone = split[r.doc_id], set()
        for s in range(len(w) - 12):
            if least[tuple(w[s : s + 13])] < r.doc_id:
                gone.update(range(s, s + 13))
        assert r.text.split() == [x for k, x in enumerate(w) if k not in gone]
        assert gone or r.text == before[r.doc_id].text

    mixed = written(pipeline.to_weights(spark, cut, d), "t")
    times = Counter(r.doc_id for r in mixed.collect())
    assert times == drawn([(r.doc_id, r.source, r.text) for r in cut.collect()])
    assert set(tuple(r) for r in mixed.collect()) <= set(tuple(r) for r in cut.collect())

    encode = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")).encode
    pieces, texts = pipeline.packed(spark, mixed, d).collect(), {r.doc_id: r.text for r in cut.collect()}
    tokens, sequences = Counter(), {}
    for r in pieces:
        tokens[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert tokens == {i: n * (len(encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in times.items()}
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= 2048
    for df in (ordinary, single, cut, mixed):
        assert df.columns == docs.columns


def test_odd_rows_and_empty_tables(spark, tmp_path):
    plain = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in plain.limit(60).collect()]
    odd = [(10_001, None, None, None, None), (10_002, "", "en", "src0", 0), (None, some[0][1], "en", "src1", 5), (None, None, None, "src1", None), some[1], some[1], (10_003, "word " * 20_000, "en", "src2", 100_000), (some[2][0], "another text under an id in use", None, "src9", 31)]
    docs = spark.createDataFrame([(*r, 0.5, 7, "x") for r in some + odd], "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, removed string")
    docs = docs.select(*[F.col(c) if c != "n_chars" else F.col(c).cast(plain.schema["n_chars"].dataType) for c in docs.columns])
    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        d = str(tmp_path / name)
        rows.write.parquet(f"{d}/documents.parquet")
        spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").write.parquet(f"{d}/labels.parquet")
        now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
        for _, stage in pipeline.STAGES[:-1]:
            now = written(stage(spark, now, d), "t")
            assert now.columns == pipeline.COLUMNS
            kept.append(now.count())
        pieces = pipeline.run(spark, d).collect()
        if name == "empty":
            assert kept == [0] * 4 and not pieces
            continue
        assert kept[1] == kept[2] <= kept[0] <= len(some + odd) and kept[0] > len(some) / 2
        ids = Counter(r.doc_id for r in now.collect())
        ends = Counter()
        for r in pieces:
            ends[r.doc_id] += r.start + r.length == r.doc_tokens
        assert ends == ids
