"""Token counts and prefix tables against the library itself."""

import random
import time

import public_tokenizers
from conftest import DATA
from tokenizers import Tokenizer

from meshlark.llm.queries import op7_token_counts
from meshlark.llm.token_counts import loaded, token_counts, truncate

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "word", "'s", "'ll", "'", " ", "  ", "\n\n", "\t", "\u0085", "　", " ", "12345", "!?...", "<|endoftext|>", "<|endof", "été", "日本語", "🙂", "́", "x" * 40, "-", "\x1c", "é" * 9, "’s"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op7_token_counts(spark, f"{DATA}/sf0.01").collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), n := count(r.text or ""), n > 512) for r in docs}


def test_every_prefix_of_odd_texts():
    counter = loaded(PATH)
    for text in odd_texts():
        table = counter.table(text)
        want = [count(text[:c]) for c in range(len(text) + 1)]
        assert [table.count(c) for c in range(len(text) + 1)] == want, text
        for budget in range(want[-1] + 2):
            assert counter.longest_prefix(text, budget) == max(c for c, n in enumerate(want) if n <= budget), (text, budget)


def test_long_words_take_no_second_encoding():
    counter, rng = loaded(PATH), random.Random(2)
    for word in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "ab" * 100_000, "語" * 50_000):
        began = time.process_time()
        cut, n = counter.longest_prefix(word, 512), counter.count(word)
        assert time.process_time() - began < 3
        assert n == count(word)
        assert count(word[:cut]) <= 512 and all(count(word[: cut + k]) > 512 for k in range(1, 20))


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "some text", 7), (3, "same", 7), (3, "same", 7), (4, "long words " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id smallint, text string, n_tokens int").withColumnRenamed("n_tokens", "Text2")
    got = token_counts(df, 512, path=PATH)
    assert [f.dataType.simpleString() for f in got.schema][:1] == ["smallint"]
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit, r.fit_chars) for r in got.collect()) == sorted((repr(d), len(t or ""), count(t or ""), count(t or "") > 512, min(len(t or ""), max(c for c in range(6000) if count((t or "")[:c]) <= 512) if len(t or "") > 6000 else len(t or ""))) for d, t, _ in rows)
    clash = df.selectExpr("doc_id", "text", "1 as id", "2 as n_bytes", "3 as c0", "4 as c1")
    assert token_counts(clash, 512, path=PATH).count() == len(rows)
    assert token_counts(df.limit(0), 512, path=PATH).count() == 0
    cut = {r.doc_id: r.text for r in truncate(df, 3, path=PATH).where("doc_id in (1, 2, 4)").collect()}
    assert cut[1] is None and cut[2] == "" and cut[4] == "long words long"
