"""Collocations against brute force, with prefixes gathered and counted apart; odd rows."""

import random
import re
from collections import Counter

import pytest

from meshlark.llm import collocations as C


def brute(rows, min_count, top=None):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in cand.items():
        if any(lang == g and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        order = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(order[:top])]
    return sorted(ranked)


def rows_for(seed):
    rng, rows = random.Random(seed), []
    fixed = ["once upon a time there was", "New York city", "to be or not to be", "été à la plage", "very very very very very very", "it's 3 o'clock"]
    for i in range(400):
        words = []
        while len(words) < 40:
            words += rng.choice(fixed).split() if rng.random() < 0.3 else [f"w{int(rng.paretovariate(0.7)) % 60}"]
            if rng.random() < 0.1:
                words[-1] += rng.choice([".", ", ", "!\n", ";x", "\r\n", "?", ":", "\t", "\v", "  "])
        rows.append((["en", "fr", None][min(2, i % 5)], " ".join(words)))
    return rows + [("en", None), ("en", ""), (None, None), ("xx", " \t. "), ("und", "one two three"), ("en", "once upon a time " * 3000)]


@pytest.mark.parametrize("hot", [C.HOT, 50])
@pytest.mark.parametrize("flush", [C.FLUSH_WORDS, 500])
def test_equals_brute_force(spark, hot, flush, monkeypatch):
    monkeypatch.setattr(C, "FLUSH_WORDS", flush)
    rows = rows_for(5)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in C.collocations(df, min_count=20, hot=hot).collect())
    want = brute(rows, 20)
    assert len(want) > 60 and any(len(r[2].split()) == 5 for r in want)
    assert got == want


def test_top_of_each_language_and_ties(spark):
    rows = [("a", "x y. p q. r s")] * 30 + [("b", "x y")] * 30
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=30, top=2).select("lang", "rank", "phrase", "score").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "p q", 6000), ("a", 2, "r s", 6000), ("b", 1, "x y", 2000)]


def test_products_beyond_64_bits_are_exact():
    """The score's arithmetic as Spark does it, on counts of a very large corpus."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a, n, l, r = 9_000_000_000_001, 80_000_000_000_003, 9_000_000_000_007, 9_100_000_000_003
    got = spark.sql(f"SELECT (cast({a}L * 1000 as decimal(19,0)) * cast({n}L as decimal(18,0))) div (cast({l}L as decimal(19,0)) * cast({r}L as decimal(18,0)))").first()[0]
    assert got == 1000 * a * n // (l * r)


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, "EN", "a b", 1, 2) for k in range(40)], "n int, lang string, text string, prefix int, suffix int")
    assert [tuple(r) for r in C.collocations(df, min_count=40).collect()] == [("EN", 1, "a b", 40, 40, 40, 80, 2000)]
    assert C.collocations(df.limit(0), min_count=40).count() == 0
    assert C.collocations(df, min_count=41).count() == 0
