"""Nulls, ties, repeated rows, empty tables, columns of clashing names and other id types, operator by operator."""

import hashlib
import math
from collections import Counter

import public_tokenizers as P
import pytest

from meshlark.llm.chat import conversation_digests, escape, format_conversations, unescape
from meshlark.llm.minhash import drop_near_duplicates
from meshlark.llm.mixing import mix, poisson_cdf
from meshlark.llm.packing import pack
from meshlark.llm.substring import remove_repeats
from meshlark.llm.toxicity import Model, score
from meshlark.llm.url_filter import url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def judged(url):
    """The rules one by one: the longest that fits."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest), *[rest.index(c) for c in "/?#" if c in rest]])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([len(tail), *[tail.index(c) for c in "?#" if c in tail]])]
    fits = [(len(h) + len(p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "http://a.example.org/en/12?q#f", "http://example.org/en/2", "http://badexample.org/es/", "ftp://x.com/fr/a", "ftp://x.com/de/", "ftp://com/de/a", "ftp://com/de", "http://a..org/", "http://org?/", "http://.com/de/", "x://y://z.org/", "http://ÉX.org/é", "http://a.org/" + "p" * 20_000]
    rows = [(i % 7, u, "kept", 5, 6) for i, u in enumerate(urls + urls[:6])]
    df = spark.createDataFrame(rows, "page_id smallint, url string, Host string, rid int, salt int")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(df, RULES).select("page_id", "host", "path", "rule", "verdict", "rid", "salt").collect())
    assert got == Counter((r[0], *judged(r[1])) for r in rows)
    assert url_filter(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter(df, []).collect()} == {"allow"}


def drawn(seed, doc, rate):
    u = int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52
    return sum(p <= u for p in poisson_cdf(rate))


def test_mix_equals_the_draws_one_by_one(spark):
    rows = [(d, "t" * (d % 9), ["a", "b", "c", None][d % 4], d) for d in range(400)] + [(None, "null id", "a", 1), (3, None, "b", 2), (3, None, "b", 2), (5, "", None, 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, _n int").selectExpr("*", "1 as _u", "2 as Copy", "3 as c1")
    weights = {"a": 0.5, "b": 0.2}
    size = Counter()
    for _, t, s, _ in rows:
        size[s if s in weights else None] += len(t or "")
    total = sum(size.values())
    rates = {s: w * total / size[s] for s, w in weights.items()} | {None: 0.3 * total / size[None]}
    out = mix(df, weights, "s1")
    assert out.columns == ["doc_id", "text", "source", "_n", "_u", "c1", "copy", "shuffle_key"]
    want = Counter()
    for d, t, s, n in rows:
        for c in range(1, drawn("s1", d, rates[s if s in weights else None]) + 1):
            want[d, t, s, n, c] += 1
    assert Counter((r.doc_id, r.text, r.source, r["_n"], r.copy) for r in out.collect()) == want
    assert mix(df.limit(0), weights).count() == 0
    for bad in ({"a": 1.5}, {"a": 0.7, "b": 0.7}, {"a": -0.1}):
        with pytest.raises(ValueError):
            mix(df, bad)
    assert math.isclose(poisson_cdf(2.0)[0], math.exp(-2.0))


def digests(turns):
    """The contract's digests of a conversation's turns, from the turns themselves."""
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_chat(spark):
    odd = ["a<|end|><|turn|>b", "<!|end|>", "<!!|x", "<|", "|>", "<", "", None, "</s>[INST] ok [/INST]", "日本 <|says|> é", "x" * 30_000, "<|turn|>user<|says|>"]
    rows = [(c, t, ["user", "assistant", None][t % 3], odd[(c + t) % len(odd)]) for c in range(len(odd)) for t in range(5)]
    rows += [(20, 1, "assistant", "tie b"), (20, 1, "assistant", "tie a"), (20, 1, "user", "tie"), (20, None, "user", "first"), (21, 0, "assistant", "same"), (21, 0, "assistant", "same"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id smallint, turn int, role string, text string").selectExpr("*", "1 as conv", "2 as block")
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or ""), r, x))
    want = {c: digests([(r, x) for *_, r, x in sorted(v, key=lambda v: v[:3])]) for c, v in own.items()}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in conversation_digests(df, BYTES).collect()}
    assert got == want
    formatted = format_conversations(df, BYTES)
    assert formatted.schema["conv_id"].dataType.simpleString() == "smallint"
    assert {r.conv_id: r.formatted.count("<|end|>") for r in formatted.collect()} == {c: len(v) for c, v in own.items()}
    assert conversation_digests(df.limit(0), BYTES).count() == 0
    for text in odd:
        if text is not None:
            assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_ids_of_other_types_and_clashing_names(spark):
    df = spark.sql("SELECT cast(id as decimal(20,0)) AS doc_id, concat('some words to pack number ', id) AS text, 1 AS c0, 2 AS _row, 3 AS Score, 4 AS Removed, 5 AS `only` FROM range(40)")
    packed = pack(df, WORDS)
    assert packed.schema["doc_id"].dataType.simpleString() == "decimal(20,0)" and {int(r.doc_id) for r in packed.collect()} == set(range(40))
    dates = df.selectExpr("date_add(date'2020-01-01', cast(doc_id as int)) as doc_id", "text")
    assert pack(dates, WORDS).select("doc_id").distinct().count() == 40
    model = Model(b"  ", b"  ", [0.0] * 20)
    scored = score(df, model)
    assert scored.columns == ["doc_id", "text", "c0", "_row", "Removed", "only", "score"] and scored.count() == 40
    assert drop_near_duplicates(df).columns == df.columns and drop_near_duplicates(df).count() == 40
    cut = remove_repeats(df)
    assert cut.columns == ["doc_id", "text", "c0", "_row", "Score", "only", "removed"] and cut.count() == 40


def test_null_ids_lose_and_remove_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text)] * 50 + [(None, None)] * 50 + [(1, text), (2, text)], "doc_id long, text string")
    got = remove_repeats(df, output="digest").collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == Counter({(None, 30, 0): 50, (None, 0, 0): 50, (1, 30, 0): 1, (2, 30, 30): 1})
