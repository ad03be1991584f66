"""Substring dedup against a brute-force count of windows, on the whole small table and on odd rows."""

import hashlib
import re

from conftest import DATA

from meshlark.llm.substring import remove_repeats


def brute(rows, window=13):
    least = {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in enumerate(rows)}
    for i, (d, _) in enumerate(rows):
        for s in range(len(split[i]) - window + 1) if d is not None else ():
            k = tuple(split[i][s : s + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        w, gone = split[i], set()
        for s in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[s : s + window])] < d:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(map(tuple, remove_repeats(df, output="digest").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert digest(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(40))
    b = " ".join(f"v{i}" for i in range(9)) + " " + " ".join(f"w{i}" for i in range(5, 18)) + "\x0bend\ttail"
    loop = " ".join(["la"] * 60)
    rows = [(5, a), (7, a), (7, a + " more"), (9, b), (None, a), (11, None), (12, ""), (3, loop), (4, loop), (4, loop), (2, "short text"), (13, "x " * 30_000 + a)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, doc string")
    assert digest(df) == brute(rows)
    cut = remove_repeats(df, output="text")
    assert cut.columns == ["doc_id", "text", "doc", "removed"]
    got = {(r.doc_id, r.text) for r in cut.where("doc_id = 9").collect()}
    assert got == {(9, " ".join(f"v{i}" for i in range(9)) + " end\ttail")}
    assert remove_repeats(df.limit(0)).count() == 0
