"""Line dedup against brute force, with the filter sent to all tasks and with lines sent to it; odd rows."""

import random

import pytest

from meshlark.llm import line_dedup as L

BLANK = " \t\n\v\f\r"


def plain_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=20, min_docs=3):
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(plain_key(line), set()).add(i)
    below = lambda i: (i is not None, i)
    gone = {k: max(ids, key=below) for k, ids in docs.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if plain_key(x) not in gone or gone[plain_key(x)] == i]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows_for(seed):
    rng = random.Random(seed)
    shared = [f"Shared line number {k} of the corpus, said again" for k in range(12)] + ["é" * 20, "é" * 19, "x" * 19, "x" * 20, "a common LINE that every document has"]
    rows = []
    for i in range(300):
        lines = [rng.choice(shared) for _ in range(rng.randrange(4))] + [f"own line {i} {k} with some words in it" for k in range(rng.randrange(3))]
        if i % 3 == 0:
            lines.append(shared[-1])
        lines = [rng.choice(["", " ", "\t", "\v \f"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in lines]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(7, "shared line number 1 of the corpus, said again"), (7, rows[7][1]), (None, shared[0]), (None, shared[0]), (301, None), (302, ""), (303, "\n\n"), (304, "z" * 200_000 + "\n" + shared[3])]


@pytest.mark.parametrize("broadcast_parts", [32, 0])
def test_equals_brute_force(spark, broadcast_parts, monkeypatch):
    monkeypatch.setattr(L, "LINES", 64)  # several parts
    rows = rows_for(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = L.drop_repeated_lines(df, broadcast_parts=broadcast_parts)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    want = brute(rows)
    assert sum(r[3] for r in want) > 200
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_a_line_in_all_documents_keeps_one(spark):
    rows = [(i, f"the very same line of every document\nown {i}") for i in range(1000)]
    got = L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert [r.doc_id for r in got if r.n_dropped == 0] == [999] and {r.text for r in got if r.doc_id < 999} == {f"own {i}" for i in range(999)}


def test_other_columns_ids_of_text_and_empty_tables(spark):
    schema = "N_lines int, gone string, part double, doc_id string, Digest string, text string, keeper int"
    line = "a line which is repeated, long enough"
    rows = [(1, "g", 0.5, k, "d", f"{line}\nx", 3) for k in ("b", "a", "c")]
    got = L.drop_repeated_lines(spark.createDataFrame(rows, schema))
    assert got.columns == ["gone", "part", "doc_id", "Digest", "text", "keeper", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["text"], r["gone"], r["Digest"], r["n_dropped"]) for r in got.collect()) == [("a", "x", "g", "d", 1), ("b", "x", "g", "d", 1), ("c", f"{line}\nx", "g", "d", 0)]
    assert L.drop_repeated_lines(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        L.drop_repeated_lines(spark.createDataFrame([], schema), min_docs=1)


def test_two_documents_are_enough_if_asked(spark):
    rows = [(1, "same line"), (2, "same line"), (3, "SAME LINE "), (4, "short")]
    got = L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=5, min_docs=2).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == [(1, "", 1), (2, "", 1), (3, "SAME LINE ", 0), (4, "short", 0)]
