"""Near-dedup by Order MinHash.

A document's k-mers are its shingles of five words (lower-cased runs of letters, digits and
underscores), each labelled with its occurrence number. A sketch takes the SIZE labelled shingles of
least hash under one hash function and keeps them in text order, so it agrees for documents of small
edit distance and not for the same shingles in another order. Documents that share a sketch are
candidates; a banded alignment of their shingle sequences decides: m aligned shingles of n1 and n2
are a similarity of m / (n1 + n2 - m), the order-true form of the Jaccard similarity.

Each member of a bucket is compared with the bucket's least document, so a group of n near copies
costs n comparisons. Buckets whose members are then still in several groups are settled exactly: two
documents at the similarity wanted must share one of the few rarest shingles of each (the shingles
of all such documents, ordered by how many of them hold them), and so near the front that enough can
follow. Documents that only have a frequent passage in common share none of those and never meet.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import components, discard, give_back, numbered, only, place, remembers, written

SHINGLE, SIMILARITY = 5, 0.8
#: Sketches and shingles of each: at similarity 0.8 a pair shares none with probability (1 - 0.8**3)**18 = 2.5e-6.
SKETCHES, SIZE = 18, 3
#: Documents that are compared with one document in one go.
BESIDE = 512
#: Shingles before one under which a document's pairs are looked for, so as not to send them again.
BEFORE = 16
WORD = re.compile(r"\w+")
_RANDOM = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _RANDOM.integers(1, 2**63, size=SKETCHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(1, 2**63, size=SKETCHES, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 2**63, size=(3, 16), dtype=np.uint64) | np.uint64(1)
_OWN = np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
LAST = np.uint64(2**64 - 1)
SPAN = 500_000  # hash values held at once for one text
#: Alignments of more equal places than this for each shingle go by rows of bits.
DENSE = 64


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()
remembers("minhash", _HASHES.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Hashes of the runs of five words in text order; of all words together if there are fewer; none without words."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out += h[j : j + len(out)] * _PLACE[0, j]
    return mixed(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes that also depend on how often the shingle came before."""
    order = np.argsort(s, kind="stable")
    k = s[order]
    new = k[1:] != k[:-1]
    if new.all():
        return mixed(s)
    starts = np.flatnonzero(np.append(True, new))
    before = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
    out = s.copy()
    out[order] += before.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(out)


def sketches(s: np.ndarray) -> np.ndarray:
    """One hash for each sketch: the SIZE least labelled shingles, in text order."""
    x, out = labelled(s), np.empty((SKETCHES, min(SIZE, len(s))), np.int64)
    step = max(1, SPAN // len(x))
    for lo in range(0, SKETCHES, step):
        v = (x[None, :] + _ADD[lo : lo + step, None]) * _MULTIPLY[lo : lo + step, None]
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x9FB21C651E98DF25)
        rows = np.arange(len(v))
        for k in range(out.shape[1]):
            out[lo : lo + step, k] = at = v.argmin(axis=1)
            v[rows, at] = LAST
    out.sort(axis=1)
    return mixed((x[out] * _PLACE[1, : out.shape[1]]).sum(axis=1, dtype=np.uint64) + _OWN).view(np.int64)


def _chain(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Largest number of equal shingles of x and y in the same order, no more than band places apart."""
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    lo, hi = np.searchsorted(ranked, x, "left"), np.searchsorted(ranked, x, "right")
    total = int((hi - lo).sum())
    if total > DENSE * (len(x) + len(y)):
        return _chain_in_bits(x, y, band)
    size = hi - lo
    i = np.repeat(np.arange(len(x)), size)
    j = order[np.repeat(hi - 1, size) - (np.arange(total) - np.repeat(np.cumsum(size) - size, size))]  # the last first
    ends: list[int] = []
    for v in j[np.abs(i - j) <= band].tolist():
        k = bisect_left(ends, v)
        if k == len(ends):
            ends.append(v)
        else:
            ends[k] = v
    return len(ends)


def _chain_in_bits(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """The same for texts that say few things often: the table's rows are bits of whole numbers."""
    masks: dict[int, int] = {}
    for i, s in enumerate(x.tolist()):
        masks[s] = masks.get(s, 0) | (1 << i)
    row = full = (1 << len(x)) - 1
    wide = (1 << (2 * band + 1)) - 1
    for j, s in enumerate(y.tolist()):
        hit = masks.get(s, 0) & ((wide << (j - band)) if j >= band else (wide >> (band - j)))
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def aligned(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """Similarity of two shingle sequences by banded alignment; 0.0 where it is below least.

    With m of nx and ny aligned, at most (nx + ny)(1 - least) / (1 + least) shingles are not, so an
    alignment that is good enough stays in a band of that width around the diagonal.
    """
    nx, ny = len(x), len(y)
    if not nx or not ny or min(nx, ny) < least * max(nx, ny):
        return 0.0
    n = min(nx, ny)
    same = np.flatnonzero(x[:n] != y[:n])
    head = int(same[0]) if len(same) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    same = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    m = head + tail
    if len(x) and len(y):
        need = math.ceil(least * (nx + ny) / (1 + least) - 1e-6) - m  # more that must be aligned
        if min(np.isin(x, y).sum(), np.isin(y, x).sum()) < need:
            return 0.0
        m += _chain(x, y, int((nx + ny) * (1 - least) / (1 + least)) + 1)
    got = m / (nx + ny - m)
    return got if got >= least else 0.0


def _sketched(batches):
    only("minhash")
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        cols: tuple = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            s = shingles(text)
            if len(s):
                for c, v in zip(cols, (doc, xxhash.xxh3_128_digest(s.tobytes()), sketches(s), z.compress(text.encode("utf-8", "surrogatepass"))), strict=True):
                    c.append(v)
        keys = pa.ListArray.from_arrays(np.arange(len(cols[0]) + 1, dtype=np.int32) * SKETCHES, np.concatenate(cols[2]) if cols[2] else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), keys, pa.array(cols[3], pa.binary())], ["doc", "mark", "keys", "packed"])
    give_back()


def _opened(packed: bytes, z=zstandard.ZstdDecompressor()) -> np.ndarray:  # noqa: B008
    return shingles(z.decompress(packed).decode("utf-8", "surrogatepass"))


def _verified(batches, least: float):
    """Rows (a, part, other, packed) in order, a's own text (other null) first: similarity of a and each other."""
    only("minhash")
    last, head = None, None
    for batch in batches:
        out: tuple = [], [], []
        for a, part, other, packed in zip(*batch.columns, strict=True):
            a, part, other = a.as_py(), part.as_py(), other.as_py()
            if other is None:
                if (a, part) != last:
                    last, head = (a, part), _opened(packed.as_py())
                continue
            for c, v in zip(out, (a, other, aligned(head, _opened(packed.as_py()), least)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])
    give_back()


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the distinct pairs (a, b) that have at least the similarity. The text of a document
    with many partners is sent once for BESIDE of them, to another task each time."""
    pairs = written(pairs, "omh-pairs", 8)
    parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / BESIDE).cast("int").alias("parts")), "omh-parts", 16)
    # one part for documents with few partners, which need no count
    dealt = pairs.join(parts.where("parts > 1"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    left = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("doc", "a"), "a")
    right = dealt.join(texts.withColumnRenamed("doc", "b"), "b")
    rows = left.select("a", "part", F.lit(None).cast("long").alias("b"), "packed").unionByName(right.select("a", "part", "b", "packed"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    found = rows.mapInArrow(lambda it: _verified(it, least), "a long, b long, similarity double")
    links = written(found.where("similarity > 0").select("a", "b"), "omh-links", 2)
    discard(pairs)
    discard(parts)
    return links


def _rare_shingles(batches):
    """(doc, n, shingle) of each labelled shingle of each packed text."""
    only("minhash")
    for batch in batches:
        for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = labelled(_opened(packed.as_py())).view(np.int64)
            for lo in range(0, len(s), SPAN):
                part = s[lo : lo + SPAN]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc, np.int64)), pa.array(np.full(len(part), len(s), np.int32)), pa.array(part)], ["doc", "n", "shingle"])
    give_back()


def _across_groups(texts: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of texts(doc, packed) of different roots(doc, root) that may have the similarity.

    Of the labelled shingles of all these texts, ordered by the number of texts that hold them, two
    texts with m of n1 <= n2 in common and m (1 + least) >= least (n1 + n2) have their first common
    one among the first n1 - 2 least n1 / (1 + least) + 1 of the one and n2 - least n2 + 1 of the other.
    """
    all_ = written(texts.mapInArrow(_rare_shingles, "doc long, n int, shingle long"), "omh-shingles")
    held = all_.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    shared = all_.join(held, "shingle")
    each = Window.partitionBy("doc").orderBy("held", "shingle")  # one document's shingles
    often = F.count("*").over(Window.partitionBy("doc"))
    at = (F.col("n") - often + F.row_number().over(each) - 1).alias("at")  # those that no other text holds come before
    shared = shared.select("doc", "n", "shingle", "held", at)
    near = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-6)
    front = F.col("n") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - 1e-6)
    first = written(shared.where(F.col("at") <= near).withColumn("index", F.col("at") <= front).join(roots, "doc").drop("held"), "omh-first", 2)
    discard(all_)
    # documents of the largest group under a shingle need not meet each other, which leaves work in the number of pairs of different groups
    groups = first.groupBy("shingle", "root").agg(F.count("*").alias("rows"), F.max("index").alias("index"))
    groups = groups.groupBy("shingle").agg(F.max(F.struct("rows", "root")).alias("top"), F.count("*").alias("groups"), F.max("index").alias("index"))
    first = first.join(groups.where("groups > 1 and index").select("shingle", F.col("top.root").alias("top")), "shingle")
    # a pair that has met under one of the shingles before need not again
    before = F.collect_list("shingle").over(Window.partitionBy("doc").orderBy("at").rowsBetween(-BEFORE, -1))
    first = first.withColumn("before", before)
    side = F.col("root") == F.col("top")
    x = first.where("index").select("shingle", side.alias("side"), *[F.col(c).alias(f"x_{c}") for c in ("doc", "n", "at", "root", "before")])
    y = first.select("shingle", F.explode(F.when(side, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("side"), *[F.col(c).alias(f"y_{c}") for c in ("doc", "n", "at", "root", "before")])
    enough = (F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))) * (1 + least) >= least * (F.col("x_n") + F.col("y_n")) - 1e-6
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_doc") < F.col("y_doc")))
    met = x.join(y, ["shingle", "side"]).where(smaller & enough & (F.col("x_root") != F.col("y_root")) & ~F.arrays_overlap("x_before", "y_before"))
    return met.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: id, class_id (least id of its group), kept (it is that document).

    Documents of a similarity of at least ``similarity``, directly or over others, are a group; equal
    word sequences always are. Texts that are null, empty or without words are groups of their own.
    Rows with a null id get a null class and are kept; rows that share an id share a class (copies of
    all their texts are found, near copies of one of them); repeated rows stay; an empty table gives
    no rows; other columns are not read.

    Copies are folded into their least id before anything is compared. Intermediate tables (sketches
    with packed texts, buckets, links) are written to the shared folder; no step holds a bucket in one task.
    """
    plain = numbered(docs)
    ids = plain.select(F.col(place(docs, id_col)).cast("long").alias("doc"), F.col(place(docs, text_col)).alias("text"))
    sketched = ids.where("doc is not null and text is not null").mapInArrow(_sketched, "doc long, mark binary, keys array<long>, packed binary")
    sketched = written(sketched, "omh")
    first = written(sketched.groupBy("mark").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1").select("mark", "rep"), "omh-copies", 8)
    copies = sketched.select("doc", "mark").join(first, "mark").where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    reps = sketched.select("doc", "mark", "keys").join(first, "mark", "left").where("rep is null or doc = rep")
    reps = written(reps.groupBy("doc").agg(F.min(F.struct("mark", "keys")).alias("r")).select("doc", "r.mark", "r.keys"), "omh-reps", 2)
    keyed = reps.select(F.explode("keys").alias("key"), "doc")
    heads = keyed.groupBy("key").agg(F.min("doc").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    met = written(keyed.join(heads, "key"), "omh-met", 4)
    wanted = reps.select("doc", "mark").join(met.select("doc").distinct(), "doc", "left_semi")
    packed = written(sketched.select("doc", "mark", "packed").join(wanted, ["doc", "mark"], "left_semi").dropDuplicates(["doc"]).select("doc", "packed"), "omh-texts", 4)
    links = [_verify(met.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct(), packed, similarity)]
    classes = components(links[0])

    root: Column = F.coalesce("component", "doc").alias("root")
    rooted = met.select("key", "doc").join(classes.withColumnRenamed("id", "doc"), "doc", "left").select("key", "doc", root)
    mixed_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_ = written(rooted.join(mixed_keys, "key", "left_semi").select("doc", "root").distinct(), "omh-open", 8)
    more = _across_groups(packed.join(open_.select("doc"), "doc", "left_semi"), open_, similarity)
    links.append(_verify(more, packed, similarity))
    classes = components(reduce(DataFrame.unionByName, [*links, copies.distinct()]))
    for table in (sketched, first, packed, met, open_, reps, *links):
        discard(table)

    kind = docs.schema[id_col].dataType
    out = ids.select("doc").join(classes.select(F.col("id").alias("doc"), "component"), "doc", "left")
    out = out.select(F.col("doc").cast(kind).alias(id_col), F.coalesce("component", "doc").cast(kind).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group: the one of least id (of rows that share it, the one whose
    text sorts first). Rows with a null id are kept; columns of any name pass through."""
    rows, doc, text = numbered(docs), place(docs, id_col), place(docs, text_col)
    kept = near_duplicates(docs, id_col, text_col, similarity).where("kept").select(F.col(id_col).alias("only")).where("only is not null").distinct()
    one = Window.partitionBy(doc).orderBy(F.col(text).asc_nulls_last())
    known = rows.join(kept, F.col(doc) == F.col("only"), "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    return known.unionByName(rows.where(F.col(doc).isNull())).toDF(*docs.columns)
