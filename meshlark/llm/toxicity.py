"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one of what is frequent in ordinary texts,
and one that adds the stretches that recur in toxic texts and hardly in ordinary ones. Each window
of a text is compressed with both; the bytes that the toxic dictionary saves are its distance. How
many windows pass each of a row of thresholds, over the number of windows, gives the score by a
logistic calibration on labelled texts that made no dictionary.

Bytes are written doubled (each with a partner that depends on it alone) before compression: a
literal then costs twice while a dictionary match costs what it did, so a single word stands out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import give_back, numbered, only, place

#: Labelled rows that training reads at most, of each class; the bound is a parameter of train().
TOXIC_ROWS, ORDINARY_ROWS = 4000, 8000
#: Characters of text that training reads at most, of each class.
TOXIC_CHARS, ORDINARY_CHARS = 8_000_000, 16_000_000
WINDOW, DICTIONARY = 32, 8192
#: A toxic stretch begins words in this share of toxic texts at least, is so many times as frequent as
#: in ordinary ones, and has this log-likelihood ratio; so long and so many at most.
SHARE, CONTRAST, TELLING, STEM, STEMS = 0.01, 3.0, 40.0, 12, 200
MARKS = ".,;:!?\"'()[]{}<>"
THRESHOLDS = np.array([2, 4, 6, 8, 10, 12, 14, 16, 20])
_PARTNER = np.random.Generator(np.random.PCG64(3)).permutation(256).astype(np.uint8)


def doubled(b: bytes) -> bytes:
    a = np.frombuffer(b, np.uint8)
    out = np.empty((len(a), 2), np.uint8)
    out[:, 0], out[:, 1] = a, _PARTNER[a]
    return out.tobytes()


def windows(b: bytes) -> np.ndarray:
    """(start, length) of windows of about WINDOW bytes that end at white space where it is near."""
    a = np.frombuffer(b, np.uint8)
    n = len(a)
    cut = np.arange(WINDOW, n, WINDOW)
    gap = np.flatnonzero((a == 32) | (a == 10))
    if len(gap) and len(cut):
        j = np.searchsorted(gap, cut)
        e = np.where(j < len(gap), gap[np.minimum(j, len(gap) - 1)] + 1, n)
        cut = np.where(e - cut > WINDOW, cut, e)
    cut = np.unique(np.concatenate([[0], cut, [n]]))
    return np.stack([cut[:-1], np.diff(cut)], 1)


class Model:
    """Two dictionaries and the calibration; small, and pickled to the workers."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._made = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._made is None:
            made = []
            for content in (self.ordinary, self.toxic):
                content = doubled(content)
                kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(6, source_size=2 * WINDOW, dict_size=len(content), min_match=6, write_content_size=False, write_dict_id=False, write_checksum=False)
                made.append(zstandard.ZstdCompressor(dict_data=kept, compression_params=how))
            self._made = made
        return self._made

    def distances(self, text: str) -> np.ndarray:
        b = text.encode("utf-8", "surrogatepass").lower()
        if not b:
            return np.zeros(0, np.int64)
        at = windows(b)
        segments = zstandard.BufferWithSegments(doubled(b), (2 * at).astype(np.uint64).tobytes())
        plain, toxic = (c.multi_compress_to_buffer(segments) for c in self._compressors())
        n = len(at)
        return np.fromiter((len(plain[i]) - len(toxic[i]) for i in range(n)), np.int64, n)

    def features(self, text: str) -> np.ndarray:
        d = np.sort(self.distances(text))
        over = len(d) - np.searchsorted(d, THRESHOLDS)
        return np.concatenate([[1.0], np.log1p(over), np.minimum(over, 1), [np.log1p(len(d))]])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -35, 35))))


def _stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Word beginnings that set toxic texts apart, the most telling last.

    Greedy: take the beginning with the largest log-likelihood ratio of its document counts, drop
    the words it covers, and go on until none is significant, so endings of a chosen stem add nothing.
    """

    def counted(texts):
        words = Counter()
        for b in texts:
            words.update({w.strip(MARKS) for w in set(b.decode("utf-8", "replace").split())})
        return words

    words, plain = counted(toxic), counted(ordinary)
    stems = lambda w: [w[:k] for k in range(3, min(len(w), STEM) + 1)]
    often = Counter()
    for w, n in words.items():
        for g in stems(w):
            often[g] += n
    often = {g: n for g, n in often.items() if n >= max(5, SHARE * len(toxic))}
    rarely, under = Counter(), defaultdict(list)
    for w, n in plain.items():
        for g in stems(w):
            if g in often:
                rarely[g] += n
    for w in words:
        for g in stems(w):
            if g in often:
                under[g].append(w)

    share = len(toxic) / (len(toxic) + len(ordinary))

    def telling(g: str) -> float:
        a, b = often[g], rarely[g]
        if a <= 0 or a / len(toxic) < CONTRAST * b / len(ordinary):
            return 0.0
        return 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))

    out, gone, weight = [], set(), {g: telling(g) for g in often}
    while weight and len(out) < STEMS:
        g = max(weight, key=lambda g: (round(weight[g], 6), len(g), g))
        if weight[g] < TELLING:
            break
        out.append(f" {g}".encode())
        changed = set()
        for w in under[g]:
            if w not in gone:
                gone.add(w)
                for h in stems(w):
                    if h in often:
                        often[h] -= words[w]
                        rarely[h] -= min(rarely[h], plain[w])
                        changed.add(h)
        for h in changed:
            weight[h] = telling(h)
    return out[::-1]


def apart(texts: list[str]) -> list[str]:
    """texts without near copies of earlier ones, which would make chance words look frequent: those
    that share one of four least hashes of their runs of three words."""
    seen, out = set(), []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split()
        h = np.array([zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
        least = {(k, int((((h ^ np.uint64(k * 0x9E3779B1)) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(16)).min())) for k in range(4)}
        if not least & seen:
            out.append(t)
        seen |= least
    return out


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from three quarters of each class, the calibration from the rest. With too few
    labelled texts the score is the share of toxic ones for every text."""
    toxic, ordinary = (apart([t for t in c if t]) for c in (toxic, ordinary))
    n, width = len(toxic) + len(ordinary), 2 + 2 * len(THRESHOLDS)
    if min(len(toxic), len(ordinary)) < 8:
        p = (len(toxic) + 0.5) / (n + 1)
        return Model(b"  ", b"  ", np.append(np.log(p / (1 - p)), np.zeros(width - 1)))
    low = lambda c: [t.encode("utf-8", "surrogatepass").lower() for t in c]
    t, o = len(toxic) * 3 // 4, len(ordinary) * 3 // 4
    common = Counter(w for b in low(ordinary[:o]) for w in set(b.split()))
    base = b" ".join(w for w, _ in sorted(common.items(), key=lambda x: (x[1], x[0])))[-DICTIONARY:]
    model = Model(base + b" ", base + b" " + b" ".join(_stretches(low(toxic[:t]), low(ordinary[:o])))[-DICTIONARY:] + b" ", np.zeros(width))
    x = np.array([model.features(s) for s in toxic[t:] + ordinary[o:]])
    y = np.array([1.0] * (len(toxic) - t) + [0.0] * (len(ordinary) - o))
    w, ridge = np.zeros(width), 0.3 * np.eye(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    model.weights = w
    return model


def held_out(id_col):
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, toxic_chars: int = TOXIC_CHARS, ordinary_chars: int = ORDINARY_CHARS) -> Model:
    """Fit on at most toxic_rows and ordinary_rows labelled texts of so many characters together, chosen
    by a hash of their id, none held out.

    The ids are chosen from the labels alone; only their whole texts come to the driver, those that
    fit under the bound in order of the hash. A text longer than a fiftieth of the bound teaches
    nothing, so that one long text never takes the place of all others. Rows with a null id or label, and ids that have both
    labels, teach nothing; of rows that share an id one text does.
    """
    ids, named = [], numbered(labels)
    once = named.where(f"{place(labels, 'toxic')} in (0, 1)").groupBy(F.col(place(labels, id_col)).alias("id")).agg(F.min(place(labels, "toxic")).alias("low"), F.max(place(labels, "toxic")).alias("high")).where("id is not null and low = high")
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        rows = once.where((F.col("low") == label) & ~held_out(F.col("id")))
        ids += [(r[0], label) for r in rows.orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, f"chosen {docs.schema[id_col].dataType.simpleString()}, toxic int")
    # at most toxic_rows + ordinary_rows short rows, whatever the input
    texts = numbered(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text_col)).alias("text"))
    texts = texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).groupBy("id", "toxic").agg(F.min("text").alias("text")).where("text <> ''")
    # at most toxic_rows + ordinary_rows rows in these windows
    bound = F.when(F.col("toxic") == 1, toxic_chars).otherwise(ordinary_chars)
    texts = texts.where(F.length("text") * 50 <= bound)
    so_far = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    got = texts.withColumn("so_far", so_far).where(F.col("so_far") <= bound).select("id", "text", "toxic").collect()
    got = sorted(got, key=lambda r: (hash_order(r["id"]), r["text"]))
    return fit([r["text"] for r in got if r["toxic"] == 1], [r["text"] for r in got if r["toxic"] == 0])


def hash_order(value) -> int:
    return zlib.crc32(f"order:{value}".encode())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns and score (0 to 1, higher: toxic likelier), of the whole text alone.

    Null and empty texts get the score of a text without windows; repeated rows stay; an empty table
    gives no rows; a column named score, in any case, is replaced, and others, whatever their names,
    pass through. No shuffle.
    """
    kept = {f"c{i}": c for i, c in enumerate(docs.columns) if c.lower() != "score"}
    plain = numbered(docs).select(*kept)
    at = list(kept).index(place(docs, text_col))

    def run(batches):
        only("toxicity")
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])
        give_back()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, score double").toDF(*kept.values(), "score")
