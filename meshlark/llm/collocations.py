"""Phrase collocations by contiguous pattern growth, as in PrefixSpan.

Two scans of the texts and one shuffle of projections:

1. Words and pairs of words are counted by a 64-bit hash of (language, words). A hash's count is never
   below that of a phrase with it, so a pair whose hash is rare is rare. The hashes that are frequent
   enough become two bit fields of a fixed size. They only prune: a bit set for no reason costs time.
2. The occurrences of each pair that may be frequent are projected: the pair is the prefix, and its up
   to three next words, as far as each next pair may be frequent too, are what the pointer points at.
   Occurrences with equal words fold into one with a count within a task. Prefixes are dealt over
   buckets by a hash, as many as hold about BUCKET occurrences each, and travel in arrays by bucket.
   One task gets a prefix's whole projection and grows it to the right, depth first: a frequent next
   word gives a longer phrase, whose pointers are those that the word follows.

Prefixes with more than HOT occurrences are not gathered: their longer phrases are counted each by
itself, folded in the tasks before the shuffle, so that a frequent pair never fills a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import LOWER, UPPER, discard, give_back, numbered, only, place, written

#: Words in the longest phrase.
LONGEST = 5
#: Words gathered by a task before it folds and sends them.
FLUSH_WORDS = 1_500_000
#: Bits of each pruning field: 8 MiB, whatever the input.
FIELD_BITS = 1 << 26
#: Occurrences beyond which a prefix's phrases are counted apart.
HOT = 1 << 18
#: Occurrences in a bucket of prefixes, on average: bounds what a task holds.
BUCKET = 1_000_000
#: The marks that end a piece, besides the line breaks 0x0A to 0x0D.
MARKS = b".,;:!?"
_BREAK = b"."
_TABLE = bytes.maketrans(MARKS + b"\n\v\f\r\t" + UPPER.encode(), _BREAK * (len(MARKS) + 4) + b" " + LOWER.encode())
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
ROWS = 20_000


def words_of(text: bytes) -> list[bytes]:
    """The words, lower-cased, with a full stop for every end of a piece."""
    return text.translate(_TABLE).replace(_BREAK, b" . ").split()


class Numbers(dict):
    """word -> its number in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Some documents' words as numbers, 0 for an end of a piece."""

    def __init__(self) -> None:
        self.known, self.lang_of = Numbers({_BREAK: 0}), Numbers()
        self.parts: list[np.ndarray] = []
        self.of_part: list[int] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        words = words_of(text)
        words.append(_BREAK)
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.of_part.append(self.lang_of[lang])
        self.size += len(words)

    def closed(self) -> Block:
        self.ids = np.concatenate(self.parts)
        self.lang = np.repeat(np.array(self.of_part, np.int32), [len(p) for p in self.parts])
        self.parts, self.words, self.langs = [], list(self.known), list(self.lang_of)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        self.tongue = np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in self.langs], np.uint64)
        self.is_word = self.ids > 0
        self.is_pair = self.is_word[:-1] & self.is_word[1:]
        return self

    def word_hash(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.hashes[self.ids[at]] * _MULTIPLIERS[0] + self.tongue[self.lang[at]])

    def pair_hash(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.hashes[self.ids[at]] * _MULTIPLIERS[1] + self.hashes[self.ids[at + 1]] * _MULTIPLIERS[2] + self.tongue[self.lang[at]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def blocks(batches):
    """The documents of a task in blocks of about FLUSH_WORDS words."""
    block = Block()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            block.add(lang, text.as_py())
            if block.size >= FLUSH_WORDS:
                yield block.closed()
                block = Block()
    if block.size:
        yield block.closed()


def folded(columns: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each distinct row of whole numbers below top."""
    bits, keys, room = max(1, int(top).bit_length()), [], 0
    for c in columns:
        if keys and room >= bits:
            keys[-1] = keys[-1] << bits | c
            room -= bits
        else:
            keys.append(c.astype(np.int64))  # as many columns in one number as it has room for
            room = 63 - bits
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def hash_counts(rows: DataFrame) -> DataFrame:
    """(h, n): occurrences of words and of pairs by hash, from rows(lang, text)."""

    def scan(batches):
        only("collocations")
        for block in blocks(batches):
            h, n = np.unique(np.concatenate([block.word_hash(np.flatnonzero(block.is_word)), block.pair_hash(np.flatnonzero(block.is_pair))]), return_counts=True)
            for i in range(0, len(h), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + ROWS].view(np.int64)), pa.array(n[i : i + ROWS].astype(np.int64))], ["h", "n"])
        give_back()

    return rows.mapInArrow(scan, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def pruning_fields(counts: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the bit fields that are not zero: their places, the frequent bits, the hot bits.

    At most FIELD_BITS / 64 rows come to the driver, whatever the input.
    """
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    fields = (
        counts.groupBy(F.expr(f"shiftright(h & {FIELD_BITS - 1}L, 6)").alias("w"))
        .agg(F.bit_or(bit).alias("frequent"), F.bit_or(F.when(F.col("n") >= hot, bit).otherwise(F.lit(0).cast("long"))).alias("hot"))
        .toArrow()
    )
    return tuple(fields.column(c).to_numpy() for c in ("w", "frequent", "hot"))


def _field(w: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(FIELD_BITS // 64, np.uint64)
    out[w] = bits.view(np.uint64)
    return out


def _set_in(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (field[(h & np.uint64(FIELD_BITS - 1)) >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def projections(rows: DataFrame, fields: tuple, buckets: int) -> DataFrame:
    """(bucket, lang, prefix, suffix, n), the last three arrays, from rows(lang, text).

    Without a suffix an entry only counts its prefix: a word, or a phrase that begins with a hot pair;
    an empty prefix counts the language's words. Else it stands for n occurrences of the pair with the
    words after it.
    """
    shared = rows.sparkSession.sparkContext.broadcast(fields)
    texts = pa.list_(pa.string())

    def sent(langs: list[str], key: np.ndarray, prefix: list, suffix: list, n: np.ndarray):
        """Entries in the order of key, which is bucket * languages + language."""
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        offsets = pa.array(np.append(start, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(prefix, pa.binary()).cast(pa.string()), pa.array(suffix, pa.binary()).cast(pa.string()), pa.array(n))]
        key = key[start]
        return pa.RecordBatch.from_arrays([pa.array(key // len(langs)), pa.array([langs[x] for x in (key % len(langs)).tolist()], pa.string()), lists[0].cast(texts), lists[1].cast(texts), lists[2]], ["bucket", "lang", "prefix", "suffix", "n"])

    def scan(batches):
        only("collocations")
        w, frequent, hot = shared.value
        frequent, hot = _field(w, frequent), _field(w, hot)
        for block in blocks(batches):
            words, langs, top = block.words, block.langs, max(len(block.words), len(block.langs))
            key_of = lambda h, lang: (h % np.uint64(buckets)).astype(np.int64) * len(langs) + lang
            lang_n = np.bincount(block.lang[block.is_word], minlength=len(langs))
            live = np.flatnonzero(lang_n)
            key = key_of(block.tongue[live], live)
            order = np.argsort(key)
            if len(live):
                yield sent(langs, key[order], [b""] * len(live), [None] * len(live), lang_n[live[order]].astype(np.int64))
            at = np.flatnonzero(block.is_word)
            at = at[_set_in(frequent, block.word_hash(at))]
            first, n = folded([block.lang[at], block.ids[at]], top)
            at = at[first]
            key = key_of(block.word_hash(at), block.lang[at])
            order = np.argsort(key, kind="stable")
            for i in range(0, len(order), ROWS):
                some = order[i : i + ROWS]
                yield sent(langs, key[some], [words[x] for x in block.ids[at[some]].tolist()], [None] * len(some), n[some])
            at = np.flatnonzero(block.is_pair)
            at = at[_set_in(frequent, block.pair_hash(at))]
            ids = np.append(block.ids, np.zeros(LONGEST, np.int32))
            live = np.zeros(len(ids), bool)
            live[at] = True
            reach = np.ones(len(at), bool)
            columns = [block.lang[at], ids[at], ids[at + 1]]
            for k in range(2, LONGEST):  # the next word belongs to it as long as its pair may be frequent
                reach &= live[at + k - 1]
                columns.append(np.where(reach, ids[at + k], 0))
            first, n = folded(columns, top)
            h = block.pair_hash(at[first])
            is_hot, columns = _set_in(hot, h), [c[first] for c in columns]
            key = key_of(h, columns[0])
            cold = np.flatnonzero(~is_hot)
            cold = cold[np.argsort(key[cold], kind="stable")]
            for i in range(0, len(cold), ROWS):
                some = cold[i : i + ROWS]
                prefix, suffix = [], []
                for a, b, *more in zip(*(c[some].tolist() for c in columns[1:]), strict=True):
                    prefix.append(words[a] + b" " + words[b])
                    suffix.append(b" ".join([words[x] for x in more if x]))
                yield sent(langs, key[some], prefix, suffix, n[some])
            for k in range(3, LONGEST + 2):  # columns: the language and the first k - 1 words
                very = np.flatnonzero(is_hot & (columns[k - 1] > 0))
                if not len(very):
                    continue
                first, _ = folded([c[very] for c in columns[:k]], top)
                number = {p: i for i, p in enumerate(zip(*(c[very[first]].tolist() for c in columns[:k]), strict=True))}
                mine = np.fromiter(map(number.__getitem__, zip(*(c[very].tolist() for c in columns[:k]), strict=True)), np.int64, len(very))
                counts = np.bincount(mine, weights=n[very], minlength=len(number)).astype(np.int64)
                phrases = [b" ".join([words[x] for x in p]) for _, *p in number]
                lang = columns[0][very[first]]
                key = key_of(np.array([xxhash.xxh3_64_intdigest(p) for p in phrases], np.uint64), lang)
                order = np.argsort(key, kind="stable")
                for i in range(0, len(order), ROWS):
                    some = order[i : i + ROWS]
                    yield sent(langs, key[some], [phrases[x] for x in some.tolist()], [None] * len(some), counts[some])
        give_back()

    return rows.mapInArrow(scan, "bucket long, lang string, prefix array<string>, suffix array<string>, n array<long>")


def grown(prefix: bytes, suffixes: list[bytes], n: np.ndarray, min_count: int) -> list[tuple[bytes, int]]:
    """The frequent phrases that begin with prefix, grown to the right depth first, with their counts."""
    total = int(n.sum())
    if total < min_count:
        return []
    out, known = [(prefix, total)], Numbers({b"": 0})
    arena = np.zeros((len(suffixes), LONGEST - 2), np.int64)
    for i, s in enumerate(suffixes):
        if s:
            for j, word in enumerate(s.split(b" ")):
                arena[i, j] = known[word]
    words = list(known)

    def extend(phrase: bytes, pointers: np.ndarray, depth: int) -> None:
        following = arena[pointers, depth]
        pointers, following = pointers[following > 0], following[following > 0]
        if not len(pointers):
            return
        order = np.argsort(following, kind="stable")
        pointers, following = pointers[order], following[order]
        start = np.flatnonzero(np.append(True, following[1:] != following[:-1]))
        for k, (a, count) in enumerate(zip(start.tolist(), np.add.reduceat(n[pointers], start).tolist(), strict=True)):
            if count >= min_count:
                longer = phrase + b" " + words[following[a]]
                out.append((longer, count))
                if depth + 1 < LONGEST - 2:
                    extend(longer, pointers[a : start[k + 1] if k + 1 < len(start) else len(pointers)], depth + 1)

    extend(prefix, np.arange(len(suffixes)), 0)
    return out


def frequent_phrases(rows: DataFrame, min_count: int, hot: int = HOT) -> DataFrame:
    """(lang, phrase, a): every phrase of 1 to LONGEST words with a >= min_count occurrences, from
    rows(lang, text); and with a null phrase each language's number of words."""

    def mined(lang: str, lists: list[list[pa.Array]]):
        """The frequent phrases of a bucket's prefixes in one language."""
        prefix, suffix, n = (pa.concat_arrays(x) for x in lists)
        order = pc.sort_indices(prefix)
        prefix, suffix, n = prefix.take(order), suffix.take(order).cast(pa.binary()), n.take(order).to_numpy()
        cuts = [0, *(np.flatnonzero(pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(prefix)]
        out: list[tuple[bytes | None, int]] = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            total = int(n[i:j].sum())
            if suffix[i].is_valid:
                if total >= min_count:
                    out += grown(prefix[i].as_py().encode(), suffix[i:j].to_pylist(), n[i:j], min_count)
            elif not (head := prefix[i].as_py()):
                out.append((None, total))
            elif total >= min_count:
                out.append((head.encode(), total))
        for i in range(0, len(out), ROWS):
            phrase, a = zip(*out[i : i + ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(a, pa.int64())], ["lang", "phrase", "a"])

    def mine(batches):
        only("collocations")
        now, held = None, ([], [], [])
        for batch in batches:
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != now:
                    if now is not None:
                        yield from mined(now[1], held)
                    now, held = key, ([], [], [])
                for lists, c in zip(held, batch.columns[2:], strict=True):
                    lists.append(c[i].values)
        if now is not None:
            yield from mined(now[1], held)
        give_back()

    counts = written(hash_counts(rows).where(F.col("n") >= min_count), "pair-hashes", 2)
    fields = pruning_fields(counts, hot)
    occurrences = counts.where(F.col("n") < hot).agg(F.sum("n")).first()[0] or 0
    discard(counts)
    buckets = -(-int(occurrences) // BUCKET) + 1
    dealt = projections(rows, fields, buckets).repartition("bucket").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(mine, "lang string, phrase string, a long")


def collocations(docs: DataFrame, min_count: int = 100, top: int | None = None, lang_col: str = "lang", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line breaks into pieces and those at spaces and
    tabs into words. Candidates are the phrases of 2 to 5 words with a >= min_count contiguous
    occurrences within pieces. Cut after its first k words, a candidate scores
    floor(1000 * a * n / (l * r)), with l and r the occurrences of both parts and n all words of the
    language; the lowest-scoring cut counts, the least k at equal scores. A candidate inside a longer
    one with as many occurrences goes. rank orders by score and a, both falling, then by phrase in byte
    order; with ``top``, only so many of each language are returned.

    A null language is ``und``, a null text empty; ids are not read, so rows that repeat count as often
    as they come; other columns, whatever their names, are not read. An empty table gives no rows.
    Numbers are exact: products are 38-digit decimals.
    """
    plain = numbered(docs)
    rows = plain.select(F.coalesce(F.col(place(docs, lang_col)).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(place(docs, text_col)), F.lit("")).alias("text"))
    found = written(frequent_phrases(rows, min_count, hot), "phrases")
    f = found.where("phrase is not null")
    totals = found.where("phrase is null").select("lang", F.col("a").alias("n"))
    cand = f.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = f.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = f.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    big = lambda c, digits=19: f"cast({c} as decimal({digits},0))"
    score = F.expr(f"({big('a * 1000')} * {big('n', 18)}) div ({big('l')} * {big('r', 18)})")
    scored = (
        cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    )
    shorter = cand.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    left_over = scored.join(shorter, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left_over.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
