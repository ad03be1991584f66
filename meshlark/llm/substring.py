"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words (7), which are the index; every
rolling window of BLOCK words of every document probes it. A repeat of WINDOW = 13 = 2 * 7 - 1 words
always holds one whole block of the document it repeats, so no repeat is missed. A probe that meets
a block of a smaller document is an anchor, and so is a block that a larger document's probe meets.
Anchors are then extended word by word: all 13-word windows around them are compared by a wide hash,
and overlapping equal windows are joined into maximal repeats.

No pairs of documents are made: both comparisons keep, for each hash, only the least and the largest
document, first within a task and then within a shuffle partition. A line in a third of all documents
thus sends a few entries from each task. Hashes go through the shuffle as packed arrays: four bytes
and a position difference for each window.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import give_back, numbered, only, place, remembers, shuffle_partitions

WINDOW = 13
#: Words gathered by a task before it sends its packed arrays; bounds its memory.
FLUSH_WORDS = 700_000
TOP = np.iinfo(np.int64).max
_MULTIPLIERS = np.random.Generator(np.random.PCG64(20240)).integers(1, 2**63, size=(3, 64), dtype=np.uint64) | np.uint64(1)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """word -> 64-bit hash; emptied when full, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
remembers("substring", _HASHES.clear)


def words_of(text: str) -> list[bytes]:
    """Maximal runs without space, tab and the other ASCII line and page breaks, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def rolled(h: np.ndarray, size: int, which: int) -> np.ndarray:
    """Hash of each window of size words, by the place it starts at."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j : j + n] * _MULTIPLIERS[which, j]
    return mixed(out)


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def unsqueeze(b: bytes, kind: type) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def joined(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def parted(b: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", b)
    sizes, at, out = struct.unpack_from(f"<{n}I", b, 4), 4 + 4 * n, []
    for s in sizes:
        out.append(b[at : at + s])
        at += s
    return out


def pack(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, hashes: list[np.ndarray]) -> bytes:
    """Entries in document order as one array each of documents, position differences and hashes."""
    new = np.empty(len(doc), bool)
    new[:1] = True
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(doc))).astype(np.uint32)
    step = np.diff(pos, prepend=0).astype(np.int64)
    step[first] = pos[first]
    return joined([squeeze(doc[first].astype(np.int64)), squeeze(tag[first].astype(np.uint32)), squeeze(counts), squeeze(step.astype(np.int32)), *[np.ascontiguousarray(h).tobytes() for h in hashes]])


def unpack(b: bytes, kinds: tuple = ()) -> tuple[np.ndarray, ...]:
    docs, tags, counts, step, *hashes = parted(b)
    docs, tags, counts = unsqueeze(docs, np.int64), unsqueeze(tags, np.uint32), unsqueeze(counts, np.uint32)
    pos = np.cumsum(unsqueeze(step, np.int32).astype(np.int64))
    first = np.cumsum(counts) - counts
    base = np.repeat(np.where(first > 0, pos[first - 1], 0), counts) if len(counts) else pos
    return np.repeat(docs, counts), np.repeat(tags, counts), pos - base, *[np.frombuffer(h, k) for h, k in zip(hashes, kinds, strict=True)]


def home(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group that a document's results meet in."""
    return (mixed(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def dealt(key: np.ndarray, *columns: np.ndarray):
    """(key, columns) of each group of equal keys; order within a group stays."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield [c[at] for c in columns], at


SENT = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SENT.types, strict=True)], schema=SENT)


def homeward(doc, tag, pos, groups: int, kind: int):
    """Rows that carry (document, position) to the documents' home groups."""
    key = home(doc, groups)
    for (d, t, p), at in dealt(key, doc, tag, pos):
        order = np.lexsort((p, t, d))
        yield int(key[at[0]]), kind, pack(d[order], t[order], p[order], [])


def extremes(order_key: np.ndarray, doc: np.ndarray, low_of: np.ndarray):
    """For each entry, the least of low_of and the largest document among the entries of equal key,
    and whether the entry is the first that reaches one of them."""
    order = np.argsort(order_key, kind="stable")
    k = order_key[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(k)))
    low, high = np.minimum.reduceat(low_of[order], starts), np.maximum.reduceat(doc[order], starts)
    out_low, out_high, lead = np.empty_like(doc), np.empty_like(doc), np.zeros(len(doc), bool)
    out_low[order], out_high[order] = np.repeat(low, sizes), np.repeat(high, sizes)
    index = np.arange(len(k))
    for value, best in ((low_of[order], np.repeat(low, sizes)), (doc[order], np.repeat(high, sizes))):
        at = np.where((value == best) & (value != TOP), index, len(k))
        firsts = np.minimum.reduceat(at, starts)
        lead[order[firsts[firsts < len(k)]]] = True
    return out_low, out_high, lead


def _probes(batches, groups: int, window: int):
    """Packed rolling block hashes of each document, dealt by hash; anchors already found go home."""
    block = (window + 1) // 2

    def flush():
        n = np.array([len(h) for h in hs], np.int64)
        h, ids, tags = np.concatenate(hs), np.repeat(np.array(docs, np.int64), n), np.repeat(np.array(marks, np.uint32), n)
        at = np.concatenate([np.arange(k) for k in n])
        left = np.repeat(n, n) - at
        key = rolled(h, block, 0)
        ok = np.flatnonzero(left[: len(key)] >= block)
        key, ids, tags, at = key[ok], ids[ok], tags[ok], at[ok]
        if not len(key):
            return []
        aligned = at % block == 0
        low, high, lead = extremes(key, ids, np.where(aligned, ids, TOP))
        hit = (low < ids) | (aligned & (high > ids))
        rows = list(homeward(ids[hit], tags[hit], at[hit], groups, 1))
        go = ~hit | lead
        key, ids, tags, at = key[go], ids[go], tags[go], at[go]
        part = (key >> np.uint64(32)) % np.uint64(groups)
        for (k, d, t, p), i in dealt(part, key, ids, tags, at):
            rows.append((int(part[i[0]]), 0, pack(d, t, p, [k.astype(np.uint32)])))
        return rows

    only("substring")
    hs, docs, marks, total = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if doc is None or not text:
                continue
            words = words_of(text)
            if len(words) < window:
                continue
            hs.append(hashed(words))
            docs.append(doc)
            marks.append(xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")))
            total += len(words)
            if total >= FLUSH_WORDS:
                yield sent(flush())
                hs, docs, marks, total = [], [], [], 0
    if hs:
        yield sent(flush())
    hs, docs, marks = [], [], []
    give_back()


def _gathered(table: pa.Table, kinds: tuple):
    """The packed entries of kind 0, and the rows of kind 1 as they are."""
    parts, through = [], []
    for key, kind, data in zip(*(table.column(c).to_pylist() for c in ("key", "kind", "data")), strict=True):
        if kind == 0:
            parts.append(unpack(data, kinds))
        else:
            through.append((key, 1, data))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None, through


def _anchors(table: pa.Table, groups: int, window: int) -> pa.Table:
    got, rows = _gathered(table, (np.uint32,))
    if got:
        ids, tags, at, key = got
        aligned = at % ((window + 1) // 2) == 0
        low, high, _ = extremes(key, ids, np.where(aligned, ids, TOP))
        hit = (low < ids) | (aligned & (high > ids))
        rows += homeward(ids[hit], tags[hit], at[hit], groups, 1)
        del got, ids, tags, at, key, aligned, low, high, hit
    give_back()
    return pa.Table.from_batches([sent(rows)])


def _spread(places: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n places lie from before each given place to after it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(places - before, 0, n), 1)
    np.add.at(edge, np.clip(places + after + 1, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _found(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Positions by (document, tag)."""
    out: dict[tuple[int, int], list] = {}
    for data in table.column("data").to_pylist():
        d, t, p = unpack(data)
        cuts = np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1
        for x, y in zip(np.append(0, cuts), np.append(cuts, len(d)), strict=True) if len(d) else ():
            out.setdefault((int(d[x]), int(t[x])), []).append(p[x:y])
    return {k: np.concatenate(v) for k, v in out.items()}


def _windows(anchors: pa.Table, docs: pa.Table, groups: int, window: int) -> pa.Table:
    """The wide hashes of the windows around each anchor, dealt by hash; repeats already found go home."""
    block = (window + 1) // 2
    places, opened, entries = _found(anchors), zstandard.ZstdDecompressor(), []
    for doc, tag, packed in zip(*(docs.column(c).to_pylist() for c in ("doc", "tag", "packed")), strict=True):
        at = places.pop((doc, tag), None) if doc is not None else None
        if at is None:
            continue
        h = hashed(opened.decompress(packed).split())
        n = len(h) - window + 1
        near = np.flatnonzero(_spread(at, window - block, 0, n))
        entries.append((np.full(len(near), doc, np.int64), np.full(len(near), tag, np.uint32), near, rolled(h, window, 1)[near], rolled(mixed(h), window, 2)[near]))
    if not entries:
        return pa.Table.from_batches([sent([])])
    ids, tags, at, key, more = (np.concatenate(c) for c in zip(*entries, strict=True))
    low, _, lead = extremes(key ^ (more << np.uint64(1)), ids, ids)
    hit = low < ids
    rows = list(homeward(ids[hit], tags[hit], at[hit], groups, 1))
    go = ~hit | (lead & (low == ids))
    ids, tags, at, key, more = ids[go], tags[go], at[go], key[go], more[go]
    part = more % np.uint64(groups)
    for (k, m, d, t, p), i in dealt(part, key, more, ids, tags, at):
        rows.append((int(part[i[0]]), 0, pack(d, t, p, [k, (m >> np.uint64(32)).astype(np.uint32)])))
    del ids, tags, at, key, more, low, lead, hit, go, part, entries
    give_back()
    return pa.Table.from_batches([sent(rows)])


def _repeats(table: pa.Table, groups: int) -> pa.Table:
    got, rows = _gathered(table, (np.uint64, np.uint32))
    if got:
        ids, tags, at, key, more = got
        low, _, _ = extremes(key ^ (more.astype(np.uint64) << np.uint64(13)), ids, ids)
        hit = low < ids
        rows += homeward(ids[hit], tags[hit], at[hit], groups, 1)
        del got, ids, tags, at, key, more, low, hit
    give_back()
    return pa.Table.from_batches([sent(rows)])


def _packed(batches, groups: int):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        docs, texts = batch.column(0), [None if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        ids = docs.to_pylist()  # rows with a null id meet nothing, so any group does: they are spread
        key = home(np.array([k if d is None else d for k, d in enumerate(ids)], np.int64), groups)
        tags = [0 if t is None else xxhash.xxh32_intdigest(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), docs, pa.array(tags, pa.int64()), pa.array([None if t is None else z.compress(t) for t in texts], pa.binary()), *batch.columns[2:]], ["key", "doc", "tag", "packed", *batch.schema.names[2:]])


def _cut(text: bytes, gone: np.ndarray) -> tuple[bytes, list[dict]]:
    """The text without the marked words, and their runs: kept stretches stay as they are, a blank between."""
    spans = np.array([m.span() for m in WORDS.finditer(text)], np.int64).reshape(-1, 2)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    out, at = [], 0
    for first, stop in runs:
        out.append(text[at : spans[first, 0]].rstrip() if first else b"")
        at = spans[stop, 0] if stop < len(spans) else len(text)
    out.append(text[at:])
    return b" ".join(x for x in out if x), [{"first": int(a), "stop": int(b)} for a, b in runs]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, output: str = "text") -> DataFrame:
    """Remove every word under a window of ``window`` (odd) words that also starts in a document of smaller id.

    output "text": the input's columns with the text cut, plus removed, the removed runs of words
    [first, stop). output "digest": id, n_words, n_removed, kept_sha256 (kept words, one blank
    between). All windows are judged on the input.

    Null text has no words and stays null; texts under a window lose nothing; a row with a null id
    neither loses nor removes anything; rows that share an id do not remove one another's words;
    repeated rows stay; an empty table gives no rows. A column named removed, in any case, is replaced;
    others, whatever their names, pass through.
    """
    import hashlib

    spark = docs.sparkSession
    groups = shuffle_partitions(spark) * 3 // 2
    rows, doc, text = numbered(docs), place(docs, id_col), place(docs, text_col)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rest = [c for c, name in names.items() if c not in (doc, text) and name.lower() != "removed"] if output == "text" else []
    base = rows.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    kind = "key long, kind int, data binary"
    carried = rows.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), *rest)
    fields = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    packed = carried.mapInArrow(lambda it: _packed(it, groups), f"key long, doc long, tag long, packed binary{fields}")

    probes = base.mapInArrow(lambda it: _probes(it, groups, window), kind)
    anchors = probes.groupBy("key").applyInArrow(lambda t: _anchors(t, groups, window), kind)
    texts = packed.select("key", "doc", "tag", "packed") if rest else packed
    windows = anchors.groupBy("key").cogroup(texts.groupBy("key")).applyInArrow(lambda a, d: _windows(a, d, groups, window), kind)
    repeats = windows.groupBy("key").applyInArrow(lambda t: _repeats(t, groups), kind)

    def finish(found: pa.Table, texts: pa.Table) -> pa.Table:
        places, opened, cols = _found(found), zstandard.ZstdDecompressor(), []
        for doc, tag, z in zip(*(texts.column(c).to_pylist() for c in ("doc", "tag", "packed")), strict=True):
            text = None if z is None else opened.decompress(z)
            at = places.get((doc, tag)) if doc is not None else None
            if output == "text":
                cut, runs = (text, []) if at is None else _cut(text, _spread(at, 0, window - 1, len(text.split())))
                cols.append((None if cut is None else cut.decode("utf-8", "surrogatepass"), runs))
                continue
            words = (text or b"").split()
            gone = np.zeros(len(words), bool) if at is None else _spread(at, 0, window - 1, len(words))
            kept = words if at is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            cols.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*cols, strict=True)) or [[]] * (2 if output == "text" else 3)
        if output == "text":
            runs = pa.array(cols[1], pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])))
            return pa.Table.from_arrays([texts.column("doc"), pa.array(cols[0], pa.string()), *[texts.column(c) for c in rest], runs], names=["doc", "text", *rest, "removed"])
        return pa.Table.from_arrays([texts.column("doc"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc", "n_words", "n_removed", "kept_sha256"])

    result = f"doc long, text string{fields}, removed array<struct<first:bigint,stop:bigint>>" if output == "text" else "doc long, n_words long, n_removed long, kept_sha256 string"
    out = repeats.groupBy("key").cogroup(packed.groupBy("key")).applyInArrow(finish, result)
    if output == "text":
        back = {doc: F.col("doc").cast(rows.schema[doc].dataType), text: F.col("text")} | {c: F.col(c) for c in rest}
        kept = [c for c in names if c in back]
        return out.select(*[back[c].alias(c) for c in kept], "removed").toDF(*[names[c] for c in kept], "removed")
    return out.withColumnRenamed("doc", id_col)
