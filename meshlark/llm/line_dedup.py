"""Line dedup with two Bloom filters: lines seen once, and lines seen again.

A first scan fills both filters with 64-bit hashes of the lines' keys; a second one looks every line up
in the filter of those seen twice. Only the lines found there, the suspected repeats, go through a
shuffle: a 128-bit digest of the key and the document confirm that the key is in enough documents and
say which of them keeps it.

The filters are split over the range of the hash into parts of one size, as many as the number of lines
asks for, so no task holds more than one part of both. A key that one task meets a second time counts as
seen twice there and reaches its part once a flush, however frequent it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm.common import discard, give_back, numbered, only, place, written

#: Bits of one part of a filter, the lines that it is made for (12 bits a line: 0.7 % are suspected wrongly), and its probes.
BITS = 1 << 23
LINES = BITS // 12
PROBES = 4
#: A filter of at most this many parts (1 MiB each) is sent to all tasks; beyond, the lines go to the parts.
BROADCAST_PARTS = 32
#: Lines gathered by a task before it sends their hashes.
FLUSH = 1_000_000
#: What is stripped from both ends of a line.
BLANK = b" \t\n\v\f\r"


def key_of(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def long_enough(key: bytes, chars: int) -> bool:
    """Whether the key has that many code points, each of 1 to 4 bytes."""
    return len(key) >= 4 * chars or (len(key) >= chars and sum(b & 0xC0 != 0x80 for b in key) >= chars)


def keys(text: bytes | None, chars: int) -> list[bytes | None]:
    """Of each line its key, or None where it is too short."""
    return [k if long_enough(k := key_of(line), chars) else None for line in (text or b"").split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """parts is a power of two: the hash's first bits."""
    return (h >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)


def probes(h: np.ndarray) -> np.ndarray:
    """The places of each hash in its part."""
    step = (h >> np.uint64(23)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def distinct_hashes(texts: list[bytes | None], chars: int) -> tuple[list[int], list[bytes], list[int]]:
    """Hash, key and place of the text, once for each key of each text."""
    hashes, found, at = [], [], []
    for i, text in enumerate(texts):
        for k in {k for k in keys(text, chars) if k is not None}:
            hashes.append(xxhash.xxh3_64_intdigest(k))
            found.append(k)
            at.append(i)
    return hashes, found, at


def seen_twice(rows: DataFrame, parts: int, chars: int) -> DataFrame:
    """The filter of keys seen twice: (part, bits), from rows(id, text)."""

    def sent(hashes: list[int]):
        h, n = np.unique(np.array(hashes, np.uint64), return_counts=True)
        cuts = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
        live = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(live, pa.int64()),
                pa.array([h[cuts[p] : cuts[p + 1]].tobytes() for p in live], pa.binary()),
                pa.array([(n[cuts[p] : cuts[p + 1]] > 1).tobytes() for p in live], pa.binary()),
            ],
            ["part", "hashes", "again"],
        )

    def scan(batches):
        only("line_dedup")
        held: list[int] = []
        for batch in batches:
            held += distinct_hashes(batch.column(1).cast(pa.binary()).to_pylist(), chars)[0]
            if len(held) >= FLUSH:
                yield sent(held)
                held = []
        if held:
            yield sent(held)
        give_back()

    def fill(batches):
        only("line_dedup")
        part, once, twice = None, np.zeros(0, bool), np.zeros(0, bool)
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            for p, hashes, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield bits()
                    part, once, twice = p, np.zeros(BITS, bool), np.zeros(BITS, bool)
                at = probes(np.frombuffer(hashes, np.uint64))
                seen = once[at].all(axis=1) | np.frombuffer(again, bool)
                twice[at[seen]] = True
                once[at] = True
        if part is not None:
            yield bits()
        give_back()

    packed = rows.select("id", "text").mapInArrow(scan, "part long, hashes binary, again binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(fill, "part long, bits binary")


def held_in(bits: bytes, at: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(bits, np.uint8)
    return ((raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def suspects(rows: DataFrame, seen: DataFrame, parts: int, chars: int, kind: str, broadcast_parts: int) -> DataFrame:
    """(id, digest) of every key of every text of rows(id, text) that may be in two texts.

    A filter of at most broadcast_parts parts goes to all tasks. Of a larger one the keys go to their
    part, but for those that a batch holds twice: these are repeats whatever the filter says.
    """
    small = parts <= broadcast_parts
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast({r["part"]: bytes(r["bits"]) for r in seen.collect()} if small else {})

    def scan(batches):
        only("line_dedup")
        for batch in batches:
            hashes, found, at = distinct_hashes(batch.column(1).cast(pa.binary()).to_pylist(), chars)
            if not hashes:
                continue
            h = np.array(hashes, np.uint64)
            part = part_of(h, parts)
            _, back, n = np.unique(h, return_inverse=True, return_counts=True)
            suspect = n[back.reshape(-1)] > 1
            ask = np.zeros(len(h), bool)
            if small:
                for p in np.unique(part):
                    here = np.flatnonzero(part == p)
                    if p in sent.value:
                        suspect[here] |= held_in(sent.value[p], probes(h[here]))
            else:
                ask = ~suspect
            take = np.flatnonzero(suspect | ask)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.array(at, np.int64)[take])),
                    pa.array([digest(found[i]) for i in take], pa.binary()),
                    pa.array(part[take], pa.int64(), mask=~ask[take]),
                    pa.array(h[take].view(np.int64), pa.int64()),
                ],
                ["id", "digest", "part", "h"],
            )
        give_back()

    def answer(batches):
        only("line_dedup")
        bits = b""
        for batch in batches:
            part, h = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            keep = np.zeros(len(part), bool)
            ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for i, j in zip([0, *ends], ends, strict=False):
                if batch.column(4)[i].is_valid:  # a part's filter comes before the keys that ask for it
                    bits = batch.column(4)[i].as_py()
                    i += 1
                keep[i:j] = held_in(bits, probes(h[i:j]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["id", "digest"])
        give_back()

    out = rows.select("id", "text").mapInArrow(scan, f"id {kind}, digest binary, part long, h long")
    if small:
        return out.select("id", "digest")
    out = written(out, "lines")
    filters = seen.select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast("binary").alias("digest"), "part", F.lit(0).cast("long").alias("h"), "bits")
    asked = out.where("part is not null").withColumn("bits", F.lit(None).cast("binary")).unionByName(filters)
    answered = asked.repartition("part").sortWithinPartitions("part", F.col("bits").isNull()).mapInArrow(answer, f"id {kind}, digest binary")
    return out.where("part is null").select("id", "digest").unionByName(answered)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_parts: int = BROADCAST_PARTS) -> DataFrame:
    """docs without the lines that repeat in other documents; adds n_lines (before) and n_dropped.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. A key of at least
    min_chars code points that is in at least min_docs (2 or more) documents loses all its lines but
    those of the document with the largest id that holds it. Lines end at a line feed only.

    Rows that repeat an id are one document; all rows without an id are one document, below every
    other. A null text is one empty line and stays null. Input columns named n_lines or n_dropped, in
    any case, are replaced; others, whatever their names, pass through. An empty table gives no rows.
    Texts of any length are read whole. Equality is that of a 128-bit digest of the key.
    """
    if min_docs < 2:
        raise ValueError("a repeat is in two documents at least")
    plain = numbered(docs)
    i, t = place(docs, id_col), place(docs, text_col)
    kind = plain.schema[i].dataType.simpleString()
    rows = plain.select(F.col(i).alias("id"), F.col(t).alias("text"))
    lines = plain.agg(F.sum(F.length(t) - F.length(F.replace(F.col(t), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    parts = 1 << max(0, -(-int(lines) // LINES) - 1).bit_length()
    seen = written(seen_twice(rows, parts, min_chars), "seen-twice", 8)
    found = written(suspects(rows, seen, parts, min_chars, kind, broadcast_parts), "suspects", 4)
    discard(seen)
    confirmed = found.groupBy("digest").agg(F.countDistinct(F.struct("id")).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    confirmed = written(confirmed, "repeats", 8)  # a table, so that a join with a frequent line can be split
    gone = found.distinct().join(confirmed, "digest").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_list("digest").alias("gone"))

    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_dropped")]
    names = [docs.columns[k] for k in kept]
    fields = [T.StructField(f"c{k}", plain.schema[f"c{k}"].dataType) for k in kept]
    at = [f"c{k}" for k in kept].index(t)

    def cut(batches):
        only("line_dedup")
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [x for x, k in zip(lines, keys(text, min_chars), strict=True) if k is None or digest(k) not in drop]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(text)
            columns = batch.columns[: len(kept)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*(f.name for f in fields), "n_lines", "n_dropped"])
        give_back()

    joined = plain.join(gone, plain[i].eqNullSafe(gone["id"]), "left").select(*(f.name for f in fields), "gone")
    out = joined.mapInArrow(cut, T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
    return out.toDF(*names, "n_lines", "n_dropped")
