"""Alignment of two tokenizers' tokens over the same bytes, relationally.

The core is plain relational algebra over tokens (``aligned``): the tokens of both sides are exploded with the
byte where each ends and put in order of it by a window; a byte where both sides end is a cut, and a running count of the
cuts before a token is its group's number. Its texts are dealt out once; all of that runs in one stage with one sort.
``summed_up`` reads each text's tokens in that order and forms its groups and linked id pairs.

It does not run over whole documents, which repeat the same words all over, but over their distinct
chunks. A chunk is a space and what follows it up to the next one, where that cut is safe: neither
tokenizer has a token over the border of a printed character and a space, and a chunk's tokens do not
depend on its neighbours (a text with the sign U+2581, which sentencepiece takes for a space, is never
spelled, so its cuts do not matter). So a document's tokens, groups and links are those of its chunks, one after
the other. Scan tasks number the chunks of a block of documents; chunks meet their results by a join on
the chunk's number; a block's documents meet its numbered results by a shuffle on the block.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from meshlark.llm.common import discard, give_back, numbered, only, place, release, remembers, shuffle_partitions, written
from meshlark.llm.substring import squeeze, unsqueeze
from meshlark.llm.token_counts import byte_chars

#: The white space beyond ASCII, in UTF-8.
WIDE = (rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80")
#: A space after a printed character and before one or wide white space: where a text is cut.
CUT = re.compile(rb"(?<=[^\x00-\x20])" + b"".join(rb"(?<!" + w + rb")" for w in WIDE) + rb" (?=[^\x00-\x20])")
#: Spaces that are no such cuts; without them all spaces are.
OTHER = re.compile(rb" [\x00-\x20]|[\x00-\x20] |\A | \Z|(?:" + b"|".join(WIDE) + rb") ")
#: Chunks of a block: distinct ones, and all.
BLOCK_DISTINCT, BLOCK_CHUNKS = 1_000_000, 16_000_000
#: Distinct chunks for each partition of the relational core.
CHUNKS_A_PARTITION = 150_000
#: So many pairs of ids (16 bytes each) are sent to all tasks; more of them meet their links in a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Groups of more links are held as their different pairs and how often each occurs.
LARGE_GROUP = 10_000
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text, each without its leading space."""
    return CUT.split(text) if OTHER.search(text) else text.split(b" ")


class Tokenizers:
    """Both tokenizers with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        chars = byte_chars()
        self.a_bytes = {i: bytes(chars[c] for c in s) if all(c in chars for c in s) else s.encode() for s, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)], self.b.encode(chunks, num_threads=1)


_LOADED: dict[tuple[str, str], Tokenizers] = {}
remembers("alignment", _LOADED.clear)


def loaded(paths: tuple[str, str]) -> Tokenizers:
    only("alignment")
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


def without_tokenizers() -> None:
    """Called when a task begins that needs none: its worker may still hold those of a task before."""
    only("alignment")
    if _LOADED:
        _LOADED.clear()
        give_back()


def folded(rows: DataFrame, kind: str) -> DataFrame:
    """rows(id, text) as two sorts of rows: a block's distinct chunks (block, k, chunk), and its
    documents (block, id, chunks), whose chunks are numbers k."""

    def scan(batches):
        only("alignment")
        block = TaskContext.get().partitionId() << 24
        known: defaultdict[bytes, int] = defaultdict(count().__next__)  # what is new gets the next number
        seen = 0
        for batch in batches:
            packed, new = [], len(known)
            for text in batch.column(1).cast(pa.binary()):
                text = text.as_py()
                if not text:
                    packed.append(b"")
                    continue
                chunks = chunks_of(text)
                seen += len(chunks)
                packed.append(squeeze(np.fromiter(map(known.__getitem__, chunks), np.uint32, len(chunks))))
            fresh, n = list(known)[new:] if len(known) > new else [], len(packed)
            m = len(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m + n, block, np.int64)),
                    pa.concat_arrays([pa.array(np.arange(new, new + m, dtype=np.int32)), pa.nulls(n, pa.int32())]),
                    pa.concat_arrays([pa.array(fresh, pa.binary()).cast(pa.string()), pa.nulls(n, pa.string())]),
                    pa.concat_arrays([pa.nulls(m, batch.column(0).type), batch.column(0)]),
                    pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array(packed, pa.binary())]),
                ],
                ["block", "k", "chunk", "id", "chunks"],
            )
            if len(known) >= BLOCK_DISTINCT or seen >= BLOCK_CHUNKS:
                block, known, seen = block + 1, defaultdict(count().__next__), 0
        give_back()

    return rows.select("id", "text").mapInArrow(scan, f"block long, k int, chunk string, id {kind}, chunks binary")


def tokenized(chunks: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Of each chunk the ids of both sides, the n_a of a first, with the bytes where they end; ok: both spell the chunk."""

    def run(batches):
        t = loaded(paths)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            if not chunks:
                continue
            a, b = t.encode(chunks)
            ids, ends, ok = [], [], []
            for c, x, y in zip(chunks, a, b, strict=True):
                raw = b" " + c.encode("utf-8", "surrogatepass")
                p, q = [t.a_bytes[i] for i in x], [t.b_bytes[i] for i in y]
                ok.append(b"".join(p) == raw and b"".join(q) == raw)
                ids.append(x + y)
                ends.append([*accumulate(map(len, p)), *accumulate(map(len, q))])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok), pa.array(list(map(len, a)), pa.int32()), pa.array(ids, ints), pa.array(ends, ints)], ["chunk", "ok", "n_a", "ids", "ends"])
        give_back()

    return chunks.mapInArrow(run, "chunk string, ok boolean, n_a int, ids array<int>, ends array<int>")


def aligned(tokens: DataFrame, partitions: int) -> DataFrame:
    """(cid, is_b, id, grp) from tokens(cid, n_a, ids, ends): every token with its group's number, in order of cid and end.

    A byte where tokens of both sides end is a cut; the cuts before a token's end are its group's number.
    """
    one = tokens.repartition(partitions, "cid").select("cid", "n_a", F.posexplode(F.arrays_zip("ids", "ends")).alias("pos", "token"))
    one = one.select("cid", F.col("token.ends").alias("end"), (F.col("pos") >= F.col("n_a")).alias("is_b"), F.col("token.ids").alias("id"))
    by_end = Window.partitionBy("cid").orderBy("end", "is_b")
    cut = one.withColumn("cut", F.coalesce((F.lag("end").over(by_end) == F.col("end")).cast("int"), F.lit(0)))
    grouped = cut.withColumn("grp", F.coalesce(F.sum("cut").over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return grouped.sortWithinPartitions("cid", "end", "is_b").select("cid", "is_b", "id", "grp")


def _pairs_of(ids: np.ndarray, start: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group, whose a ids and then b ids begin at start: the pairs, their numbers of occurrences, and how many pairs."""
    many = n_a * n_b
    large = np.flatnonzero(many > LARGE_GROUP)
    folded_ = {}
    for g in large.tolist():
        middle = start[g] + n_a[g]
        (a, x), (b, y) = (np.unique(side, return_counts=True) for side in (ids[start[g] : middle], ids[middle : middle + n_b[g]]))
        folded_[g] = ((a[:, None] << 32) | b[None, :]).reshape(-1), (x[:, None] * y[None, :]).reshape(-1)
    size = many.copy()
    size[large] = 0
    g = np.repeat(np.arange(len(size)), size)
    t = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
    pairs, times = (ids[start[g] + t // n_b[g]] << 32) | ids[start[g] + n_a[g] + t % n_b[g]], np.ones(len(g), np.int64)
    if folded_:
        at = (np.cumsum(size) - size)[large]
        size[large] = [len(folded_[i][0]) for i in large.tolist()]
        at = np.repeat(at, size[large])
        pairs, times = (np.insert(z, at, np.concatenate([folded_[i][k] for i in large.tolist()])) for k, z in enumerate((pairs, times)))
    return pairs, times, size


def _summary(cid: np.ndarray, is_b: np.ndarray, ids: np.ndarray, grp: np.ndarray) -> pa.RecordBatch:
    new = np.r_[True, cid[1:] != cid[:-1]]
    opens = new | np.r_[True, grp[1:] != grp[:-1]]
    order = np.argsort(np.cumsum(opens) * 2 + is_b, kind="stable")  # in a group a before b, each in order of its end
    is_b, ids = is_b[order], ids[order].astype(np.int64)
    chunk, group = np.flatnonzero(new), np.flatnonzero(opens)
    sign = np.full(len(ids), 3, np.int8)
    sign[is_b & ~np.r_[False, is_b[:-1]]] = 2
    sign[group], sign[chunk] = 1, 0
    words = pc.binary_join_element_wise(pa.array(["", ";", "|", ","]).take(pa.array(sign)), pa.array(ids).cast(pa.string()), "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(chunk, len(ids)).astype(np.int32)), words), "")
    n_b = np.add.reduceat(is_b.astype(np.int64), group)
    n_a = np.diff(np.append(group, len(ids))) - n_b
    first = np.searchsorted(group, chunk)
    pairs, times, size = _pairs_of(ids, group, n_a, n_b)
    ends = pa.array(np.append(0, np.cumsum(np.add.reduceat(size, first))).astype(np.int32))
    numbers = [np.add.reduceat(n_a, first), np.add.reduceat(n_b, first), np.diff(np.append(first, len(group))), np.add.reduceat(n_a * n_b, first)]
    cols = [pa.array(cid[chunk]), *map(pa.array, numbers), text, pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(times))]
    return pa.RecordBatch.from_arrays(cols, ["cid", *NUMBERS[:4], "groups", "pairs", "times"])


def summed_up(tokens: DataFrame) -> DataFrame:
    """aligned()'s rows, a chunk's one after the other, as a row a chunk: its numbers, groups as text, linked
    pairs (a << 32 | b) and how often each occurs; a pair may come several times."""

    def run(batches):
        without_tokenizers()
        held: list[list[np.ndarray]] = []  # the last chunk's rows so far, as the next batch may go on with it
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            other = np.flatnonzero(cols[0] != cols[0][-1])
            at = other[-1] + 1 if len(other) else 0
            if held and (at or held[-1][0][-1] != cols[0][-1]):
                held.append([c[:at] for c in cols])
                yield _summary(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            elif at:
                yield _summary(*(c[:at] for c in cols))
            held.append([c[at:] for c in cols])
        if held:
            yield _summary(*map(np.concatenate, zip(*held, strict=True)))
        give_back()

    numbers = ", ".join(f"{n} long" for n in NUMBERS[:4])
    return tokens.mapInArrow(run, f"cid long, {numbers}, groups string, pairs array<bigint>, times array<bigint>")


#: Rows of a task that are packed together on their way to their blocks, and documents put together at once.
PACKED_ROWS, DOCUMENTS = 400_000, 256


def packed_by_block(answers: DataFrame, kind: DataType) -> DataFrame:
    """answers(block, k, value, whole numbers) as rows of many: a block's numbers k, and squeezed their
    values' sizes (-1: null) with the whole numbers, and their values (texts, or arrays of whole numbers).

    Every task packs what it has for a block, at most PACKED_ROWS rows at a time.
    """

    def pack(rows: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(rows).combine_chunks()
        block = rows.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        block, k = block[order], rows.column(1).to_numpy()[order].astype(np.uint32)
        values = rows.column(2).take(pa.array(order)).combine_chunks()
        texts = pa.types.is_string(values.type)
        size = (pc.binary_length if texts else pc.list_value_length)(values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.stack([size, *(c.fill_null(0).to_numpy()[order] for c in rows.columns[3:])])
        flat = values.fill_null("").to_pylist() if texts else values.flatten().to_numpy()
        ends = np.append(0, np.cumsum(np.maximum(size, 0)))
        cuts = [*np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist(), len(block)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = zstandard.compress("".join(flat[i:j]).encode(), 3) if texts else squeeze(flat[ends[i] : ends[j]]) if ends[i] < ends[j] else b""
            yield int(block[i]), squeeze(k[i:j]), squeeze(np.ascontiguousarray(heads[:, i:j]).reshape(-1)), own

    def packed(rows):
        b, k, h, v = zip(*pack(rows), strict=True)
        n = len(b)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.binary()), pa.array(h, pa.binary()), pa.array(v, pa.binary()), pa.nulls(n, id_type), pa.nulls(n, pa.binary())], ["block", "ks", "heads", "values", "id", "chunks"])

    def run(batches):
        without_tokenizers()
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= PACKED_ROWS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)
        give_back()

    id_type = to_arrow_type(kind)
    first = ["block", "k", "value"]
    return answers.select(*first, *(c for c in answers.columns if c not in (*first, "cid"))).mapInArrow(run, f"block long, ks binary, heads binary, values binary, id {kind.simpleString()}, chunks binary")


def unfolded(docs: DataFrame, placed: DataFrame, results: DataFrame, value, done, schema: str) -> DataFrame:
    """A block's documents with the results of their chunks.

    results(cid, value, whole numbers) meet the blocks' chunks, placed(block, k, cid), and these, packed, their documents;
    a chunk without a result has null. value(the numbers k, sizes and whole numbers by row, packed values, of each pack of a
    block) gives what done(that, ids, batches) needs: done yields record batches of
    the schema from the block's documents, given as pairs of id arrays and lists of number arrays.
    """
    answers = packed_by_block(placed.join(results, "cid", "left"), docs.schema["id"].dataType)
    asked = docs.select("block", *(F.lit(None).cast("binary").alias(c) for c in ("ks", "heads", "values")), "id", "chunks")
    dealt = answers.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("ks").isNull())

    def run(batches):
        without_tokenizers()
        now, packs, ready = None, [], None
        for batch in batches:
            block, answer = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            state = block * 2 + ~answer
            cuts = [*(np.flatnonzero(state[1:] != state[:-1]) + 1).tolist(), len(state)] if len(state) else []
            for i, j in zip([0, *cuts], cuts, strict=False):
                if block[i] != now:
                    if ready is not None:
                        yield from done(ready, None, None)
                    now, packs, ready = block[i], [], None
                if answer[i]:
                    for k, head, own in zip(*(batch.column(c)[i:j].to_pylist() for c in (1, 2, 3)), strict=True):
                        k = unsqueeze(k, np.uint32)
                        packs.append((k, unsqueeze(head, np.int64).reshape(-1, len(k)), own))
                    continue
                if ready is None:
                    ready, packs = value(*(zip(*packs, strict=True) if packs else ([], [], []))), []
                for at in range(i, j, DOCUMENTS):
                    few = slice(at, min(at + DOCUMENTS, j))
                    chunks = batch.column(5)[few].to_pylist()
                    yield from done(ready, batch.column(4)[few], [unsqueeze(x, np.uint32) if x else np.zeros(0, np.uint32) for x in chunks])
        if ready is not None:
            yield from done(ready, None, None)
        give_back()

    return dealt.mapInArrow(run, schema)


def _by_number(ks, heads, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By k: the head (a size and ``more`` whole numbers), and where its value begins and ends among all that were packed."""
    if not len(ks):
        return np.zeros((more + 1, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, head = np.concatenate(ks), np.concatenate(heads, axis=1)
    size = np.maximum(head[0], 0)
    ends = np.cumsum(size)
    out = np.empty_like(head), np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    out[0][:, k], out[1][k], out[2][k] = head, ends - size, ends
    return out


class Pairs:
    """A block's linked id pairs by chunk, and how many of its documents hold each."""

    def __init__(self, ks, heads, values):
        head, self.starts, self.stops = _by_number(ks, heads, 0)
        self.ok = head[0] >= 0
        flat = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(v, np.int64) for v in values if v)])
        self.pairs, self.number = np.unique(flat, return_inverse=True)
        self.number = self.number.reshape(-1).astype(np.int32)
        self.docs = np.zeros(len(self.pairs), np.int64)

    def add(self, ids: np.ndarray) -> None:
        ids = np.unique(ids)
        if not len(ids) or not self.ok[ids].all():
            return
        sizes = self.stops[ids] - self.starts[ids]
        at = np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        self.docs[np.unique(self.number[at])] += 1


def _pair_counts(ready: Pairs, ids, docs):
    if docs is not None:
        for d in docs:
            ready.add(d)
        return
    for i in range(0, len(ready.pairs), 100_000):
        pairs = ready.pairs[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(ready.docs[i : i + 100_000])], ["a", "b", "n"])


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Totals:
    """A block's chunks with their numbers and groups as text."""

    def __init__(self, ks, heads, values):
        head, starts, stops = _by_number(ks, heads, len(NUMBERS))
        self.ok, self.numbers = head[0] >= 0, np.ascontiguousarray(head[1:].T)
        text = b"".join(map(zstandard.decompress, values))  # digits and signs
        self.groups = [text[i:j] for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]


def _document_rows(ready: Totals, ids, docs):
    if docs is None:
        return
    sums, groups = np.zeros((len(docs), len(NUMBERS)), np.int64), []
    for i, d in enumerate(docs):
        fine = len(d) > 0 and bool(ready.ok[d].all())
        if fine:
            sums[i] = ready.numbers[d].sum(axis=0)
        groups.append(b";".join(map(ready.groups.__getitem__, d.tolist())) if fine else b"")
    yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(c)) for c in sums.T), pa.array(groups, pa.binary()).cast(pa.string())], ["id", *NUMBERS, "groups"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    a_path is a byte-level byte-pair file, given a space and the text; b_path a sentencepiece model that
    adds that space itself. Byte offsets where tokens of both end cut them into groups; ``groups`` is
    ``a1,a2|b1;a3|b2,b3``, the ids in order. Links are all pairs of tokens in one group. A pair of ids
    counts the documents that hold it linked; n_best are the links whose count is the highest of their
    a id, count_sum the sum of the counts over all links.

    A text that is null or empty, or that either side does not spell byte for byte, has no tokens:
    zeros and ''. Every row is a document, rows that repeat an id too. An empty table gives no rows;
    other columns, whatever their names, are not read. Whole texts count, however long.
    """
    spark, paths = docs.sparkSession, (a_path, b_path)
    plain = numbered(docs)
    kind = docs.schema[docs.columns[int(place(docs, id_col)[1:])]].dataType.simpleString()
    rows = plain.select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text_col)).alias("text"))
    both = written(folded(rows, kind), "chunks-of-blocks", codec="zstd")
    own, words = written(both.where("k is null").select("block", "id", "chunks"), "documents-of-blocks", codec="zstd"), both.where("k is not null").select("block", "k", "chunk")
    tokens = written(tokenized(words.select("chunk").distinct(), paths).withColumn("cid", F.monotonically_increasing_id()), "chunk-tokens", codec="zstd")
    placed = written(words.join(tokens.select("chunk", "cid"), "chunk").select("block", "k", "cid"), "placed-chunks", codec="zstd")
    discard(both)
    release(spark)
    partitions = max(shuffle_partitions(spark), -(-tokens.count() // CHUNKS_A_PARTITION))
    known = written(summed_up(aligned(tokens.where("ok").select("cid", "n_a", "ids", "ends"), partitions)), "chunk-groups", codec="zstd")
    discard(tokens)
    release(spark)
    pairs = written(unfolded(own, placed, known.select("cid", F.col("pairs").alias("value")), Pairs, _pair_counts, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts", 2)
    release(spark)
    best = pairs.groupBy("a").agg(F.max("n").alias("most"))
    counted = pairs.join(best, "a").select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    small = pairs.count() <= BROADCAST_PAIRS
    linked = known.select("cid", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("cid", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = linked.join(F.broadcast(counted) if small else counted, "pair").groupBy("cid").agg(F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.col("is_best") * F.col("times")).alias("n_best"))
    final = written(known.join(sums, "cid", "left").select("cid", F.col("groups").alias("value"), *NUMBERS), "chunk-totals", codec="zstd")
    discard(pairs)
    discard(known)
    release(spark)
    out = unfolded(own, placed, final, Totals, _document_rows, f"id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, groups string")
    return out.withColumnRenamed("id", id_col)
