"""Lexical retrieval packing.

Documents are encoded, and each shard of them gets a BM25 inverted index over its tokens. A window
starts with a seed document; the shard's index returns the seed's unused neighbours, best first, and
they fill the window one after another (where none is left, the next unused document does). The last
one is cut where the window ends and its rest seeds the next window, so only the last window of a
shard is not full.

Shards are what a task reads, in blocks of SHARD_DOCS documents or SHARD_TOKENS tokens, whichever is
reached first: no shuffle, and a task holds one block. Within a shard every document is searched.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import give_back, numbered, only, place, remembers
from meshlark.llm.token_counts import byte_chars

WINDOW, END_ID = 2048, 1
SHARD_DOCS, SHARD_TOKENS = 1024, 3_000_000
#: Tokens in more than one of so many documents have a full row of weights.
OFTEN = 24
K1, B = 1.2, 0.75
#: Characters for which a text's encoding is that of its white-space chunks, each on its own.
#: (U+0130 is none of them: its small letter is two characters.)
BEYOND = re.compile("[^\t-\r -~\xa1-įı-ɏ]")
#: The vocabulary's split pattern, for those characters.
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")
#: Chunks and words that a worker remembers (some 200 bytes each); a full memory is emptied, which costs time only.
CHUNKS, WORDS = 300_000, 250_000
#: Texts whose new chunks are encoded in one call.
TOGETHER = 256


class Encoder(dict):
    """lower-cased chunk without white space -> its ids as little-endian bytes; other texts go to the library whole.

    The vocabulary's normaliser lower-cases and its splitter drops white space and never joins over it,
    so for plain characters a text's ids are its chunks' ids in a row, and a chunk's those of its words.
    Words go to the vocabulary's own model, in its byte characters, without the steps done already.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merger = Tokenizer(self.library.model)
        self.merger.pre_tokenizer = WhitespaceSplit()
        self.chars = str.maketrans({chr(b): c for c, b in byte_chars().items() if b != 32})
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks. Each word ends with an end-of-word id, which says which ids are whose."""
        parts = [(c,) if c.isalpha() else WORD.findall(c) for c in chunks]
        new = list({w for p in parts for w in p}.difference(self.words))
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = list({w for p in parts for w in p})
        if new:
            ids = np.array(self.merger.encode_batch_fast([" ".join(new).encode().decode("latin-1").translate(self.chars)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(new):
                raise ValueError("the vocabulary does not end each word with an end-of-word id")
            bounds, raw = [0, *(4 * stops).tolist()], ids.tobytes()
            self.words.update(zip(new, map(raw.__getitem__, map(slice, bounds[:-1], bounds[1:])), strict=True))
        words = self.words
        self.update((c, words[c] if len(p) == 1 else b"".join(map(words.__getitem__, p))) for c, p in zip(chunks, parts, strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [not (BEYOND.search(t) or any(s in t for s in self.special)) for t in texts]
        chunks = [t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        known = [list(map(self.get, c)) for c in chunks]
        gaps = [k for k, found in enumerate(known) if None in found]
        if gaps:
            new = {c for k in gaps for c, v in zip(chunks[k], known[k], strict=True) if v is None}
            if len(self) + len(new) > CHUNKS:
                self.clear()
            self.learn(list(new))
            for k in gaps:
                known[k] = [v if v is not None else self[c] for c, v in zip(chunks[k], known[k], strict=True)]
        return [np.frombuffer(b"".join(v) if p else self.whole(t), "<u4") for t, p, v in zip(texts, plain, known, strict=True)]


_LOADED: dict[str, Encoder] = {}
remembers("packing", _LOADED.clear)


def loaded(path: str) -> Encoder:
    only("packing")
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Index:
    """BM25 over the documents of a shard: for each token the documents that hold it and its weight there.

    Tokens in many documents keep a weight for every document, others a list of those that hold them.
    """

    def __init__(self, docs: list[np.ndarray]):
        lengths, n = np.array([len(d) for d in docs], np.int64), len(docs)
        # equal tokens of a document next to each other: one sort over the shard
        both = np.sort(np.concatenate(docs).astype(np.int64) + (np.repeat(np.arange(n, dtype=np.int64), lengths) << 32))
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(both))).astype(np.float64)
        o, t = both[first] >> 32, both[first] & 0xFFFFFFFF
        self.starts = np.searchsorted(o, np.arange(n + 1))
        names, self.terms = np.unique(t, return_inverse=True)
        order = np.argsort(self.terms, kind="stable")
        held = np.bincount(self.terms, minlength=len(names))
        self.stop = np.cumsum(held)
        self.first = self.stop - held
        idf = np.log1p((n - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self.owners = o[order]
        self.weights = np.repeat(idf, held) * c[order] * (K1 + 1) / (c[order] + norm[self.owners])
        often = np.flatnonzero(held * OFTEN > n)
        self.row = np.full(len(names), -1)
        self.row[often] = np.arange(len(often))
        self.full = np.zeros((len(often), n), np.float32)
        for k, i in enumerate(often.tolist()):
            self.full[k, self.owners[self.first[i] : self.stop[i]]] = self.weights[self.first[i] : self.stop[i]]
        self.n = n

    def scores(self, i: int) -> np.ndarray:
        """Of every document of the shard for document i's distinct tokens."""
        at = self.terms[self.starts[i] : self.starts[i + 1]]
        row = self.row[at]
        rare = at[row < 0]
        lo, size = self.first[rare], self.stop[rare] - self.first[rare]
        pick = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(rare) else rare
        return np.bincount(self.owners[pick], self.weights[pick], self.n) + self.full[row[row >= 0]].sum(axis=0)


def pack_shard(ids: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every id is in one piece."""
    index, n = Index(ids), len(ids)
    unused, out = np.ones(n, bool), []
    sequence, room = 0, window
    queue: list[int] = []
    scores = None  # of the window's seed for all documents
    nxt = 0
    while True:
        if queue:
            doc = queue.pop()
        else:  # a new window, or no document is like its seed: the next unused one
            while nxt < n and not unused[nxt]:
                nxt += 1
            if nxt == n:
                return out
            doc = nxt
        unused[doc], start = False, 0
        while start < len(ids[doc]):
            take = min(room, len(ids[doc]) - start)
            out.append((doc, start, take, sequence, window - room))
            start += take
            room -= take
            if room == 0:
                sequence, room, queue, scores = sequence + 1, window, [], None
        if room < window and not queue:
            if scores is None:  # the document, or the rest of it that began the window, is its seed
                scores = index.scores(doc)
            scores = np.where(unused, scores, 0.0)
            k = min(n, max(8, 4 * room // max(1, len(ids[doc]))))
            near = np.argpartition(-scores, k - 1)[:k] if k < n else np.arange(n)
            near = near[np.lexsort((near, -scores[near]))]
            queue = [j for j in near[::-1].tolist() if scores[j] > 0]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked).

    A document is its ids and then end_id; a null or empty text is end_id alone. Null ids, repeated
    ids and repeated rows are documents like others; an empty table gives no rows; other columns,
    whatever their names, are not read. sequence_id is unique over all shards: partition, shard and number within it.
    """
    from pyspark import TaskContext

    kind = docs.schema[id_col].dataType.simpleString()

    def shard(names, ids, number: int, partition: int, kind):
        rows, pieces = pack_shard(ids, window), []
        for doc, start, length, sequence, offset in rows:
            part = ids[doc][start : start + length]
            pieces.append((names[doc], start, length, zlib.crc32(part.tobytes()), len(ids[doc]), (partition << 40) | (number << 24) | sequence, offset, part.astype(np.int32) if with_ids else None))
        cols = list(zip(*pieces, strict=True))
        arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
        if with_ids:
            arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, fields)

    fields = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        encoder, partition = loaded(path), TaskContext.get().partitionId()
        names, ids, tokens, number = [], [], 0, 0
        tail = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                for name, got in zip(part.column(0).to_pylist(), encoder.ids([t.as_py() or "" for t in part.column(1)]), strict=True):
                    names.append(name)
                    ids.append(np.concatenate([got, tail]))
                    tokens += len(got) + 1
                    if len(ids) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                        yield shard(names, ids, number, partition, batch.schema.field(0).type)
                        names, ids, tokens, number = [], [], 0, number + 1
        if ids:
            yield shard(names, ids, number, partition, batch.schema.field(0).type)
        names, ids = [], []
        give_back()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    plain = numbered(docs)
    return plain.select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text_col)).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
