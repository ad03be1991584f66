"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its turns meet
the sorted token spans by binary search, which gives each turn's tokens. A conversation beyond
BLOCK characters is rendered block by block at turn ends; control strings are tokens of their own,
so the encoding of the blocks is that of the whole.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import numbered, only, place, remembers, shuffle_partitions

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
TURNS = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.DOTALL)
BLOCK = 4_000_000


def escape(text: str) -> str:
    """No control string, nor the start of one, is left: a mark goes between < and |, one more each time."""
    return re.sub(r"<(!*)\|", r"<!\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<!(!*)\|", r"<\1|", text) if "|" in text else text


class Formatter:
    def __init__(self, path: str, loss_role: str = "assistant"):
        from tokenizers import AddedToken, Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (TURN, SAYS, END)])
        self.loss_role = loss_role

    def block(self, turns: list[tuple[str, str]]) -> dict:
        """formatted text, ids, and of each loss turn its token range and characters."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
            if role == self.loss_role:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += (head, body, END)
            at += len(head) + len(body) + len(END)
        formatted = "".join(parts)
        got = self.encoder.encode(formatted, add_special_tokens=False)
        offsets = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
        edges = np.array(spans, dtype=np.int64).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 0], edges[:, 0], side="left")
        stop = np.searchsorted(offsets[:, 0], edges[:, 1], side="left")
        tokens = np.stack([first, stop], 1)
        chars = [(int(offsets[i, 0]), int(offsets[i:j, 1].max())) for i, j in tokens if j > i]
        return {"formatted": formatted, "ids": got.ids, "loss_tokens": tokens.tolist(), "loss_chars": chars}


_LOADED: dict[tuple, Formatter] = {}
remembers("chat", _LOADED.clear)


def loaded(path: str, loss_role: str) -> Formatter:
    only("chat")
    if (path, loss_role) not in _LOADED:
        _LOADED[path, loss_role] = Formatter(path, loss_role)
    return _LOADED[path, loss_role]


def _blocks(batches, formatter: Formatter):
    """(conversation id, number of the block, block, whether it is the last), from rows in order."""
    none = object()
    now, turns, size, k = none, [], 0, 0
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if conv != now or now is none:
                if now is not none:
                    yield now, k, formatter.block(turns), True
                now, turns, size, k = conv, [], 0, 0
            elif size >= BLOCK:
                yield now, k, formatter.block(turns), False
                turns, size, k = [], 0, k + 1
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
    if now is not none:
        yield now, k, formatter.block(turns), True


def _id_type(batches):
    """The Arrow type of the first column, and the batches again."""
    first = next(batches, None)
    return (pa.null(), iter(())) if first is None else (first.schema.field(0).type, chain([first], batches))


def _ordered(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    plain = numbered(rows)
    plain = plain.select(*[plain[place(rows, c)].alias(n) for c, n in ((id_col, "conv"), (role_col, "role"), (text_col, "text"), (turn_col, "turn"))])
    return plain.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_conversations(rows: DataFrame, path: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Rows (id, block, formatted, ids, loss): loss holds the token ranges [first, stop) under the mask.

    Turns go in order of turn, then role, then text (nulls first), so ties and repeated rows have one
    result and all stay. Null role or text counts as empty, rows with a null id are one conversation,
    an empty table gives no rows, and other columns are not read. A conversation streams through its
    task in blocks of about four million characters, so its memory is bounded whatever its length.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        ids, batches = _id_type(batches)
        schema = pa.schema([("id", ids), ("block", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])))])
        for conv, k, b, _ in _blocks(batches, loaded(path, loss_role)):
            yield pa.RecordBatch.from_pylist([{"id": conv, "block": k, "formatted": b["formatted"], "ids": b["ids"], "loss": [{"first": i, "stop": j} for i, j in b["loss_tokens"]]}], schema=schema)

    out = _ordered(rows, id_col, turn_col, role_col, text_col).mapInArrow(run, f"id {kind}, block int, formatted string, ids array<int>, loss array<struct<first:bigint,stop:bigint>>")
    return out.withColumnRenamed("id", id_col)


def conversation_digests(rows: DataFrame, path: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """What the formatted conversations hold, read back from them: turns by the control strings, loss
    text by the token offsets under the mask. Same cases as format_conversations."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        ids, batches = _id_type(batches)
        types = (ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out, turns, loss = [], hashlib.sha256(), hashlib.sha256()
        n = chars = length = 0
        for conv, _, b, last in _blocks(batches, loaded(path, loss_role)):
            for role, text in TURNS.findall(b["formatted"]):
                turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for s, e in b["loss_chars"]:
                said = unescape(b["formatted"][s:e])
                loss.update(said.encode("utf-8", "surrogatepass"))
                chars += len(said)
            length += len(b["formatted"])
            if last:
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))
                turns, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done = _ordered(rows, id_col, turn_col, role_col, text_col).mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return done.withColumnRenamed("id", id_col)


def with_probe(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) plus conversation -1, whose turns hold another template's control strings."""
    probe = rows.sparkSession.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe.select(*[F.col(c) for c in ("conv_id", "turn", "role", "text")]))
