"""Exact BPE token counts of every prefix by dynamic programming.

For byte-pair encodings whose merges are applied in order, the encoding of a prefix is that of a
shorter prefix plus one token: the only token t ending there whose left neighbour and t stay apart
when both are merged side by side. So ``last token`` and ``count`` of every prefix of a pretoken come
from one left-to-right pass. A text's table holds the starts of its pretokens and the counts before
them; with the row of the pretoken that a cut falls into they answer "how many tokens has this
prefix" and "how much fits the budget" without encoding again.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from meshlark.llm.common import numbered, only, place, remembers

#: The byte-to-character table of byte-level BPE keeps these ranges as they are.
KEPT_BYTES = ((33, 126), (161, 172), (174, 255))
#: Letters, numbers and white space up to U+024F, as in the byte-level split pattern.
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: All white space of that pattern, and its endings after an apostrophe.
SPACE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
ENDINGS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
BEYOND = re.compile("[^\x00-\u024f]")
#: Pretokens that a worker remembers, and counts in its stored rows; a full cache is emptied, which costs time only.
CACHE, ROWS = 400_000, 2_000_000


def byte_chars() -> dict[str, int]:
    kept = {b for lo, hi in KEPT_BYTES for b in range(lo, hi + 1)}
    out = {chr(b): b for b in kept}
    out.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)})
    return out


class PrefixCounts(dict):
    """pretoken -> its number of tokens, found by the prefix recurrence when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model, chars = spec["model"], byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        ids = {raw(s): i for s, i in model["vocab"].items() if all(c in chars for c in s)}
        #: of each beginning of a token its id, or -1 where it is none itself
        self.begun = {t[:k]: -1 for t in ids for k in range(1, len(t))} | ids
        self.merge: dict[tuple[int, int], int] = {}
        self.born, self.halves = {}, {}
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(s) for s in (m.split(" ") if isinstance(m, str) else m))
            t = ids[a + b]
            self.merge[ids[a], ids[b]] = rank
            if t not in self.born:
                self.born[t], self.halves[t] = rank, (ids[a], ids[b])
        self.apart: dict[tuple[int, int], bool] = {}
        self.rows: dict[str, array] = {}
        self.held = 0
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.library = Tokenizer.from_file(path)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as they are when b follows a.

        Runs the merges backwards: the pair at the seam exists until the later of the two was
        formed, so a merge across the seam would have come first if its rank is lower. At equal
        ranks the left place is merged first.
        """
        born, until = self.born, 1 << 60
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < until:
                return False
            ta, tb = born.get(a, -1), born.get(b, -1)
            if ta > tb:
                until, a = ta, self.halves[a][1]
            elif tb >= 0:
                until, b = tb + 1, self.halves[b][0]
            else:
                return True

    def prefix_counts(self, pretoken: str) -> array:
        """Token count of each prefix of the pretoken's bytes; item 0 is 0."""
        w = pretoken.encode("utf-8", "surrogatepass")
        n, begun, apart = len(w), self.begun, self.apart
        last, count = [0] * (n + 1), array("q", bytes(8 * (n + 1)))
        ending: list = [()] * (n + 1)  # the tokens that end there, the longest first
        for i in range(n + 1):
            for j, t in ending[i]:
                if j:
                    pair = (last[j], t)
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) > CACHE:
                            apart.clear()
                        ok = apart[pair] = self.stay_apart(*pair)
                    if not ok:
                        continue
                last[i], count[i] = t, count[j] + 1
                break
            ending[i] = ()
            k = i + 1
            while k <= n and (t := begun.get(w[i:k])) is not None:
                if t >= 0:
                    if ending[k]:
                        ending[k].append((i, t))
                    else:
                        ending[k] = [(i, t)]
                k += 1
        return count

    def row(self, pretoken: str) -> array:
        """The stored prefix counts of a pretoken that was cut before."""
        got = self.rows.get(pretoken)
        if got is None:
            if self.held > ROWS:
                self.rows.clear()
                self.held = 0
            got = self.rows[pretoken] = self.prefix_counts(pretoken)
            self.held += len(got)
        return got

    def __missing__(self, pretoken: str) -> int:
        if len(self) > CACHE:
            self.clear()
        if len(pretoken) > 64:
            return self.row(pretoken)[-1]
        n = self[pretoken] = self.prefix_counts(pretoken)[-1]
        return n

    def split(self, text: str) -> list[str]:
        """Pretokens of a text without special strings. Rare characters go by the library's own split."""
        if text.isascii() or not BEYOND.search(text):
            return SPLIT.findall(text)
        return [text[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """(special, pretoken or special string), in order."""
        if not self.specials or not self.specials.search(text):
            return [(False, p) for p in self.split(text)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [(False, p) for p in self.split(text[at : m.start()])] + [(True, m[0])]
            at = m.end()
        return out + [(False, p) for p in self.split(text[at:])]

    def count(self, text: str) -> int:
        if self.special and any(s in text for s in self.special):
            return sum(1 if special else self[p] for special, p in self.pieces(text))
        return sum(map(self.__getitem__, self.split(text)))

    def table(self, text: str) -> Prefixes:
        return Prefixes(self, text)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most budget tokens."""
        size = 8 * budget + 64
        while size < len(text):  # all but the last pieces of a beginning are pieces of the text too
            head = self.table(text[:size])
            if len(head.before) > 4 and head.before[-5] >= budget:
                return head.longest(budget)
            size *= 4
        return self.table(text).longest(budget)


class Prefixes:
    """A text's prefix table: starts of its pieces and the token counts before them (one more item each, the ends)."""

    def __init__(self, counter: PrefixCounts, text: str):
        self.counter, self.text = counter, text
        self.pieces = counter.pieces(text)
        self.starts = list(accumulate((len(p) for _, p in self.pieces), initial=0))
        self.before = list(accumulate((1 if special else counter[p] for special, p in self.pieces), initial=0))

    def _bytes(self, piece: str, chars: int) -> int:
        return chars if piece.isascii() else len(piece[:chars].encode("utf-8", "surrogatepass"))

    def _run(self, k: int) -> int:
        """Where the white space that piece k begins with begins: at a cut it is one pretoken with that before."""
        while k and not self.pieces[k - 1][0] and self.pieces[k - 1][1][-1] in SPACE:
            k -= 1
        return k

    def count(self, chars: int) -> int:
        """Token count of the text's first chars characters."""
        if chars <= 0 or not self.pieces:
            return 0
        if chars >= len(self.text):
            return self.before[-1]
        k = bisect_left(self.starts, chars) - 1
        special, piece = self.pieces[k]
        start = self.starts[k]
        if special and chars < self.starts[k + 1]:  # a cut special string is plain text, which may join what is before
            while k and not self.pieces[k - 1][0] and start - self.starts[k] < 1 and not self.pieces[k - 1][1][-1].isalnum():
                k -= 1
            return self.before[k] + self.counter.count(self.text[self.starts[k] : chars])
        if not special and self.text[chars - 1] in SPACE:
            k = self._run(k)
            return self.before[k] + self.counter.row(self.text[self.starts[k] : chars])[-1]
        if special or chars == self.starts[k + 1]:
            return self.before[k + 1]
        if piece in ENDINGS:
            return self.before[k] + self.counter.count(piece[: chars - start])
        return self.before[k] + self.counter.row(piece)[self._bytes(piece, chars - start)]

    def _last_in(self, k: int, budget: int) -> int:
        """The last cut within piece k with at most budget tokens; 0 if there is none."""
        special, piece = self.pieces[k]
        start, stop = self.starts[k], self.starts[k + 1]
        if special or piece in ENDINGS:
            return next((c for c in range(stop, start, -1) if self.count(c) <= budget), 0)
        space = piece[0] in SPACE
        if piece[-1] in SPACE:  # white space alone
            r = self._run(k)
            run, skip = self.text[self.starts[r] : stop], start - self.starts[r]
            row, base = self.counter.row(run), self.before[r]
        else:
            run, skip, row, base = piece, int(space), self.counter.row(piece), self.before[k]
        at = len(row) - 1
        for c in range(len(run), skip, -1):
            if base + row[at] <= budget:
                return stop - len(run) + c
            at -= 1 if run[c - 1] < "\x80" else len(run[c - 1].encode("utf-8", "surrogatepass"))
        return start + 1 if space and skip and piece[-1] not in SPACE and self.count(start + 1) <= budget else 0

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with at most budget tokens."""
        if self.before[-1] <= budget:
            return len(self.text)
        k = bisect_left(self.before, budget)  # pieces from k on add to a full budget
        while k < len(self.pieces):  # but white space joins the run before it, and a cut special string what is before it
            joined = max(0, k - 1) if self.pieces[k][0] else self._run(k) if self.pieces[k][1][0] in SPACE else k
            if self.before[joined] >= budget:
                break
            k += 1
        for i in range(k - 1, -1, -1):
            if got := self._last_in(i, budget):
                return got
        return 0


_LOADED: dict[str, PrefixCounts] = {}
remembers("token_counts", _LOADED.clear)


def loaded(path: str) -> PrefixCounts:
    """The worker's counter for a vocabulary file; one stays loaded for each path."""
    only("token_counts")
    if path not in _LOADED:
        _LOADED[path] = PrefixCounts(path)
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, over_limit, fit_chars.

    n_tokens is the library's count of the whole text without added begin and end; fit_chars is the
    length of the longest prefix of at most ``limit`` tokens, read off the prefix table. A null text
    counts as empty; a null id stays; rows repeat as often as they come; an empty table gives no
    rows; other columns, whatever their names, are not read. No shuffle: every scan task counts its
    own rows with bounded caches.
    """
    plain = numbered(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = loaded(path or vocabulary())
        for batch in batches:
            n_bytes, n_tokens, fit = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n = counter.count(text)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(n)
                fit.append(len(text) if n <= limit else counter.longest_prefix(text, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    out = plain.select(plain[place(docs, id_col)].alias("id"), plain[place(docs, text_col)].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumnRenamed("id", id_col)


def truncate(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and the longest prefix of each text with at most ``limit`` tokens (null stays null)."""
    plain = numbered(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = loaded(path or vocabulary())
        for batch in batches:
            cut = [t if t is None else t[: counter.longest_prefix(t, limit)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["id", "text"])

    out = plain.select(plain[place(docs, id_col)].alias("id"), plain[place(docs, text_col)].alias("text")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
