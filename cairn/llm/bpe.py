"""Byte-level BPE by monoid tree reduction.

A text's encoding is the product of its halves' encodings, under a join that repairs the seam:

* Within one match of the splitting pattern, the tree goes down to single bytes. Two neighbouring tokens a, b are
  compatible if merging bytes(a) + bytes(b) by rank gives a, b again. A sequence is the encoding of its bytes exactly if
  all neighbours are compatible: up to the first merge over some token's end, every token's bytes go through the merges
  that they go through alone, so the first such merge would also happen in the pair on its own. Joining two encodings
  therefore re-encodes a window of i tokens on either side of the seam, and doubles i until the window's outer neighbours
  are compatible with what stays. Matches, halves and pairs of tokens that came before are remembered.
* Between matches, a match depends on the text from its start on only. Halves split on their own are joined by
  splitting anew from the last match of the left half that provably ends before the cut, until a boundary meets one
  that the right half found; from there on both splits are the same. Leaves of this tree are LEAF characters.

Decoding concatenates the bytes of neighbours, level by level, up the tree. No tokenizer library takes part.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_struct

#: Characters of a leaf of the tree over a text; bytes of what is remembered at most; neighbours that are joined at once when decoding.
LEAF, SHORT, FAN = 512, 48, 16
#: Matches, halves of matches and pairs of tokens that a worker remembers: between so many and twice as many.
REMEMBERED = (150_000, 150_000, 150_000)
#: Bytes of a window beyond which its pairs are queued; the rank of a pair that is no token.
WIDE, NEVER = 256, 1 << 40
#: Characters behind a match that the pattern may look at ('ll after an apostrophe).
LOOK = 3


class _Memo(dict):
    """Results of a function of short keys. When there is no room, those not asked for since the last time go."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(key) > SHORT:
            return self.make(key)
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class Tokenizer:
    """Ranks of a vocabulary and the pattern that splits texts before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: tuple[int, int, int] = REMEMBERED):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known, self.parts, self.pairs = (_Memo(f, n) for f, n in zip((self.match, self.tree, self.pair), remembered, strict=True))

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Merges by rank, leftmost first: what the joins apply to their windows."""
        if len(raw) > WIDE:
            return self.queued(raw)
        ranks, get = self.ranks, self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        order = [get(raw[i : i + 2], NEVER) for i in range(len(raw) - 1)]
        while order and (best := min(order)) < NEVER:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return tuple([ranks[p] for p in parts])

    def queued(self, raw: bytes) -> tuple[int, ...]:
        """The same with a queue of pairs by rank and place, whose time does not grow with the square of a window."""
        ranks, n = self.ranks, len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged into the one before
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            r, i = heappop(queue)
            j = after[i]
            if not end[i] or j >= n or ranks.get(raw[i : end[j]]) != r:
                continue
            end[i], end[j], after[i] = end[j], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(raw[i : end[after[i]]])) is not None:
                    heappush(queue, (r, i))
            if (b := before[i]) >= 0 and (r := ranks.get(raw[b : end[i]])) is not None:
                heappush(queue, (r, b))
        return tuple([ranks[raw[i:e]] for i, e in enumerate(end) if e])

    def match(self, match: str) -> tuple[int, ...]:
        """Encoding of one match: its own token if the vocabulary has one, else what the tree over its bytes gives."""
        raw = match.encode()
        whole = self.ranks.get(raw)
        return self.tree(raw) if whole is None else (whole,)

    def tree(self, raw: bytes) -> tuple[int, ...]:
        """Halves, joined, down to single bytes."""
        if len(raw) == 1:
            return (self.ranks[raw],)
        half = len(raw) // 2
        return self.join(self.parts[raw[:half]], self.parts[raw[half:]])

    def pair(self, pair: tuple[int, int]) -> tuple[int, ...]:
        """What two neighbouring tokens become; the same two if they are compatible."""
        return self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of what two encodings of one match spell together."""
        if not left or not right:
            return left + right
        pairs, of, reach = self.pairs, self.bytes_of, 1
        window = pairs[left[-1], right[0]]
        if window == (left[-1], right[0]):  # then nothing changes: all other neighbours are those of either side
            return left + right
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            if reach > 1:
                window = self.merged(b"".join([of[t] for t in left[i:] + right[:j]]))
            if (not i or pairs[before := (left[i - 1], window[0])] == before) and (j == len(right) or pairs[after := (window[-1], right[j])] == after):
                return left[:i] + window + right[j:]
            reach *= 2

    def matches(self, text: str) -> list[str]:
        """The pattern's matches: halves, joined."""
        if len(text) <= LEAF:
            return self.pattern.findall(text)
        half = len(text) // 2
        left, right = self.matches(text[:half]), self.matches(text[half:])
        safe = self.safe(left, half)
        seam: list[str] = []
        n, at = 0, half  # where the right half's next boundary is
        for m in self.pattern.finditer(text, half - sum(map(len, left[safe:]))):
            start = m.start()
            while at < start and n < len(right):
                at += len(right[n])
                n += 1
            if at == start:
                return left[:safe] + seam + right[n:]
            seam.append(m.group())
        return left[:safe] + seam

    @staticmethod
    def safe(matches: list[str], end: int) -> int:
        """How many matches of a half that was cut at `end` stay whatever follows the cut."""
        n, at = len(matches), end
        while n:
            at -= len(matches[n - 1])
            n -= 1
            if end - at > LOOK and n and not matches[n - 1].isspace():  # the one before ends well before the cut, and no run of spaces goes on
                return n
        return 0

    def forget(self) -> None:
        """What was remembered goes, so that a worker holds nothing between tasks."""
        for memo in (self.known, self.parts, self.pairs):
            memo.clear(), memo.older.clear()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.matches(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, neighbours joined up the tree; an id outside the vocabulary is an error."""
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return level[0] if level else b""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str, remembered: tuple[int, int, int]) -> Tokenizer:
    with open(path, "rb") as f:
        return Tokenizer(read_ranks(f.read()), pattern, remembered)


def _batched(path: str, pattern: str, make: Callable, names: list[str], remembered: tuple[int, int, int] = REMEMBERED) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path, pattern, remembered)
        for s in batches:
            yield pd.DataFrame([make(tokenizer, x) for x in s], columns=names)
        tokenizer.forget()

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with out: the ids (array of int) of each whole text; a null or empty text has none.

    path: a rank file that every executor has, such as one of an installed package. Rows are independent of each other,
    so ties, repeated rows and extra columns pass unchanged; an input column named out is replaced.
    """
    def encode(tokenizer: Tokenizer, text: str | None) -> tuple:
        return (tokenizer.encode(text),)

    udf = F.pandas_udf(_batched(path, pattern, encode, ["ids"]), "ids array<int>")
    return docs.withColumn(out, udf(F.col(f"`{text_col}`"))["ids"])


def bpe_decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with out: the bytes (binary) that ids spell; null ids spell none."""
    def decode(tokenizer: Tokenizer, ids) -> tuple:
        return (tokenizer.decode(ids.tolist() if ids is not None else []),)

    udf = F.pandas_udf(_batched(path, pattern, decode, ["raw"]), "raw binary")
    return docs.withColumn(out, udf(F.col(f"`{ids_col}`"))["raw"])


def bpe_digest(docs: DataFrame, path: str, pattern: str, text_col: str = "text", remembered: tuple[int, int, int] = REMEMBERED) -> DataFrame:
    """docs with n_tokens long, ids_sha256 and decoded_sha256 (lowercase hex), after encoding and decoding each text.

    Both digests are taken beside the ids, which are thus never written or shuffled. A null text counts as empty: no
    tokens. Rows are independent, so repeated rows come out alike; other columns pass unchanged whatever their names,
    but input columns named as the three are replaced. remembered: results that a worker keeps, for time against memory.
    """

    def digest(tokenizer: Tokenizer, text: str | None) -> tuple:
        ids = tokenizer.encode(text)
        listed = ",".join(map(str, ids)).encode()
        return len(ids), sha256(listed).hexdigest(), sha256(tokenizer.decode(ids)).hexdigest()

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    udf = F.pandas_udf(_batched(path, pattern, digest, names, remembered), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return with_struct(docs, udf(F.col(f"`{text_col}`").cast("string")), names)
