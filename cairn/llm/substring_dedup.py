"""Substring dedup by super-k-mer partitioning.

Words are runs of bytes other than space and 0x09-0x0D. A window is `window` consecutive words of one document. A
window's minimiser is the smallest hash among its runs of `minimiser` words, so equal windows have equal minimisers.
Consecutive windows with one minimiser travel as one packed string to the minimiser's bucket.

1. Documents go to homes by a hash of id and text (the only time that texts are shuffled; both later uses read the
   same exchange). A home holds a bounded share of the text.
2. Each home cuts its documents into packed strings, keeps each distinct one with its smallest and largest doc_id
   (so thousands of copies of a passage leave a home as one), and sends them to buckets, compressed by bucket.
3. A bucket numbers its words exactly, sorts the windows, compares neighbours word for word and so knows every
   window's smallest doc_id. It answers only the homes whose documents have something to remove.
4. Each home meets its answers and drops the covered words. It knows its strings again by 128 bits of hash (xxh3):
   here alone are no words compared, and two different strings of one home that share all 128 bits would be taken for
   one another.

A passage that is in a third of all documents thus reaches its bucket once a home, not once a document. A minimiser
that stands in very many different contexts would still fill one bucket: these are counted over the whole input
beforehand, and their windows go to buckets of their own hash, one by one. Both ways depend on a window's words alone,
so equal windows meet whatever the list of such minimisers holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed_in_small_batches, groups_for, shuffle_partitions

#: Homes, or buckets, in one task; files' bytes in one home, text bytes in one step of a home, windows that one packed string holds at most, and how hard these are pressed.
TASK_HOMES, HOME_BYTES, BLOCK_BYTES, RUN, LEVEL = 32, 2 << 20, 3 << 20, 64, 5
#: Bytes of a word beyond which it is hashed on its own.
LONG = 256
#: Contexts beyond which a minimiser's windows are spread, or that share of all; contexts in one task that are reported; pairs held in a task.
HOT, HOT_SHARE, SEEN, HELD = 50_000, 1e-5, 8, 2_000_000
U = np.uint64
ODD, MIX = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
OUT = ("n_words", "n_removed")
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> U(32)
    h *= MIX
    h ^= h >> U(29)
    return h


def _word_hashes(text: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each word of a text that goes on for 8 bytes behind the last word: eight bytes at a time, all words at once."""
    eights = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = _mixed((eights[begin] & LOW[np.minimum(length, 8)]) + length.astype(U) * ODD)
    done = 8
    while len(some := np.flatnonzero(length > done)) and done < LONG:
        h[some] = _mixed(h[some] * ODD + (eights[begin[some] + done] & LOW[np.minimum(length[some] - done, 8)]))
        done += 8
    for i in some.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[begin[i] : begin[i] + length[i]])
    return h


def _windows(g: np.ndarray, k: int, mul: np.uint64) -> np.ndarray:
    """Hash of each k consecutive entries, by doubling."""
    n = len(g) - k + 1
    out, have, part, span, power, bits = None, 0, g, 1, mul, k
    while bits:
        if bits & 1:
            out = part[:n] if out is None else out * power + part[have : have + n]
            have += span
        bits >>= 1
        if bits:
            part = part[:-span] * power + part[span:]
            span *= 2
            power = U(int(power) ** 2 % (1 << 64))
    return out


def _superkmers(h: np.ndarray, doc: np.ndarray, k: int, m: int, hot: np.ndarray):
    """First and last window of each super-k-mer, and its minimiser; the window's own hash for hot ones. doc: the document of each word."""
    n = len(h)
    if n < k:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U),)
    g = _mixed(_windows(h, m, ODD))
    least, span, width = g, 1, k - m + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    if not len(at):
        return at, at, np.empty(0, U)
    key = least[at]
    if len(hot) and (spread := np.isin(key, hot)).any():
        key[spread] = _mixed(_windows(h, k, MIX)[at[spread]])
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(inside % RUN == 0)
    end = np.append(begin[1:], len(at)) - 1
    return at[begin], at[end], key[begin]


class Words:
    """Some documents' words in one buffer, a space behind each, and a hash of each word."""

    def __init__(self, texts: list[bytes | None]):
        raw = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        space = SPACE[raw]
        first = np.empty(len(raw), bool)  # of a word
        first[0] = not space[0]
        first[1:] = space[:-1] & ~space[1:]
        keep = ~space
        keep[1:] |= ~space[:-1]
        words = np.searchsorted(np.flatnonzero(first), np.cumsum([len(t or b"") + 1 for t in texts]))
        self.size = np.diff(words, prepend=0)
        self.bytes = np.where(space, np.uint8(32), raw)[keep]
        self.buffer = self.bytes.tobytes()
        self.begin = np.flatnonzero(first[keep])
        self.length = np.diff(np.append(self.begin, len(self.buffer))) - 1
        del raw, space, first, keep
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        self.hashes = _word_hashes(self.buffer + bytes(8), self.begin, self.length)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words of one document, and their documents; a document of fewer words, but some, is one run."""
        short = np.flatnonzero((self.size > 0) & (self.size < k))
        first = np.cumsum(self.size) - self.size
        out, doc = [_mixed(np.array([_windows(self.hashes[first[d] : first[d] + self.size[d]], int(self.size[d]), ODD)[0] for d in short.tolist()], U))], [short]
        if len(self.hashes) >= k:
            at = np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :])
            out.append(_mixed(_windows(self.hashes, k, ODD)[at]))
            doc.append(self.doc[at])
        return np.concatenate(out), np.concatenate(doc)


class _Block(Words):
    """The same with the documents' super-k-mers."""

    def __init__(self, texts: list[bytes | None], k: int, m: int, hot: np.ndarray):
        super().__init__(texts)
        self.first, self.last, self.key = _superkmers(self.hashes, self.doc, k, m, hot)
        self.of = self.doc[self.first]

    def packed(self, k: int) -> list[bytes]:
        b, end = self.buffer, self.last + k - 1
        return [b[i:j] for i, j in zip(self.begin[self.first].tolist(), (self.begin[end] + self.length[end]).tolist(), strict=True)]


def _blocks(table: pa.Table):
    """Rows of a table, in steps of a bounded size: (row numbers, texts, ids). Few texts leave Arrow at a time."""
    rows: list[int] = []
    texts: list[bytes | None] = []
    ids: list[int | None] = []
    size = 0
    for begin in range(0, table.num_rows, 128):
        part = table.slice(begin, 128)
        for i, (t, d) in enumerate(zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("doc_id").to_pylist(), strict=True), begin):
            rows.append(i)
            texts.append(t)
            ids.append(d)
            size += len(t or b"")
            if size >= BLOCK_BYTES:
                yield rows, texts, ids
                rows, texts, ids, size = [], [], [], 0
    if rows:
        yield rows, texts, ids


def _contexts(k: int, m: int):
    """Of each minimiser with at least SEEN different contexts in a task how many these are; without a minimiser, those of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, total = np.empty(0, U), 0
        keys, counts = none, np.empty(0, np.int64)
        for batch in batches:
            for _, texts, _ in _blocks(pa.Table.from_batches([batch])):
                block = _Block(texts, k, m, none)
                if not len(block.first):
                    continue
                context = _mixed(block.key * ODD + _windows(block.hashes, k, ODD)[block.first])
                key = block.key[np.unique(context, return_index=True)[1]]
                total += len(key)
                keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, np.ones(len(key), np.int64)]), len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    some = counts >= 2
                    keys, counts = keys[some], counts[some]
        some = counts >= SEEN
        out = [pa.array([None, *keys[some].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[some].tolist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["key", "n"])

    return run


def hot_minimisers(texts: DataFrame, k: int, m: int) -> np.ndarray:
    """Minimisers (hashes) that stand in more than HOT contexts and more than HOT_SHARE of all: at most 1 / HOT_SHARE of them."""
    counts = checkpointed_in_small_batches(texts.mapInArrow(_contexts(k, m), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.where("key is null").select("n").first()
    most = max(HOT, HOT_SHARE * total.n if total else 0)
    return np.array([r.key for r in counts.where("key is not null").where(F.col("n") > most).collect()], np.int64).view(U)


def _emit(k: int, m: int, buckets: int, hot: np.ndarray):
    schema = pa.schema([("bucket", pa.int32()), ("home", pa.int64()), ("strings", pa.binary()), ("ids", pa.binary())])

    def home(table: pa.Table) -> pa.Table:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        out: list[tuple] = []
        number = table.column("home")[0].as_py()
        for _, texts, ids in _blocks(table.filter(table.column("doc_id").is_valid())):
            block = _Block(texts, k, m, hot)
            own = np.array(ids, np.int64)[block.of] if len(block.of) else np.empty(0, np.int64)
            up = np.argsort(own, kind="stable").tolist()
            packed = block.packed(k)
            high = {packed[i]: i for i in up}  # the last to come is the largest
            low = {packed[i]: i for i in reversed(up)}
            strings = list(high)
            top = own[np.fromiter(high.values(), np.int64, len(strings))]
            at = np.fromiter((low[s] for s in strings), np.int64, len(strings))
            bucket = (block.key[at] % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some = order[i:j]
                both = np.stack([own[at[some]], top[some]])
                out.append((int(bucket[some[0]]), number, press(b"\n".join([strings[x] for x in some.tolist()])), press(both.tobytes())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    return home


class _Number(dict):
    """Numbers words in the order they come; two words have the same number only if they are equal."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _exact_order(words: list[bytes], at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in the order of their words, and whether each equals the one before it: for buckets where a hash stands for two sequences."""
    numbers = _Number()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    rows = ids[at[:, None] + np.arange(k)]
    order = np.lexsort(rows.T)
    rows = rows[order]
    return order, (rows[1:] == rows[:-1]).all(1)


def window_minima(strings: list[bytes], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct strings, each with its smallest id: for every window in turn the smallest id over all strings that hold it; windows of each string."""
    text = b"\n".join(strings) + b"\n"
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))  # packed strings hold no other space; control bytes belong to words
    begin = np.concatenate([[0], ends[:-1] + 1])
    n_words = np.diff(np.flatnonzero(raw[ends] == 10), prepend=-1)
    n_win = n_words - k + 1
    offset = np.cumsum(n_words) - n_words
    before = np.cumsum(n_win) - n_win
    at = np.repeat(offset - before, n_win) + np.arange(n_win.sum())
    h = _windows(_word_hashes(text + bytes(8), begin, ends - begin), k, ODD)[at]
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    pairs = np.flatnonzero(same)
    a, b = at[order[pairs]], at[order[pairs + 1]]
    spans = zip(begin[a].tolist(), ends[a + k - 1].tolist(), begin[b].tolist(), ends[b + k - 1].tolist(), strict=True)
    if not all([text[i:j] == text[x:y] for i, j, x, y in spans]):
        order, same = _exact_order([text[i:j] for i, j in zip(begin.tolist(), ends.tolist(), strict=True)], at, k)
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    per = np.repeat(least, n_win)[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(per, new), np.diff(np.append(new, len(order))))
    return out, n_win


def _count(k: int):
    schema = pa.schema([("home", pa.int64()), ("digests", pa.binary()), ("minima", pa.binary())])

    def bucket(table: pa.Table) -> pa.Table:
        unpress, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress
        index: dict[bytes, int] = {}
        homes, of, low, high = [], [], [], []
        for home, strings, ids in zip(*(table.column(c).to_pylist() for c in ("home", "strings", "ids")), strict=True):
            some = unpress(strings).split(b"\n")
            both = np.frombuffer(unpress(ids), np.int64).reshape(2, -1)
            homes.append(np.full(len(some), home))
            of.append(np.fromiter((index.setdefault(s, len(index)) for s in some), np.int64, len(some)))
            low.append(both[0])
            high.append(both[1])
        homes, of, low, high = map(np.concatenate, (homes, of, low, high))
        strings = list(index)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, of, low)
        minima, n_win = window_minima(strings, least, k)
        begin = np.cumsum(n_win) - n_win
        lowest = np.minimum.reduceat(minima, begin)
        wanted = np.flatnonzero(high > lowest[of])  # some document of that home has a word to remove
        wanted = wanted[np.argsort(homes[wanted], kind="stable")]
        cuts = np.flatnonzero(np.diff(homes[wanted], prepend=-1)).tolist() + [len(wanted)] if len(wanted) else [0]
        out = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            some = of[wanted[i:j]].tolist()
            digests = b"".join([xxhash.xxh3_128_digest(strings[x]) for x in some])
            values = np.concatenate([minima[begin[x] : begin[x] + n_win[x]] for x in some])
            out.append((int(homes[wanted[i]]), digests, press(n_win[some].astype(np.int64).tobytes() + values.tobytes())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, schema, strict=True)], schema=schema)

    return bucket


def _loose(t: pa.DataType) -> pa.DataType:
    """The type with nulls allowed everywhere, as the schemas say that results are declared by."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _loose(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(pa.field(t.value_field.name, _loose(t.value_type)))
    if pa.types.is_map(t):
        return pa.map_(t.key_type, pa.field(t.item_field.name, _loose(t.item_type)))
    return t


def _resolve(k: int, m: int, names: list[str], hot: np.ndarray):
    def home(docs: pa.Table, answers: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor().decompress
        where: dict[bytes, int] = {}
        pieces, total = [], 0
        for digests, minima in zip(answers.column("digests").to_pylist(), answers.column("minima").to_pylist(), strict=True):
            n = len(digests) // 16
            raw = np.frombuffer(unpress(minima), np.int64)
            begin = np.cumsum(raw[:n]) - raw[:n] + total
            where.update(zip([digests[16 * i : 16 * i + 16] for i in range(n)], begin.tolist(), strict=True))
            pieces.append(raw[n:])
            total += len(raw) - n
        minima = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        kept: list[bytes | None] = [None] * len(docs)
        n_words, n_removed = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for rows, texts, ids in _blocks(docs):
            block = _Block(texts, k, m, hot)
            size, gone = block.size, np.zeros(len(block.begin), bool)
            if where and len(block.first):
                digest, get = xxhash.xxh3_128_digest, where.get
                found = np.fromiter((get(digest(s), -1) for s in block.packed(k)), np.int64, len(block.first))
                known = np.array([i is not None for i in ids])
                own = np.array([i or 0 for i in ids], np.int64)
                hit = np.flatnonzero((found >= 0) & known[block.of])
                n_win = (block.last - block.first + 1)[hit]
                inside = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
                start = np.repeat(block.first[hit], n_win) + inside
                start = start[minima[np.repeat(found[hit], n_win) + inside] < np.repeat(own[block.of[hit]], n_win)]
                depth = np.zeros(len(gone) + 1, np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + k, -1)
                gone = np.cumsum(depth[:-1]) > 0
            end = np.cumsum(size)
            lost = np.concatenate([[0], np.cumsum(gone)])
            n_words[rows], n_removed[rows] = size, lost[end] - lost[end - size]
            left = block.bytes[np.repeat(~gone, block.length + 1)].tobytes() if gone.any() else block.buffer
            held = np.concatenate([[0], np.cumsum(np.where(gone, 0, block.length + 1))])
            for row, t, i, j in zip(rows, texts, held[end - size].tolist(), held[end].tolist(), strict=True):
                if t is not None:
                    kept[row] = left[i : max(i, j - 1)]
        new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed)}
        return pa.Table.from_arrays([new[c] if c in new else docs.column(c).cast(_loose(docs.column(c).type)) for c in names], names=names)

    return home


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, minimiser: int = 5) -> DataFrame:
    """docs with text_col cut to the kept words, joined by one space, and the longs n_words and n_removed.

    A word goes if a window that covers it also starts in a document with a smaller id; windows are judged on the
    input. A null text stays null and has no words; an empty one stays empty. A row whose id is null neither removes
    nor loses words. Rows with the same id never remove each other's words; repeated rows come out alike. Other
    columns pass unchanged, whatever their names; input columns named n_words or n_removed are replaced.
    """
    homes = groups_for(docs, HOME_BYTES)
    buckets, tasks = homes, max(shuffle_partitions(docs.sparkSession), homes // TASK_HOMES)
    others = [c for c in docs.columns if c not in (id_col, text_col, *OUT)]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(0)
    raw = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), kept.alias("rest"))
    keyed = raw.withColumn("home", F.pmod(F.xxhash64("doc_id", "text"), F.lit(homes))).repartition(tasks, "home")  # tasks follow the input, whatever the session says
    hot = hot_minimisers(raw.select("doc_id", "text"), window, minimiser)
    sent = keyed.groupBy("home").applyInArrow(_emit(window, minimiser, buckets, hot), "bucket int, home long, strings binary, ids binary")
    answers = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_count(window), "home long, digests binary, minima binary")
    names = ["doc_id", "text", "rest", "n_words", "n_removed"]
    schema = f"doc_id long, text string, rest {keyed.schema['rest'].dataType.simpleString()}, n_words long, n_removed long"
    out = keyed.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(_resolve(window, minimiser, names, hot), schema)
    back = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text")} | {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    return out.select(*[back[c].alias(c) for c in docs.columns if c not in OUT], *OUT)
