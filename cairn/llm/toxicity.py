"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, count an expression (a word) as Kneser-Ney smoothing counts lower orders:
by how many different words it follows in texts of the class (a text's first word follows its beginning). A passage that
many documents share thus counts once, however often it is copied. Each class model discounts its counts and gives what that
frees to one shared backoff distribution, by the number of different words that a word follows in either class:

    P(w | class) = (max(n(w, class) - D, 0) + freed(class) * shared(w)) / n(class)

So a word that is rare in both classes, or unknown, has the same ratio as any other such word, whatever it is; only
words with more than D different words before them in some class need a row of their own.

A span scores the difference of its two log-likelihoods, divided by its length. A text is judged by its strongest span of
each length in SPANS and by all of it. As an extreme rises with length, the strongest span counts by its surprise: -log of the
chance that as many spans of ordinary texts hold one as strong, by ordinary rows that the counts had not seen. Surprises and
the whole text's difference enter a logistic curve, in which none speaks against a text.

Pairs of neighbours are gathered exactly, in a grouped table with a row for each word, which grows with the corpus; tasks send
their distinct pairs packed to the buckets of words. A word is known by 64 bits of hash. The curve is fitted on a
bounded sample, each row by the counts of the other folds; scores are by counts of all training rows. The rows of words with
more than D are broadcast, 12 bytes each (24 while the curve is fitted).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import checkpointed_in_small_batches, groups_for, text_table

#: The discount, words remembered, pairs of neighbours that a task holds before it sends them.
DISCOUNT, MEMO, HELD = 2, 100_000, 1 << 20
#: Files' bytes for each bucket of words.
BUCKET_BYTES = 32 << 20
#: Words of the spans that are judged, beside the whole text. A shorter text is filled up with neutral words.
SPANS = (1, 5)
#: Rows that the curve is fitted on, and rows of labels that are broadcast, at most.
CURVE_ROWS, SMALL = 20_000, 1_000_000
#: The curve where there is nothing to fit it on: an intercept, a weight for each of SPANS, and one for the whole text.
PRIOR = np.array([-6.0, 1.0, 1.0, 0.0])
#: Training folds; the counts of all of them (0) and of all but each; their columns by class and in either.
FOLDS = (1, 2, 3, 4)
VIEWS = (0, *FOLDS)
COLUMNS = [f"{c}{v}" for v in VIEWS for c in ("ordinary", "toxic", "either")]
#: Log ratios at which the strength of ordinary spans is recorded.
LEVELS = np.arange(-2, 10.25, 0.25)
WORD = re.compile(r"[^\W\d_]+")
U = np.uint64
BEGINNING = U(0)


class _Hash(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Hash()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_memo.__getitem__, words), U, len(words))


def distinct(word: np.ndarray, left: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, left) in order, and their bits joined."""
    if not len(word):
        return word, left, bits
    order = np.lexsort((left, word))
    word, left, bits = word[order], left[order], bits[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (left[1:] != left[:-1])
    return word[new], left[new], np.bitwise_or.reduceat(bits, np.flatnonzero(new))


class Pairs:
    """Pairs (word, word before it), with a bit for each fold and class that holds them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, h: np.ndarray, label: int, fold: int = 1) -> None:
        if len(h):
            bit = np.uint8(1 << 2 * (fold - 1) + label)
            self.parts.append((h, np.concatenate([[BEGINNING], h[:-1]]), np.full(len(h), bit)))
            self.held += len(h)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.empty(0, U), np.empty(0, U), np.empty(0, np.uint8))
        return distinct(*(np.concatenate(x) for x in zip(none, *self.parts, strict=True)))


def counts_of(word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct pairs in the order of their words: the words, and a row of counts for each of COLUMNS."""
    words, at = np.unique(word, return_inverse=True)
    rows = []
    for v in VIEWS:
        own = [sum(1 << 2 * (f - 1) + label for f in FOLDS if f != v) for label in (0, 1)]
        rows += [np.bincount(at, bits & mask != 0, len(words)) for mask in (*own, own[0] | own[1])]
    return words, np.stack(rows).astype(np.int64)


def totals_of(counts: np.ndarray) -> dict[str, int]:
    """What ratios need of all words: sums of counts, of what discounts take at most, and how many words there are."""
    out = {}
    for c, n in zip(COLUMNS, counts, strict=True):
        out |= {f"n_{c}": int(n.sum()), f"freed_{c}": int(np.minimum(n, DISCOUNT).sum()), f"words_{c}": int((n > 0).sum())}
    return out


def log_probabilities(counts: np.ndarray, totals: dict[str, int], view: int) -> np.ndarray | None:
    """Rows of log P(word | ordinary) and log P(word | toxic), for counts (ordinary, toxic, either) of words; None if a class has no words."""
    names = ("ordinary", "toxic")
    n, freed = ([totals[f"{k}_{c}{view}"] for c in names] for k in ("n", "freed"))
    if not min(n):
        return None
    shared = (counts[2] + 1) / (totals[f"n_either{view}"] + totals[f"words_either{view}"] + 1)  # one for all unknown words
    return np.stack([np.log((np.maximum(counts[i] - DISCOUNT, 0) + freed[i] * shared) / n[i]) for i in (0, 1)])


class Model:
    """Log-likelihood ratios of words, and the one of all that are rare or unknown; the strength of ordinary spans; the curve."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: dict[str, int], view: int = 0, curve: np.ndarray = PRIOR):
        order = np.argsort(words)
        self.words, own = words[order], counts[3 * view : 3 * view + 3, order]
        rare = log_probabilities(np.zeros((3, 1)), totals, view)
        known = log_probabilities(own, totals, view)
        self.rare = 0.0 if rare is None else float(rare[1, 0] - rare[0, 0])
        self.ratio = np.zeros(len(self.words), np.float32) if known is None else (known[1] - known[0]).astype(np.float32)
        self.curve, self.tails = curve, np.full((len(SPANS), len(LEVELS)), 50.0)  # logs of the chance that an ordinary span is as strong as a level; as yet no surprise

    def ratios(self, h: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not len(self.words):
            return np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.ratio[at], self.rare).astype(np.float64)

    def surprise(self, i: int, top: float, n: int) -> float:
        """-log of the chance that n spans of ordinary texts, of the i-th length, hold one as strong as top."""
        x = n * math.exp(np.interp(top, LEVELS, self.tails[i]))
        return -math.log(-math.expm1(-x)) if 0 < x < 30 else 0.0

    def judged(self, tops: list[tuple[float, int]], mean: float) -> list[float]:
        return [*(self.surprise(i, top, n) if n else 0.0 for i, (top, n) in enumerate(tops)), mean]

    def features(self, h: np.ndarray) -> list[float]:
        r = self.ratios(h)
        return self.judged([(float(s.max()), len(s)) if len(s := spans(r, k)) else (0.0, 0) for k in SPANS], float(r.mean()) if len(r) else 0.0)

    def score(self, h: np.ndarray) -> float:
        z = float(self.curve[0] + np.dot(self.curve[1:], self.features(h)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def spans(r: np.ndarray, k: int) -> np.ndarray:
    """The length-normalised ratio of each span of k words; of a text that has fewer but some, that of the one it fills in part."""
    if len(r) < k:
        return np.full(min(1, len(r)), r.sum() / k)
    sums = np.concatenate([[0.0], np.cumsum(r)])
    return (sums[k:] - sums[:-k]) / k


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, of weights not below 0; the prior curve unless both classes are there."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    use = np.arange(x.shape[1])
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, use]])
        w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [1e-2] * len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            out = np.zeros(1 + x.shape[1])
            out[0], out[1 + use] = w[0], w[1:]
            return out
        use = use[w[1:] >= 0]


def _gather(buckets: int):
    """Distinct pairs of a task, packed by the bucket of their word: words, how many pairs each has; the words before, and bits."""

    def sent(pairs: Pairs) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1).compress
        word, left, bits = pairs.distinct()
        words, per = np.unique(word, return_counts=True)
        some, ours = np.argsort(words % U(buckets), kind="stable"), np.argsort(word % U(buckets), kind="stable")
        words, per, left, bits = words[some], per[some].astype(np.int32), left[ours], bits[ours]
        bucket = (words % U(buckets)).astype(np.int64)
        cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(words)]
        ends = [0, *np.cumsum(per).tolist()]
        out = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = ends[i], ends[j]
            out.append((int(bucket[i]), j - i, press(b"".join([part.tobytes() for part in (words[i:j], per[i:j], left[x:y], bits[x:y])]))))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "n", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs()
        for b in batches:
            for text, label, own in zip(*(b.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                pairs.add(word_hashes(text), label, own)
                if pairs.held >= HELD:
                    yield sent(pairs)
                    pairs = Pairs()
        yield sent(pairs)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """A row for each word of a bucket, with its counts."""
    unpress, parts = zstandard.ZstdDecompressor().decompress, []
    for m, cells in zip(table.column("n").to_pylist(), table.column("cells").to_pylist(), strict=True):
        raw = unpress(cells)
        words, per = np.frombuffer(raw, U, m), np.frombuffer(raw, np.int32, m, 8 * m)
        at, size = 12 * m, int(per.sum())
        parts.append((np.repeat(words, per), np.frombuffer(raw, U, size, at) if at % 8 == 0 else np.frombuffer(raw[at : at + 8 * size], U), np.frombuffer(raw, np.uint8, size, at + 8 * size)))
    word, _, bits = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    words, counts = counts_of(word, bits)
    return pa.Table.from_arrays([pa.array(words.view(np.int64)), *(pa.array(c.astype(np.int32)) for c in counts)], names=["word", *COLUMNS])


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marks = marks.where("doc_id is not null and label is not null").where(fold() > 0).groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    texts = text_table(docs, id_col, text_col).where(fold() > 0)
    return texts.join(F.broadcast(marks) if marks.count() <= SMALL else marks, "doc_id")


def word_counts(known: DataFrame, buckets: int) -> DataFrame:
    """(word, COLUMNS): of each word, exactly, how many different words it follows, by class and training folds."""
    parts = known.select("text", "label", fold().alias("fold")).mapInArrow(_gather(buckets), "bucket int, n int, cells binary")
    return checkpointed_in_small_batches(parts.groupBy("bucket").applyInArrow(_merge, "word long, " + ", ".join(f"{c} int" for c in COLUMNS)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of all labelled rows whose fold is 1 to 4, with a curve from at most CURVE_ROWS of them, each by the counts of the other folds.

    Rows of fold 0, rows without an id and rows without a label take no part; a document labelled twice counts as
    toxic if any label says so; of null and empty texts there is nothing to count. Without words of both classes every
    score is that of an empty text.
    """
    spark = docs.sparkSession
    known = _labelled(docs, labels, id_col, text_col, label_col)
    table = word_counts(known, groups_for(docs, BUCKET_BYTES))
    sums = [x for c in COLUMNS for x in (F.sum(c).alias(f"n_{c}"), F.sum(F.least(c, F.lit(DISCOUNT))).alias(f"freed_{c}"), F.sum((F.col(c) > 0).cast("int")).alias(f"words_{c}"))]
    totals = {k: int(n or 0) for k, n in (table.agg(*sums).first() or Row()).asDict().items()}
    frequent = table.where(F.greatest("ordinary0", "toxic0") > DISCOUNT).toArrow()  # other words have the ratio of rare ones
    words, counts = frequent.column("word").to_numpy().view(U), np.stack([frequent.column(c).to_numpy() for c in COLUMNS]).astype(np.int64)
    model, *without = [Model(words, counts, totals, v) for v in VIEWS]
    shared = spark.sparkContext.broadcast((model.words, [(m.ratio, m.rare) for m in without]))

    @F.pandas_udf("array<double>")
    def strengths(texts: pd.Series, folds: pd.Series) -> pd.Series:
        """The mean; for each span length how many there are, how many are as strong as each level, and the strongest."""
        m, out = Model.__new__(Model), []
        m.words, by_fold = shared.value
        for t, f in zip(texts, folds, strict=True):
            m.ratio, m.rare = by_fold[f - 1]
            r = m.ratios(word_hashes(t))
            row = [float(r.mean()) if len(r) else 0.0]
            for k in SPANS:
                s = np.sort(spans(r, k))
                row += [len(s), *(len(s) - np.searchsorted(s, LEVELS)).tolist(), s[-1] if len(s) else 0.0]
            out.append(row)
        return pd.Series(out, dtype="object")

    chosen = [r.doc_id for r in known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS).collect()]
    sample = known.join(F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id", "left_semi")
    got = sample.select("label", strengths("text", fold()).alias("x")).toArrow()
    label, wide = got.column("label").to_numpy(), len(LEVELS) + 2
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(label), 1 + len(SPANS) * wide)
    for i in range(len(SPANS)):
        seen = x[label == 0, 1 + i * wide : (i + 1) * wide].sum(0)
        if seen[0]:
            model.tails[i] = np.log((seen[1:] + 0.5) / (seen[0] + 1))
    rows = [model.judged([(row[(i + 1) * wide], int(row[1 + i * wide])) for i in range(len(SPANS))], row[0]) for row in x]
    if rows:
        model.curve = fit_curve(np.array(rows), label.astype(float))
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with out: a double from 0 to 1, 0.5 or more for texts that are likelier toxic.

    A null text scores as an empty one. Each row is scored alone, whole; repeated rows score alike, other columns pass
    unchanged, an input column named out is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.ratio, model.rare, model.tails, model.curve))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = Model.__new__(Model)
        m.words, m.ratio, m.rare, m.tails, m.curve = shared.value
        return pd.Series([m.score(word_hashes(t)) for t in texts], dtype="float64")

    return docs.withColumn(out, score(F.col(f"`{text_col}`").cast("string")))
