"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 characters, within words, blanks marking word
ends), over all its training texts. A document's own most frequent n-grams are compared to each profile by the
out-of-place distance: the sum over n-grams of how far apart the two ranks are, or the profile's length if absent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import with_struct

#: Length of a profile; distinct n-grams of a language that a task holds before it sends them on; characters counted at once.
PROFILE, HELD, STEP = 300, 1_000_000, 1 << 21
END = (1 << 21) - 1
BLANK = re.compile(r"\s")
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of the text's words, lower-cased, repeats included; a blank's code point is 0."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    word = letters()[c]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first character behind a word is its blank
    c = np.concatenate([[0], np.where(word, c, 0)[keep], [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.empty(0, np.int64)
    one = c[c != 0] << 42 | END << 21 | END
    two = c[:-1] << 42 | c[1:] << 21 | END
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 0]
    return np.concatenate([one, two, three])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and their counts. Long texts are cut at white space, where no n-gram and no rule of
    lower-casing reaches across, and counted in steps: the result is that of the whole."""
    if text and len(text) > STEP:
        parts, at = [], 0
        while at < len(text):
            blank = BLANK.search(text, at + STEP)
            end = blank.end() if blank else len(text)
            parts.append(_distinct(text[at:end]))
            at = end
        return _summed(parts)
    return _distinct(text)


def _distinct(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(grams(text))
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    return g[new], np.diff(np.append(new, len(g)))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    return g[new], np.add.reduceat(n, new) if len(g) else n


def top(g: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order; ties by code."""
    if len(g) > size:
        floor = np.partition(n, len(n) - size)[len(n) - size]
        some = n >= floor
        g, n = g[some], n[some]
    return g[np.lexsort((g, -n))][:size]


class Profiles:
    """Ranks of n-grams in each language's profile."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (of equals the first by name) and how near: 1 less the share of the largest distance."""
        own = top(*counted(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        rank = self.ranks[:, at]
        far = np.where(rank < 0, PROFILE, np.minimum(np.abs(rank - np.arange(len(own))), PROFILE)).sum(1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (PROFILE * len(own)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        g, n = _summed(held.pop(lang))
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            g, n = counted(text)
            if not len(g):
                continue
            held.setdefault(lang, []).append((g, n))
            size[lang] = size.get(lang, 0) + len(g)
            if size[lang] > HELD:
                held[lang] = [_summed(held[lang])]
                size[lang] = len(held[lang][0][0])
                if size[lang] > HELD // 2:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all rows whose language is not null. The driver gets PROFILE n-grams for each language."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First the best of each bucket, so that no task orders all n-grams of a language.
    part = Window.partitionBy("lang", "bucket").orderBy(F.desc("n"), "gram")
    some = counts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= PROFILE)
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = some.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in best.select("lang", "gram", "r").orderBy("lang", "r").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return Profiles(profiles)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    A text that is null or has no letters is `und` with score 0, as is every text if nothing was learned. Rows are
    independent, so repeated rows come out alike; other columns pass, input columns lang_pred and score are replaced.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return with_struct(docs, predict(F.col(f"`{text_col}`").cast("string")), ["lang_pred", "score"])
