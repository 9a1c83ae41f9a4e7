"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

1. Test items are cut into windows; the corpus is counted for their terms.
2. The index holds, over the whole corpus, the postings (term, document, position) of each window's rarest term, and with each
   the postings around it, as far as a window reaches.
3. A window's rarest list is shifted by its term's offset, and intersected with the lists of its other terms, rarest first, each
   shifted by its own offset: these entries lie beside the posting, so no list is shuffled and no text leaves the scan.
4. Positions, items and counts travel as numbers.

Test tables are broadcast only while their counted rows are below SMALL; beyond it windows meet postings by a shuffle in
which a term's list is spread over SALTS keys, and the corpus is read once for each SMALL rarest terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_table, unused

#: Rows that are broadcast at most, and keys that a list is spread over.
SMALL, SALTS = 200_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(c: Column) -> Column:
    """c with A-Z in lower case and all else as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(c), SEPARATORS), ""), F.array().cast("array<string>"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= SMALL else df


def test_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(win, n, terms, item): the windows of each item, win being their words joined by spaces. An item has a window once."""
    words = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("w")).where("size(w) > 0")
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("i"))
    cut = starts.select("item", F.expr(f"slice(w, i, {window})").alias("terms")).distinct()
    return cut.select(F.array_join("terms", " ").alias("win"), F.size("terms").alias("n"), "terms", "item")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): occurrences in the whole corpus of each of the terms that occur."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def slots(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(win, n, slots): for windows all of whose terms occur, their terms with their offsets, rarest first."""
    each = windows.select("win", "n", F.posexplode("terms").alias("off", "term")).join(counts, "term")
    ranked = each.groupBy("win", "n").agg(F.sort_array(F.collect_list(F.struct("df", "off", "term"))).alias("slots"))
    return ranked.where(F.size("slots") == F.col("n"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The index: (term, doc_id, th, pos, base, around) for every occurrence of the terms.

    th is a hash of the document's text; around holds the words from position base on that lie at most `reach` places from pos.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    tokens = words.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "term"))
    base = F.greatest(F.col("pos") - reach, F.lit(0))
    rows = terms.count()
    passes, out = max(1, -(-rows // max(1, SMALL))), None
    for i in range(passes):  # each joins in the scan, so that whole texts meet no shuffle
        some = F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i))
        part = tokens.join(some, "term", "left_semi").select("term", "doc_id", "th", "pos", base.alias("base"), F.slice("w", base + 1, F.col("pos") - base + 1 + reach).alias("around"))
        out = part if out is None else out.unionAll(part)
    return out


def _prepared(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, window: int, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Windows with their items; (win, n, slots, off, doc_id, th, pos, base, around): the rarest lists of all windows, off being the rarest term's offset."""
    windows = checkpointed(test_windows(items, item_col, item_text, window))
    terms = checkpointed(windows.select(F.explode("terms").alias("term")).distinct())
    counts = checkpointed(term_counts(docs, sized(terms, terms.count())))
    lists = checkpointed(slots(windows.select("win", "n", "terms").distinct(), counts).select("win", "n", "slots", F.col("slots")[0]["term"].alias("term"), F.col("slots")[0]["off"].alias("off")))
    wanted = checkpointed(lists.select("term").distinct())
    index = checkpointed(postings(docs, wanted, window - 1 + slop))
    rows = lists.count()
    if rows <= SMALL:
        return windows, index.join(F.broadcast(lists), "term")
    spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return windows, index.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(spread, ["term", "salt"])


def _phrases(lists: DataFrame) -> DataFrame:
    """(doc_id, th, win, n, at): where all of a window's terms stand at their offsets. Rows that repeat a document are one."""
    fits = F.expr("forall(slots, s -> get(around, pos - base - off + s.off) = s.term)")
    return lists.where(fits).select("doc_id", "th", "win", "n", (F.col("pos") - F.col("off")).alias("at")).distinct()


def _same_document(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.th") == F.col(f"{right}.th"))


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(doc_id, th, win, n, at): a row for each place, in words from 0, where a window of an item stands in a document.

    th is a hash of the document's text: rows that repeat id and text are one document, rows that share an id are several.
    Nulls and empty tables are met as by contamination.
    """
    return _phrases(_prepared(text_table(docs, id_col, text_col), items, item_col, item_text, window)[1])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """A row for each row of docs: doc_id, th, n_words, n_hit, item_ids (strings, sorted; th is a hash of the text).

    A document word is hit if it lies inside an occurrence of a window of some item; an item of fewer words is one
    window, one without words has none. Null texts have no words. Rows that repeat id and text have the same result; a
    null id is an id like any other, an item with a null id hits but is not listed. With no items, or no documents, nothing is
    hit. Extra columns are left out. A row's item_ids hold at most as many strings as there are items.
    """
    docs = text_table(docs, id_col, text_col)
    windows, lists = _prepared(docs, items, item_col, item_text, window)
    matches = checkpointed(_phrases(lists))
    hit = matches.select("doc_id", "th", F.explode(F.expr("sequence(at, at + n - 1)")).alias("p")).distinct().groupBy("doc_id", "th").agg(F.count("*").alias("n_hit"))
    held = matches.select("doc_id", "th", "win").distinct().join(sized(windows.select("win", "item"), windows.count()), "win")
    listed = held.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    both = hit.alias("l").join(listed.alias("r"), _same_document("l", "r")).select("l.doc_id", "l.th", "n_hit", "item_ids")
    both = checkpointed(both)
    every = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = every.alias("l").join(sized(both, both.count()).alias("r"), _same_document("l", "r"), "left")
    return out.select("l.doc_id", "l.th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of an item. Rows without an id stay if their text is clean."""
    bad = checkpointed(phrase_matches(docs, items, id_col, text_col, window=window).select("doc_id", "th").distinct())
    d, h = unused(docs, "d"), unused(docs, "h")
    named = sized(bad.select(F.col("doc_id").alias(d), F.col("th").alias(h)), bad.count())
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(h))
    return docs.join(named, same, "left_anti")


def proximity_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 5) -> DataFrame:
    """(win, doc_id, th, at, spread): where all terms of a window stand near their places.

    A term's shift is its position less its offset in the window. A match at `at` holds, for every term of the window, a
    shift from at to at + slop, and for some term the shift at itself; spread is the least s for which at + s would do,
    0 for the phrase itself. One row for each such place. Each term is looked up on its own: where a window repeats a
    term, one word may serve twice. The rarest term's list gives the places to try. Documents are known by id and text, as by
    phrase_matches; null and empty texts and items match nothing, empty tables give no rows.
    """
    _, lists = _prepared(text_table(docs, id_col, text_col), items, item_col, item_text, window, slop)
    tried = lists.withColumn("at", F.explode(F.expr(f"sequence(pos - off - {slop}, pos - off)")))
    low = "greatest(at + s.off, 0)"
    shifts = F.expr(f"transform(slots, s -> if(at + s.off + {slop} < 0, null, {low} - at - s.off - 1 + nullif(array_position(slice(around, {low} - base + 1, at + s.off + {slop} - {low} + 1), s.term), 0)))")
    found = tried.select("win", "doc_id", "th", "at", shifts.alias("x")).where(F.expr("forall(x, y -> y is not null) and array_min(x) = 0"))
    return found.select("win", "doc_id", "th", "at", F.array_max("x").cast("int").alias("spread")).distinct()
