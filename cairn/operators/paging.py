"""Listing pages, as an object store serves them, and fixed-size batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entry_name, has_delimiter, rest_of
from ..plans.session import stored
from ..schema import DELIMITER, PAGE
from .listing import below
from .order import positions


def page_size(max_keys: int) -> int:
    """1000 for sizes below 1 or above 1000."""
    return max_keys if 0 < max_keys <= PAGE else PAGE


def page_flat(objects: DataFrame, prefix: str = "", start_after: str = "", max_keys: int = PAGE) -> DataFrame:
    """One row (contents, truncated, token): the first keys behind start_after that have the prefix.

    Sort and limit are one operator that keeps max_keys + 1 rows a task.
    """
    n = page_size(max_keys)
    rows = below(objects, prefix).where(F.col("key") > start_after).select("key").orderBy("key").limit(n + 1)
    keys = F.array_sort(F.collect_list("key"))
    got = rows.agg(keys.alias("k"))
    more = F.size("k") > n
    kept = F.slice("k", 1, n)
    return got.select(kept.alias("contents"), more.alias("truncated"), F.when(more, F.element_at(kept, -1)).alias("token"))


def page_delimited(objects: DataFrame, prefix: str = "", start_after: str = "", max_keys: int = PAGE, delimiter: str = DELIMITER) -> DataFrame:
    """One row (contents, common_prefixes, truncated, token): files and directories count alike and stand in one order.

    A token that is a directory skips all that lies below it. Another delimiter than / is as good as none.
    """
    if delimiter != DELIMITER:
        flat = page_flat(objects, prefix, start_after, max_keys)
        return flat.select("contents", F.array().cast("array<string>").alias("common_prefixes"), "truncated", "token")
    n = page_size(max_keys)
    rest = rest_of(F.col("key"), prefix)
    name = F.concat(F.lit(prefix), entry_name(rest))
    rows = below(objects, prefix).where(F.col("key") > start_after)
    if start_after.endswith(DELIMITER) and start_after.startswith(prefix) and len(start_after) > len(prefix):
        rows = rows.where(~F.col("key").startswith(start_after))
    names = rows.select(name.alias("name"), has_delimiter(rest).alias("is_dir")).distinct().orderBy("name", "is_dir").limit(n + 1)
    got = names.agg(F.array_sort(F.collect_list(F.struct("name", "is_dir"))).alias("k"))
    kept = F.slice("k", 1, n)
    more = F.size("k") > n
    files = F.transform(F.filter(kept, lambda x: ~x["is_dir"]), lambda x: x["name"])
    dirs = F.transform(F.filter(kept, lambda x: x["is_dir"]), lambda x: x["name"])
    return got.select(files.alias("contents"), dirs.alias("common_prefixes"), more.alias("truncated"), F.when(more, F.element_at(kept, -1)["name"]).alias("token"))


def all_pages(objects: DataFrame, prefix: str = "", max_keys: int = PAGE) -> DataFrame:
    """(page, keys, first_key, last_key) of a whole listing without a delimiter."""
    n = page_size(max_keys)
    page = F.floor(F.col("pos") / n).cast("long")
    return positions(below(objects, prefix).select("key")).groupBy(page.alias("page")).agg(F.count("*").alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def chunks(objects: DataFrame, size: int = PAGE) -> DataFrame:
    """(chunk, start_from, first_key, last_key, objects, bytes) of batches of a fixed size; start_from is the last key before.

    The key before a chunk's first comes over by an equi-join on the chunk's number.
    """
    n = F.floor(F.col("pos") / size).cast("long")
    rows = positions(objects.select("key", "size")).groupBy(n.alias("chunk")).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))
    rows = stored(rows)
    before = rows.select((F.col("chunk") + 1).alias("chunk"), F.col("last_key").alias("start_from"))
    return rows.join(before, "chunk", "left").select("chunk", F.coalesce("start_from", F.lit("")).alias("start_from"), "first_key", "last_key", "objects", "bytes")


def batch_log(batches: DataFrame) -> DataFrame:
    """(chunk, line): of each batch how many objects it has, its first key and its last."""
    return batches.select("chunk", F.format_string("%d: %d objects, %s to %s", "chunk", "objects", "first_key", "last_key").alias("line"))


def visible(cursor: int, rows: int, total: int) -> tuple[int, int]:
    """The first and the end of the entries to show so that the cursor stands in the middle where it can."""
    rows = max(rows, 1)
    if total <= rows:
        return 0, total
    start = min(max(cursor - rows // 2, 0), total - rows)
    return start, start + rows


def window_rows(ranked: DataFrame, cursor: int, rows: int, total: int) -> DataFrame:
    """The entries of a ranked listing that a window of so many rows shows."""
    start, end = visible(cursor, rows, total)
    return ranked.where(F.col("rank").between(start + 1, end))


def raised(lo: Column, to: str) -> Column:
    """A lower bound after a seek: it never goes back."""
    return F.greatest(lo, F.lit(to))
