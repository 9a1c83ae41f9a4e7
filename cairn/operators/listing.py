"""Listing of one directory: entries, order, shares, class mix and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classes import class_name
from ..functions.keys import check_prefix, entry_name, has_delimiter, rest_of
from ..functions.pricing import monthly, prices_of
from ..functions.text import bar_cells, dollars, human_bytes, share_text
from .order import positions

#: What a listing can be sorted by, and whether the largest come first unless asked otherwise.
ORDERS = {"size": ("bytes", True), "name": ("name", False), "count": ("objects", True), "cost": ("cost", True)}


def below(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects whose key starts with the prefix; the test reaches the file scan."""
    return objects.where(F.col("key").startswith(prefix)) if prefix else objects


def _named(objects: DataFrame, prefix: str) -> DataFrame:
    rest = rest_of(F.col("key"), check_prefix(prefix))
    return below(objects, prefix).select(entry_name(rest).alias("name"), has_delimiter(rest).alias("is_dir"), "class", "size")


def entries_by_class(objects: DataFrame, prefix: str) -> DataFrame:
    """(name, is_dir, class, objects, bytes): what each entry holds of each class, classes without bytes included."""
    return _named(objects, prefix).groupBy("name", "is_dir", "class").agg(F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def list_directory(objects: DataFrame, prefix: str = "") -> DataFrame:
    """(name, is_dir, class, objects, bytes) of the entries of a directory; none for a prefix that no key has.

    A directory's name keeps its delimiter. The class is a file's; null for a directory. A key that equals the prefix is
    a file with an empty name. A file and a directory of one name are two entries.
    """
    cls = F.when(~F.col("is_dir"), F.max("class"))
    return _named(objects, prefix).groupBy("name", "is_dir").agg(cls.alias("class"), F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def list_rollup(rolled: DataFrame, prefix: str = "") -> DataFrame:
    """Directories of a listing from the roll-up, without reading objects: (name, objects, bytes)."""
    mine = rolled.where(F.col("parent") == check_prefix(prefix))
    return mine.groupBy(rest_of(F.col("prefix"), prefix).alias("name")).agg(F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"))


def with_entry_cost(objects: DataFrame, prefix: str, region: str) -> DataFrame:
    """list_directory with cost, in dollars a month.

    One aggregation: classes and prices are constants, so each class has its own whole sum and no join is needed.
    """
    per = prices_of(region)
    in_class = [F.sum(F.when(F.col("class") == i, F.col("size")).otherwise(0)).alias(f"b{i}") for i in per]
    whole = _named(objects, prefix).groupBy("name", "is_dir").agg(F.max("class").alias("c"), F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"), *in_class)
    cost = sum((monthly(F.col(f"b{i}"), F.lit(p)) for i, p in per.items()), F.lit(0.0))
    return whole.select("name", "is_dir", F.when(~F.col("is_dir"), F.col("c")).alias("class"), "objects", "bytes", F.round(cost, 6).alias("cost"))


def sort_keys(by: str, descending: bool | None = None, dirs_first: bool = False) -> list[Column]:
    """Order of a listing; ties stand by name, upward in either direction."""
    col, down = ORDERS[by]
    down = down if descending is None else descending
    keys = [F.desc("is_dir")] if dirs_first else []
    return [*keys, F.desc(col) if down else F.asc(col), F.asc("name")]


def next_order(by: str, descending: bool, chosen: str) -> tuple[str, bool]:
    """The order after a column was chosen: the other direction if it is the same one, else the column's own."""
    return (by, not descending) if chosen == by else (chosen, ORDERS[chosen][1])


def ranked(entries: DataFrame, by: str = "size", descending: bool | None = None, dirs_first: bool = False, wide: bool = False) -> DataFrame:
    """entries with rank from 1. A listing that a person reads is ranked in one task; wide ranks one of any size, dealt by ranges and kept."""
    keys = sort_keys(by, descending, dirs_first)
    if wide:
        # A file and a directory never share a name: the latter ends in the delimiter. So the name leaves no ties.
        return positions(entries, *keys).withColumn("rank", (F.col("pos") + 1).cast("int")).drop("pos")
    return entries.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def top_entries(entries: DataFrame, n: int, by: str = "size") -> DataFrame:
    """The first n entries with their rank. Sort and limit meet in one operator that keeps n rows a task; only these are ranked."""
    return ranked(entries.orderBy(*sort_keys(by)).limit(n), by)


def with_share(entries: DataFrame) -> DataFrame:
    """entries with share (0 to 1, null without bytes), its text and the cells of its bar. The total is a scalar subquery."""
    t = F.coalesce(entries.agg(F.sum("bytes").cast("long")).scalar(), F.lit(0).cast("long"))
    held = entries.withColumn("total", t)
    t = F.col("total")
    return held.withColumn("share", F.when(t > 0, F.round(F.col("bytes") / F.when(t > 0, t), 9))).withColumn("share_text", share_text(F.col("bytes"), t)).withColumn("cells", bar_cells(F.col("bytes"), t)).drop("total")


def listing_totals(objects: DataFrame, prefix: str, region: str) -> DataFrame:
    """One row: objects, bytes and cost of a listing."""
    per = prices_of(region)
    zero = F.lit(0).cast("long")
    in_class = [F.coalesce(F.sum(F.when(F.col("class") == i, F.col("size"))), zero).alias(f"b{i}") for i in per]
    sums = below(objects, check_prefix(prefix)).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), zero).cast("long").alias("bytes"), *in_class)
    cost = sum((monthly(F.col(f"b{i}"), F.lit(p)) for i, p in per.items()), F.lit(0.0))
    return sums.select("objects", "bytes", F.round(cost, 6).alias("cost"))


def dominant_class(objects: DataFrame, prefix: str) -> DataFrame:
    """(name, is_dir, top, extra, label): each entry's class with most bytes (of equals the lowest code; 0 without bytes), and how many others have bytes."""
    shown = entries_by_class(objects, prefix).withColumn("b", F.when(F.col("bytes") != 0, F.col("bytes")))
    top = F.max_by("class", F.when(F.col("b").isNotNull(), F.struct("b", -F.col("class"))))
    got = shown.groupBy("name", "is_dir").agg(F.coalesce(top, F.lit(0)).alias("top"), F.greatest(F.count("b") - 1, F.lit(0)).alias("extra"), F.count("b").alias("k"))
    label = F.when(F.col("k") == 0, F.lit("")).when(F.col("extra") > 0, F.concat(class_name(F.col("top")), F.lit(" +"), F.col("extra").cast("string"))).otherwise(class_name(F.col("top")))
    return got.select("name", "is_dir", "top", F.col("extra").cast("int").alias("extra"), label.alias("label"))


def class_mix(objects: DataFrame, prefix: str) -> DataFrame:
    """(class, objects, bytes) of a listing. A directory's objects all count for its dominant class; bytes go where they are.

    For exact counts use class_totals of the rows below the prefix.
    """
    by_class = entries_by_class(objects, prefix)
    counts = by_class.groupBy("name", "is_dir").agg(F.sum("objects").alias("objects"))
    tops = dominant_class(objects, prefix).select("name", "is_dir", "top")
    files = by_class.where(~F.col("is_dir")).select("class", F.col("objects"), "bytes")
    dirs = counts.join(tops, ["name", "is_dir"]).where("is_dir").select(F.col("top").alias("class"), "objects", F.lit(0).cast("long").alias("bytes"))
    held = by_class.where("is_dir and bytes <> 0").select("class", F.lit(0).cast("long").alias("objects"), "bytes")
    return files.unionByName(dirs).unionByName(held).groupBy("class").agg(F.sum("objects").cast("long").alias("objects"), F.sum("bytes").cast("long").alias("bytes"))


def root_report(objects: DataFrame, region: str, prefix: str = "") -> DataFrame:
    """The listing as a table to print: name, objects ((file) for a file), bytes, monthly cost; in the order of rank."""
    rows = ranked(with_entry_cost(objects, prefix, region), "name")
    return rows.select("rank", "name", F.when(F.col("is_dir"), F.col("objects").cast("string")).otherwise(F.lit("(file)")).alias("objects"), F.col("bytes"), human_bytes(F.col("bytes")).alias("size"), "cost", dollars(F.col("cost")).alias("monthly"))
