"""Totals of every directory by storage class, all levels at once, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ancestors, depth, directory_of, parent_of
from ..schema import CLASSES


def rollup(objects: DataFrame, n: Column | None = None) -> DataFrame:
    """(prefix, parent, depth, class, objects, bytes) for the root and every directory.

    Objects are summed by their own directory and class first; only these sums are copied to the directories above, so
    the copies follow the number of directories, not of objects. n counts an object: 1, or a sign for changes. Zero-byte
    classes stay: they count objects.
    """
    one = F.lit(1) if n is None else n
    own = objects.groupBy(directory_of(F.col("key")).alias("dir"), "class").agg(F.sum(one).alias("objects"), F.sum(F.col("size") * one).alias("bytes"))
    spread = own.select(F.explode(ancestors(F.col("dir"))).alias("prefix"), "class", "objects", "bytes")
    return described(spread.groupBy("prefix", "class").agg(F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes")))


def described(sums: DataFrame) -> DataFrame:
    """Rows (prefix, class, objects, bytes) with parent and depth."""
    p = F.col("prefix")
    return sums.select("prefix", parent_of(p).alias("parent"), depth(p).alias("depth"), "class", F.col("objects").cast("long").alias("objects"), F.col("bytes").cast("long").alias("bytes"))


def rollup_delta(changes: DataFrame) -> DataFrame:
    """Signed totals of rows (key, size, class, sign): +1 for what came, -1 for what went."""
    return rollup(changes, F.col("sign"))


def apply_delta(current: DataFrame, delta: DataFrame) -> DataFrame:
    """A roll-up after signed totals; classes of a directory with no objects left go."""
    both = current.select("prefix", "class", "objects", "bytes").unionByName(delta.select("prefix", "class", "objects", "bytes"))
    return described(both.groupBy("prefix", "class").agg(F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes")).where("objects <> 0"))


def totals(objects: DataFrame) -> DataFrame:
    """One row: objects and bytes."""
    return objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def class_totals(objects: DataFrame) -> DataFrame:
    """(class, objects, bytes); codes that are not known count as 0."""
    code = F.when(F.col("class").between(0, len(CLASSES) - 1), F.col("class")).otherwise(F.lit(0)).cast("int")
    return objects.groupBy(code.alias("class")).agg(F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def nonzero(by_class: DataFrame) -> DataFrame:
    """Class sums as they are shown: without those of no bytes."""
    return by_class.where("bytes <> 0")


def merge_class_bytes(a: Column, b: Column) -> Column:
    """Sum of two maps class -> bytes, without zeros."""
    zero = F.lit(0).cast("long")
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero)), lambda k, v: v != 0)


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)


def same_totals(a: DataFrame, b: DataFrame) -> bool:
    """Whether two roll-ups say the same of every directory and class, bytes of zero aside."""
    cols = ["prefix", "class", "objects", "bytes"]
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def directories(objects: DataFrame) -> DataFrame:
    """(prefix) of the root and every directory."""
    return objects.select(directory_of(F.col("key")).alias("d")).distinct().select(F.explode(ancestors(F.col("d"))).alias("prefix")).distinct()


def entry_counts(objects: DataFrame) -> DataFrame:
    """(prefix, depth, dirs, files, entries, objects) of each directory: what its listing shows, and all that lies below.

    One pass over the objects; then sums by directory go to all above, and each directory counts one for its parent.
    """
    own = objects.groupBy(directory_of(F.col("key")).alias("dir")).agg(F.count("*").alias("n"))
    spread = own.select("dir", "n", F.explode(ancestors(F.col("dir"))).alias("prefix"))
    held = spread.groupBy("prefix").agg(F.sum("n").alias("objects"), F.sum(F.when(F.col("dir") == F.col("prefix"), F.col("n")).otherwise(0)).alias("files"))
    zero = F.lit(0).cast("long")
    self_row = F.struct("prefix", "files", "objects", zero.alias("dirs"))
    for_parent = F.struct(parent_of(F.col("prefix")).alias("prefix"), zero.alias("files"), zero.alias("objects"), F.lit(1).cast("long").alias("dirs"))
    rows = held.select(F.explode(F.array(self_row, for_parent)).alias("r")).select("r.*").where("prefix is not null")
    sums = rows.groupBy("prefix").agg(F.sum("dirs").alias("dirs"), F.sum("files").alias("files"), F.sum("objects").alias("objects"))
    return sums.select("prefix", depth(F.col("prefix")).alias("depth"), "dirs", "files", (F.col("dirs") + F.col("files")).alias("entries"), "objects")


def structure(objects: DataFrame) -> DataFrame:
    """One row: directories, files, depths (largest, and at half and 99 % of the directories by rank), listing sizes.

    Ranks come from a count by depth, a row a level, not from a sort of all directories.
    """
    counts = entry_counts(objects)
    levels = counts.groupBy("depth").agg(F.count("*").alias("n"), F.sum("files").alias("files"), F.max("entries").alias("most"), F.sum("entries").alias("entries"))
    listed = F.array_sort(F.collect_list(F.struct("depth", "n")))
    whole = levels.agg(F.sum("n").alias("dirs"), F.sum("files").alias("files"), F.max("depth").alias("max_depth"), F.max("most").alias("max_fanout"), F.sum("entries").alias("entries"), listed.alias("l"))

    def at(rank: str) -> Column:
        reached = F.expr(f"filter(transform(l, (x, i) -> struct(x.depth as depth, aggregate(slice(l, 1, i + 1), 0L, (a, y) -> a + y.n) as upto)), x -> x.upto > {rank})")
        return reached[0]["depth"]

    return whole.select("dirs", "files", "max_depth", at("dirs div 2").alias("p50_depth"), at("(dirs * 99) div 100").alias("p99_depth"), "max_fanout", F.round(F.col("entries") / F.col("dirs"), 6).alias("avg_fanout"))
