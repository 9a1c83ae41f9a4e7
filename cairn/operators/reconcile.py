"""Incremental reconciliation: batches that own a range of keys, set operations, prefix deletion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import check_prefix, depth, parent_of
from ..plans.session import parts_of, stored
from .listing import list_directory
from .rollup import directories

CHANGED = "o_size <> n_size or o_class <> n_class"


class BatchError(ValueError):
    """A batch whose rows break its contract."""


def in_range(lo: str | None, hi: str | None):
    """Keys in (lo, hi]; a bound that is None is open. Both bounds reach the file scan."""
    test = F.lit(True)
    if lo is not None:
        test = F.col("key") > lo
    if hi is not None:
        test = test & (F.col("key") <= hi) if lo is not None else F.col("key") <= hi
    return test


def scan_range(objects: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Objects with lo < key <= hi, in key order."""
    return objects.where(in_range(lo, hi)).orderBy("key")


def batch_bounds(batch: DataFrame) -> str | None:
    """The last key of a batch, to which its range reaches; None for an empty one."""
    return batch.agg(F.max("key")).first()[0]


def batch_violations(batch: DataFrame, start_from: str) -> DataFrame:
    """(key, problem) of rows at or below the start, repeated or empty. None for a batch that keeps its contract.

    Order within a batch is not a property of a DataFrame; listings in files are checked by `unsorted`.
    """
    repeated = batch.groupBy("key").agg(F.count("*").alias("n"))
    problem = F.when(F.col("key") == "", "empty").when(F.col("key") <= start_from, "not above start").when(F.col("n") > 1, "repeated")
    return repeated.withColumn("problem", problem).where("problem is not null").select("key", "problem")


def unsorted(numbered: DataFrame) -> DataFrame:
    """Rows (pos, key) that do not come after the row before them. Each row meets its neighbour by an equi-join on the position."""
    before = numbered.select((F.col("pos") + 1).alias("pos"), F.col("key").alias("previous"))
    return numbered.join(before, "pos").where("key <= previous").select("pos", "key", "previous")


def checked(batch: DataFrame, start_from: str) -> DataFrame:
    """The batch, or BatchError with its first offending rows."""
    bad = batch_violations(batch, start_from).limit(5).collect()
    if bad:
        raise BatchError("; ".join(f"{r.key!r} is {r.problem}" for r in bad))
    return batch


def apply_batch(objects: DataFrame, batch: DataFrame, start_from: str, hi: str | None = None) -> DataFrame:
    """Objects after a batch that owns (start_from, its last key]: what lay there is replaced. An empty batch changes nothing.

    The cheapest form: rows outside the range pass by, rows inside are never compared. hi saves the pass over the batch
    that finds its last key.
    """
    hi = batch_bounds(batch) if hi is None else hi
    if hi is None:
        return objects
    return objects.where(~in_range(start_from, hi)).unionByName(batch.select("key", "size", "class"))


def merge_actions(objects: DataFrame, batch: DataFrame, start_from: str, hi: str | None = None) -> DataFrame:
    """(key, action, o_size, o_class, n_size, n_class) for the range of a batch: insert, update, delete or keep."""
    held = held_in(objects, batch, start_from, hi)
    old = held.select("key", F.col("size").alias("o_size"), F.col("class").alias("o_class"))
    new = batch.select("key", F.col("size").alias("n_size"), F.col("class").alias("n_class"))
    action = F.when(F.col("n_size").isNull(), "delete").when(F.col("o_size").isNull(), "insert").when(F.expr(CHANGED), "update").otherwise("keep")
    return old.join(new, "key", "full_outer").select("key", action.alias("action"), "o_size", "o_class", "n_size", "n_class")


def held_in(objects: DataFrame, batch: DataFrame, start_from: str, hi: str | None = None) -> DataFrame:
    """Objects in the range that a batch owns: what a comparison with the batch may read. None for an empty batch.

    The range is two literals, so the scan skips files and row groups outside it.
    """
    hi = batch_bounds(batch) if hi is None else hi
    return objects.where(in_range(start_from, hi) if hi is not None else F.lit(False))


def inserts(objects: DataFrame, batch: DataFrame, start_from: str, hi: str | None = None) -> DataFrame:
    held = held_in(objects, batch, start_from, hi)
    return batch.join(held.select("key"), "key", "left_anti").select("key", "size", "class")


def deletes(objects: DataFrame, batch: DataFrame, start_from: str, hi: str | None = None) -> DataFrame:
    held = held_in(objects, batch, start_from, hi)
    return held.join(batch.select("key"), "key", "left_anti").select("key", "size", "class")


def common(objects: DataFrame, batch: DataFrame, start_from: str, hi: str | None = None) -> DataFrame:
    """(key) of objects in a batch's range that the batch holds too."""
    return held_in(objects, batch, start_from, hi).select("key").join(batch.select("key"), "key", "left_semi").distinct()


def updates(objects: DataFrame, batch: DataFrame, start_from: str, hi: str | None = None) -> DataFrame:
    """(key, o_size, o_class, n_size, n_class) of keys in both that differ."""
    held = held_in(objects, batch, start_from, hi)
    old = held.select("key", F.col("size").alias("o_size"), F.col("class").alias("o_class"))
    new = batch.select("key", F.col("size").alias("n_size"), F.col("class").alias("n_class"))
    return old.join(new, "key").where(CHANGED)


def signed_changes(actions: DataFrame) -> DataFrame:
    """Rows (key, size, class, sign) for a roll-up's delta: what went with -1, what came with +1."""
    went = actions.where("action in ('delete', 'update')").select("key", F.col("o_size").alias("size"), F.col("o_class").alias("class"), F.lit(-1).alias("sign"))
    came = actions.where("action in ('insert', 'update')").select("key", F.col("n_size").alias("size"), F.col("n_class").alias("class"), F.lit(1).alias("sign"))
    return went.unionByName(came)


def union_listings(*parts: DataFrame) -> DataFrame:
    """All rows of all listings, one for each key: of repeated ones that of the smallest class and size."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return deduped(whole)


def deduped(objects: DataFrame) -> DataFrame:
    """One row for each key, chosen by value so that every run chooses alike; combined before the shuffle."""
    return objects.groupBy("key").agg(F.min(F.struct("class", "size")).alias("v")).select("key", "v.size", "v.class")


def owners(objects: DataFrame, batches: DataFrame) -> DataFrame:
    """(key, batch): for each object the batch whose range (start_from, last_key] holds its key; null without one.

    batches (batch, start_from, last_key) must not overlap. No range is tested against every key: starts and keys are
    dealt by ranges together and kept, each key looks back to the last start, and a range's first keys to the last start
    of an earlier range, a row each.
    """
    n = parts_of(objects)
    held = F.struct("batch", "last_key")
    starts = batches.select(F.col("start_from").alias("k"), F.lit(1).alias("kind"), held.alias("b"))
    rows = objects.select(F.col("key").alias("k"), F.lit(0).alias("kind")).unionByName(starts, allowMissingColumns=True)
    dealt = stored(rows.repartitionByRange(n, "k").withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.max_by("b", F.when(F.col("kind") == 1, F.col("k"))).alias("b"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.last("b", ignorenulls=True).over(ahead).alias("carried"))
    back = Window.partitionBy("part").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("own", F.last("b", ignorenulls=True).over(back)).where("kind = 0").join(F.broadcast(ends), "part")
    b = F.coalesce("own", "carried")
    return seen.select(F.col("k").alias("key"), F.when(F.col("k") <= b["last_key"], b["batch"]).alias("batch"))


@dataclass(frozen=True)
class DeleteGuards:
    """What a deletion must state. It runs dry unless told otherwise."""

    prefix: str
    confirm: str = ""
    dry_run: bool = True
    versioned: bool = False
    allow_versioned: bool = False
    batch_size: int = 1000
    workers: int = 8

    def check(self) -> None:
        if not self.prefix.strip().strip("/"):
            raise ValueError("a deletion needs a prefix")
        if self.batch_size <= 0 or self.workers <= 0 or self.batch_size > 1000:
            raise ValueError("batch_size is 1 to 1000, workers at least 1")
        if self.versioned and not self.allow_versioned:
            raise PermissionError("the bucket keeps versions: deletion would leave them")
        if not self.dry_run and self.confirm != self.prefix:
            raise PermissionError("type the prefix to confirm")


def delete_victims(objects: DataFrame, prefix: str) -> DataFrame:
    """All keys that start with the prefix, directories' own files included. The prefix is one of bytes: `foo` takes `foobar` too."""
    return objects.where(F.col("key").startswith(prefix))


def delete_prefix(objects: DataFrame, guards: DeleteGuards) -> tuple[DataFrame, DataFrame]:
    """(objects that are left, one row of statistics). A dry run leaves all and counts what it would delete."""
    guards.check()
    stats = delete_stats(objects, guards.prefix, guards.dry_run, guards.batch_size)
    return (objects if guards.dry_run else objects.where(~F.col("key").startswith(guards.prefix))), stats


def delete_stats(objects: DataFrame, prefix: str, dry_run: bool = True, batch_size: int = 1000) -> DataFrame:
    n = F.count("*")
    zero = F.lit(0).cast("long")
    return delete_victims(objects, prefix).agg(
        n.alias("listed"),
        F.coalesce(F.sum("size"), zero).cast("long").alias("bytes"),
        (zero if dry_run else n).alias("deleted"),
        (n if dry_run else zero).alias("would_delete"),
        F.ceil(n / batch_size).cast("long").alias("requests"),
    )


#: Error codes that mean too many requests.
THROTTLES = ("SlowDown", "Throttling", "ThrottlingException", "RequestLimitExceeded")


def delete_outcome(batch: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of a delete call's result: rows (key, size) that were sent and errors (key, code) that came back."""
    zero = F.lit(0).cast("long")
    sent = batch.select("key", "size", F.lit(1).alias("sent"))
    back = errors.select("key", F.col("code").isin(*THROTTLES).cast("int").alias("slow"))
    both = sent.join(back, "key", "full_outer")  # an error may name a key that was not sent
    failed = F.col("slow").isNotNull()
    return both.agg(
        F.sum(F.coalesce("sent", F.lit(0)) - failed.cast("int")).cast("long").alias("deleted"),
        F.coalesce(F.sum(F.when(failed, 0).otherwise(F.col("size"))), zero).cast("long").alias("bytes"),
        F.sum(failed.cast("long")).alias("errors"),
        F.coalesce(F.sum("slow"), zero).cast("long").alias("throttled"),
    )


def fan_out(objects: DataFrame, root: str, max_depth: int = 3, min_prefixes: int = 8) -> DataFrame:
    """(prefix): the frontier of a breadth-first walk, a level at a time, until it is wide enough or stops growing.

    Levels are DataFrames; the driver sees their counts only. A prefix without directories below stays in the frontier.
    """
    check_prefix(root)
    below_root = directories(objects.where(F.col("key").startswith(root)))
    dirs = stored(below_root.where(F.col("prefix").startswith(root) & (depth(F.col("prefix")) <= root.count("/") + max_depth)))
    level = objects.sparkSession.createDataFrame([(root,)], "prefix string")
    for _ in range(max_depth):
        up = dirs.select(parent_of(F.col("prefix")).alias("above"), F.col("prefix").alias("next"))
        grown = level.join(up, level.prefix == F.col("above"), "left")
        after = stored(grown.select(F.coalesce("next", "prefix").alias("prefix"), F.col("next").isNotNull().cast("int").alias("new")))
        n, new = after.agg(F.count("*"), F.coalesce(F.sum("new"), F.lit(0))).first()
        level = after.select("prefix")
        if not new or n >= min_prefixes:
            break
    return level


def root_directories(objects: DataFrame) -> DataFrame:
    return list_directory(objects, "").where("is_dir").select(F.col("name").alias("prefix"))
