"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of a group (by default, of equal texts) are linked. As links join all of a group, a group's state is how many
of its documents each shard holds: at most one row a shard, whatever the group's size. Rounds move documents towards
the shard that holds most of their neighbours, under quotas:

* what shards want to give each other, two at a time or around a circle, is swapped in equal numbers;
* beyond that, a shard takes in no more than its capacity leaves free.

So every state keeps to the capacities. A group's last mover may move in part. Where these moves come to a stand, groups
that are still in several shards move as wholes: their rows free what they hold, and by size, the largest first, each
goes where most of it is, or where there is most room; only what fits nowhere whole is split, and the step is taken only
if it cuts fewer links. Documents without links fill what is left, so that in the end row counts differ by one at most.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, numbered, parts_for, release

#: Rounds of moves before whole groups move, at most; rows that one task numbers, about.
ROUNDS, TASK_ROWS = 12, 1_000_000


def _before(df: DataFrame, within: list[str], bucket: Column, order: list[Column], weight: str, out: str) -> DataFrame:
    """df with out: the sum of weight over the rows that come before in the group, in the order of bucket, then order."""
    named = df.withColumn("__b", bucket)
    sums = named.groupBy(*within, "__b").agg(F.sum(weight).alias("__s"))
    ahead = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*within, "__b", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*within, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("__p", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(offsets, [*within, "__b"]).withColumn(out, F.col("__o") + F.col("__p")).select(*df.columns, out)


def _spread(buckets: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def _in_ranges(number: Column, sizes: list[int]) -> Column:
    """The index of the range that holds number, ranges of these sizes standing one after the other from 0."""
    out, end = F.lit(0), 0
    for i, n in enumerate(sizes[:-1]):
        end += n
        out = F.when(number >= end, F.lit(i + 1)).otherwise(out)
    return out


def quotas(want: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from shard to shard, of those that want to, so that no shard takes in more than leaves it and is free.

    First swaps; then moves into free room, which leave room where they come from; then circles of three or more. A
    matter of shards x shards numbers.
    """
    left, free, out = dict(want), list(free), dict.fromkeys(want, 0)

    def go(a: int, b: int, n: int) -> None:
        left[a, b] -= n
        out[a, b] += n

    for a, b in want:
        if a < b and (n := min(left[a, b], left.get((b, a), 0))):
            go(a, b, n), go(b, a, n)
    while True:
        moved = False
        for (a, b), m in sorted(left.items(), key=lambda x: (-x[1], x[0])):
            if n := min(m, max(0, free[b])):
                go(a, b, n)
                free[b] -= n
                free[a] += n
                moved = True
        if moved:
            continue
        circle = _circle({e for e, m in left.items() if m})
        if not circle:
            return out
        n = min(left[e] for e in circle)
        for e in circle:
            go(*e, n)


def _circle(edges: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges of some circle, or none."""
    while True:
        onward = {a: min(b for x, b in edges if x == a) for a, _ in edges}
        kept = {(a, b) for a, b in edges if b in onward}
        if kept == edges:
            break
        edges = kept  # an edge into a dead end is on no circle
    if not edges:
        return []
    path = [min(onward)]
    while onward[path[-1]] not in path:
        path.append(onward[path[-1]])
    ring = path[path.index(onward[path[-1]]) :]
    return list(zip(ring, [*ring[1:], ring[0]], strict=True))


Places = dict[tuple[int, int], list[tuple[int, list[tuple[int, int]]]]]


def pack(sizes: dict[tuple[int, int], int], free: list[int]) -> Places:
    """Where groups go that are to be whole: for (size, home) a list of (how many groups, [(shard, rows)]).

    sizes: how many groups there are of a size and home; free: rows that shards have room for, enough for all of them.
    Of three orders of shards (home and then the roomiest, the roomiest, the tightest first) that which cuts least.
    A matter of distinct sizes x shards numbers, and of sizes there are at most as many as the root of twice the rows.
    """
    return min((_packed(sizes, free, order) for order in ("home", "roomy", "tight")), key=cut_by)


def cut_by(places: Places) -> int:
    """Twice the links that a plan cuts."""
    return sum(many * (n * n - sum(m * m for _, m in pieces)) for (n, _), some in places.items() for many, pieces in some)


def _packed(sizes: dict[tuple[int, int], int], free: list[int], order: str) -> Places:
    free, out = list(free), {}
    shards = range(len(free))
    for (n, home), count in sorted(sizes.items(), key=lambda x: (-x[0][0], x[0][1])):
        places = out[n, home] = []
        roomy = sorted(shards, key=lambda s: (-free[s], s))
        for s in {"home": [home, *roomy], "roomy": roomy, "tight": roomy[::-1]}[order]:
            if some := min(count, free[s] // n):
                places.append((some, [(s, n)]))
                free[s] -= some * n
                count -= some
        for _ in range(count):  # fewer than there are shards, since none has room for a whole one
            pieces, left = [], n
            for s in sorted(shards, key=lambda s: (-free[s], s)):
                if some := min(left, free[s]):
                    pieces.append((s, some))
                    free[s] -= some
                    left -= some
            places.append((1, pieces))
    return out


def _whole_groups(chunks: DataFrame, caps: list[int], loads: list[int], buckets: int, least: int) -> tuple[DataFrame, list[int]]:
    """The chunks and loads after the groups that stand in `least` shards or more have moved as wholes, if that cuts fewer links."""
    held = chunks.groupBy("g").agg(F.sum("n").alias("n"), F.max_by("s", F.struct(F.col("n"), -F.col("s"))).alias("home"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    before = int(held.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("squares")), F.lit(0))).first()[0])
    if not before:
        return chunks, loads
    split = checkpointed(held.where(F.col("k") >= least).select("g", "n", "home", "squares"))
    sizes = {(x.n, x.home): int(x.c) for x in split.groupBy("n", "home").agg(F.count("*").alias("c")).collect()}
    moving = chunks.join(split.select("g"), "g", "left_semi").groupBy("s").agg(F.sum("n").alias("n")).collect()  # a row a shard
    rest = list(loads)
    for x in moving:
        rest[x.s] -= int(x.n)
    plan = pack(sizes, [c - n for c, n in zip(caps, rest, strict=True)])
    if cut_by(plan) >= before:
        return chunks, loads
    rows, new = [], list(rest)
    for (n, home), places in plan.items():
        end, ends = 0, []
        for many, pieces in places:
            end += many
            ends.append({"e": end, "pieces": [{"s": s, "n": m} for s, m in pieces]})
            for s, m in pieces:
                new[s] += many * m
        rows.append({"n": n, "home": home, "ends": ends})
    shape = "array<struct<n: long, home: int, ends: array<struct<e: long, pieces: array<struct<s: int, n: long>>>>>>"
    places = chunks.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), shape)))
    ranked = numbered(split.select("g", "n", "home"), ["n", "home"], [F.col("g")], "i", F.xxhash64("g"), buckets)
    placed = ranked.join(places, ["n", "home"]).select("g", F.explode(F.expr("filter(ends, x -> i < x.e)[0].pieces")).alias("p"))
    stay = chunks.join(split.select("g"), "g", "left_anti")
    return checkpointed(stay.select("g", "s", "n").unionAll(placed.select("g", "p.s", "p.n"))), new


def _round(chunks: DataFrame, loads: list[int], caps: list[int], buckets: int) -> tuple[DataFrame, list[int], int]:
    """The chunks (g, s, n) after one round, their loads by shard, and how many documents moved."""
    free = [c - n for c, n in zip(caps, loads, strict=True)]
    is_open = F.get(F.array(*[F.lit(f > 0) for f in free]), F.col("s"))
    heavy = Window.partitionBy("g").orderBy(F.desc("n"), F.desc(is_open), F.xxhash64("g", "s"), "s")  # of equals one with room
    whole = Window.partitionBy("g")
    ranked = chunks.withColumn("r", F.row_number().over(heavy))
    best = F.min_by("s", "r").over(whole)
    roomy = F.min(F.when(is_open, F.struct("r", "s"))).over(whole)
    aimed = ranked.withColumn("best", best).withColumn("roomy", roomy)
    to = F.when(F.col("roomy.r") < F.col("r"), F.col("roomy.s")).when(F.col("r") > 1, F.col("best"))
    movers = checkpointed(aimed.withColumn("to", to).where("to is not null").select("g", "s", "to", "n", "r"))
    want = {(x.s, x.to): int(x.m) for x in movers.groupBy("s", "to").agg(F.sum("n").alias("m")).collect()}  # at most shards x shards rows
    quota = quotas(want, free)
    if not any(quota.values()):
        return chunks, loads, 0
    allowed = F.lit(0)
    for (a, b), q in quota.items():
        allowed = F.when((F.col("s") == a) & (F.col("to") == b), F.lit(q)).otherwise(allowed)
    level = F.floor(F.log2(F.col("n"))).cast("int") * -1  # heavier movers first
    bucket = level * buckets + _spread(buckets, "g")
    ordered = _before(movers, ["s", "to"], bucket, [F.desc("n"), F.col("g")], "n", "ahead")
    moved = ordered.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), allowed - F.col("ahead")))).where("go > 0")
    moved = checkpointed(moved.select("g", "s", "to", "go"))
    change = moved.select("g", "s", (-F.col("go")).alias("n")).unionAll(moved.select("g", "to", "go"))
    after = checkpointed(chunks.unionAll(change).groupBy("g", "s").agg(F.sum("n").alias("n")).where("n > 0"))
    loads = [0] * len(caps)
    for x in after.groupBy("s").agg(F.sum("n").alias("n")).collect():  # a row a shard
        loads[x.s] = int(x.n)
    return after, loads, int(moved.agg(F.coalesce(F.sum("go"), F.lit(0))).first()[0])


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs.

    size: UTF-8 bytes of the text plus 1, 1 for a null text; text_crc32 is that of the bytes, 0 for none. Numbers of
    rows in two shards differ by one at most; slots count from 0 in each shard without gaps. group: what linked rows
    share, else their text; rows where it is null have no links. Rows may repeat, ids may be null; an empty table has no
    rows. Extra columns are left out. rounds: of moves towards neighbours, at most; whole groups move after them, so that
    none stays split because rounds ran out. One node or one group may be of any size; fewer cut links are not proven.
    """
    text = F.col(f"`{text_col}`").cast("string")
    key = F.sha2(text if group is None else group.cast("string"), 256)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), key.alias("g"))
    base = checkpointed(base)
    total = base.count()
    buckets = parts_for(docs.sparkSession, total, TASK_ROWS)
    caps = [total // shards + (i < total % shards) for i in range(shards)]
    groups = checkpointed(base.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    placed = _before(groups.withColumn("one", F.lit(1)), ["one"], _spread(buckets, "g"), [F.col("g")], "n", "first")
    share = F.floor((F.col("first") + F.col("n") + (shards - 1) - F.col("s")) / shards) - F.floor((F.col("first") + (shards - 1) - F.col("s")) / shards)
    chunks = placed.select("g", "n", "first", F.explode(F.array(*[F.lit(i) for i in range(shards)])).alias("s")).select("g", "s", share.cast("long").alias("n")).where("n > 0")
    chunks = checkpointed(chunks)
    loads = [0] * shards
    for x in chunks.groupBy("s").agg(F.sum("n").alias("n")).collect():  # a row a shard
        loads[x.s] = int(x.n)
    for _ in range(rounds):
        last, (chunks, loads, moved) = chunks, _round(chunks, loads, caps, buckets)
        if not moved:
            break
        release(last)
    for least in (2, 1):  # those that are split; if some still are, all
        chunks, loads = _whole_groups(chunks, caps, loads, buckets, least)

    # Rows of a group are numbered over buckets; a bucket's offset and the group's shards reach its rows by group and bucket, so a hot group is spread.
    rows = base.withColumn("b", _spread(buckets, "doc_id", "size"))
    ranges = chunks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("held"))  # at most a struct a shard
    ends = F.expr("transform(held, (x, i) -> struct(x.s as s, aggregate(slice(held, 1, i + 1), 0L, (a, y) -> a + y.n) as e))")
    counts = rows.where("g is not null").groupBy("g", "b").agg(F.count("*").alias("c")).join(ranges.select("g"), "g", "left_semi")
    ahead = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("o", F.coalesce(F.sum("c").over(ahead), F.lit(0))).join(ranges.select("g", ends.alias("ends")), "g").select("g", "b", "o", "ends")
    mine = Window.partitionBy("g", "b").orderBy("doc_id", "size", "text_crc32")
    linked = rows.where("g is not null").join(offsets, ["g", "b"]).withColumn("i", F.col("o") + F.row_number().over(mine) - 1)
    linked = linked.select("doc_id", "size", "text_crc32", F.expr("filter(ends, x -> i < x.e)[0].s").alias("shard"))
    single = rows.join(ranges.select("g"), "g", "left_anti").select("doc_id", "size", "text_crc32", F.lit(1).alias("one"))
    single = numbered(single, ["one"], [F.col("doc_id"), F.col("text_crc32")], "i", F.xxhash64("doc_id", "text_crc32"), buckets)
    left = [c - n for c, n in zip(caps, loads, strict=True)]
    single = single.select("doc_id", "size", "text_crc32", _in_ranges(F.col("i"), left).alias("shard"))
    both = checkpointed(linked.unionAll(single))
    return numbered(both, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", F.xxhash64("doc_id", "text_crc32"), buckets)


def cut_links(assigned: DataFrame, group: str = "text_crc32") -> DataFrame:
    """One row: links between documents of a group, and how many of them join two shards."""
    held = assigned.groupBy(group, "shard").agg(F.count("*").alias("n"))
    per = held.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("inside"))
    return per.select(F.expr("n * (n - 1) div 2").alias("links"), "inside").agg(F.sum("links").alias("links"), F.sum(F.col("links") - F.col("inside")).alias("cut"))
