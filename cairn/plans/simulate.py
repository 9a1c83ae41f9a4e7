"""Listing strategies, by their number of requests.

A strategy's requests follow from the sizes of listings and subtrees alone, so each is one aggregate over the directories
and no page is emulated. K keys fit a page; an empty listing still costs a request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import positions
from ..operators.rollup import entry_counts
from ..schema import PAGE

DEPTH = 8


def _pages(n: Column, k: int) -> Column:
    return F.ceil(n / k).cast("long")


def work_items(objects: DataFrame, strategy: str, max_depth: int = DEPTH, k: int = PAGE) -> DataFrame:
    """(prefix, kind, requests, contents, prefixes): what the workers of a strategy have to do; kind is probe or list."""
    if strategy == "s1-recursive":
        return objects.agg(F.count("*").alias("n")).select(F.lit("").alias("prefix"), F.lit("list").alias("kind"), F.greatest(F.lit(1), _pages(F.col("n"), k)).alias("requests"), F.col("n").alias("contents"), F.lit(0).cast("long").alias("prefixes"))
    limit = {"s2-probe-root": 1, "s3-current": max_depth if max_depth >= 1 else DEPTH, "s4-worksteal": None}[strategy]
    depth = F.col("depth")
    listings = entry_counts(objects)
    if limit is None:
        return listings.select("prefix", F.lit("probe").alias("kind"), _pages(F.col("entries"), k).alias("requests"), F.col("files").alias("contents"), F.col("dirs").alias("prefixes"))
    return listings.where(depth <= limit).select(
        "prefix",
        F.when(depth < limit, "probe").otherwise("list").alias("kind"),
        _pages(F.when(depth < limit, F.col("entries")).otherwise(F.col("objects")), k).alias("requests"),
        F.when(depth < limit, F.col("files")).otherwise(F.col("objects")).alias("contents"),
        F.when(depth < limit, F.col("dirs")).otherwise(F.lit(0)).alias("prefixes"),
    )


def simulate(objects: DataFrame, strategy: str, max_depth: int = DEPTH, k: int = PAGE) -> DataFrame:
    """One row: strategy, requests, contents, common_prefixes, entries per request."""
    zero = F.lit(0).cast("long")
    sums = work_items(objects, strategy, max_depth, k).agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.sum("requests"), zero)).alias("requests"), F.coalesce(F.sum("contents"), zero).alias("contents"), F.coalesce(F.sum("prefixes"), zero).alias("common_prefixes"))
    per = F.round((F.col("contents") + F.col("common_prefixes")) / F.col("requests"), 6)
    return sums.select(F.lit(strategy).alias("strategy"), "requests", "contents", "common_prefixes", per.alias("per_request"))


#: Strategies by name; a caller may add more.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, run: Callable[..., DataFrame]) -> None:
    if name in STRATEGIES:
        raise KeyError(f"{name} is registered")
    STRATEGIES[name] = run


def _built_in(name: str) -> Callable[..., DataFrame]:
    return lambda objects, max_depth=DEPTH, k=PAGE: simulate(objects, name, max_depth, k)


for _name in ("s1-recursive", "s2-probe-root", "s3-current", "s4-worksteal"):
    register(_name, _built_in(_name))


def balance(objects: DataFrame, strategy: str, workers: int = 8, max_depth: int = DEPTH, k: int = PAGE) -> DataFrame:
    """(worker, items, requests): items dealt to workers in turn, in the order of kind and prefix. Our own rule: which worker does what is otherwise a matter of timing."""
    items = work_items(objects, strategy, max_depth, k).withColumn("item", F.concat_ws(":", "kind", "prefix"))
    dealt = positions(items.select("item", "requests"), "item")
    return dealt.groupBy((F.col("pos") % workers).cast("int").alias("worker")).agg(F.count("*").alias("items"), F.sum("requests").cast("long").alias("requests"))


def load_stats(loads: DataFrame) -> DataFrame:
    """One row: least, most and population variance of the workers' requests."""
    return loads.agg(F.min("requests").alias("least"), F.max("requests").alias("most"), F.round(F.var_pop("requests"), 6).alias("variance"))


def seconds(loads: DataFrame, latency: float) -> DataFrame:
    """One row: how long the worker with most requests takes, one after the other, and the workers' mean share of that time."""
    most = F.max("requests")
    return loads.agg((most * latency).alias("seconds"), F.round(F.sum("requests") / most, 6).alias("parallelism"))


def result_line(row) -> str:
    return f"{row['strategy']:<16} requests={row['requests']:<9} per request={row['per_request']:<9.1f} contents={row['contents']:<9} prefixes={row['common_prefixes']}"
