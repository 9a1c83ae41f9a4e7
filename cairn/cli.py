"""Command line: python -m cairn.cli COMMAND TABLE ..., a table being a folder that InventoryTable keeps."""

from __future__ import annotations

import argparse
import sys
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from .operators import listing, reconcile, rollup, trie
from .plans.progress import Ticker, log, log_to
from .plans.session import session
from .plans.simulate import STRATEGIES, balance, result_line, seconds
from .sources.listings import read_inventory, read_jsonl, write_jsonl
from .sources.snapshot import read_snapshot, write_snapshot
from .sources.synthetic import generate
from .sources.table import InventoryTable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("table", help="folder of the table")
        c.add_argument("--progress", type=float, default=0, metavar="SECONDS", help="report on running jobs that often; 0: never")
        c.add_argument("--log", default="", metavar="FILE")
        return c

    c = add("load", "load listings from files")
    c.add_argument("source")
    c.add_argument("--format", choices=("jsonl", "parquet", "csv", "snapshot"), default="jsonl")
    c = add("scan", "list a live bucket")
    c.add_argument("bucket")
    c.add_argument("--prefix", default="")
    c.add_argument("--max-depth", type=int, default=3)
    c.add_argument("--region", default="", help="default: asked of the bucket")
    c.add_argument("--endpoint", default="")
    c.add_argument("--workers", type=int, default=32, help="directories that are probed at a time")
    c = add("gen", "make the demonstration inventory")
    c.add_argument("--seed", type=int, default=1)
    c.add_argument("--scale", type=int, default=1)
    c = add("list", "list a directory")
    c.add_argument("--prefix", default="")
    c.add_argument("--sort", choices=sorted(listing.ORDERS), default="name")
    c.add_argument("--reverse", action="store_true")
    c.add_argument("--dirs-first", action="store_true")
    c.add_argument("--region", default="us-east-1")
    c.add_argument("--limit", type=int, default=100)
    add("stats", "totals, directories and trie")
    c = add("sim", "requests of listing strategies")
    c.add_argument("--strategy", choices=["all", *STRATEGIES], default="all")
    c.add_argument("--max-depth", type=int, default=8)
    c.add_argument("--workers", type=int, default=0, help="deal the work to so many workers, too")
    c.add_argument("--latency", type=float, default=0.15, help="seconds of a request")
    c = add("rm", "delete a prefix from the table; a dry run unless --yes repeats the prefix")
    c.add_argument("prefix")
    c.add_argument("--yes", default="", metavar="PREFIX")
    c.add_argument("--bucket", default="", help="delete in this live bucket, too")
    c.add_argument("--region", default="")
    c.add_argument("--endpoint", default="")
    c.add_argument("--allow-versioned", action="store_true")
    c.add_argument("--workers", type=int, default=8)
    c.add_argument("--batch-size", type=int, default=1000)
    c = add("export", "write a binary snapshot file, or JSON lines of the first objects in key order")
    c.add_argument("path")
    c.add_argument("--format", choices=("snapshot", "jsonl"), default="snapshot")
    c.add_argument("--limit", type=int, default=0, help="objects at most; 0: all")
    return p


def show(df: DataFrame, out) -> None:
    rows = df.collect()
    if not rows:
        print("(empty)", file=out)
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r), file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, store=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    log_to(args.log)
    with Ticker(spark, args.command, args.progress) if args.progress > 0 else nullcontext():
        run(args, spark, out, store)
    return 0


def run(args: argparse.Namespace, spark: SparkSession, out, store) -> None:
    table = InventoryTable(spark, args.table)
    log.info("%s %s", args.command, args.table)
    if args.command == "load":
        read = {"jsonl": read_jsonl, "snapshot": read_snapshot}.get(args.format, lambda s, p: read_inventory(s, p, args.format))
        table.save(reconcile.deduped(read(spark, args.source)))
    elif args.command == "scan":
        from .sources.listings import normalised
        from .sources.live import ListingSource, S3Bucket, region_of

        spark.dataSource.register(ListingSource)
        region = args.region or region_of(S3Bucket(None, args.endpoint or None), args.bucket, None, args.endpoint)
        options = {"bucket": args.bucket, "prefix": args.prefix, "max_depth": str(args.max_depth), "workers": str(args.workers)} | {k: v for k, v in (("region", region), ("endpoint", args.endpoint)) if v}
        table.save(reconcile.deduped(normalised(spark.read.format("listing").options(**options).load())))
    elif args.command == "gen":
        table.save(generate(spark, args.seed, args.scale))
    elif args.command == "list":
        rows = listing.with_entry_cost(table.load(), args.prefix, args.region)
        down = None if not args.reverse else not listing.ORDERS[args.sort][1]
        show(rows.orderBy(*listing.sort_keys(args.sort, down, args.dirs_first)).limit(args.limit).select("name", "objects", "bytes", "cost"), out)
    elif args.command == "stats":
        objects = table.load()
        show(rollup.totals(objects), out)
        show(rollup.structure(objects), out)
        show(trie.trie_counts(objects), out)
    elif args.command == "sim":
        for name in STRATEGIES if args.strategy == "all" else [args.strategy]:
            text = result_line(STRATEGIES[name](table.load(), max_depth=args.max_depth).first())
            if args.workers:
                took = seconds(balance(table.load(), name, args.workers, args.max_depth), args.latency).first()
                text += f" seconds={took.seconds:.1f} parallelism={took.parallelism:.1f}"
            print(text, file=out)
    elif args.command == "rm":
        guards = reconcile.DeleteGuards(args.prefix, confirm=args.yes, dry_run=not args.yes, allow_versioned=args.allow_versioned, batch_size=args.batch_size, workers=args.workers)
        if args.bucket:
            from .sources.live import S3Bucket, delete_in_bucket

            show(delete_in_bucket(table.load(), store or S3Bucket(args.region or None, args.endpoint or None), args.bucket, guards), out)
        left, stats = reconcile.delete_prefix(table.load(), guards)
        show(stats, out)
        if not guards.dry_run:
            table.save(left)
    elif args.command == "export":
        rows = table.load().orderBy("key").limit(args.limit) if args.limit else table.load()
        (write_snapshot if args.format == "snapshot" else write_jsonl)(rows, args.path)


if __name__ == "__main__":
    sys.exit(main())
