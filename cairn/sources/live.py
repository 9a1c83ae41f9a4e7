"""Live buckets: listing as a Spark data source, the region, deletion.

The planner probes directories a level at a time with a delimiter, up to a depth, several at once; what is then a prefix becomes a
partition that an executor lists page by page. Objects that a probe saw on its first page go along; a directory with
more files of its own is listed again by an executor, so the driver never holds more than a page a directory. Results
are only united: no partition replaces keys of another.
"""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.reconcile import DeleteGuards, delete_outcome, delete_stats, delete_victims
from ..plans.progress import log
from ..plans.session import stored
from ..schema import DELIMITER, PAGE


@dataclass
class Page:
    """One page of a listing: objects (key, size, class name), directories, and where to go on."""

    objects: list[tuple[str, int, str]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    token: str | None = None


#: Lists a page: (bucket, prefix, delimiter, token) -> Page.
Lister = Callable[[str, str, str, str | None], Page]


class Bucket(Protocol):
    """What is asked of a live bucket besides pages."""

    def region(self, bucket: str) -> str | None: ...

    def versioned(self, bucket: str) -> bool: ...

    def delete(self, bucket: str, keys: list[str]) -> list[tuple[str, str]]:
        """Deletes keys in one request; (key, code) of those that were not."""
        ...


class Emulator:
    """A bucket in memory, for tests: pages of a sorted listing, deletion with errors for some keys, and how many requests there were.

    delay: seconds that a page takes.
    """

    def __init__(self, objects: list[tuple[str, int, str]], max_keys: int = PAGE, home: str | None = None, keeps_versions: bool = False, errors: dict[str, str] | None = None, delay: float = 0.0):
        self.objects, self.max_keys, self.requests = sorted(objects), max_keys if 0 < max_keys <= PAGE else PAGE, 0
        self.home, self.keeps_versions, self.errors, self.delay = home, keeps_versions, errors or {}, delay

    def region(self, bucket: str) -> str | None:
        return self.home

    def versioned(self, bucket: str) -> bool:
        return self.keeps_versions

    def delete(self, bucket: str, keys: list[str]) -> list[tuple[str, str]]:
        if len(keys) > PAGE:
            raise ValueError(f"a request deletes {PAGE} keys at most")
        self.requests += 1
        gone = set(keys) - set(self.errors)
        self.objects = [o for o in self.objects if o[0] not in gone]
        return [(k, self.errors[k]) for k in keys if k in self.errors]

    def __call__(self, bucket: str, prefix: str, delimiter: str, token: str | None) -> Page:
        self.requests += 1
        time.sleep(self.delay)
        page, last = Page(), None
        for key, size, cls in self.objects:
            if not key.startswith(prefix) or (token is not None and (key <= token or token.endswith(DELIMITER) and token != prefix and key.startswith(token) and delimiter)):
                continue
            rest = key[len(prefix) :]
            cut = rest.find(delimiter) if delimiter == DELIMITER else -1
            name = prefix + rest[: cut + 1] if cut >= 0 else None
            if name is not None and page.prefixes and page.prefixes[-1] == name:
                continue
            if len(page.objects) + len(page.prefixes) == self.max_keys:
                page.token = last
                break
            if name is not None:
                page.prefixes.append(name)
                last = name
            else:
                page.objects.append((key, size, cls))
                last = key
        return page


def _client(region: str | None = None, endpoint: str | None = None, attempts: int = 8):
    try:
        import boto3
        from botocore.config import Config
    except ImportError as e:
        raise RuntimeError("live buckets of S3 need boto3") from e
    style = {"addressing_style": "path"} if endpoint else {}
    return boto3.client("s3", region_name=region, endpoint_url=endpoint, config=Config(retries={"mode": "adaptive", "max_attempts": attempts}, s3=style))


def s3_lister(region: str | None = None, endpoint: str | None = None) -> Lister:
    """Pages of an S3 bucket; needs boto3, which is not part of this library."""
    client = _client(region, endpoint)

    def page(bucket: str, prefix: str, delimiter: str, token: str | None) -> Page:
        more = {"ContinuationToken": token} if token else {}
        got = client.list_objects_v2(Bucket=bucket, Prefix=prefix, Delimiter=delimiter, MaxKeys=PAGE, **more)
        rows = [(o.get("Key") or "", o.get("Size") or 0, o.get("StorageClass") or "") for o in got.get("Contents", [])]
        return Page(rows, [p["Prefix"] for p in got.get("CommonPrefixes", []) if p.get("Prefix")], got.get("NextContinuationToken"))

    return page


class S3Bucket:
    """Region, versioning and deletion of S3 buckets; needs boto3. Clients are made where they are used, so an instance may travel."""

    def __init__(self, region: str | None = None, endpoint: str | None = None):
        self.where, self.endpoint = region, endpoint

    def region(self, bucket: str) -> str | None:
        return _client(self.where, self.endpoint).head_bucket(Bucket=bucket).get("BucketRegion")

    def versioned(self, bucket: str) -> bool:
        return _client(self.where, self.endpoint).get_bucket_versioning(Bucket=bucket).get("Status") in ("Enabled", "Suspended")

    def delete(self, bucket: str, keys: list[str]) -> list[tuple[str, str]]:
        got = _client(self.where, self.endpoint, 20).delete_objects(Bucket=bucket, Delete={"Objects": [{"Key": k} for k in keys], "Quiet": True})
        return [(e.get("Key", ""), e.get("Code", "")) for e in got.get("Errors", [])]


def region_of(store: Bucket, bucket: str, given: str | None = None, endpoint: str | None = None) -> str | None:
    """The region to scan and to price in: the given one at a custom endpoint, else the bucket's own. Where that cannot be found, the given one, with a warning."""
    if endpoint:
        return given
    try:
        return store.region(bucket) or given
    except Exception as e:  # a scan goes on without it
        warnings.warn(f"no region found for {bucket}: {e}", stacklevel=2)
        return given


OUTCOME = "key string, size long, code string"


def delete_objects(victims: DataFrame, store: Bucket, bucket: str, batch_size: int = PAGE) -> DataFrame:
    """(key, size, code) of every victim (key, size) after deleting it: code is null for what went, else the error's.

    A request takes batch_size keys of a task at most; a task that runs again deletes again, which changes nothing. Run
    it once and keep the result (its rows are the outcome); guards are checked by the caller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch_size):
                part = b.slice(i, batch_size)
                keys = part.column("key").to_pylist()
                errors = dict(store.delete(bucket, keys))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("size"), pa.array([errors.get(k) for k in keys], pa.string())], names=["key", "size", "code"])

    return victims.select("key", "size").mapInArrow(run, OUTCOME)


def delete_in_bucket(victims: DataFrame, store: Bucket, bucket: str, guards: DeleteGuards) -> DataFrame:
    """One row of what a deletion did (see delete_outcome), or would do: a dry run counts and deletes nothing.

    Whether the bucket keeps versions is asked of the bucket, whatever the guards say.
    """
    replace(guards, versioned=store.versioned(bucket)).check()
    own = delete_victims(victims, guards.prefix)
    if guards.dry_run:
        return delete_stats(own, guards.prefix, True, guards.batch_size)
    done = stored(delete_objects(own.repartition(guards.workers), store, bucket, guards.batch_size))
    return delete_outcome(done.select("key", "size"), done.where("code is not null").select("key", "code"))


def pages(lister: Lister, bucket: str, prefix: str, delimiter: str = "") -> Iterator[Page]:
    token = None
    while True:
        page = lister(bucket, prefix, delimiter, token)
        yield page
        if page.token is None:
            return
        token = page.token


class Work(InputPartition):
    """A prefix to list, whole or its own files only; or objects that probes have listed."""

    def __init__(self, prefix: str | None, objects: list[tuple[str, int, str]], shallow: bool = False):
        super().__init__(prefix)
        self.prefix, self.objects, self.shallow = prefix, objects, shallow


def probe(lister: Lister, bucket: str, prefix: str) -> tuple[list[tuple[str, int, str]] | None, list[str]]:
    """The files and directories of a prefix; None for files that fill more than a page."""
    files: list[tuple[str, int, str]] | None = []
    below: list[str] = []
    for page in pages(lister, bucket, prefix, DELIMITER):
        below += page.prefixes
        if files is not None:
            files = files + page.objects if len(files) + len(page.objects) <= PAGE else None
    return files, below


def plan(lister: Lister, bucket: str, prefix: str, max_depth: int, workers: int = 32, waiting: Callable[[int], None] | None = None) -> list[Work]:
    """Prefixes at the depth limit, directories with many files of their own, and the objects met on the way.

    workers: probes at a time; waiting is told how many prefixes of a level are still to be probed. The first probe that fails ends the plan.
    """
    level, work, seen = [prefix], [], []
    with ThreadPoolExecutor(max(1, workers)) as pool:
        for _ in range(max_depth):
            after: list[str] = []
            for left, p, (files, below) in zip(range(len(level) - 1, -1, -1), level, pool.map(lambda p: probe(lister, bucket, p), level), strict=True):
                if waiting:
                    waiting(left)
                after += below
                if files is None:
                    work.append(Work(p, [], shallow=True))
                else:
                    seen += files
                if len(seen) >= PAGE:
                    work.append(Work(None, seen))
                    seen = []
            level = after
    if seen:
        work.append(Work(None, seen))
    return work + [Work(p, []) for p in level]


class ListingReader(DataSourceReader):
    def __init__(self, make: Callable[[], Lister], bucket: str, prefix: str, max_depth: int, workers: int):
        self.make, self.bucket, self.prefix, self.max_depth, self.workers = make, bucket, prefix, max_depth, workers

    def partitions(self) -> list[Work]:
        work = plan(self.make(), self.bucket, self.prefix, self.max_depth, self.workers, lambda n: log.debug("%d prefixes wait", n))
        log.info("%s: %d prefixes to list, %d objects met by probes", self.bucket, sum(w.prefix is not None for w in work), sum(len(w.objects) for w in work))
        return work or [Work(None, [])]

    def read(self, partition: Work) -> Iterator[tuple]:
        yield from partition.objects
        if partition.prefix is not None:
            for page in pages(self.make(), self.bucket, partition.prefix, DELIMITER if partition.shallow else ""):
                yield from page.objects


class ListingSource(DataSource):
    """spark.read.format("listing"), with options bucket, prefix, max_depth, workers, region, endpoint, or objects (JSON) for tests."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "key string, size long, class string"

    def reader(self, schema) -> ListingReader:
        o = self.options
        if "objects" in o:
            given, most, delay = json.loads(o["objects"]), int(o.get("max_keys", PAGE)), float(o.get("delay", 0))
            make: Callable[[], Lister] = lambda: Emulator([tuple(x) for x in given], most, delay=delay)
        else:
            region, endpoint = o.get("region"), o.get("endpoint")
            make = lambda: s3_lister(region, endpoint)  # noqa: E731  a client is made where it is used
        return ListingReader(make, o.get("bucket", ""), o.get("prefix", ""), int(o.get("max_depth", 3)), int(o.get("workers", 32)))
