"""Inventories kept as Parquet files in key order, listed in a manifest; a change rewrites the files whose keys it touches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import batch_bounds, deduped, in_range, merge_actions, signed_changes
from ..operators.rollup import apply_delta, rollup, rollup_delta
from ..schema import OBJECTS, ROLLUP

#: Objects of a file, about, where a change writes files anew; manifests that stay readable.
FILE_ROWS, KEEP = 4_000_000, 2


def table_path(root: str, bucket: str, region: str | None = None) -> str:
    """Where a bucket's table lies."""
    return f"{root.rstrip('/')}/bucket={bucket}/region={region or 'unknown'}"


@dataclass
class Manifest:
    """What a version consists of: files in key order, each with its first key, and the folder of the roll-up.

    A file owns the keys from its first one up to the next file's; the first file owns what comes before it, too.
    """

    files: list[tuple[str, str]] = field(default_factory=list)
    rollup: str = ""

    def owner(self, key: Column) -> Column:
        """The number of the file that owns a key."""
        firsts = F.from_json(F.lit(json.dumps([first for _, first in self.files])), "array<string>")
        return F.greatest(F.lit(0), F.size(F.filter(firsts, lambda x: x <= key)) - 1)


@dataclass
class InventoryTable:
    """A folder with files, manifests and a pointer to the one that counts.

    A version is written in full before the pointer moves, so a job that fails leaves the table as it was. Files are
    sorted by key over ranges: a prefix or range test then skips files and row groups. The roll-up lies beside them and
    follows changes by signed sums; no object is summed again. The KEEP latest versions stay readable; what only older ones name is
    removed.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _text(self, name: str) -> str | None:
        fs, jvm = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        fs, jvm = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        new, old = path(f"{self.path}/{name}.{uuid4().hex}"), path(f"{self.path}/{name}")
        out = fs.create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, old, options)

    def versions(self) -> list[str]:
        """Names of the versions that are readable, the current one last."""
        return (self._text("CURRENT") or "").split()

    def current(self) -> str | None:
        return (self.versions() or [None])[-1]

    def manifest(self, version: str | None = None) -> Manifest:
        version = version or self.current()
        text = self._text(f"manifest-{version}.json") if version else None
        if text is None:
            raise FileNotFoundError(f"no table at {self.path}")
        raw = json.loads(text)
        return Manifest([tuple(f) for f in raw["files"]], raw["rollup"])

    def _point(self, manifest: Manifest) -> str:
        version = uuid4().hex
        self._put(f"manifest-{version}.json", json.dumps({"files": manifest.files, "rollup": manifest.rollup}))
        before = self.versions()
        kept = [*before, version][-KEEP:]
        self._put("CURRENT", " ".join(kept))
        gone = [v for v in before if v not in kept]
        if gone:
            used = [self.manifest(v) for v in kept]
            held = {name for m in used for name in (*(f for f, _ in m.files), m.rollup)}
            fs, jvm = self._fs()
            for v in gone:
                old = self.manifest(v)
                for name in {*(f for f, _ in old.files), old.rollup} - held:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{v}.json"), True)
        return version

    def _written(self, rows: DataFrame, files: int, *slot: str) -> list[tuple[str, str]]:
        """Write rows sorted by key over ranges of slot and key; the files with their first keys."""
        folder = f"objects-{uuid4().hex}"
        out = rows.select(*slot, "key", "size", "class").repartitionByRange(files, *slot, "key").sortWithinPartitions(*slot, "key").write
        (out.partitionBy(*slot) if slot else out).parquet(f"{self.path}/{folder}")
        kept = self.spark.read.schema(OBJECTS).option("recursiveFileLookup", "true").parquet(f"{self.path}/{folder}")
        firsts = kept.groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("first")).collect()  # a row a file, of its first column
        return [(f"{folder}/{r.file.split(folder + '/')[1]}", r.first) for r in sorted(firsts, key=lambda r: r.first.encode())]

    def _rolled(self, sums: DataFrame, files: int) -> str:
        folder = f"rollup-{uuid4().hex}"
        sums.repartitionByRange(files, "parent", "prefix").sortWithinPartitions("parent", "prefix").write.parquet(f"{self.path}/{folder}")
        return folder

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def save(self, objects: DataFrame, files: int | None = None, with_rollup: bool = True) -> str:
        """Write a version of these objects alone and point to it; its name."""
        new = Manifest(self._written(objects, files or self._parts()))
        if with_rollup:
            new.rollup = self._rolled(rollup(self._objects(new.files)), max(1, self._parts() // 4))
        return self._point(new)

    def _objects(self, files: list[tuple[str, str]]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], OBJECTS)
        return self.spark.read.schema(OBJECTS).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{f}" for f, _ in files])

    def load(self) -> DataFrame:
        return self._objects(self.manifest().files)

    def load_rollup(self) -> DataFrame:
        folder = self.manifest().rollup
        if not folder:
            raise FileNotFoundError(f"no roll-up at {self.path}")
        return self.spark.read.schema(ROLLUP).parquet(f"{self.path}/{folder}")

    def replace(self, batch: DataFrame, start_from: str, hi: str | None = None) -> str | None:
        """Objects after a batch that owns (start_from, its last key]: what lay there is replaced. An empty batch changes nothing.

        Only files with keys in the range are read and written.
        """
        hi = batch_bounds(batch) if hi is None else hi
        if hi is None:
            return self.current()
        now = self.manifest()
        ends = [*(first for _, first in now.files[1:]), None]
        touched = [i for i, (first, end) in enumerate(zip([first for _, first in now.files], ends, strict=True)) if (i == 0 or first <= hi) and (end is None or end > start_from)]
        old = self._objects([now.files[i] for i in touched])
        return self._change(now, touched, old.where(~in_range(start_from, hi)), batch, signed_changes(merge_actions(old, batch, start_from, hi)))

    def unite(self, batch: DataFrame) -> str | None:
        """Objects of the table and the batch; of a key that both have the row of the smaller class and size.

        Only files that own a key of the batch are read and written.
        """
        now = self.manifest()
        touched = sorted(r.slot for r in batch.select(now.owner(F.col("key")).alias("slot")).distinct().collect()) if now.files else [0]  # a row a file
        if not touched:
            return self.current()
        old = self._objects([now.files[i] for i in touched] if now.files else [])
        both = old.select("key", "size", "class", F.lit(1).alias("was")).unionByName(batch.select("key", "size", "class", F.lit(0).alias("was")))
        pairs = both.groupBy("key").agg(F.min(F.struct("class", "size")).alias("n"), F.max(F.when(F.col("was") == 1, F.struct("class", "size"))).alias("o"), F.min("was").alias("only"))
        moved = pairs.where("only = 0 and not (o <=> n)")  # keys of the batch that change something
        went = moved.where("o is not null").select("key", "o.size", "o.class", F.lit(-1).alias("sign"))
        came = moved.select("key", "n.size", "n.class", F.lit(1).alias("sign"))
        return self._change(now, touched, old, batch, went.unionByName(came))

    def _change(self, now: Manifest, touched: list[int], kept: DataFrame, batch: DataFrame, changes: DataFrame) -> str:
        rows = deduped(kept.select("key", "size", "class").unionByName(batch.select("key", "size", "class")))
        slot = now.owner(F.col("key")) if now.files else F.lit(0)
        slots = rows.withColumn("slot", slot)
        files = max(len(touched), 1 + rows.count() // FILE_ROWS)
        new = self._written(slots, files, "slot")
        gone = {now.files[i][0] for i in touched} if now.files else set()
        listed = sorted([f for f in now.files if f[0] not in gone] + new, key=lambda f: f[1].encode())
        folder = ""
        if now.rollup:
            sums = self.spark.read.schema(ROLLUP).parquet(f"{self.path}/{now.rollup}")
            folder = self._rolled(apply_delta(sums, rollup_delta(changes)), max(1, self._parts() // 4))
        return self._point(Manifest(listed, folder))
