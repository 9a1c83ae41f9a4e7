import io
import json
import time

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from cairn import cli
from cairn.operators import reconcile, rollup
from cairn.plans import progress
from cairn.schema import OBJECTS
from cairn.sources import listings, live, snapshot, synthetic
from cairn.sources.table import InventoryTable, table_path
from cairn.streaming import ingest

ROWS = [("a/", 0, 1), ("a/b", 3, 2), ("a/b/c", 4, 5), ("a/bd", 5, 0), ("é/x", 6, 10), ("z", 7, 1)]


def table(spark, rows):
    return spark.createDataFrame(rows, OBJECTS)


def rows_of(df):
    return sorted((r.key, r.size, r["class"]) for r in df.collect())


def test_jsonl(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"key":"a","size":3,"class":"GLACIER"}\n\n{"key":"b"}\n')
    assert rows_of(listings.read_jsonl(spark, str(tmp_path / "l.jsonl"))) == [("a", 3, 6), ("b", 0, 0)]
    (tmp_path / "bad.jsonl").write_text('{"key": oops\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        listings.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    listings.write_jsonl(table(spark, ROWS), str(tmp_path / "out"))
    assert rows_of(listings.read_jsonl(spark, str(tmp_path / "out"))) == sorted(ROWS)


def test_inventory(spark, tmp_path):
    (tmp_path / "i.csv").write_text("key,size,storage_class\nx,5,SNOW\ny,,\n")
    assert rows_of(listings.read_inventory(spark, str(tmp_path / "i.csv"), "csv")) == [("x", 5, 10), ("y", 0, 0)]


def test_snapshot_round_trip(spark, tmp_path):
    for rows in ([], ROWS[:1], ROWS):
        data = snapshot.encode(rows)
        assert list(snapshot.decode(data)) == sorted(rows, key=lambda r: r[0].encode())
    path = str(tmp_path / "deep" / "tree.snap")
    snapshot.write_snapshot(table(spark, ROWS), path)
    assert rows_of(snapshot.read_snapshot(spark, path)) == sorted(ROWS)


def test_snapshot_errors():
    good = snapshot.encode(ROWS)
    for bad, what in ((b"", "header"), (b"XXXX" + good[4:], "magic"), (good[:4] + b"\x09\x00" + good[6:], "version"), (good[:-3], "breaks off|follow"), (good + b"x", "follow"), (good[:8] + b"\x00" * 4 + good[12:], "damaged")):
        with pytest.raises(snapshot.SnapshotError, match=what):
            list(snapshot.decode(bad))


def test_table_versions(spark, tmp_path):
    t = InventoryTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.load()
    first = t.save(table(spark, ROWS))
    assert t.current() == first and rows_of(t.load()) == sorted(ROWS)
    assert rollup.same_totals(t.load_rollup(), rollup.rollup(table(spark, ROWS)))
    t.save(reconcile.delete_victims(t.load(), "a/"))
    assert t.current() != first and len(rows_of(t.load())) == 4
    assert table_path("r/", "b") == "r/bucket=b/region=unknown"
    assert listings.empty(spark).schema == OBJECTS


def test_synthetic(spark):
    df = synthetic.generate(spark, seed=3)
    rows = rows_of(df)
    assert rows == rows_of(synthetic.generate(spark, seed=3)) != rows_of(synthetic.generate(spark, seed=4))
    keys = [k for k, _, _ in rows]
    assert len(keys) == len(set(keys)) and 2 * synthetic.EXPOSURES < len(keys) < 5 * synthetic.EXPOSURES
    assert {c for _, _, c in rows} == {1, 2, 3, 4, 5, 6, 7, 10} and all(s >= 0 for _, s, _ in rows)
    assert synthetic.generate(spark, seed=3, scale=2).count() > 1.5 * len(keys)


def test_live_listing(spark):
    rows = [(k, s, "STANDARD") for k, s, _ in ROWS] + [(f"n/{i:03}", i, "SNOW") for i in range(25)] + [("foo.txt", 1, ""), ("foo/a", 1, ""), ("foo-bar/x", 1, "")]
    spark.dataSource.register(live.ListingSource)
    for depth in (0, 1, 3):
        df = spark.read.format("listing").option("objects", json.dumps(rows)).option("max_keys", "4").option("max_depth", str(depth)).load()
        assert sorted(r.key for r in df.collect()) == sorted(k for k, _, _ in rows)
    df = spark.read.format("listing").option("objects", json.dumps(rows)).option("prefix", "n/").load()
    assert df.count() == 25
    assert spark.read.format("listing").option("objects", "[]").load().count() == 0


def test_plan_holds_a_page_a_directory_and_probes_at_once(spark):
    rows = [(f"d{i:02}/f{j}", 1, "") for i in range(24) for j in range(3)] + [(f"big/{j:05}", 1, "") for j in range(2500)] + [("top", 1, "")]
    work = live.plan(live.Emulator(rows), "b", "", 2)
    assert max((len(w.objects) for w in work), default=0) <= 2000
    assert [w.prefix for w in work if w.shallow] == ["big/"]
    assert sum(len(w.objects) for w in work) == 24 * 3 + 1
    slow = live.Emulator(rows[: 24 * 3], delay=0.05)
    began = time.monotonic()
    live.plan(slow, "b", "", 2, workers=12)
    assert slow.requests == 25 and time.monotonic() - began < 25 * 0.05 * 0.6
    spark.dataSource.register(live.ListingSource)
    got = spark.read.format("listing").option("objects", json.dumps(rows)).option("max_depth", "2").option("workers", "4").load()
    assert sorted(r.key for r in got.collect()) == sorted(k for k, _, _ in rows)


def test_region():
    here = live.Emulator([], home="eu-north-1")
    assert live.region_of(here, "b") == "eu-north-1" and live.region_of(here, "b", "us-east-1", "http://localhost") == "us-east-1"
    assert live.region_of(live.Emulator([]), "b", "us-east-1") == "us-east-1"

    class Broken(live.Emulator):
        def region(self, bucket):
            raise OSError("no answer")

    with pytest.warns(UserWarning, match="no answer"):
        assert live.region_of(Broken([]), "b", "us-west-2") == "us-west-2"


class Recorded(live.Emulator):
    """Writes what it deletes to a file, as it lives in executors' processes."""

    def __init__(self, path, *args, **named):
        super().__init__([], *args, **named)
        self.path = str(path)

    def delete(self, bucket, keys):
        with open(self.path, "a") as f:
            f.write("".join(f"{k}\n" for k in keys if k not in self.errors))
        return super().delete(bucket, keys)


def test_deletion_in_a_bucket(spark, tmp_path):
    rows = [(f"a/{i:04}", i, 1) for i in range(2300)] + [("b/x", 5, 1)]
    victims = table(spark, rows).repartition(3)
    store = Recorded(tmp_path / "gone", errors={"a/0007": "SlowDown", "a/0009": "AccessDenied"})
    dry = live.delete_in_bucket(victims, store, "b", reconcile.DeleteGuards("a/")).first()
    assert (dry.listed, dry.deleted, dry.would_delete) == (2300, 0, 2300) and not (tmp_path / "gone").exists()
    done = live.delete_in_bucket(victims, store, "b", reconcile.DeleteGuards("a/", confirm="a/", dry_run=False)).first()
    assert (done.deleted, done.errors, done.throttled, done.bytes) == (2298, 2, 1, sum(range(2300)) - 16)
    gone = (tmp_path / "gone").read_text().split()
    assert sorted(gone) == sorted(k for k, _, _ in rows if k.startswith("a/") and k not in store.errors)
    with pytest.raises(PermissionError, match="versions"):
        live.delete_in_bucket(victims, Recorded(tmp_path / "no", keeps_versions=True), "b", reconcile.DeleteGuards("a/", confirm="a/", dry_run=False))
    with pytest.raises(ValueError, match="1000 keys"):
        live.Emulator([]).delete("b", ["k"] * 1001)


def files_of(t):
    return {f for f, _ in t.manifest().files}


def test_changes_rewrite_only_what_they_touch(spark, tmp_path):
    rows = [(f"k{i:04}/x", i, i % 3) for i in range(2000)]
    t = InventoryTable(spark, str(tmp_path / "t"))
    t.save(table(spark, rows), files=8)
    before = files_of(t)
    assert len(before) == 8
    batch = [("k0620/x", 7, 1), ("k0621/y", 8, 2)]
    t.replace(table(spark, batch), "k0619/x")
    held = {k: (s, c) for k, s, c in rows if not "k0619/x" < k <= "k0621/y"} | {k: (s, c) for k, s, c in batch}
    assert rows_of(t.load()) == sorted((k, *v) for k, v in held.items())
    assert len(before - files_of(t)) == 1
    assert rollup.same_totals(t.load_rollup(), rollup.rollup(t.load()))
    before = files_of(t)
    more = [("a/first", 1, 1), ("k0100/x", 5, 9), ("k0100/x2", 5, 0), ("zz", 3, 3), ("k0101/x", 1, 0)]
    t.unite(table(spark, more))
    for k, s, c in more:
        old = held.get(k)
        held[k] = (s, c) if old is None else min((s, c), old, key=lambda v: (v[1], v[0]))
    assert rows_of(t.load()) == sorted((k, *v) for k, v in held.items())
    assert len(before - files_of(t)) == 2
    assert rollup.same_totals(t.load_rollup(), rollup.rollup(t.load()))
    version = t.current()
    t.unite(table(spark, more))  # again
    assert rows_of(t.load()) == sorted((k, *v) for k, v in held.items()) and rollup.same_totals(t.load_rollup(), rollup.rollup(t.load()))
    assert t.replace(table(spark, []), "a") == t.current() != version
    firsts = [first for _, first in t.manifest().files]
    assert firsts == sorted(firsts)
    t.replace(table(spark, [("zzz", 1, 1)]), "")  # all that lay there goes
    assert rows_of(t.load()) == [("zzz", 1, 1)] and rollup.same_totals(t.load_rollup(), rollup.rollup(t.load()))


def test_old_versions_are_removed(spark, tmp_path):
    t = InventoryTable(spark, str(tmp_path / "t"))
    t.save(table(spark, ROWS))
    for i in range(4):
        t.unite(table(spark, [(f"new{i}", i, 1)]))
    assert len(t.versions()) == 2 and rows_of(t.load()) == sorted(ROWS + [(f"new{i}", i, 1) for i in range(4)])
    assert len(list((tmp_path / "t").glob("manifest-*.json"))) == 2
    named = {f for v in t.versions() for f, _ in t.manifest(v).files}
    there = {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").glob("objects-*/**/*.parquet")}
    assert there == named
    assert len(list((tmp_path / "t").glob("rollup-*"))) == 2


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.jsonl").write_text("".join(json.dumps({"key": f"k{j}", "size": j, "class": "STANDARD"}) + "\n" for j in range(i * 2, i * 2 + 3)))
    t = InventoryTable(spark, str(tmp_path / "t"))
    log = ingest.ProgressLog()
    spark.streams.addListener(log)
    ingest.ingest(spark, str(folder), t, str(tmp_path / "cp"), files_per_trigger=1).awaitTermination()
    assert rows_of(t.load()) == [(f"k{j}", j, 1) for j in range(7)]
    ingest.ingest(spark, str(folder), t, str(tmp_path / "cp")).awaitTermination()
    assert t.load().count() == 7
    spark.streams.removeListener(log)
    write = ingest.merge_into(t, start_from="k1")
    write(table(spark, [("k2", 99, 2), ("k4", 4, 1)]), 0)
    assert rows_of(t.load()) == [("k0", 0, 1), ("k1", 1, 1), ("k2", 99, 2), ("k4", 4, 1), ("k5", 5, 1), ("k6", 6, 1)]


def test_cli(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("".join(json.dumps({"key": k, "size": s, "class": "STANDARD"}) + "\n" for k, s, _ in ROWS))
    root = str(tmp_path / "t")

    def run(*args):
        out = io.StringIO()
        assert cli.main([args[0], root, *args[1:]], spark, out) == 0
        return out.getvalue()

    run("load", str(tmp_path / "l.jsonl"))
    assert run("list").splitlines()[0].startswith("a/\t4\t12")
    assert run("list", "--prefix", "none/") == "(empty)\n"
    assert len(run("stats").splitlines()) == 3
    assert "s3-current" in run("sim")
    sim = run("sim", "--strategy", "s4-worksteal", "--workers", "3", "--latency", "2", "--log", str(tmp_path / "log.txt"))
    assert "seconds=" in sim and "parallelism=" in sim and "sim" in (tmp_path / "log.txt").read_text()
    assert run("rm", "a/").startswith("4\t12\t0\t4")
    run("rm", "a/", "--yes", "a/")
    assert run("list").startswith("z") or "a/" not in run("list")
    run("export", str(tmp_path / "x.snap"))
    assert len(list(snapshot.decode((tmp_path / "x.snap").read_bytes()))) == 2
    run("gen", "--seed", "2")
    assert "frames/" in run("list", "--sort", "size", "--reverse", "--dirs-first")
    run("export", str(tmp_path / "x.jsonl"), "--format", "jsonl", "--limit", "3")
    assert [r[0] for r in rows_of(listings.read_jsonl(spark, str(tmp_path / "x.jsonl")))] == [r.key for r in synthetic.generate(spark, 2).orderBy("key").limit(3).collect()]


def test_ticker(spark):
    lines = []
    with progress.Ticker(spark, "count", 0.05, report=lines.append):
        spark.range(0, 40, 1, 8).foreach(lambda _: time.sleep(0.05))
    assert lines[-1].startswith("count: done after") and any("tasks (" in x for x in lines[:-1])
    with pytest.raises(ValueError), progress.Ticker(spark, "x", 1, report=lines.append):
        raise ValueError
    assert lines[-1].startswith("x: failed")
    assert progress.line("load", 5, 20, 10) == "load: 5/20 tasks (25%), 10 s, 30 s to go"
    assert progress.line("load", 0, 0, 1) == "load: 0/0 tasks (-), 1 s"


def test_waiting_prefixes_and_the_first_failure():
    rows = [(f"d{i}/f", 1, "") for i in range(4)]
    told = []
    live.plan(live.Emulator(rows), "b", "", 2, waiting=told.append)
    assert told == [0, 3, 2, 1, 0]

    def broken(bucket, prefix, delimiter, token):
        if prefix == "d2/":
            raise OSError("gone")
        return live.Emulator(rows)(bucket, prefix, delimiter, token)

    with pytest.raises(OSError, match="gone"):
        live.plan(broken, "b", "", 2)
