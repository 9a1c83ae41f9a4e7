import pytest
from pyspark.sql import functions as F

from cairn.functions.keys import above_prefix
from cairn.operators import listing, rollup
from cairn.plans.browser import Browser
from cairn.schema import OBJECTS

from . import model


def table(spark, rows):
    return spark.createDataFrame(rows, OBJECTS)


def listed(df, prefix=""):
    return sorted((r["name"], r.is_dir, r["class"], r.objects, r.bytes) for r in listing.list_directory(df, prefix).collect())


def test_empty_and_bad_prefix(spark):
    df = table(spark, [])
    assert listed(df) == []
    assert listing.listing_totals(df, "", "us-east-1").first() == (0, 0, 0.0)
    with pytest.raises(ValueError, match="prefix"):
        listing.list_directory(df, "foo")


def test_split(spark):
    df = table(spark, [("afk/abc.jpg", 10, 1), ("afk/abcdef/x.jpg", 20, 5)])
    assert listed(df, "afk/") == [("abc.jpg", False, 1, 1, 10), ("abcdef/", True, None, 1, 20)]


def test_deep_chain(spark):
    df = table(spark, [("afk/images/2024/05/09/x.jpg", 100, 5)])
    at = ""
    for name in ("afk/", "images/", "2024/", "05/", "09/"):
        assert listed(df, at) == [(name, True, None, 1, 100)]
        at += name
    assert listed(df, at) == [("x.jpg", False, 5, 1, 100)]
    assert listed(df, "afk/missing/") == []


def test_marker(spark):
    df = table(spark, [("afk/", 0, 1), ("afk/file.jpg", 5, 5)])
    assert listed(df) == [("afk/", True, None, 2, 5)]
    assert listed(df, "afk/") == [("", False, 1, 1, 0), ("file.jpg", False, 5, 1, 5)]
    shown = rollup.nonzero(listing.entries_by_class(df, "")).collect()
    assert [(r["class"], r.bytes) for r in shown] == [(5, 5)]


ROWS = [("foo-bar/x", 1, 1), ("foo.txt", 2, 2), ("foo/a", 3, 3), ("foo", 4, 4), ("a//b", 5, 5), ("a/", 0, 1), ("z/ünï/é.txt", 6, 0), ("z/zero", 0, 9), ("b", 7, 20)]


def test_model(spark):
    df = table(spark, ROWS)
    dirs = model.directories(ROWS)
    assert {r.prefix for r in rollup.directories(df).collect()} == dirs
    for d in dirs:
        expected = model.listing(ROWS, d)
        assert {(r["name"], r.is_dir): (r.objects, r.bytes) for r in listing.list_directory(df, d).collect()} == {k: (n, sum(b.values())) for k, (n, b) in expected.items()}
    rolled = {(r.prefix, r["class"]): (r.objects, r.bytes, r.parent, r.depth) for r in rollup.rollup(df).collect()}
    for d in dirs:
        mine = [(s, c) for k, s, c in ROWS if k.startswith(d)]
        for c in {c for _, c in mine}:
            up = None if not d else d[: d[:-1].rfind("/") + 1]
            assert rolled[d, c] == (sum(x == c for _, x in mine), sum(s for s, x in mine if x == c), up, d.count("/"))
    assert sum(1 for _ in rolled) == sum(len({c for k, _, c in ROWS if k.startswith(d)}) for d in dirs)


def test_order_ties_and_directions(spark):
    df = table(spark, [("b", 5, 1), ("a", 5, 1), ("c/x", 9, 1), ("d/x", 1, 1), ("d/y", 1, 1)])
    names = lambda **k: [r["name"] for r in listing.ranked(listing.list_directory(df), **k).orderBy("rank").collect()]
    assert names() == ["c/", "a", "b", "d/"]
    assert names(descending=False) == ["d/", "a", "b", "c/"]
    assert names(by="count") == ["d/", "a", "b", "c/"]
    assert names(by="name", dirs_first=True) == ["c/", "d/", "a", "b"]
    assert listing.next_order("size", True, "size") == ("size", False)
    assert listing.next_order("size", True, "name") == ("name", False)
    assert [r["name"] for r in listing.top_entries(listing.list_directory(df), 2).orderBy("rank").collect()] == ["c/", "a"]


def test_dominant_class_and_mix(spark):
    df = table(spark, [("d/a", 5, 6), ("d/b", 5, 2), ("e/z", 0, 3), ("f", 0, 4), ("g", 3, 4)])
    got = {r["name"]: (r.top, r.extra, r.label) for r in listing.dominant_class(df, "").collect()}
    assert got == {"d/": (2, 1, "STANDARD_IA +1"), "e/": (0, 0, ""), "f": (0, 0, ""), "g": (4, 0, "INTELLIGENT_TIERING")}
    mix = {r["class"]: (r.objects, r.bytes) for r in listing.class_mix(df, "").collect()}
    assert mix == {0: (1, 0), 2: (2, 5), 6: (0, 5), 4: (2, 3)}


def test_maps_and_equality(spark):
    df = spark.sql("select map(1, 5L, 2, 7L) as a, map(1, -5L, 3, 1L) as b").select(rollup.merge_class_bytes(F.col("a"), F.col("b")).alias("m"))
    assert df.select("m", rollup.map_total(F.col("m")).alias("t")).first() == ({2: 7, 3: 1}, 8)
    a = rollup.rollup(table(spark, ROWS))
    assert rollup.same_totals(a, rollup.rollup(table(spark, ROWS[::-1])))
    assert not rollup.same_totals(a, rollup.rollup(table(spark, ROWS[1:])))


def test_prefix_bound():
    for p in ("a/", "x", "events/", "é", "日本", "\ue000", "a\x00"):
        lo = above_prefix(p)
        assert lo.encode() < p.encode() <= (p + "x").encode()
        assert p[-1] == "\x00" or lo.encode() > (p[:-1] + "\x01" * 9).encode()
    assert above_prefix("") == ""


def test_browser(spark):
    b = Browser(table(spark, ROWS), rows=3)
    assert b.view().count() == 3
    b.descend("z/")
    assert {r["name"] for r in b.entries().collect()} == {"ünï/", "zero"}
    b.sort("size")
    assert not b.descending
    b.ascend()
    assert b.prefix == ""
    b.ascend()


def test_plan_pushes_prefix_down(spark, tmp_path):
    table(spark, ROWS).write.parquet(str(tmp_path / "t"))
    df = listing.list_directory(spark.read.schema(OBJECTS).parquet(str(tmp_path / "t")), "foo/")
    plan = df._jdf.queryExecution().toString()
    assert "StringStartsWith(key,foo/)" in plan and "BatchEvalPython" not in plan


def test_report_rounds_a_cost_as_it_is(spark):
    cost = 1.015  # as a double below that number
    df = table(spark, [("a/x", round(cost / 0.023 * (1 << 30)), 1)])
    assert [(r.cost, r.monthly) for r in listing.root_report(df, "us-east-1").collect()] == [(cost, "$1.01")]
