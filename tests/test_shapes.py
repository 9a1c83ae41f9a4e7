"""Paging, simulation and trie shapes against the plain model on random keys."""

import random

import pytest

from cairn.operators import paging, rollup, trie
from cairn.plans import simulate
from cairn.schema import OBJECTS
from cairn.sources.live import Emulator, pages

from . import model


def table(spark, rows):
    return spark.createDataFrame(rows, OBJECTS)


def random_rows(seed, n=60):
    rnd = random.Random(seed)
    keys = {"".join(rnd.choice("ab-/é") for _ in range(rnd.randint(1, 8))) for _ in range(n)}
    return [(k, rnd.randint(0, 9), rnd.randint(0, 3)) for k in sorted(keys)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = random_rows(seed)
    expected = model.trie([k for k, _, _ in rows])
    got = {r.path.encode("latin-1"): r for r in trie.with_children(trie.trie_nodes(table(spark, rows))).collect()}
    assert set(got) == set(expected)
    for p, (parent, has_key, children, inner) in expected.items():
        r = got[p]
        assert (r.parent.encode("latin-1") if r.parent is not None else None) == parent
        assert (r.has_object, r.children, r.kind, r.edge) == (has_key, children, "internal" if inner else "leaf", len(p) - len(parent or b""))


def test_trie_of_nothing_and_one(spark):
    row = trie.trie_counts(table(spark, [])).first()
    assert (row.nodes, row.leaves, row.empty) == (1, 0, 1)
    row = trie.trie_counts(table(spark, [("abc", 1, 1)])).first()
    assert (row.nodes, row.leaves, row.internals, row.max_edge) == (2, 1, 1, 3)


@pytest.mark.parametrize("strategy", list(simulate.STRATEGIES))
def test_simulate(spark, strategy):
    for seed in (3, 4):
        rows = random_rows(seed)
        for k, depth in ((3, 2),):
            r = simulate.STRATEGIES[strategy](table(spark, rows), max_depth=depth, k=k).first()
            assert (r.requests, r.contents, r.common_prefixes) == model.simulate(rows, strategy, depth, k)
    r = simulate.STRATEGIES[strategy](table(spark, [])).first()
    assert (r.requests, r.contents, r.common_prefixes) == (1, 0, 0)


def test_balance_adds_up(spark):
    df = table(spark, random_rows(5))
    loads = simulate.balance(df, "s4-worksteal", workers=3, k=2).collect()
    assert sum(r.requests for r in loads) == simulate.simulate(df, "s4-worksteal", k=2).first().requests
    with pytest.raises(KeyError):
        simulate.register("s1-recursive", simulate.simulate)


def walk(df, prefix, delimiter, k):
    """All pages of a listing through tokens."""
    token, seen, dirs, n = "", [], [], 0
    while True:
        r = (paging.page_delimited if delimiter else paging.page_flat)(df, prefix, token, k).first()
        n += 1
        seen += r.contents
        dirs += r.common_prefixes if delimiter else []
        if not r.truncated:
            return seen, dirs, n
        token = r.token


def test_pages(spark):
    rows = [(k, 1, 1) for k in ["a/1", "a/2", "a/3", "b/1", "b/2", "c/1", "top.txt"]]
    df = table(spark, rows)
    assert paging.page_flat(df, "a/").first() == (["a/1", "a/2", "a/3"], False, None)
    assert paging.page_delimited(df).first() == (["top.txt"], ["a/", "b/", "c/"], False, None)
    assert walk(df, "", "/", 2) == (["top.txt"], ["a/", "b/", "c/"], 2)
    assert paging.page_delimited(df, delimiter="-").first().contents == [k for k, _, _ in rows]
    assert (paging.page_size(0), paging.page_size(1001), paging.page_size(7)) == (1000, 1000, 7)
    keys = random_rows(8, 30)
    df = table(spark, keys)
    listed = [(k, s, str(c)) for k, s, c in keys]
    for prefix, k in (("", 4), ("a", 3)):
        seen, dirs, n = walk(df, prefix, "/", k)
        bucket = Emulator(listed, k)
        got = list(pages(bucket, "", prefix, "/"))
        assert seen == [o[0] for p in got for o in p.objects] and dirs == [d for p in got for d in p.prefixes] and n == bucket.requests
        assert (n, len(seen), dirs) == model.pages(keys, prefix, "/", k)


def test_positions_and_chunks(spark):
    rows = random_rows(9, 80)
    df = table(spark, rows)
    got = [r.key for r in paging.positions(df).orderBy("pos").collect()]
    assert got == sorted((k for k, _, _ in rows), key=str.encode)
    made = paging.chunks(df, 7).orderBy("chunk").collect()
    assert [c.start_from for c in made] == ["", *[c.last_key for c in made[:-1]]]
    assert sum(c.objects for c in made) == len(rows) and all(c.objects == 7 for c in made[:-1])
    assert paging.all_pages(df, "nothing").count() == 0


def test_visible():
    assert paging.visible(0, 5, 3) == (0, 3)
    assert paging.visible(0, 5, 100) == (0, 5)
    assert paging.visible(50, 5, 100) == (48, 53)
    assert paging.visible(99, 5, 100) == (95, 100)
    assert paging.visible(0, 0, 9) == (0, 1)


def test_structure(spark):
    rows = random_rows(11)
    dirs = model.directories(rows)
    depths = sorted(d.count("/") for d in dirs)
    r = rollup.structure(table(spark, rows)).first()
    assert (r.dirs, r.files, r.max_depth) == (len(dirs), len(rows), depths[-1])
    assert (r.p50_depth, r.p99_depth) == (depths[len(depths) // 2], depths[len(depths) * 99 // 100])
    assert r.max_fanout == max(len(model.listing(rows, d)) for d in dirs)
