import random

import pytest

from cairn.operators import reconcile, rollup
from cairn.schema import OBJECTS


def table(spark, rows):
    return spark.createDataFrame(rows, OBJECTS)


def rows_of(df):
    return sorted((r.key, r.size, r["class"]) for r in df.collect())


def test_range_delete_and_idempotence(spark):
    base = [("a/b.txt", 1, 1), ("a/c.txt", 2, 1), ("a/d.txt", 3, 1)]
    df = table(spark, base)
    assert rows_of(reconcile.apply_batch(df, df, "")) == base
    batch = table(spark, [base[0], base[2]])
    assert rows_of(reconcile.apply_batch(df, batch, "a/a")) == [base[0], base[2]]
    assert [r.key for r in reconcile.deletes(df, batch, "a/a").collect()] == ["a/c.txt"]
    assert rows_of(reconcile.apply_batch(df, table(spark, []), "a/")) == base


def test_range_update(spark):
    df, batch = table(spark, [("a/x", 10, 1)]), table(spark, [("a/x", 25, 5)])
    assert rows_of(reconcile.apply_batch(df, batch, "a")) == [("a/x", 25, 5)]
    assert [tuple(r) for r in reconcile.updates(df, batch, "a/").collect()] == [("a/x", 10, 1, 25, 5)]


def test_batch_contract(spark):
    batch = table(spark, [("a", 1, 1), ("a", 2, 1), ("0", 1, 1), ("", 1, 1), ("b", 1, 1)])
    assert {(r.key, r.problem) for r in reconcile.batch_violations(batch, "5").collect()} == {("a", "repeated"), ("0", "not above start"), ("", "empty")}
    with pytest.raises(reconcile.BatchError, match="repeated"):
        reconcile.checked(batch, "5")
    assert reconcile.checked(table(spark, [("b", 1, 1)]), "a").count() == 1
    lines = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "b")], "pos long, key string")
    assert sorted(r.pos for r in reconcile.unsorted(lines).collect()) == [2, 3]


def test_merge_and_rollup_delta(spark):
    rnd = random.Random(5)
    for _ in range(3):
        keys = sorted({"".join(rnd.choice("ab-/") for _ in range(rnd.randint(1, 6))) for _ in range(40)})
        old = [(k, rnd.randint(0, 9), rnd.randint(0, 3)) for k in keys if rnd.random() < 0.7]
        lo = rnd.choice(["", "a", "a/"])
        new = [(k, rnd.randint(0, 9), rnd.randint(0, 3)) for k in keys if k > lo and rnd.random() < 0.6][:20]
        if not new:
            continue
        hi = new[-1][0]
        expected = sorted([r for r in old if not lo < r[0] <= hi] + new)
        a, b = table(spark, old), table(spark, new)
        assert rows_of(reconcile.apply_batch(a, b, lo)) == expected
        actions = reconcile.merge_actions(a, b, lo)
        assert {r.action for r in actions.collect()} <= {"insert", "update", "delete", "keep"}
        delta = rollup.rollup_delta(reconcile.signed_changes(actions))
        assert rollup.same_totals(rollup.apply_delta(rollup.rollup(a), delta), rollup.rollup(table(spark, expected)))


def test_deduped(spark):
    df = table(spark, [("a", 2, 1), ("a", 1, 1), ("a", 9, 0), ("b", 1, 1)])
    assert rows_of(reconcile.deduped(df)) == [("a", 9, 0), ("b", 1, 1)]
    assert rows_of(reconcile.union_listings(df, df)) == [("a", 9, 0), ("b", 1, 1)]


def test_delete_guards(spark):
    df = table(spark, [("foo/a", 1, 1), ("foobar", 2, 1), ("x", 4, 1)])
    left, stats = reconcile.delete_prefix(df, reconcile.DeleteGuards("foo"))
    assert left.count() == 3 and stats.first().asDict() == {"listed": 2, "bytes": 3, "deleted": 0, "would_delete": 2, "requests": 1}
    left, stats = reconcile.delete_prefix(df, reconcile.DeleteGuards("foo", confirm="foo", dry_run=False))
    assert rows_of(left) == [("x", 4, 1)] and stats.first().deleted == 2
    for bad in (reconcile.DeleteGuards("/"), reconcile.DeleteGuards("a", batch_size=0), reconcile.DeleteGuards("a", batch_size=1001)):
        with pytest.raises(ValueError):
            bad.check()
    for bad in (reconcile.DeleteGuards("a", dry_run=False), reconcile.DeleteGuards("a", versioned=True)):
        with pytest.raises(PermissionError):
            bad.check()


def test_delete_outcome(spark):
    sent = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "key string, size long")
    errors = spark.createDataFrame([("b", "SlowDown"), ("c", "AccessDenied")], "key string, code string")
    assert reconcile.delete_outcome(sent, errors).first() == (1, 1, 2, 1)


def test_fan_out(spark):
    df = table(spark, [("a/x/1", 1, 1), ("a/y/1", 1, 1), ("b/1", 1, 1), ("c", 1, 1)])
    front = lambda **k: sorted(r.prefix for r in reconcile.fan_out(df, "", **k).collect())
    assert front(max_depth=1) == ["a/", "b/"]
    assert front(max_depth=3, min_prefixes=99) == ["a/x/", "a/y/", "b/"]
    assert front(max_depth=3, min_prefixes=2) == ["a/", "b/"]


def test_owners(spark):
    rnd = random.Random(3)
    keys = sorted({"".join(rnd.choice("abc/") for _ in range(rnd.randint(1, 5))) for _ in range(120)})
    cuts = sorted(rnd.sample(keys, 12))
    batches = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i % 3]
    df = table(spark, [(k, 1, 1) for k in keys])
    got = {r.key: r.batch for r in reconcile.owners(df, spark.createDataFrame(batches, "batch int, start_from string, last_key string")).collect()}
    assert got == {k: next((i for i, a, b in batches if a < k <= b), None) for k in keys}
    assert reconcile.owners(df, spark.createDataFrame([], "batch int, start_from string, last_key string")).where("batch is null").count() == len(keys)
