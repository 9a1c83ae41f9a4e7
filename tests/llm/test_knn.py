import math
import random

from cairn.llm import knn


def brute(rows, test, k):
    fine = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for m, q, x in fine:
        if test(q):
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for n, i, y in fine if n != m and len(y) == len(x))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k=10, divisor=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string").repartition(3)
    return sorted(tuple(r) for r in knn.voronoi_knn(df, lambda i: i % divisor == 0, k).collect())


def test_clusters_ties_and_bad_rows(spark, monkeypatch):
    rnd = random.Random(3)
    f = lambda x: round(x * 64) / 64  # noqa: E731  floats that float32 holds
    rows = []
    for i in range(300):
        c = i % 4
        rows.append((i, [f(rnd.gauss(3 * (c == j), 0.3)) for j in range(4)]))
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(150)]
    rows += [(2000, None), (2005, []), (2010, [1.0, None, 0.0, 0.0]), (2015, [float("nan"), 0.0, 0.0, 0.0]), (2020, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (2025, [1.0]), (2030, [0.0] * 4), (1000, [1.0, 1.0, 0.0, 0.0])]
    rows += [(3000 + i // 2, [f(rnd.gauss(0, 1)) for _ in range(9)]) for i in range(40)]  # another length, ids twice
    for pivots in (1024, 7):
        monkeypatch.setattr(knn, "PIVOTS", pivots)
        assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 10)


def test_a_stray_row_empties_nothing(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.randint(-8, 8) / 8 for _ in range(3)]) for i in range(50)] + [(100, [1.0] * 7)]
    got = run(spark, rows)
    assert len(got) == 100 and got == brute(rows, lambda i: i % 5 == 0, 10)


def test_bounds_hold_and_prune(spark, monkeypatch):
    """With clusters, cells of many queries keep few of all pairs; what is kept holds the answer."""
    monkeypatch.setattr(knn, "PIVOTS", 24)
    rnd = random.Random(10)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [round((x + rnd.gauss(0, 0.02)) * 64) / 64 for x in centres[i % 12]]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = knn.routing(df, lambda i: i % 5 == 0, 10, "vec_id", "embedding", 1024)
    assert 0 < plan.kept < 0.5 * plan.pairs
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 10)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILE_DATA", 40)
    monkeypatch.setattr(knn, "TILE_QUERIES", 7)
    rnd = random.Random(8)
    rows = [(i, [rnd.randint(-8, 8) / 8 for _ in range(6)]) for i in range(160)]
    for pivots in (1024, 3, 1):
        monkeypatch.setattr(knn, "PIVOTS", pivots)
        assert run(spark, rows, 3, 4) == brute(rows, lambda i: i % 4 == 0, 3)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0, 2.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, [(5, [1.0]), (6, [2.0])]) == [(5, 1, 6, 1024 * 2048)]
    assert run(spark, [(5, [0.0]), (6, [0.0])]) == [(5, 1, 6, 0)]
    big = [(5, [1.0e6, 1.0]), (6, [1.0e6, 2.0]), (7, [-1.0e6, 0.0]), (8, [2.0e6, 0.0])]
    assert run(spark, big) == brute(big, lambda i: i % 5 == 0, 10)
