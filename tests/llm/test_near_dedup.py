import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from cairn.llm import common, simhash_dedup as sh


def brute_fp(text):
    words = text.encode().lower().split() if text else []
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """(id, fingerprint) -> smallest id reachable by links of two bits."""
    up = list(range(len(points)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(points):
        for j, (_, b) in enumerate(points[:i]):
            if (a ^ b).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, (n, _) in enumerate(points):
        if n is not None:
            least[root(i)] = min(n, least.get(root(i), n))
    return [least.get(root(i)) for i in range(len(points))]


def test_fingerprints_and_components(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice(["Alpha", "beta", "gamma", "ÉTÉ", "été", "x"]) for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.upper() if i % 2 else t + " x") for i, t in enumerate(base)] + [(200, None), (201, ""), (202, " \n"), (3, base[3]), (None, base[5]), (300, "one two"), (301, "ONE  two")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = {}
    for r in sh.simhash_components(df).collect():
        got.setdefault((r.doc_id, r.fp & (1 << 64) - 1), []).append(r.component_id)
    points = [(i, brute_fp(t)) for i, t in rows]
    expected = {}
    for p, c in zip(points, brute_components(points), strict=True):
        expected.setdefault(p, []).append(c)
    assert got == expected


def test_ball_links_connect_all_links(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f)
            f ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ 1 << i for i in range(64)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = sh.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links.collect())
    roots = {r.node: r.root for r in common.components(links).collect()}
    expected = brute_components([(s, s & (1 << 64) - 1) for s in sorted(signed)])
    assert [roots.get(s, s) for s in sorted(signed)] == expected


def test_components_of_chains_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (-5, 200)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, -5: -5, 200: -5}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_text_in_steps(monkeypatch):
    monkeypatch.setattr(sh, "STEP", 16)
    text = " ".join(f"w{i % 97}" for i in range(500))
    assert int(sh.fingerprints([text])[0]) & (1 << 64) - 1 == brute_fp(text)
    assert [int(x) & (1 << 64) - 1 for x in sh.fingerprints([text[:60], None, text[:90]])] == [brute_fp(text[:60]), 0, brute_fp(text[:90])]


def brute_like(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := (t or "").encode().lower().split()) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_near(rows, least=0.8):
    """(id, text) -> smallest id reachable by links of likeness, over all pairs."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if brute_like(a, b) >= least:
                up[root(i)] = root(j)
    smallest = {}
    for i, (n, _) in enumerate(rows):
        smallest[root(i)] = min(n, smallest.get(root(i), n))
    return [smallest[root(i)] for i in range(len(rows))]


def prose(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 3))) for _ in range(n)]


def edited(rnd, words, share):
    return [prose(rnd, 1)[0] if rnd.random() < share else w for w in words]


def test_likeness():
    rnd = random.Random(17)
    for _ in range(200):
        a = prose(rnd, rnd.randint(0, 30))
        b = edited(rnd, a, 0.05)[rnd.randint(0, 2) :]
        assert sh.likeness(" ".join(a), "\n".join(b).upper()) == brute_like(" ".join(a), " ".join(b))
    assert sh.likeness(None, "") == 1.0 and sh.likeness("a", None) == 0.0


def test_wide_fingerprints_are_majorities(monkeypatch):
    rnd = random.Random(18)
    texts = [" ".join(prose(rnd, n)) for n in (0, 1, 2, 3, 50, 400)] + [None, "a b a b a b", "A  b"]
    whole = sh.wide_fingerprints(texts)
    monkeypatch.setattr(sh, "STEP", 7)
    monkeypatch.setattr(sh, "BLOCK_BYTES", 40)
    steps = sh.wide_fingerprints(texts)
    assert whole[0] == steps[0] and (whole[1] == steps[1]).all()
    assert whole[0][0] == whole[0][6] and whole[0][2] != whole[0][3] and (whole[1] >> 32 == range(sh.PARTS)).all()
    one = sh.wide_fingerprints(["a b", "b a", "a b a"])[1] & 0xFFFFFFFF
    assert (one[2] == (one[0] & one[1])).all()  # of two hashes the bits that are set in both


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(19)
    rows = []
    for g in range(30):
        base = prose(rnd, rnd.choice([6, 40, 120, 300]))
        rows += [(100 * g + i, " ".join(base if i % 3 == 0 else edited(rnd, base, rnd.choice([0.005, 0.02, 0.2])))) for i in range(rnd.randint(1, 6))]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE  two"), (5005, "one"), (rows[0][0], rows[0][1]), (rows[0][0], "quite another text under an id that was there before"), (6000, " ".join(prose(rnd, 60_000)))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows] + [(None, rows[0][1], 1, 2)], "doc_id long, text string, copy int, first int").repartition(3)
    got = sorted(tuple(r) for r in sh.near_duplicates(df).collect())
    expected = sorted(zip([i for i, _ in rows], brute_near(rows), strict=True))
    assert got == expected
    kept = sh.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in expected})


def test_recall_of_near_duplicates(spark):
    """Pairs whose likeness is 0.8 to 0.9, single words replaced."""
    rnd = random.Random(20)
    rows, pairs = [], 0
    while pairs < 300:
        base = prose(rnd, rnd.randint(60, 200))
        other = edited(rnd, base, 0.02)
        if 0.8 <= brute_like(" ".join(base), " ".join(other)) <= 0.9:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(pairs))
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.95 * pairs


def linked_pairs(texts, least=0.8):
    return {(i, j) for j in range(len(texts)) for i in range(j) if sh.likeness(texts[i], texts[j]) >= least}


def near_texts(rnd, n, frame):
    """Texts around a common frame of words, each followed by one at a likeness about 0.8: words replaced, or a passage added or moved."""
    texts = []
    for i in range(n):
        base = [*frame[: rnd.randint(0, len(frame))], *prose(rnd, rnd.choice([3, 8, 30, 90]))]
        more = max(1, len(base) // 5 - rnd.randint(0, 6))
        texts += [base, (edited(rnd, base, 0.02), base + prose(rnd, more), base[more:] + base[:more])[i % 3]]
    return [" ".join(t) for t in texts]


def test_no_link_is_missed(spark):
    """Links that share no part, or meet only by way of a text that is like neither, are found as well."""
    rnd = random.Random(21)
    rows = list(enumerate(near_texts(rnd, 120, prose(rnd, 40))))
    rnd.shuffle(rows)
    got = sorted(tuple(r) for r in sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted(zip([i for i, _ in rows], brute_near(rows), strict=True))


def test_stars_lose_no_link(spark, monkeypatch):
    """All texts share all parts, so that each is compared with the smallest alone, which is like none."""
    whole = sh.wide_fingerprints
    monkeypatch.setattr(sh, "wide_fingerprints", lambda texts: (whole(texts)[0], whole([None] * len(texts))[1]))
    rnd = random.Random(22)
    base = [prose(rnd, 60) for _ in range(3)]
    rows = [(0, " ".join(prose(rnd, 60)))] + [(3 * i + j + 1, " ".join([*b, f"x{i}"])) for i in range(4) for j, b in enumerate(base)]
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_near(rows), strict=True)) and len(set(got.values())) == 4


def test_frequent_shingles(spark, monkeypatch):
    rnd = random.Random(23)
    texts = near_texts(rnd, 40, prose(rnd, 30)) + [None, "", "two words"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    monkeypatch.setattr(sh, "OFTEN", 3)
    codes, n = sh.frequent_shingles(df, 5, 3)
    rows = list(dict.fromkeys(tuple((t or "").encode().lower().split()) for t in texts))
    held = [sh._distinct(sh.Words([b" ".join(w)]), 5)[0] for w in rows]
    every = Counter(c for h in held for c in sh._codes(h, 3).tolist())
    assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == {c: k for c, k in every.items() if k > 3} and (codes[1:] > codes[:-1]).all()
    monkeypatch.setattr(sh, "SMALL", 20)
    some, most = sh.frequent_shingles(df, 5, 3)
    assert 0 < len(some) <= 20 < len(codes) and most.min() > max(k for c, k in every.items() if c not in some.tolist())
    monkeypatch.setattr(sh, "SMALL", 0)
    assert len(sh.frequent_shingles(df, 5, 3)[0]) == 0


def test_first_shingles_meet(monkeypatch):
    """Whatever is taken for frequent, each link is among what meets, unless its ends have one root."""
    rnd = random.Random(24)
    texts = near_texts(rnd, 60, prose(rnd, 40))
    links = linked_pairs(texts)
    assert len(links) > 40
    codes, n = np.unique(np.concatenate([sh._codes(sh._distinct(sh.Words([t.encode()]), 5)[0], 7) for t in texts]), return_counts=True)
    for often in ((codes[:0], n[:0]), (codes[n > 2], n[n > 2]), (codes[::3], n[::3])):
        digests, sizes, firsts = sh.first_shingles(texts, 5, 0.8, 7, often)
        assert digests == sh.wide_fingerprints(texts)[0]
        many = [len(f) for f in firsts]
        rep = np.repeat(np.arange(len(texts)), many)
        for held, root in ((sh.HELD, rep), (2, rep), (sh.HELD, rep // 2), (sh.HELD, 0 * rep)):
            monkeypatch.setattr(sh, "HELD", held)
            got = [tuple(p) for some in sh.meeting(np.concatenate(firsts), rep, root, np.repeat(sizes, many), np.concatenate([np.arange(m) for m in many]), 0.8) for p in some.tolist()]
            of = dict(zip(rep.tolist(), root.tolist(), strict=True))
            assert {(a, b) for a, b in links if of[a] != of[b]} <= set(got) and all(a < b and of[a] != of[b] for a, b in got)


def test_first_shingles_are_sought_once(spark, monkeypatch, tmp_path):
    """A task that evaluates the function twice keeps two Python workers."""
    whole, seen = sh.first_shingles, tmp_path / "seen"

    def noted(texts, *more):
        with seen.open("a") as f:
            f.write("x" * len(texts))
        return whole(texts, *more)

    monkeypatch.setattr(sh, "first_shingles", noted)
    rows = list(enumerate([*near_texts(random.Random(25), 20, ["a", "b", "c"]), None, ""]))
    assert sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).count() == len(rows)
    assert seen.stat().st_size == len(rows)


def test_lean_checkpoints_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}

    before, key = held(), spark.conf.get(common.CLEAN_KEY)
    kept = common.checkpointed_lean(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and sorted(r.id for r in kept.collect()) == list(range(1000))
    assert kept.sparkSession.conf.get(common.CLEAN_KEY) == key


def test_keep_first(spark):
    rows = [(1, "a b c d", "x"), (2, "A b c d", "y"), (1, "a b c d", "x"), (3, "other words stand here now", "z"), (None, "a b c d", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = sh.keep_first(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n) for r in out.collect()) == [(False, 1, "x"), (False, 3, "z"), (True, 0, "n")]
    assert sh.keep_first(df.limit(0)).count() == 0


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    got = common.numbered(df, ["g"], [F.col("id")], "n", F.xxhash64("id"), 4).collect()
    for g in range(3):
        assert sorted(r.n for r in got if r.g == g) == list(range(sum(i % 3 == g for i in range(500))))


def batch_sizes(df):
    @F.pandas_udf("long")
    def size(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    return [r.n for r in df.select(size(df.columns[0]).alias("n")).distinct().collect()]


def test_small_batches_leave_the_session_alone(spark):
    before, df = spark.conf.get(common.BATCH_KEY), spark.range(3000).coalesce(1)
    assert max(batch_sizes(common.in_small_batches(df))) == common.BATCH_ROWS
    assert spark.conf.get(common.BATCH_KEY) == before and max(batch_sizes(df)) == 3000
    kept = common.checkpointed_in_small_batches(df)
    assert kept.join(spark.range(5), "id").count() == 5 and max(batch_sizes(kept)) == 3000


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    df = spark.range(120).coalesce(1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit("x")), 1_000_000).alias("t"))
    assert max(batch_sizes(df)) < 60  # some 3 MB each, 64 MB a batch


def test_release_and_unused_names(spark):
    df = common.checkpointed(spark.range(10))
    file = Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert file.exists() and df.count() == 10
    common.release(df)
    assert not file.exists()
    common.release(spark.range(3))  # nothing to delete
    named = spark.createDataFrame([(1, 2, 3)], "made int, MADE_ int, x int")
    assert common.unused(named, "made") == "made__"
    assert common.with_struct(named, F.struct(F.lit(7).alias("x")), ["x"]).collect()[0] == (1, 2, 7)
