import random
import re

from cairn.llm import decontaminate as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window):
    tests = set()
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - window + 1)) if w else ():
            tests.add((i, tuple(w[j : j + window])))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, x in tests:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, window):
    a = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, pos int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in de.contamination(a, b, window=window).collect()), key=repr)


def test_random(spark, monkeypatch):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice(["The ", "the", " ", "É", "é ", "b2 ", "c-", "_", "\n", "a "]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(50)]
    docs += [(3, docs[3][1]), (None, docs[4][1]), (60, None), (61, ""), (62, "--"), (63, "a " * 200)]
    items = [(i, text(rnd.randint(0, 14))) for i in range(8)] + [(8, None), (9, "a a a a a"), (10, "--"), (11, "A"), (12, "zzz never seen here")]
    for window in (3, 5):
        assert run(spark, docs, items, window) == brute(docs, items, window)
    monkeypatch.setattr(de, "SMALL", 2)  # no table is broadcast, lists are spread, the corpus is read several times
    assert run(spark, docs, items, 4) == brute(docs, items, 4)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")], 10) == []
    assert run(spark, [(1, "a b")], [], 10) == [(1, 2, 0, [])]


def test_clean_documents(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "x " + item), (2, "x w1 w2 w3"), (None, item), (None, "fine"), (3, None), (4, " ".join(f"w{i}" for i in range(9)))]
    a = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = de.clean_documents(a, b)
    assert out.columns == a.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(2, "x w1 w2 w3"), (0, "fine"), (3, ""), (4, docs[5][1])])


def brute_near(docs, items, window, slop):
    wins = {tuple(words(t)[j : j + window]) for _, t in items for j in range(max(1, len(words(t)) - window + 1)) if words(t)}
    out = set()
    for d, t in docs:
        w = words(t)
        for x in wins:
            for at in range(-len(x) - slop, len(w) + 1):
                shifts = [min((s for s in range(slop + 1) if 0 <= at + o + s < len(w) and w[at + o + s] == term), default=None) for o, term in enumerate(x)]
                if None not in shifts and min(shifts) == 0:
                    out.add((" ".join(x), d, at, max(shifts)))
    return out


def test_proximity_against_brute_force(spark):
    rnd = random.Random(9)
    text = lambda n, k: " ".join(rnd.choice("abcdefgh"[:k]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 40), 8)) for i in range(40)] + [(41, None), (42, ""), (None, "a b c d e"), (43, "c b a e d"), (0, "a b"), (44, "a x b c")]
    items = [(1, "a b c d e"), (2, text(6, 8)), (3, "a b"), (4, None), (5, ""), (6, "zz a")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window, slop in ((5, 3), (3, 0), (4, 6)):
        got = [(r.win, r.doc_id, r["at"], r.spread) for r in de.proximity_matches(a, b, window=window, slop=slop).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_near(docs, items, window, slop)
    assert de.proximity_matches(a.limit(0), b).count() == de.proximity_matches(a, b.limit(0)).count() == 0


def test_phrases_are_places(spark):
    docs = [(1, "x a b c a b c"), (1, "x a b c a b c"), (1, "a b"), (None, "c a b c")]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c"), (2, "A b C"), (None, "b c a")], "item_id long, text string")
    got = sorted((r.win, r.doc_id or 0, r["at"], r.n) for r in de.phrase_matches(a, b).collect())
    assert got == [("a b c", 0, 1, 3), ("a b c", 1, 1, 3), ("a b c", 1, 4, 3), ("b c a", 1, 2, 3)]


def test_clashing_names(spark):
    a = spark.createDataFrame([(1, "a b c", 1, 2, 3)], "doc_id long, text string, d int, h int, __d int")
    b = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert de.clean_documents(a, b).collect() == a.collect()


def test_no_python_in_the_plan(spark):
    a = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = de.contamination(a, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
