import random
import re

import numpy as np

from cairn.llm import substring_dedup as sd

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """(id, text, words, removed) of each row, by dictionaries of windows."""
    first = {}
    words = [WORD.findall(t.encode()) if t is not None else [] for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for j in range(len(w) - k + 1):
                s = b" ".join(w[j : j + k])
                first[s] = min(first.get(s, i), i)
    out = []
    for (i, t), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[b" ".join(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out.append((i, kept if t is not None else None, len(w), sum(gone)))
    return sorted(out, key=repr)


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in sd.substring_dedup(df, **k).collect()), key=repr)


def test_random_texts(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        rows.append((i, "".join(rnd.choice(["a", "b", "é", " ", "\n", "  ", " "]) for _ in range(rnd.randint(0, 60)))))
    rows += [(7, rows[7][1]), (90, rows[3][1]), (None, rows[4][1]), (91, None), (92, ""), (93, " \t "), (None, None)]
    for k, m in ((3, 2), (4, 1)):
        assert run(spark, rows, window=k, minimiser=m) == brute(rows, k)


def test_passages_and_copies(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(30_000))
    rows = [(i, " ".join(word() for _ in range(20)) + "\n" + passage + " " + " ".join(word() for _ in range(20))) for i in range(40)]
    rows += [(100 + i, "x y " * 200) for i in range(30)] + [(200, long), (201, long + " end"), (202, "w" * 5000 + " " + passage)]
    assert run(spark, rows) == brute(rows, 13)


def test_hot_minimisers_are_spread(spark, monkeypatch):
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    rows = [(i, " ".join([*(word(5) for _ in range(9)), "the of and to in", *(word(5) for _ in range(9))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " " + word(3)) for i in range(0, 300, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(sd.hot_minimisers(df, 13, 5)) == 0
    monkeypatch.setattr(sd, "HOT", 100)
    monkeypatch.setattr(sd, "SEEN", 2)
    hot = sd.hot_minimisers(df, 13, 5)
    assert 0 < len(hot) < 20
    plain, spread = (sd._Block([t.encode() for _, t in rows], 13, 5, x) for x in (hot[:0], hot))
    assert max(np.unique(spread.key, return_counts=True)[1]) < max(np.unique(plain.key, return_counts=True)[1]) / 2
    assert run(spark, rows) == brute(rows, 13)


def test_hash_collisions_are_told_apart(monkeypatch):
    strings = [b"a b c d", b"b c d e", b"x y z", b"a b c"]
    expected, n = sd.window_minima(strings, np.array([5, 3, 9, 7]), 3)
    assert (expected.tolist(), n.tolist()) == ([5, 3, 3, 3, 9, 5], [2, 2, 1, 1])
    monkeypatch.setattr(sd, "_word_hashes", lambda text, begin, length: np.zeros(len(begin), np.uint64))
    assert sd.window_minima(strings, np.array([5, 3, 9, 7]), 3)[0].tolist() == expected.tolist()


def test_empty_table_and_clashing_columns(spark):
    schema = "home int, doc_id int, n_words string, rest string, bucket string, text string"
    assert sd.substring_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, 1, "x", "r", None, text), (2, 2, "y", "s", "b", text)], schema)
    out = sd.substring_dedup(df)
    assert out.columns == ["home", "doc_id", "rest", "bucket", "text", "n_words", "n_removed"]
    assert [tuple(r) for r in out.orderBy("home").collect()] == [(1, 1, "r", None, text, 20, 0), (2, 2, "s", "b", "", 20, 20)]


def test_control_bytes_belong_to_words(spark, monkeypatch):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("ab\x00\x01\x0e\x1b\x1c\x1fc") for _ in range(rnd.randint(1, 5)))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(15)) + "\t" + passage + " " + " ".join(word() for _ in range(15))) for i in range(20)]
    for k, m in ((13, 5), (3, 2)):
        assert run(spark, rows, window=k, minimiser=m) == brute(rows, k)
    strings = [b"a\x01 b c\x1cd", b"a \x01b c\x1cd", b"b c\x1cd e"]
    expected, n = sd.window_minima(strings, np.array([5, 3, 2]), 3)
    assert (expected.tolist(), n.tolist()) == ([5, 3, 2], [1, 1, 1])
    monkeypatch.setattr(sd, "_word_hashes", lambda text, begin, length: np.zeros(len(begin), np.uint64))
    assert [x.tolist() for x in sd.window_minima(strings, np.array([5, 3, 2]), 3)] == [[5, 3, 2], [1, 1, 1]]
