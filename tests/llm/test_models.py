"""Language ID and toxicity, on made-up and on given tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cairn.llm import language_id, queries, toxicity

DATA = "/root/testdata/sf0.01"
COMMON = {"xx": "the of and to in is that for".split(), "yy": "der die und ist nicht ein zu von".split(), "zz": "le la et que les des est pour".split()}


def made(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(COMMON[lang]) for _ in range(rnd.randint(8, 40))), lang) for i, lang in ((i, "xx yy zz".split()[i % 3]) for i in range(n))]


def test_language_predictions(spark):
    rows = made(90, 1) + [(1000, "the of and in", None), (None, "der die und", "yy"), (1001, None, "xx"), (1002, "123 !?", "xx"), (1003, "", None)]
    df = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    profiles = language_id.train(df.where(~language_id.held_out()))
    out = language_id.identify(df, profiles)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in out.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (r.lang or "xx") and 0 < r.score <= 1
    assert {language_id.train(df.limit(0)).predict("the")[0]} == {"und"}


def test_profiles_match_a_plain_count(spark):
    rows = made(30, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.train(df)
    for i, lang in enumerate(profiles.langs):
        counts = {}
        for _, t, own in rows:
            if own == lang:
                for w in t.lower().split():
                    for n, padded in ((1, w), (2, f" {w} "), (3, f" {w} ")):
                        for j in range(len(padded) - n + 1):
                            code = 0
                            for c in padded[j : j + n]:
                                code = code << 21 | (0 if c == " " else ord(c))
                            for _ in range(3 - n):
                                code = code << 21 | language_id.END
                            counts[code] = counts.get(code, 0) + 1
        best = sorted(counts, key=lambda g: (-counts[g], g))[: language_id.PROFILE]
        ranks = profiles.ranks[i]
        got = [int(profiles.grams[j]) for j in sorted((j for j in range(len(profiles.grams)) if ranks[j] >= 0), key=lambda j: ranks[j])]
        assert got == best  # a blank between two words is one character, and belongs to both


def plain_grams(text):
    """Counts of n-grams, word by word."""
    counts, words, word = {}, [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    for i, w in enumerate(words):
        for n, padded in ((1, w), (2, f" {w}" + (" " if i == len(words) - 1 else "")), (3, f" {w} ")):
            for j in range(len(padded) - n + 1):
                counts[padded[j : j + n]] = counts.get(padded[j : j + n], 0) + 1
        if i < len(words) - 1:
            counts[w[-1] + " "] = counts.get(w[-1] + " ", 0) + 1
    return counts


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (0 if c == " " else ord(c))
    for _ in range(3 - len(gram)):
        out = out << 21 | language_id.END
    return out


def ranked(counts):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language_id.PROFILE]


def test_distances_against_brute_force(spark):
    """Profiles, their order, out-of-place distances, the choice and its score, all recomputed."""
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    totals = {}
    for i, r in docs.items():
        if r.lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            own = totals.setdefault(r.lang, {})
            for g, n in plain_grams(r.text or "").items():
                own[g] = own.get(g, 0) + n
    profiles = {lang: {g: k for k, g in enumerate(ranked(counts))} for lang, counts in totals.items()}
    for r in queries.op4_language_id(spark, "/root/testdata/sf0.001").collect():
        own = ranked(plain_grams(docs[r.doc_id].text or ""))
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(min(language_id.PROFILE, abs(p[g] - k)) if g in p else language_id.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 - far[best] / (language_id.PROFILE * len(own)))


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(t for _, t, _ in made(40, 3)) + " " + "x" * 500 + "\nΟΔΟΣ' ΣΑΣ.Σ  1 ab2cd\t\u0130" * 9
    whole = language_id.counted(text)
    for step in (1, 7, 100):
        monkeypatch.setattr(language_id, "STEP", step)
        parts = language_id.counted(text)
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_held_out_accuracy(spark):
    out = queries.op4_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in out if r.held_out and r.lang]
    assert len(out) == 1000 and len(test) > 200
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)


def test_toxicity_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = queries.op10_toxicity(spark, DATA).collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    test = [r for r in out if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.9


def test_toxicity_edges(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(12)) + (" vile awful" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "vile"), (900, None), (901, ""), (902, "vile awful " * 5000), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (900, 1), (901, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {(r.doc_id, r.text): r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert out[902, "vile awful " * 5000] > 0.5 > out[901, ""] == out[900, None]
    assert all((out[i, t] >= 0.5) == (i % 4 == 0) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0)
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.score, 9) for r in toxicity.score_toxicity(docs, none).collect()} == {round(none.score(toxicity.word_hashes("")), 9)}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def brute_ratios(rows, folds):
    """log P(word | toxic) - log P(word | ordinary), from sets of pairs of words; the last is that of an unknown word."""
    pairs = {0: set(), 1: set()}
    for i, text, label in rows:
        if zlib.crc32(str(i).encode()) % 5 in folds:
            words = toxicity.WORD.findall(text.lower())
            pairs[label] |= set(zip([None, *words[:-1]], words, strict=False))
    count = [Counter(w for _, w in pairs[c]) for c in (0, 1)]
    either = Counter(w for _, w in pairs[0] | pairs[1])

    def p(c, w):
        n, freed = sum(count[c].values()), sum(min(2, k) for k in count[c].values())
        return (max(count[c][w] - 2, 0) + freed * (either[w] + 1) / (sum(either.values()) + len(either) + 1)) / n

    return {w: math.log(p(1, w) / p(0, w)) for w in [*either, "never"]}, p, either


def test_probabilities_against_brute_force(spark):
    rnd = random.Random(31)
    rows = [(i, " ".join(rnd.choice("ABCDEF")[: rnd.randint(0, 1)] + rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 12))), i % 2) for i in range(120)]
    rows += [(i, rows[3][1], 1) for i in range(500, 560)]  # copies
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for view, folds in ((0, (1, 2, 3, 4)), (2, (1, 3, 4))):
        expected, p, either = brute_ratios(rows, folds)
        assert sum(p(0, w) for w in either) + p(0, "never") == pytest.approx(1)  # with one place for what is unknown
        if view == 0:
            for w, r in expected.items():
                assert model.ratios(toxicity.word_hashes(w))[0] == pytest.approx(r, abs=1e-5), w
    long = " ".join(t for _, t, _ in rows[:9])
    r = [expected_0[w] for expected_0 in [brute_ratios(rows, (1, 2, 3, 4))[0]] for w in toxicity.WORD.findall(long.lower())]
    got = toxicity.spans(model.ratios(toxicity.word_hashes(long)), 5)
    assert got == pytest.approx([sum(r[i : i + 5]) / 5 for i in range(len(r) - 4)], abs=1e-5)
    assert toxicity.spans(model.ratios(toxicity.word_hashes("never ever")), 5) == pytest.approx([2 * expected["never"] / 5], rel=0.5)


def test_scores_against_brute_force(spark):
    """Tails of out-of-fold spans, surprises, the curve's optimum and the scores, all recomputed from the brute ratios."""
    texts, marks = labelled(240, 33, size=12)
    label = dict(marks)
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in texts}
    rows = [(i, t, label[i]) for i, t in texts]
    model = toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    views = {f: brute_ratios(rows, [g for g in (1, 2, 3, 4) if g != f])[0] for f in (0, 1, 2, 3, 4)}

    def ratios(text, f):
        return [views[f].get(w, views[f]["never"]) for w in toxicity.WORD.findall(text.lower())]

    def means(r, k):
        return [sum(r[j : j + k]) / k for j in range(len(r) - k + 1)] if len(r) >= k else [sum(r) / k] if r else []

    training = [(i, t, ratios(t, fold[i])) for i, t in texts if fold[i]]
    for n, k in enumerate(toxicity.SPANS):
        ordinary = [x for i, _, r in training if not label[i] for x in means(r, k)]
        tail = [math.log((sum(x >= v - 1e-6 for x in ordinary) + 0.5) / (len(ordinary) + 1)) for v in toxicity.LEVELS]
        assert model.tails[n] == pytest.approx(tail, abs=0.02)

    def features(r):
        out = []
        for n, k in enumerate(toxicity.SPANS):
            s = means(r, k)
            x = len(s) * math.exp(np.interp(max(s), toxicity.LEVELS, model.tails[n])) if s else 99
            out.append(-math.log(-math.expm1(-x)) if x < 30 else 0.0)
        return [*out, sum(r) / len(r) if r else 0.0]

    x, y = np.array([[1.0, *features(r)] for _, _, r in training]), np.array([label[i] for i, _, _ in training])
    p = 1 / (1 + np.exp(-x @ model.curve))
    slope = x.T @ (y - p) - np.array([1e-6, *[1e-2] * 3]) * model.curve
    used = model.curve != 0
    assert np.abs(slope[used]).max() < 0.05 and (model.curve[1:] >= 0).all()
    for i, t in texts[:60]:
        z = float(model.curve @ [1.0, *features(ratios(t, 0))])
        assert model.score(toxicity.word_hashes(t)) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_counts_by_view_against_brute_force(spark):
    rnd = random.Random(32)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 9))), rnd.randint(1, 4), i % 2) for i in range(60)]
    pairs = toxicity.Pairs()
    for _, t, f, c in rows:
        pairs.add(toxicity.word_hashes(t), c, f)
    word, _, bits = pairs.distinct()
    words, counts = toxicity.counts_of(word, bits)
    known = {int(toxicity.word_hashes(w)[0]): w for w in "abcde"}
    for v in toxicity.VIEWS:
        for j, classes in enumerate(((0,), (1,), (0, 1))):
            seen = {(a, b) for _, t, f, c in rows if f != v and c in classes for a, b in zip([None, *t.split()[:-1]], t.split(), strict=False)}
            for h, n in zip(words.tolist(), counts[3 * v + j], strict=True):
                assert n == sum(b == known[h] for _, b in seen)


def labelled(n, seed, size=40):
    """Texts of which every fourth is toxic and holds a word that no ordinary one holds."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    texts = [[words[int(3000 * rnd.random() ** 3)] for _ in range(size)] + (["vile"] if i % 4 == 0 else []) for i in range(n)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)], [(i, int(i % 4 == 0)) for i in range(n)]


def test_long_ordinary_texts_stay_ordinary(spark):
    rows, labels = labelled(1500, 11)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    clean = [t for i, t in held if i % 4 and model.score(toxicity.word_hashes(t)) < 0.5]
    rnd = random.Random(12)
    joined = [" ".join(rnd.sample(clean, 100)) for _ in range(30)]
    assert len(clean) > 190 and sum(model.score(toxicity.word_hashes(t)) >= 0.5 for t in joined) <= 1
    assert all(model.score(toxicity.word_hashes(t)) >= 0.5 for i, t in held if i % 4 == 0)


def test_repeated_passages_count_once(spark):
    """A word that stands in one passage of many toxic texts says nothing; one that stands among many words does."""
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [(i, " ".join([*(rnd.choice(words) for _ in range(20)), *(["shared passage here"] * (i % 4 == 0)), rnd.choice(words), *(["vile", rnd.choice(words)] * (i % 4 == 0))])) for i in range(400)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    vile, passage = (model.ratios(toxicity.word_hashes(w))[0] for w in ("vile", "passage"))
    assert vile > model.rare + 1 and passage == pytest.approx(model.rare, abs=1e-5)


def test_all_training_folds_are_counted(spark):
    rows, labels = labelled(300, 13)
    for f in (1, 2, 3, 4):
        only = [i for i, _ in rows if i % 4 == 0 and zlib.crc32(str(i).encode()) % 5 == f]
        marked = [(i, t.replace(" ", f" foul x{i % 26 * 'y'}z ") if i in only else t) for i, t in rows]
        model = toxicity.train(spark.createDataFrame(marked, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert model.ratios(toxicity.word_hashes("foul"))[0] > model.rare
