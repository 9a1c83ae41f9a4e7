import random

import public_tokenizers
import pytest
import tiktoken

from cairn.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("alphabet", ["ab", "ab '", "a 's\n\t!1é", "the ing on'll re   \n漢字😀", "aaaaaaab", " \n", "'lre v"])
def test_halves_join_to_the_whole(ranks, library, monkeypatch, alphabet):
    rnd = random.Random(len(alphabet))
    t = bpe.Tokenizer(ranks, PATTERN)
    for _ in range(250):
        monkeypatch.setattr(bpe, "LEAF", rnd.choice([4, 8, 16, 64]))
        for memo in (t.known, t.parts, t.pairs):
            memo.most = rnd.choice([0, 3, 1000])
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 3, 10, 50, 300])))
        ids = t.encode(s)
        assert ids == library.encode_ordinary(s)
        assert t.decode(ids) == s.encode()


def test_long_matches(ranks, library):
    t = bpe.Tokenizer(ranks, PATTERN)
    rnd = random.Random(1)
    for s in ("a" * 20_001, "".join(rnd.choice("abcdeinoprst") for _ in range(30_000)), " " * 9_000 + "x", "é!" * 5_000, "<|endoftext|>"):
        assert t.encode(s) == library.encode_ordinary(s)


def test_merges_of_windows(ranks):
    """Against merging by looking through all pairs for the lowest rank, again and again."""
    t = bpe.Tokenizer(ranks, PATTERN)
    rnd = random.Random(2)
    for _ in range(100):
        raw = bytes(rnd.choice(b"abne ,\xc3\xa9") for _ in range(rnd.randint(1, 90)))
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert t.merged(raw) == t.queued(raw) == t.tree(raw) == tuple(ranks[p] for p in parts)


def test_the_tree_needs_no_library(ranks, library):
    """Every match of the texts by the tree alone, its memory empty before each."""
    t = bpe.Tokenizer(ranks, PATTERN)
    for s in ("The quick brown fox, it's said, jumped over 12345 lazy dogs.", "Engeberö geverü auf schö — naïve 漢字 😀"):
        for m in t.pattern.findall(s):
            t.forget()
            assert list(t.tree(m.encode())) == library.encode_ordinary(m)
    with open(bpe.__file__) as f:
        assert "tiktoken" not in f.read()


def test_frames(spark, library):
    rows = [(1, "Hello, world's   end\n", 5), (1, "Hello, world's   end\n", 5), (2, None, 1), (3, "", 1), (None, "naïve 漢字 " * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t, _ in rows)
    assert all(r.token_ids == library.encode_ordinary(r.text or "") for r in out)
    digest = bpe.bpe_digest(df, PATH, PATTERN)
    assert digest.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert all(r.n_tokens == len(library.encode_ordinary(r.text or "")) for r in digest.collect())
    assert bpe.bpe_digest(df.limit(0), PATH, PATTERN).count() == 0
    clash = df.withColumnRenamed("doc_id", "made").withColumnRenamed("n_tokens", "__bpe")
    assert bpe.bpe_digest(clash, PATH, PATTERN).columns == ["made", "text", "__bpe", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r["__bpe"] for r in bpe.bpe_digest(clash, PATH, PATTERN).collect()) == [1, 1, 1, 5, 5]


def test_unknown_id_is_an_error(ranks):
    with pytest.raises(KeyError):
        bpe.Tokenizer(ranks, PATTERN).decode([len(ranks) + 5])
