"""The folder's queries against DuckDB or brute force, and the pipeline against both."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, queries, toxicity

from ..test_entry import TABLES, same
from .test_decontaminate import brute as brute_items
from .test_near_dedup import brute_components, brute_fp, brute_near
from .test_substring_dedup import brute as brute_windows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck.execute(queries.SQL[name]))


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_simhash(spark, documents):
    points = [(i, brute_fp(t)) for i, t in documents.items()]
    expected = sorted((i, f"{f:016x}", c) for (i, f), c in zip(points, brute_components(points), strict=True))
    assert sorted(tuple(r) for r in queries.op3_simhash_dedup(spark, DATA).collect()) == expected


def encoded(text):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    return lambda t: library.encode_ordinary(t)


def digests(encode, text):
    ids = encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe(spark, documents):
    encode = encoded("")
    assert sorted(tuple(r) for r in queries.op7_bpe(spark, DATA).collect()) == sorted((i, *digests(encode, t or "")) for i, t in documents.items())


def test_sharding(spark, documents):
    out = queries.op8_sharding(spark, DATA).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in documents.items())
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    sizes = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1 and all(s == list(range(len(s))) for s in sizes)


def test_pipeline_against_brute_force(spark, documents):
    """Each stage over what brute force leaves of the one before; the toxicity model is the operator's, its decisions are taken one by one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    left = {i: t for i, t in documents.items() if model.score(toxicity.word_hashes(t)) < 0.5}
    left = {i: left[i] for i, c in zip(list(left), brute_near(list(left.items())), strict=True) if c == i}
    left = {i: t for i, t, _, _ in brute_windows(list(left.items()), 13)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {i: left[i] for i, _, hit, _ in brute_items(list(left.items()), items, 10) if not hit}
    encode = encoded("")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted((i, *digests(encode, t)) for i, t in left.items())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_stages_on_nulls_repeats_and_clashing_names(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long + " more", None, None, None), (None, long, "en", "s", 1), (None, None, None, None, None), (3, None, "fr", "s", 0), (4, "", "fr", None, 0), (5, "short", "de", "s", 5), (6, "quite other words stand here", "en", "s", 1), (6, "and these are others again, under one id", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = "score, first, d, h, made, home, rest, copy, label, fold, __score, __kept, __d, __h, __bpe, th, w".split(", ")
    docs = spark.createDataFrame(rows, schema)
    for c in more:
        docs = docs.withColumn(c, F.lit(c))
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")

    def kept(i):
        out = corpus_pipeline.STAGES[i][1](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [tuple(r[c] for c in more) for r in out.collect()] == [tuple(more)] * out.count()
        return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.n_chars if r.n_chars is not None else -1) for r in out.collect())

    every = sorted((-1 if i is None else i, t or "", -1 if n is None else n) for i, t, _, _, n in rows)
    assert kept(0) == every  # nothing was learned, so nothing is toxic
    assert kept(1) == sorted([(1, long, 5), (-1, long, 1), (-1, "", -1), (3, "", 0), (5, "short", 5), (6, "and these are others again, under one id", 1)]) or kept(1) == sorted([(1, long, 5), (-1, long, 1), (-1, "", -1), (3, "", 0), (5, "short", 5), (6, "quite other words stand here", 1)])
    cut = kept(2)
    assert (2, "more", 4) in cut and cut.count((1, long, len(long))) == 2 and (-1, long, len(long)) in cut and (3, "", 0) in cut and len(cut) == len(rows)
    assert kept(3) == every
    spark.createDataFrame([(1, long)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert kept(3) == [r for r in every if not r[1].startswith("w0 ")]
    out = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.n_tokens > 0 for r in out) == sorted(bool(t) for _, t, *_ in rows)
