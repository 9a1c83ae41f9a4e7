"""From raw documents to token counts: five operators of cairn.llm, one after the other.

Each stage works on all rows that its predecessor kept and returns the columns of documents; the last returns a row of
token counts and digests for each document. Columns beyond doc_id, lang, text and n_chars pass all stages but the last,
whatever their names. An empty table passes as one.

Null and empty texts pass as they are, but near-dedup takes them for copies of each other; rows without a doc_id are scored and
decontaminated, and otherwise left alone, as nothing tells them apart. Rows that repeat a doc_id stand for one document where they hold
the same words, of which near-dedup keeps one.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe import bpe_digest
from cairn.llm.common import checkpoint_folder, in_small_batches, unused
from cairn.llm.decontaminate import clean_documents
from cairn.llm.simhash_dedup import keep_first
from cairn.llm.substring_dedup import substring_dedup
from cairn.llm.toxicity import score_toxicity, train


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. A null text scores as an empty one."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return in_small_batches(score_toxicity(docs, model, out=score).where(F.col(score) < 0.5).drop(score))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of five-word shingles in common), that of the smallest doc_id."""
    return keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that stand in an earlier one; n_chars follows the text (a null one's stays). A document may become empty."""
    cut = substring_dedup(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return cut.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_tokens and the digests of ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return in_small_batches(bpe_digest(docs.select("doc_id", "lang", "text"), path, public_tokenizers.PATTERN, remembered=(60_000, 50_000, 80_000)).drop("text"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("byte_level_bpe", tokens),
]

#: Hashes of 64 bits and BPE merges are beyond DuckDB's SQL: tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the checkpoint folder and read again by the next.

    A stage's folder goes when the next one's is written; that which the result is read from stays, as the result is lazy.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            _remove(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
