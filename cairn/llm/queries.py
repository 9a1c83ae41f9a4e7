"""The queries opN_ of this folder, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn import voronoi_knn

    return voronoi_knn(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages, audited against a replica in which some records were changed and some lost.

    A replica's record lies where the archive has it: repeated pages are one record, pages that share an id are several,
    a null id is an id like any other.
    """
    from .common import checkpointed
    from .warc_fixity import audit, record_text, records

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = checkpointed(records(pages))
    html = F.when(F.col("page_id") % 61 == 7, F.reverse("html")).otherwise(F.col("html"))
    kept = pages.where(F.coalesce(F.col("page_id") % 97 != 11, F.lit(True)))
    own, copy = (record_text(F.col("page_id"), F.col("url"), x) for x in (F.col("html"), html))
    copies = kept.select(F.col("page_id").cast("long").alias("p"), F.sha2(own, 256).alias("d"), F.sha2(copy, 256).alias("digest"), F.octet_length(copy).cast("long").alias("length")).distinct()
    places = archive.select("page_id", F.col("digest").alias("was"), "file", "offset")
    replica = checkpointed(copies.join(places, F.col("p").eqNullSafe(F.col("page_id")) & (F.col("d") == F.col("was"))).select("file", "offset", "length", "digest"))
    found = audit(archive, replica)
    return archive.join(found, ["file", "offset"], "left").select("page_id", F.col("length").alias("n_bytes"), F.col("digest").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join("item_ids", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    out = balanced_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fold, score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_voronoi_knn, op3_simhash_dedup, op4_language_id, op5_warc_fixity, op6_decontaminate, op7_bpe, op8_sharding, op9_html_extract, op10_toxicity)}

#: Words of documents with their positions, as op1 counts them.
_OP1 = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM windows JOIN firsts USING (k), range(13) AS r(o) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_OP6 = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
tests AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM tests WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
found AS (SELECT doc_id, i, spots.n AS n, item_id FROM spots JOIN wins ON spots.k = wins.k AND spots.n = wins.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_OP5 = """
WITH r AS (SELECT DISTINCT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t, coalesce(html, '') AS h FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS n_bytes, sha256(t) AS sha256, CASE WHEN page_id % 97 = 11 THEN 'missing' WHEN page_id % 61 = 7 AND reverse(h) <> h THEN 'corrupt' ELSE 'intact' END AS status FROM r
"""

SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op2_voronoi_knn": _OP2, "op5_warc_fixity": _OP5, "op6_decontaminate": _OP6}
