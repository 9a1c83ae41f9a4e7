"""Merkle fixity audit of WARC replicas.

Records lie in files at byte offsets. A file's offsets are cut into ranges of SPAN bytes; the ranges of all files, in
order, are the leaves of a tree of fan-out FAN. A leaf's digest covers offset, length and digest of its records; a
node's digest covers the numbers and digests of its children. An audit compares the roots of two replicas and then, level
by level, only the children of nodes that differ, down to ranges and the records in them. Payloads are hashed where they
lie and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Bytes of a range, children of a node, records of a file (about).
SPAN, FAN, FILE_RECORDS = 1 << 16, 16, 512
END = "\r\n"


def record_text(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC resource record as text: header, payload, two line ends. Null parts count as empty."""
    empty = F.lit("")
    body = F.coalesce(payload.cast("string"), empty)
    head = [F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), empty), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri.cast("string"), empty)]
    return F.concat(*head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, file, offset, length, digest) of the records of an archive of pages. Repeated rows are one record.

    Files hold about FILE_RECORDS records each, by a hash of id, uri and digest, in the order of id and digest.
    """
    text = record_text(F.col(f"`{id_col}`"), F.col(f"`{uri_col}`"), F.col(f"`{payload_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("length"))
    rows = checkpointed(rows.distinct())
    files = max(1, rows.count() // FILE_RECORDS)
    placed = rows.withColumn("file", F.pmod(F.xxhash64("page_id", "digest"), F.lit(files)))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("page_id", "file", "offset", "length", "digest")


def _ranges(recs: DataFrame, width: int) -> DataFrame:
    """(node, digest) of the tree's leaves. A range holds at most SPAN divided by a header's length records."""
    node = (F.col("file") * width + F.floor(F.col("offset") / SPAN)).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))
    line = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x.offset.cast("string"), x.length.cast("string"), x.digest)), "\n")
    return recs.withColumn("node", node).groupBy("node").agg(F.sha2(line, 256).alias("digest"))


def _parents(nodes: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("node", "digest")))
    line = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x.node.cast("string"), x.digest)), "\n")
    return nodes.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(F.sha2(line, 256).alias("digest")).withColumnRenamed("up", "node")


def merkle_tree(recs: DataFrame, width: int, height: int) -> list[DataFrame]:
    """Levels (node, digest) from the leaves to the root. width: ranges of a file; FAN ** height covers all files."""
    levels = [checkpointed(_ranges(recs, width))]
    for _ in range(height):
        levels.append(_parents(levels[-1]))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    pairs = a.withColumnRenamed("digest", "da").join(b.withColumnRenamed("digest", "db"), "node", "full_outer")
    return pairs.where(~F.col("da").eqNullSafe(F.col("db"))).select("node")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, status) of the places where replica right differs from left: corrupt, missing or extra.

    Both are (file, offset, length, digest), with any further columns; (file, offset) is unique in each, since bytes
    hold one record. Two empty replicas, or equal ones, give no rows.
    """
    cols = ["file", "offset", "length", "digest"]
    left, right = left.select(*cols), right.select(*cols)
    far = left.unionAll(right).agg(F.max("file"), F.max("offset")).first()
    if far[0] is None:
        return left.sparkSession.createDataFrame([], "file long, offset long, status string")
    width, height = int(far[1]) // SPAN + 1, 0
    while FAN**height < width * (int(far[0]) + 1):
        height += 1
    a, b = merkle_tree(left, width, height), merkle_tree(right, width, height)
    wrong = checkpointed(_differing(a[-1], b[-1]))
    for x, y in zip(reversed(a[:-1]), reversed(b[:-1]), strict=True):
        if not wrong.limit(1).count():
            break
        up = wrong.withColumnRenamed("node", "up")
        below = F.floor(F.col("node") / FAN).cast("long") == F.col("up")
        wrong = checkpointed(_differing(x.join(up, below, "left_semi"), y.join(up, below, "left_semi")))
    node = (F.col("file") * width + F.floor(F.col("offset") / SPAN)).cast("long")
    at = wrong.withColumnRenamed("node", "at")
    p = left.join(at, node == F.col("at"), "left_semi").select("file", "offset", F.struct("length", "digest").alias("p"))
    q = right.join(at, node == F.col("at"), "left_semi").select("file", "offset", F.struct("length", "digest").alias("q"))
    status = F.when(F.col("q").isNull(), "missing").when(F.col("p").isNull(), "extra").otherwise("corrupt")
    return p.join(q, ["file", "offset"], "full_outer").where(~F.col("p").eqNullSafe(F.col("q"))).select("file", "offset", status.alias("status"))


def pack(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(file, content): the archive's files as binaries of about FILE_RECORDS records, at the offsets that records() gives."""
    text = record_text(F.col(f"`{id_col}`"), F.col(f"`{uri_col}`"), F.col(f"`{payload_col}`"))
    texts = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.sha2(text, 256).alias("digest"), text.alias("record")).dropDuplicates(["page_id", "digest"])
    places = records(pages, id_col, uri_col, payload_col).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "file", "offset")
    placed = texts.join(places, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")))

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("offset").to_pylist(), table.column("record").to_pylist(), strict=True))
        return pa.table({"file": pa.array([table.column("file")[0].as_py()], pa.int64()), "content": pa.array([b"".join(r.encode() for _, r in rows)], pa.binary())})

    return placed.select("file", "offset", "record").groupBy("file").applyInArrow(join, "file long, content binary")


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of a file; an error names the offset where one breaks off."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at offset {at}")
        lines = content[at:end].decode("utf-8", "replace").split(END)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", "0"))
        body = content[end + 4 : end + 4 + size]
        if len(body) < size:
            raise ValueError(f"the record at offset {at} breaks off")
        stop = end + 4 + size + 4
        yield at, stop - at, headers, body
        at = stop


def unpack(files: DataFrame) -> DataFrame:
    """(file, offset, length, digest, uri, payload) of the records in files (file, content)."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "length", "digest", "uri", "payload"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(file, at, n, sha256(content[at : at + n]).hexdigest(), h.get("warc-target-uri", ""), body.decode("utf-8", "replace")) for at, n, h, body in parse(content or b"")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    return files.mapInArrow(run, "file long, offset long, length long, digest string, uri string, payload string")
