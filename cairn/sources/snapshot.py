"""Binary snapshots of a compressed trie: reading for exchange with other tools, and writing of small ones.

Little-endian. A header of 20 bytes: magic, version, flags, largest node id, number of nodes, id of the root (0). Then the
nodes: id, flags (1: has an object, 2: has totals), length of the edge and edge, number of children and their ids, then
class and size of the object, then the totals: objects, number of classes, class and bytes of each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, VERSION, HAS_OBJECT, HAS_TOTALS = 0x54584452, 1, 1, 2
HEADER, NODE, VALUE, TOTALS = struct.Struct("<IHHIII"), struct.Struct("<IBHH"), struct.Struct("<Bq"), struct.Struct("<qB")


class SnapshotError(ValueError):
    """A file that is no snapshot, of another version, or damaged."""


def decode(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(key, size, class) of a snapshot in key order."""
    if len(data) < HEADER.size:
        raise SnapshotError("the header breaks off")
    magic, version, flags, largest, count, root = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise SnapshotError("magic mismatch")
    if version != VERSION:
        raise SnapshotError(f"version {version} is not known")
    if flags or root or count > largest + 1 or count * NODE.size > len(data):
        raise SnapshotError("the header is damaged")
    nodes: dict[int, tuple[bytes, tuple[int, ...], tuple[int, int] | None]] = {}
    at = HEADER.size
    try:
        for _ in range(count):
            number, kind, n_edge, n_children = NODE.unpack_from(data, at)
            at += NODE.size
            if number > largest or number in nodes:
                raise SnapshotError(f"node {number} is out of range or comes twice")
            edge = data[at : at + n_edge]
            at += n_edge
            children = struct.unpack_from(f"<{n_children}I", data, at)
            at += 4 * n_children
            held = None
            if kind & HAS_OBJECT:
                code, size = VALUE.unpack_from(data, at)
                held = (size, code)
                at += VALUE.size
            if kind & HAS_TOTALS:
                at += TOTALS.size + VALUE.size * TOTALS.unpack_from(data, at)[1]
            nodes[number] = (edge, children, held)
    except struct.error as e:
        raise SnapshotError("a node breaks off") from e
    if at != len(data):
        raise SnapshotError("bytes follow the last node")
    stack, seen = [(0, b"")] if count else [], 0
    while stack:
        number, path = stack.pop()
        if number not in nodes:
            raise SnapshotError(f"node {number} is missing")
        edge, children, held = nodes[number]
        seen += 1
        if seen > count:
            raise SnapshotError("nodes form a circle")
        path += edge
        if held:
            yield path.decode("utf-8", "replace"), *held
        stack += [(c, path) for c in reversed(children)]
    if seen != count:
        raise SnapshotError("nodes are not reachable")


def encode(rows: Iterable[tuple[str, int, int]]) -> bytes:
    """A snapshot of (key, size, class); of rows with one key the last counts. The whole trie is held in memory."""
    held = {k.encode(): (s, c) for k, s, c in rows}
    keys = sorted(held)
    paths = {b""}
    for a, b in zip(keys, keys[1:], strict=False):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        paths.add(a[:n])
    inner, leaves = sorted(paths), [k for k in keys if k not in paths]
    number = {p: i for i, p in enumerate(inner + leaves)}
    children: dict[bytes, list[bytes]] = {p: [] for p in inner}
    above: dict[bytes, bytes] = {}
    stack: list[bytes] = []
    for p in sorted(number):
        while stack and not p.startswith(stack[-1]):
            stack.pop()
        if stack:
            above[p] = stack[-1]
            children[stack[-1]].append(p)
        if p in children:
            stack.append(p)
    totals: dict[bytes, tuple[int, dict[int, int]]] = {}
    for p in sorted(inner, key=len, reverse=True):
        n, by = 0, {}
        for q in [*children[p], *([p] if p in held else [])]:
            if q in totals and q != p:
                m, some = totals[q]
            else:
                m, some = 1, {held[q][1]: held[q][0]}
            n += m
            for c, b in some.items():
                by[c] = by.get(c, 0) + b
        totals[p] = (n, {c: b for c, b in by.items() if b})
    out = [HEADER.pack(MAGIC, VERSION, 0, len(number) - 1, len(number), 0)]
    for p in inner + leaves:
        edge = p[len(above.get(p, b"")) :]
        kids = children.get(p, [])
        has = p in held
        summed = p in totals and totals[p][0] > 0
        out += [NODE.pack(number[p], has * HAS_OBJECT + summed * HAS_TOTALS, len(edge), len(kids)), edge, struct.pack(f"<{len(kids)}I", *[number[k] for k in kids])]
        if has:
            out.append(VALUE.pack(held[p][1], held[p][0]))
        if summed:
            n, by = totals[p]
            out += [TOTALS.pack(n, len(by)), *[VALUE.pack(c, b) for c, b in sorted(by.items())]]
    return b"".join(out)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Objects of snapshot files, one task a file: the format is one stream. For large inventories keep an InventoryTable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = list(decode(content))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["key", "size", "class"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, size long, class int")


def write_snapshot(objects: DataFrame, path: str) -> None:
    """A snapshot file for exchange, in the file system of the driver; written beside and renamed. Rows come a partition at a time."""
    import os

    data = encode((r["key"], r["size"], r["class"]) for r in objects.select("key", "size", F.col("class")).toLocalIterator())
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "wb") as f:
        f.write(data)
    os.replace(f"{path}.tmp", path)
