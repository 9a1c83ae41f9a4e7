"""The shape of the compressed trie of all keys, from neighbours in key order.

Inner nodes are the root and the longest common prefixes of neighbouring keys; leaves are the other keys. A leaf's parent
is the longer of the prefixes it shares with its two neighbours. Inner nodes are closed under common prefixes, so an
inner node's parent is what it shares with the inner node before it. Both need a neighbour only: no trie is built and
no prefix is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import as_bytes, common_length, from_bytes
from ..functions.text import fan_bucket, length_bucket
from ..plans.session import parts_of, stored


def with_neighbours(rows: DataFrame, col: str, both: bool = True) -> DataFrame:
    """rows with `before` and `after`: the values of a unique column next to theirs, null at the ends.

    Rows are dealt by ranges and kept, so that ranges do not change. Only the ends of ranges, a row each, are ordered
    in one task.
    """
    n = parts_of(rows)
    dealt = stored(rows.repartitionByRange(n, col).withColumn("__part", F.spark_partition_id()))
    ends = dealt.groupBy("__part").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    line = Window.orderBy("__part")
    ends = ends.select("__part", F.lag("hi").over(line).alias("__hi"), F.lead("lo").over(line).alias("__lo"))
    inside = Window.partitionBy("__part").orderBy(col)
    out = dealt.withColumn("before", F.lag(col).over(inside))
    if both:
        out = out.withColumn("after", F.lead(col).over(inside))
    out = out.join(F.broadcast(ends), "__part").withColumn("before", F.coalesce("before", "__hi"))
    if both:
        out = out.withColumn("after", F.coalesce("after", "__lo"))
    return out.drop("__part", "__hi", "__lo")


def adjacent_common(objects: DataFrame) -> DataFrame:
    """(key, shared): bytes that each key shares with the one before it."""
    rows = with_neighbours(objects.select(as_bytes(F.col("key")).alias("k")), "k", both=False)
    return rows.select(from_bytes(F.col("k")).alias("key"), common_length(F.col("before"), F.col("k")).alias("shared"))


def trie_nodes(objects: DataFrame) -> DataFrame:
    """(path, parent, edge, kind, has_object) of all nodes; paths are byte strings (see as_bytes), edge is a length in bytes.

    kind: leaf, or internal; the root is internal and has no parent. has_object: a key ends here.
    """
    keys = with_neighbours(objects.select(as_bytes(F.col("key")).alias("k")), "k")
    k = F.col("k")
    left, right = common_length(F.col("before"), k), common_length(k, F.col("after"))
    seen = stored(keys.select("k", left.alias("l"), right.alias("r")))
    root = objects.sparkSession.createDataFrame([("",)], "p string")
    shared = seen.where("r > 0").select(F.expr("left(k, r)").alias("p")).unionByName(root).distinct()
    inner = with_neighbours(shared, "p", both=False)
    above = F.when(F.col("p") != "", F.left(F.col("p"), common_length(F.col("before"), F.col("p"))))
    inner = inner.select(F.col("p").alias("path"), above.alias("parent"))
    own = seen.where("r = length(k)").select(F.col("k").alias("path"), F.lit(True).alias("o"))  # a key that the next one goes on from is an inner node
    inner = inner.join(own, "path", "left").select("path", "parent", F.lit("internal").alias("kind"), F.coalesce("o", F.lit(False)).alias("has_object"))
    leaves = seen.where("r < length(k)").select(F.col("k").alias("path"), F.expr("left(k, greatest(l, r))").alias("parent"), F.lit("leaf").alias("kind"), F.lit(True).alias("has_object"))
    whole = inner.unionByName(leaves)
    return whole.select("path", "parent", F.coalesce(F.length("path") - F.length("parent"), F.lit(0)).alias("edge"), "kind", "has_object")


def with_children(nodes: DataFrame) -> DataFrame:
    """nodes with their number of children. Each node counts one for its parent in the same pass; none is read twice.

    Only numbers are aggregated, in a hash table; a parent is what is left of a path without its edge.
    """
    own = F.struct(F.col("path"), F.col("edge"), (F.col("kind") == "leaf").cast("int").alias("leaf"), F.col("has_object").cast("int").alias("object"), F.lit(0).cast("long").alias("one"))
    none = F.lit(None).cast("int")
    for_parent = F.struct(F.col("parent").alias("path"), none.alias("edge"), none.alias("leaf"), none.alias("object"), F.lit(1).cast("long").alias("one"))
    rows = nodes.select(F.explode(F.array(own, for_parent)).alias("r")).select("r.*").where("path is not null")
    sums = rows.groupBy("path").agg(F.max("edge").alias("edge"), F.max("leaf").alias("leaf"), F.max("object").alias("object"), F.sum("one").alias("children"))
    parent = F.when(F.col("path") != "", F.left("path", F.length("path") - F.col("edge")))
    return sums.select("path", parent.alias("parent"), "edge", F.when(F.col("leaf") == 1, "leaf").otherwise("internal").alias("kind"), (F.col("object") == 1).alias("has_object"), "children")


def trie_counts(objects: DataFrame) -> DataFrame:
    """One row of totals: nodes by kind, edge bytes, the longest edge, the largest number of children."""
    nodes = with_children(trie_nodes(objects))
    leaf, inner = F.col("kind") == "leaf", F.col("kind") == "internal"
    total = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    return nodes.agg(
        F.count("*").alias("nodes"),
        total(leaf).alias("leaves"),
        total(inner & ~F.col("has_object") & (F.col("children") > 0)).alias("internals"),
        total(inner & F.col("has_object") & (F.col("children") > 0)).alias("internals_with_object"),
        total(inner & (F.col("children") == 0)).alias("empty"),
        F.sum("edge").cast("long").alias("edge_bytes"),
        F.sum("children").cast("long").alias("child_slots"),
        F.max("edge").cast("int").alias("max_edge"),
        F.max("children").cast("long").alias("max_children"),
    )


def edge_histogram(objects: DataFrame) -> DataFrame:
    """(bucket, nodes) by the length of the edge, leaves and inner nodes (the root's is 0) alike."""
    return trie_nodes(objects).groupBy(length_bucket(F.col("edge")).alias("bucket")).agg(F.count("*").alias("nodes"))


def children_histogram(objects: DataFrame) -> DataFrame:
    """(bucket, nodes) by the number of children."""
    return with_children(trie_nodes(objects)).groupBy(fan_bucket(F.col("children")).alias("bucket")).agg(F.count("*").alias("nodes"))


def children_of(nodes: DataFrame, path: str) -> DataFrame:
    """(label, kind, edge, has_object, children) of a node's children; label is the edge's text, whose first byte orders them."""
    raw = path.encode().decode("latin-1")
    mine = with_children(nodes).where(F.col("parent") == raw)
    return mine.select(from_bytes(F.substr(F.col("path"), F.lit(len(raw) + 1))).alias("label"), "kind", "edge", "has_object", "children")


def table_bytes(objects: DataFrame) -> Column:
    """Bytes of keys and fixed columns of an object, in place of a heap estimate."""
    return F.octet_length("key") + F.lit(12)
