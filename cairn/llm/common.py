"""What the operators of this folder share: the checkpoint folder, sizes, numbering without a global sort, components."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a temporary one on a local master; elsewhere an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Texts that go to Python at a time where a step runs at once: a batch of long documents is then some megabytes.
#: Elsewhere Spark's own bound holds, spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless it is set).
BATCH_ROWS, BATCH_KEY = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bound(df: DataFrame, jsession) -> DataFrame:
    """The same rows, computed under the settings of another session of the same context."""
    spark = df.sparkSession
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(jsession, df._jdf.queryExecution().analyzed()), spark)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, to be computed with batches of BATCH_ROWS at most: in a session of its own, a copy of df's, whose settings no one else sees."""
    spark = df.sparkSession
    own = int(spark.conf.get(BATCH_KEY))
    copy = spark._jsparkSession.cloneSession()
    copy.conf().set(BATCH_KEY, str(min(BATCH_ROWS, own) if own > 0 else BATCH_ROWS))
    return _bound(df, copy)


def checkpointed_in_small_batches(df: DataFrame) -> DataFrame:
    """checkpointed(df), its texts sent to Python in small batches; the result belongs to df's session."""
    return _bound(checkpointed(in_small_batches(df)), df.sparkSession._jsparkSession)


#: Shuffle files go when the computation that wrote them ends, not when the driver happens to collect its garbage.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed_lean(df: DataFrame, small: bool = True) -> DataFrame:
    """checkpointed_in_small_batches(df), or checkpointed(df) unless small, that leaves no shuffle files; for a df that nothing else is read from."""
    run = in_small_batches(df) if small else _bound(df, df.sparkSession._jsparkSession.cloneSession())
    own = run._jdf.sparkSession()
    own.conf().set(CLEAN_KEY, "true")
    return _bound(checkpointed(_bound(run, own)), df.sparkSession._jsparkSession)


def release(df: DataFrame) -> None:
    """Delete the files of a checkpointed df that nothing reads any more, such as the state of a round before the last."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Size of df by the optimizer's statistics, which for files are the files' sizes: no row is read. 0 where unknown."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else 0


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows: about `each` in one, and the session's number of shuffle partitions at least."""
    return max(shuffle_partitions(spark), -(-rows // each))


def groups_for(df: DataFrame, group_bytes: int) -> int:
    """A number of hash groups that follows the input: at most about group_bytes of files each, and one for each shuffle partition at least."""
    return max(shuffle_partitions(df.sparkSession), plan_bytes(df) // group_bytes)


def text_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators on texts read, under fixed names and types."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name, name or name with underscores behind it, that no column of df has (whatever its letters' case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_struct(df: DataFrame, made: Column, names: Sequence[str]) -> DataFrame:
    """df with the fields of a struct as its last columns; columns of df that have their names are replaced."""
    held = unused(df, "made")
    out = {n.lower() for n in names}
    return df.withColumn(held, made).select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out], *[F.col(f"`{held}`.{n}").alias(n) for n in names])


def numbered(df: DataFrame, within: Sequence[str], order: Sequence[Column], out: str, spread: Column, buckets: int) -> DataFrame:
    """df with column out: a gapless number from 0 in each group of `within`.

    No group is sorted in one task: rows are spread over buckets by the hash `spread`, counted by bucket,
    and numbered from their bucket's offset. The order is by bucket, then by `order`. The table of counts has
    groups x buckets rows.
    """
    named = df.withColumn("__bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    keys = [*within, "__bucket"]
    counts = named.groupBy(*keys).agg(F.count("*").alias("__n"))
    running = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        named.withColumn("__rank", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(out, (F.col("__offset") + F.col("__rank") - 1).cast("long"))
        .select(*df.columns, out)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), longs; root is the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris and others, 2014): each round joins every edge with
    its node's smallest neighbour, so that long chains halve; no neighbour list is ever collected. Rounds end
    when the set of edges, taken as its count and the sum of its hashes, stays the same.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, large.a == least.k).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, edges = edges, checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
        release(before)
        last, now = now, state(edges)
        if last == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


LONG = T.LongType()
