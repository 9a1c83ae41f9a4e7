"""Inventories from files: JSON lines, Parquet or CSV reports, and the projection of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import class_code
from ..schema import LISTING, OBJECTS


def normalised(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (key, size, class name or code) as objects: missing keys are empty, sizes 0, classes unknown. more: columns that pass."""
    kind = dict(rows.dtypes).get("class", "string")
    code = class_code(F.col("class")) if kind == "string" else F.coalesce(F.col("class"), F.lit(0))
    return rows.select(F.coalesce("key", F.lit("")).alias("key"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), code.cast("int").alias("class"), *more)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A listing of one JSON object a line; blank lines are skipped, a line that is no JSON fails the job."""
    return normalised(spark.read.schema(LISTING).option("mode", "FAILFAST").json(path))


def write_jsonl(objects: DataFrame, path: str) -> None:
    from ..functions.classes import class_name

    objects.select("key", "size", class_name(F.col("class")).alias("class")).write.mode("overwrite").json(path)


def read_inventory(spark: SparkSession, path: str, fmt: str = "parquet", key: str = "key", size: str = "size", storage_class: str = "storage_class") -> DataFrame:
    """An inventory report of an object store; only the three columns are read."""
    rows = spark.read.format(fmt).option("header", "true").load(path)
    return normalised(rows.select(F.col(key).cast("string").alias("key"), F.col(size).cast("long").alias("size"), F.col(storage_class).cast("string").alias("class")))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OBJECTS)


def event_objects(events: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy/MM/dd")
    key = F.concat(F.lit("events/"), "event_type", F.lit("/"), day, F.lit("/"), F.col("event_id").cast("string"), F.lit(".json"))
    return events.select(key.alias("key"), F.floor(F.col("value") * 1048576).cast("long").alias("size"), (F.col("user_id") % 11).cast("int").alias("class"))


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects made of five tables, so that queries and their SQL read the same inventory."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    docs, labels, orders, region = table("documents"), table("labels"), table("orders"), table("region")
    slash = F.lit("/")
    home = F.concat(F.lit("documents/"), "lang", slash)
    parts = [
        docs.select(F.concat(home, "source", slash, F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"), F.col("n_chars").alias("size"), (F.col("doc_id") % 3 + 1).cast("int").alias("class")),
        docs.select(home.alias("key")).distinct().select("key", F.lit(0).cast("long").alias("size"), F.lit(1).alias("class")),
        labels.select(F.concat(F.lit("documents-labels/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("key"), (F.col("quality") * 10 + F.col("toxic")).cast("long").alias("size"), F.lit(2).alias("class")),
        orders.select(F.concat(F.lit("orders/"), "o_orderstatus", slash, F.date_format("o_orderdate", "yyyy"), slash, F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("key"), F.floor("o_totalprice").cast("long").alias("size"), F.when(F.col("o_orderstatus") == "F", 6).otherwise(1).alias("class")),
        region.select(F.concat(F.lit("region-"), "r_name", F.lit(".csv")).alias("key"), F.col("r_regionkey").cast("long").alias("size"), F.lit(10).alias("class")),
    ]
    out = event_objects(table("events"))
    for p in parts:
        out = out.unionByName(p)
    return out
