"""Storage and LIST prices. The tables are constants of a fixed size, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BASE_REGION, CLASSES, LIST_DEFAULT, LIST_PRICES, STORAGE_PRICES

GIB = float(1 << 30)


def prices_of(region: str) -> dict[int, float]:
    """Price by class code, of the classes that cost something: the region's, else the base region's."""
    prices = STORAGE_PRICES[BASE_REGION] | STORAGE_PRICES.get(region, {})
    return {i: prices[n] for i, n in enumerate(CLASSES) if n in prices}


def storage_prices(spark: SparkSession, region: str) -> DataFrame:
    """(class, per_gib): the region's price, else that of the base region, else 0, for each of the classes."""
    per = prices_of(region)
    return spark.createDataFrame([(i, per.get(i, 0.0)) for i in range(len(CLASSES))], "class int, per_gib double")


def storage_price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, n, p) for r, prices in STORAGE_PRICES.items() for n, p in prices.items()], "region string, class_name string, per_gib double")


def list_price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LIST_PRICES.items()), "region string, per_1000 double")


def monthly(size: Column, per_gib: Column) -> Column:
    """Dollars a month."""
    return size.cast("double") / F.lit(GIB) * per_gib


def with_cost(by_class: DataFrame, region: str, keys: list[str]) -> DataFrame:
    """(keys, cost) of rows (keys, class, bytes). Whole bytes are summed by class before a price is applied, so the order of rows does not matter."""
    prices = F.broadcast(storage_prices(by_class.sparkSession, region))
    summed = by_class.groupBy(*keys, "class").agg(F.sum("bytes").alias("bytes")).join(prices, "class", "left")
    cost = F.round(F.sum(monthly(F.col("bytes"), F.coalesce("per_gib", F.lit(0.0)))), 6)
    return summed.groupBy(*keys).agg(cost.alias("cost"))


def list_cost(requests: DataFrame) -> DataFrame:
    """Rows (region, requests) with cost, in dollars; unknown regions pay the default."""
    prices = F.broadcast(list_price_table(requests.sparkSession))
    per = F.coalesce("per_1000", F.lit(LIST_DEFAULT)) / 1000
    return requests.join(prices, "region", "left").withColumn("cost", F.round(F.col("requests").cast("double") * per, 9)).drop("per_1000")
