"""A made-up inventory of an observatory's archive: keys, sizes and classes by a few rules over a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import deduped

#: Exposures of an archive of scale 1. Everything else follows from them.
EXPOSURES = 4_000


def _text(form: str, *values: Column) -> Column:
    return F.format_string(form, *values)


def generate(spark: SparkSession, seed: int = 1, scale: int = 1) -> DataFrame:
    """Objects of an archive; one row a key. Values follow a seeded hash, so every run makes the same rows.

    Telescopes take exposures in nights. Each exposure has a raw frame, whose class grows colder with its age in quarters, and
    a header beside it; two of three were calibrated, one of five has cut-outs, as many as a hash says. Nights have a log,
    telescopes a directory marker, and every 500th exposure belongs to a catalogue at the root.
    """

    def drawn(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(f"{seed}/{salt}")), F.lit(n)).cast("int")

    def size(low: int, high: int, salt: str) -> Column:
        """Between two sizes, as many in each doubling."""
        return F.floor(low * F.pow(F.lit(high / low), drawn(1 << 20, salt) / (1 << 20))).cast("long")

    number = F.col("id").cast("long")
    scope, night = drawn(3, "scope"), drawn(365, "night")
    day = F.date_format(F.date_add(F.lit("2021-03-01").cast("date"), night), "yyyyMMdd")
    home = _text("frames/scope-%d/%s/", scope, day)
    age = F.floor(night / 91)
    cold = F.when(age == 0, 7).when(age == 1, 6).when(age == 2, 5).otherwise(1)
    rows = spark.range(EXPOSURES * scale)

    def objects(where: Column, key: Column, bytes_: Column, code: Column | int) -> Column:
        return F.when(where, F.struct(key.alias("key"), bytes_.alias("size"), (code if isinstance(code, Column) else F.lit(code)).cast("int").alias("class")))

    always = F.lit(True)
    made = F.array(
        objects(always, F.concat(home, _text("raw/e%07d.fits", number)), size(4 << 20, 96 << 20, "raw"), cold),
        objects(always, F.concat(home, _text("raw/e%07d.hdr", number)), size(300, 9_000, "head"), 1),
        objects(number % 3 > 0, F.concat(home, _text("calibrated/e%07d.fits.gz", number)), size(1 << 20, 32 << 20, "calibrated"), 4),
        objects(always, F.concat(home, F.lit("night.log")), F.lit(0).cast("long") + 2_000 + night, 2),
        objects(always, _text("frames/scope-%d/", scope), F.lit(0).cast("long"), 1),
        objects(number % 500 == 0, _text("catalogue-%03d.parquet", F.floor(number / 500)), size(1 << 10, 1 << 22, "catalogue"), 10),
    )
    cut_outs = F.transform(F.sequence(F.lit(1), drawn(9, "cuts") + 1), lambda k: F.struct(_text("cut-outs/%02x/%07d-%d.png", number % 256, number, k).alias("key"), (size(20_000, 400_000, "cut") + k).alias("size"), F.lit(3).alias("class")))
    every = F.concat(made, F.when(number % 5 == 0, cut_outs).otherwise(F.slice(cut_outs, 1, 0)))
    return deduped(rows.select(F.explode(every).alias("o")).where("o is not null").select("o.key", "o.size", "o.class"))
