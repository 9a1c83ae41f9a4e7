"""Rates, smoothed rates and parallelism of a scan, over tables of samples or requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds over which a smoothed rate forgets; the weight of a new reading of an I/O rate.
TAU, IO_WEIGHT = 30.0, 0.3


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ewma(samples: DataFrame, by: Sequence[str], ts: str, value: str, tie: str, tau: float = TAU) -> DataFrame:
    """(by, samples, ewma): alpha = 1 - exp(-dt / tau), e += alpha (x - e), from 0 and the first sample's time; dt <= 0 is passed over.

    The recurrence is a weighted sum: each sample counts alpha x exp(-time left / tau) (steps without time have alpha 0).
    So it needs a lag and one aggregation, with partial sums, and no ordered list of a group. The lag's window is a series'
    own; cut long series by time with ewma_step.
    """
    line = Window.partitionBy(*by).orderBy(ts, tie)
    t = micros(F.col(ts)) / 1e6
    dt = F.greatest(F.coalesce(F.col("t") - F.lag("t").over(line), F.lit(0.0)), F.lit(0.0))
    last = samples.groupBy(*by).agg(F.max(t).alias("end"), F.count("*").alias("samples"))
    steps = samples.withColumn("t", t).withColumn("dt", dt).join(last, list(by))
    part = (1 - F.exp(-F.col("dt") / tau)) * F.col(value) * F.exp(-(F.col("end") - F.col("t")) / tau)
    return steps.groupBy(*by).agg(F.max("samples").alias("samples"), F.round(F.sum(part), 6).alias("ewma"))


def ewma_step(state: Column, x: Column, dt: Column, tau: float = TAU) -> Column:
    return F.when(dt > 0, state + (1 - F.exp(-dt / tau)) * (x - state)).otherwise(state)


def io_rate(samples: DataFrame, by: Sequence[str], ts: str, value: str, tie: str) -> DataFrame:
    """(by, rate): readings of bytes per second smoothed 0.7 to 0.3; a rate of 0 takes the next reading as it is.

    Readings are not negative, so a rate leaves 0 once, at the first reading that is not 0. From there on the fold is a
    weighted sum: the k-th reading from the end counts 0.3 x 0.7^(k - 1), the one that starts it 0.7^(k - 1). No
    series is gathered into an array.
    """
    line = Window.partitionBy(*by).orderBy("t", tie)
    dt = (F.col("t") - F.lag("t").over(line)) / 1e6
    seen = samples.withColumn("t", micros(F.col(ts))).withColumn("dt", dt).where("dt > 0").withColumn("inst", F.col(value) / F.col("dt"))
    ahead = line.rowsBetween(Window.unboundedPreceding, 0)
    started = seen.withColumn("on", F.max((F.col("inst") != 0).cast("int")).over(ahead))
    placed = started.withColumn("i", F.sum("on").over(ahead)).withColumn("n", F.sum("on").over(Window.partitionBy(*by)))
    kept = F.pow(F.lit(1 - IO_WEIGHT), F.col("n") - F.col("i"))
    part = F.when(F.col("i") == 0, 0.0).when(F.col("i") == 1, kept).otherwise(kept * IO_WEIGHT) * F.col("inst")
    return placed.groupBy(*by).agg(F.round(F.sum(part), 4).alias("rate"))


def rates(samples: DataFrame, by: Sequence[str], ts: str, value: str, tie: str) -> DataFrame:
    """(by, tie, rate): change of a counter over the time since the sample before; null for the first and without time."""
    line = Window.partitionBy(*by).orderBy(ts, tie)
    t = micros(F.col(ts)) / 1e6
    dt, dv = t - F.lag(t).over(line), F.col(value) - F.lag(value).over(line)
    return samples.select(*by, tie, dt.alias("dt"), dv.alias("dv")).select(*by, tie, F.when(F.col("dt") > 0, F.round(F.col("dv") / F.when(F.col("dt") > 0, F.col("dt")), 6)).alias("rate"))


def parallelism(requests: DataFrame, start: str, seconds: str) -> DataFrame:
    """One row: requests, their summed time, the time from first start to last end, and their quotient (0 without time)."""
    begin = micros(F.col(start)) / 1e6
    seen = requests.agg(F.count("*").alias("requests"), F.sum(seconds).alias("busy"), F.min(begin).alias("lo"), F.max(begin + F.col(seconds)).alias("hi"))
    span = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0))
    mean = F.when(span > 0, F.col("busy") / F.when(span > 0, span)).otherwise(F.lit(0.0))
    return seen.select("requests", F.round(F.coalesce("busy", F.lit(0.0)), 4).alias("busy"), F.round(span, 4).alias("elapsed"), F.round(mean, 6).alias("parallelism"))


def in_flight(requests: DataFrame, by: Sequence[str], start: str, seconds: str, tie: str) -> DataFrame:
    """(by, peak): most requests that were open at once, ends before starts at one instant."""
    begin = micros(F.col(start))
    marks = requests.select(*by, F.explode(F.array(F.struct(begin.alias("at"), F.lit(1).alias("d")), F.struct((begin + F.floor(F.col(seconds) * 1e6)).alias("at"), F.lit(-1).alias("d")))).alias("m")).select(*by, "m.at", "m.d")
    net = marks.groupBy(*by, "at", "d").agg(F.sum("d").alias("n"))
    line = Window.partitionBy(*by).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("open", F.sum("n").over(line)).groupBy(*by).agg(F.max("open").cast("long").alias("peak"))


def eta_seconds(current: float, total: float, rate: float) -> float | None:
    """Seconds to go; none without a rate or a total."""
    return max(0.0, total - current) / rate if rate > 0 and total > 0 else None


def progress_line(requests: int, objects: int, size: int, seconds: float, parallel: float) -> str:
    """One line of a scan's report."""
    per = objects / requests if requests else 0.0
    speed = objects / seconds if seconds > 0 else 0.0
    return f"{requests} lists, {objects} objects ({per:.1f} a list), {size} bytes, {speed:.0f} objects/s, parallelism {parallel:.1f}"
