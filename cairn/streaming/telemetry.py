"""Rates of a live scan: smoothed per series with state, and totals by window and class with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import TAU

OUTPUT = "series string, samples long, ewma double"
STATE = "ewma double, at double, samples long"


def _smooth(tau: float):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ewma, at, n = state.get if state.exists else (0.0, None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "tie"])
        t, x = rows["t"].to_numpy(float), rows["value"].to_numpy(float)
        now = np.maximum.accumulate(t if at is None else np.maximum(t, at))  # time does not go back
        dt = np.diff(now, prepend=now[0] if at is None else at)
        # The recurrence as a weighted sum: what is left of each step, and of the state, at the end.
        left = np.exp(-(now[-1] - now) / tau)
        ewma = ewma * float(np.exp(-dt.sum() / tau)) + float(((1 - np.exp(-dt / tau)) * x * left).sum())
        at, n = float(now[-1]), n + len(rows)
        state.update((float(ewma), float(at), int(n)))
        yield pd.DataFrame({"series": [key[0]], "samples": [n], "ewma": [ewma]})

    return update


def smoothed(samples: DataFrame, series: str, ts: str, value: str, tie: str, tau: float = TAU) -> DataFrame:
    """(series, samples, ewma) of a stream of samples, in update mode: the recurrence of operators.telemetry.ewma.

    The state of a series is three numbers. Samples that come behind a later one of their series count, but no time passes.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = samples.select(F.col(series).cast("string").alias("series"), t.alias("t"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("series").applyInPandasWithState(_smooth(tau), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_totals(objects: DataFrame, ts: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, class, objects, bytes) by window of event time; rows later than the watermark are dropped, as Spark does."""
    spans = objects.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(F.window("__ts", window).alias("w"), "class")
    return spans.agg(F.count("*").alias("objects"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("start"), "class", "objects", "bytes")
