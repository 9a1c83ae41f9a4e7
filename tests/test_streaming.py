import math
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from cairn.streaming import telemetry


def run(stream, mode):
    name = f"out_{uuid4().hex}"
    stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_smoothed_keeps_state_between_triggers(spark, tmp_path):
    rows = [(0, 0.0, 5.0), (1, 1.5, 7.0), (2, 1.5, 100.0), (3, 40.0, 1.0)]
    schema = "g string, id int, t double, v double"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame([("g", *r) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    e, before = 0.0, 0.0
    for _, t, v in rows:
        if t > before:
            e += (1 - math.exp(-(t - before) / 30)) * (v - e)
        before = t
    last = max(run(telemetry.smoothed(stream, "g", "ts", "v", "id"), "update"), key=lambda r: r.samples)
    assert (last.samples, last.ewma) == (4, pytest.approx(e))


def test_windowed_totals(spark, tmp_path):
    rows = [(10.0, 1, 5), (50.0, 1, 6), (70.0, 1, 1), (70.0, 2, 9)]
    schema = "t double, class int, size long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.start.timestamp(), r["class"]): (r.objects, r.bytes) for r in run(telemetry.windowed_totals(stream, "ts").select("start", "class", "objects", "bytes"), "complete")}
    assert sorted(v for v in got.values()) == [(1, 1), (1, 9), (2, 11)]
