import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import classes, keys, text
from cairn.operators import telemetry
from cairn.schema import CLASSES


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def go_bytes(n):
    for unit, name in ((1 << 60, "EiB"), (1 << 50, "PiB"), (1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")):
        if n >= unit:
            return "%.2f %s" % (n / unit, name)
    return f"{n} B"


def test_human_bytes(spark):
    values = [0, 1023, 1024, 1536, 1029, 1034, 1 << 20, (1 << 20) - 1, 5 << 30, 3 << 40, (1 << 62) + 12345, 1664, 1280 * 1024 + 5243]
    df = spark.createDataFrame([(v,) for v in values], "n long").select("n", text.human_bytes(F.col("n")).alias("t"))
    assert {r.n: r.t for r in df.collect()} == {v: go_bytes(v) for v in values}


def test_numbers(spark):
    assert one(spark, text.human_dollars(F.lit(0.0099))) == "$0.0099"
    assert one(spark, text.human_dollars(F.lit(12.345))) == "$12.34"
    assert [one(spark, text.human_rate(F.lit(x))) for x in (999.4, 1500.0, 2.5e6, 3e9)] == ["999/s", "1.5K/s", "2.5M/s", "3.0G/s"]
    assert one(spark, text.percent(F.lit(1), F.lit(0))) == 0
    assert one(spark, text.percent(F.lit(1.0), F.lit(8))) == 13
    assert [one(spark, text.bar_cells(F.lit(v), F.lit(t))) for v, t in ((0, 5), (1, 10**6), (5, 5), (9, 5), (3, 0), (1, 2))] == [0, 1, 12, 12, 0, 6]
    assert one(spark, text.share_text(F.lit(1), F.lit(8))) == " 12.5%"
    assert one(spark, text.share_text(F.lit(1), F.lit(0))) == "      "
    assert one(spark, text.elapsed(F.lit(3725))) == "62:05"
    assert one(spark, text.clamp01(F.lit(-2.0))) == 0.0
    assert [one(spark, text.truncated(F.lit("añb…d"), w)) for w in (9, 5, 3, 1, 0)] == ["añb…d", "añb…d", "añ…", "…", "…"]


def test_decimals_as_printf_writes_them(spark):
    halves = [(n + 0.5) / 10**p for p in (1, 2, 4) for n in (0, 1, 2, 7, 99, 101, 1234, 999999)]
    values = [*halves, *(-v for v in halves), *(math.nextafter(v, to) for v in halves for to in (0.0, math.inf))]
    values += [12.345, 1.015, 105000 / 7e8, 1050 / 7e6, 0.995, 0.9999999, 9.995, 0.01, 0.0099999, 0.0, -0.0, -1e-9, 5e-324]
    values += [2.0**53 + 2, 2.0**63, 1e22, 1e23, -1e23, 2.0**126, 1e300, 1.7976931348623157e308, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = df.select("i", text.dollars(F.col("v")).alias("d"), text.human_rate(F.col("v")).alias("r"))
    want = {i: ("$%.4f" % v if v < 0.01 else "$%.2f" % v, "%.0f/s" % v) for i, v in enumerate(values)}
    rows = got.collect()
    assert {r.i: r.d for r in rows} == {i: d for i, (d, _) in want.items()}
    assert {r.i: r.r for r in rows if values[r.i] < 1e3} == {i: r for i, (_, r) in want.items() if values[i] < 1e3}
    assert one(spark, text.dollars(F.lit(None).cast("double"))) is None


def test_buckets(spark):
    edges = lambda n: next(i for i, top in enumerate((0, 1, 2, 4, 8, 16, 32, 64, 10**9)) if n <= top)
    fans = lambda n: next(i for i, top in enumerate((0, 1, 2, 3, 4, 7, 15, 31, 10**9)) if n <= top)
    df = spark.range(200).select("id", text.length_bucket(F.col("id")).alias("e"), text.fan_bucket(F.col("id")).alias("f"))
    assert all((r.e, r.f) == (edges(r.id), fans(r.id)) for r in df.collect())


def test_classes(spark):
    for i, n in enumerate(CLASSES):
        assert one(spark, classes.class_name(F.lit(i))) == n
        assert one(spark, classes.class_code(F.lit(n))) == i
    assert [one(spark, classes.class_code(F.lit(x).cast("string"))) for x in ("standard", "", None)] == [0, 0, 0]
    assert [one(spark, classes.class_name(F.lit(x))) for x in (-1, 11)] == ["UNKNOWN", "UNKNOWN"]


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "abd"), ("ab", "abc"), ("é1", "è1"), ("a", None), ("x", "y"), ("añb", "añb")])
def test_common_length(spark, a, b):
    x, y = (v.encode() if v is not None else b"" for v in (a, b))
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    assert one(spark, keys.common_length(keys.as_bytes(F.lit(a)), keys.as_bytes(F.lit(b).cast("string")))) == n


def test_keys(spark):
    got = spark.createDataFrame([("a/b/c",), ("a//",), ("x",), ("/",)], "k string").select("k", keys.directory_of(F.col("k")).alias("d"), keys.ancestors(keys.directory_of(F.col("k"))).alias("a"), keys.quoted(F.col("k")).alias("q"))
    assert {r.k: (r.d, r.a) for r in got.collect()} == {"a/b/c": ("a/b/", ["", "a/", "a/b/"]), "a//": ("a//", ["", "a/", "a//"]), "x": ("", [""]), "/": ("/", ["", "/"])}
    assert one(spark, keys.quoted(F.lit(""))) == "<root>"
    assert one(spark, keys.quoted(F.lit('a"b'))) == '"a\\"b"'


def test_telemetry_folds(spark):
    rows = [(0, 0.0, 5.0), (1, 1.5, 7.0), (2, 1.5, 100.0), (3, 40.0, 1.0)]
    df = spark.createDataFrame([("g", i, t, v) for i, t, v in rows], "g string, id int, t double, v double").withColumn("ts", F.timestamp_seconds("t"))
    e, before = 0.0, 0.0
    for _, t, v in rows:
        if t > before:
            e += (1 - math.exp(-(t - before) / 30)) * (v - e)
        before = t
    assert telemetry.ewma(df, ["g"], "ts", "v", "id").first().ewma == pytest.approx(e, abs=1e-6)
    rate, before = 0.0, 0.0
    for _, t, v in rows:
        if t > before:
            rate = v / (t - before) if rate == 0 else 0.7 * rate + 0.3 * v / (t - before)
        before = t
    assert telemetry.io_rate(df, ["g"], "ts", "v", "id").first().rate == pytest.approx(rate, abs=1e-4)
    assert telemetry.parallelism(df.limit(0), "ts", "v").first() == (0, 0.0, 0.0, 0.0)
    assert telemetry.eta_seconds(5, 15, 2) == 5.0 and telemetry.eta_seconds(5, 15, 0) is None
    assert "parallelism 2.0" in telemetry.progress_line(2, 10, 100, 5.0, 2.0)
    step = telemetry.ewma_step(F.lit(0.0), F.lit(10.0), F.lit(0.0))
    assert one(spark, step) == 0.0
