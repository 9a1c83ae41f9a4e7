"""Numbers as people read them. Decimals are rounded half to even on exact values, as C's printf does."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of 1024, from KiB on.
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def _decimals(part: Column, places: int) -> Column:
    """A part of one in units of the last decimal, rounded half to even on its exact value.

    The product with a power of ten may round to a half, or from one. The distance to the nearest unit is exact, though: the
    float that is nearest, and what it leaves of the double, are each short enough to be multiplied without rounding.
    """
    scale = float(10**places)
    unit, high = F.rint(part * scale), part.cast("float").cast("double")
    above, rest = high * scale - unit, (part - high) * scale
    return (unit + F.when(above - 0.5 + rest > 0, 1.0).when(above + 0.5 + rest < 0, -1.0).otherwise(0.0)).cast("int")


def _far_digits(x: Column) -> Column:
    """All digits of a finite double from 2**63 on: its 53 bits in limbs of 15 digits, times 1024 as often as need be."""
    base, zero = F.lit(10**15), F.lit(0).cast("bigint")
    times = F.size(F.filter(F.sequence(F.lit(0), F.lit(96)), lambda k: x >= F.pow(F.lit(2.0), k * 10 + 63)))
    start = F.floor(x / F.pow(F.lit(2.0), times * 10))

    def add(held: Column, limb: Column) -> Column:
        n = limb * 1024 + held.carry
        return F.struct(F.call_function("div", n, base).alias("carry"), F.concat(held.out, F.array(n % base)).alias("out"))

    none = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))
    limbs = F.concat(F.array(start % base, F.call_function("div", start, base)), F.array_repeat(zero, 19))
    limbs = F.aggregate(F.array_repeat(zero, times), limbs, lambda held, _: F.aggregate(held, none, add, lambda end: end.out))
    padded = F.transform(F.reverse(limbs), lambda limb: F.lpad(limb.cast("string"), 15, "0"))
    return F.regexp_replace(F.array_join(padded, ""), "^0+", "")


def _fixed(number: Column, places: int) -> Column:
    """A double with so many decimals, as C's printf writes it: all digits, `nan`, `-inf` and the sign of a negative zero, too."""
    d = number.cast("double")
    x = F.abs(d)
    whole = F.floor(x if places else F.rint(x))
    text = whole.cast("string")
    if places:
        unit = F.lit(Decimal(1).scaleb(-places)).cast(f"decimal({places + 1},{places})")
        text = (whole.cast("decimal(19,0)") + _decimals(x - whole.cast("double"), places).cast("decimal(5,0)") * unit).cast("string")
    # What is far or no number is rare: as a function of an array's element it stays out of the code that is made for each row.
    tail = "." + "0" * places if places else ""
    rare = F.transform(F.array(x), lambda v: F.when(F.isnan(v), "nan").when(v == math.inf, "inf").otherwise(F.concat(_far_digits(v), F.lit(tail))))
    sign = F.when((d < 0) | ((d == 0) & (d.cast("string") == "-0.0")), "-").otherwise("")
    return F.when(d.isNotNull(), F.concat(sign, F.when(x < 2.0**63, text).otherwise(rare[0])))


def _as_written(number: Column, places: int) -> Column:
    """A double with so many decimals, rounded half to even on the shortest decimals that tell it from others."""
    return F.format_string(f"%.{places}f", F.bround(number, places))


def human_bytes(n: Column, places: int = 2) -> Column:
    """`1.50 KiB`; `n B` below 1024. The quotient by a power of two is exact, so it is rounded as a whole number."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS):
        size, scale = 1 << 10 * (i + 1), 10**places
        wide = n.cast("decimal(38,0)") * F.lit(scale).cast("decimal(10,0)")
        whole = F.floor(wide / F.lit(size).cast("decimal(20,0)")).cast("decimal(38,0)")
        twice = (wide - whole * F.lit(size).cast("decimal(20,0)")) * 2
        up = (twice > size) | ((twice == size) & (whole % 2 == 1))
        rounded = (whole + F.when(up, 1).otherwise(0)).cast("decimal(30,0)")
        text = F.concat(F.floor(rounded / scale).cast("bigint").cast("string"), F.lit("."), F.lpad((rounded % scale).cast("bigint").cast("string"), places, "0"), F.lit(f" {unit}"))
        out = F.when(n >= F.lit(size), text).otherwise(out)
    return out


def dollars(d: Column) -> Column:
    """`$12.35`; four decimals below a cent. 12.345 is a double above that number, so it is rounded up."""
    return F.when(d < 0.01, F.concat(F.lit("$"), _fixed(d, 4))).otherwise(F.concat(F.lit("$"), _fixed(d, 2)))


def human_dollars(d: Column) -> Column:
    """As dollars, but an amount counts as it is written: 12.345 is a tie, and `$12.34`. Not what printf gives; queries use dollars."""
    return F.when(d < 0.01, F.concat(F.lit("$"), _as_written(d, 4))).otherwise(F.concat(F.lit("$"), _as_written(d, 2)))


def human_rate(r: Column) -> Column:
    out = F.concat(_fixed(r, 0), F.lit("/s"))
    for least, sign in ((1e3, "K"), (1e6, "M"), (1e9, "G")):
        out = F.when(r >= least, F.concat(_fixed(r / least, 1), F.lit(f"{sign}/s"))).otherwise(out)
    return out


def percent(x: Column, cap: Column) -> Column:
    """x of cap as a whole percentage, halves away from zero; 0 if cap is not positive."""
    return F.when(cap <= 0, F.lit(0)).otherwise(F.round(x * 100 / F.when(cap > 0, cap))).cast("int")


def share_text(value: Column, total: Column, width: int = 6) -> Column:
    """`  4.5%`; blanks without a total."""
    return F.when(total <= 0, F.lit(" " * width)).otherwise(F.lpad(F.concat(_fixed(value.cast("double") * 100 / F.when(total > 0, total), 1), F.lit("%")), width, " "))


def bar_cells(value: Column, total: Column, width: int = 12) -> Column:
    """Cells of a bar of that width: at least one for what is not nothing."""
    filled = F.greatest(F.least(F.floor(value.cast("decimal(38,0)") * width / F.when(total > 0, total)).cast("int"), F.lit(width)), F.lit(1))
    return F.when((total <= 0) | (value <= 0), F.lit(0)).otherwise(filled)


def bar(value: Column, total: Column, width: int = 12) -> Column:
    n = bar_cells(value, total, width)
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("·"), F.lit(width) - n))


def truncated(s: Column, width: int) -> Column:
    """At most so many characters, the last an ellipsis where something was cut."""
    cut = F.lit("…") if width <= 1 else F.concat(F.left(s, F.lit(width - 1)), F.lit("…"))
    return F.when(F.char_length(s) <= width, s).otherwise(cut)


def elapsed(seconds: Column) -> Column:
    """mm:ss; minutes go past 59."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def length_bucket(n: Column) -> Column:
    """0, 1, 2, 3-4, 5-8, 9-16, 17-32, 33-64, more."""
    return F.when(n <= 2, n).otherwise(F.least(F.lit(8), F.ceil(F.log2(n.cast("double"))) + 1)).cast("int")


def fan_bucket(n: Column) -> Column:
    """0, 1, 2, 3, 4, 5-7, 8-15, 16-31, more."""
    return F.when(n <= 4, n).when(n <= 7, 5).otherwise(F.least(F.lit(8), F.floor(F.log2(n.cast("double"))) + 3)).cast("int")


def stamp(ts: Column) -> Column:
    """A time as it stands in names of files."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")
