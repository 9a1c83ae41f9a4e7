"""Expressions over `/`-separated keys. All are built in; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DELIMITER


def check_prefix(prefix: str) -> str:
    """A directory prefix: empty or ending in the delimiter."""
    if prefix and not prefix.endswith(DELIMITER):
        raise ValueError(f"a directory prefix is empty or ends in {DELIMITER!r}: {prefix!r}")
    return prefix


def rest_of(key: Column, prefix: str) -> Column:
    """What follows the prefix in a key that starts with it."""
    return F.substr(key, F.lit(len(prefix) + 1))


def has_delimiter(rest: Column) -> Column:
    return F.instr(rest, DELIMITER) > 0


def entry_name(rest: Column) -> Column:
    """The first segment with its delimiter (a directory), or all of it (a file)."""
    return F.when(has_delimiter(rest), F.substr(rest, F.lit(1), F.instr(rest, DELIMITER))).otherwise(rest)


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit(DELIMITER), F.lit("")))).cast("int")


def directory_of(key: Column) -> Column:
    """The key up to its last delimiter, that included; empty without one."""
    return F.substr(key, F.lit(1), F.length(key) - F.length(F.substring_index(key, DELIMITER, -1)))


def parent_of(directory: Column) -> Column:
    """The directory above one; null for the root."""
    return F.when(directory != "", directory_of(F.substr(directory, F.lit(1), F.length(directory) - 1)))


def ancestors(directory: Column) -> Column:
    """The root, every directory above a directory, and itself, from the top."""
    parts = F.split(directory, DELIMITER)
    steps = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    grown = lambda a, p: F.concat(a, F.array(F.concat(F.element_at(a, -1), p, F.lit(DELIMITER))))
    return F.aggregate(steps, F.array(F.lit("")), grown)


def as_bytes(text: Column) -> Column:
    """A string with a character for each byte of the text's UTF-8: lengths and cuts are then in bytes, order is kept."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_bytes(text: Column) -> Column:
    """The text of a string that as_bytes made; bytes that are cut inside a character show as replacement characters."""
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings that as_bytes made; 0 if either is null.

    Found by halving: prefixes of growing length are equal up to the answer and differ from there on.
    """
    short = F.coalesce(F.least(F.length(a), F.length(b)), F.lit(0))
    powers = F.sequence(F.length(F.bin(short)) - 1, F.lit(0), F.lit(-1))

    def longer(n: Column, power: Column) -> Column:
        m = n + F.call_function("shiftleft", F.lit(1), power)
        return F.when((m <= short) & (F.left(a, m) == F.left(b, m)), m).otherwise(n)

    return F.when(a.isNull() | b.isNull(), F.lit(0)).otherwise(F.aggregate(powers, F.lit(0), longer))


def quoted(path: Column) -> Column:
    """A label for a path in double quotes; <root> for the empty one."""
    inner = F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(path == "", F.lit("<root>")).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))


def above_prefix(prefix: str) -> str:
    """An exclusive lower bound for the keys with a prefix: what stands before them, and behind hardly any other key.

    Order of code points is order of UTF-8 bytes, so the last character is lowered by one and followed by the largest.
    """
    if not prefix:
        return ""
    last = ord(prefix[-1]) - 1
    if last < 0:
        return prefix[:-1]
    return prefix[:-1] + chr(0xD7FF if 0xD800 <= last <= 0xDFFF else last) + "\U0010ffff" * 256
