"""Storage classes by name and by code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASSES


def class_code(name: Column) -> Column:
    """The code of a class name, as written; 0 for any other or none."""
    names = F.create_map(*[F.lit(x) for i, n in enumerate(CLASSES) if i for x in (n, i)])
    return F.coalesce(F.try_element_at(names, F.coalesce(name, F.lit(""))), F.lit(0)).cast("int")


def class_name(code: Column) -> Column:
    """The name of a code; UNKNOWN outside the known ones."""
    names = F.array(*[F.lit(n) for n in CLASSES])
    return F.coalesce(F.get(names, code), F.lit(CLASSES[0]))


def class_list(bytes_by_class: Column) -> Column:
    """`CLASS=bytes ...` of an array of (class, bytes), by code."""
    return F.array_join(F.transform(F.array_sort(bytes_by_class), lambda x: F.concat(class_name(x["class"]), F.lit("="), x["bytes"].cast("string"))), " ")
