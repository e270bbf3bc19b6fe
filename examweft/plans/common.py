"""What the three question parsers share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examweft.schemas import OPTION

#: Options of a question that has none (fixed values).
PLACEHOLDERS = (("A", "Phương án A"), ("B", "Phương án B"), ("C", "Phương án C"), ("D", "Phương án D"))


def with_placeholders(options: Column) -> Column:
    """Four placeholder options where there are none."""
    four = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in PLACEHOLDERS))
    return F.when(F.size(options) == 0, four).otherwise(options).cast(f"array<{OPTION}>")


def joined(parts: Column, by: str = " ") -> Column:
    """The non-empty parts in order."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), by)


def ordered(*columns: str | Column) -> Column:
    """The structs of a group by their first field."""
    return F.array_sort(F.collect_list(F.struct(*columns)))
