"""The exam catalog: search, facets, distinct values, ordering, questions without repeats."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions.text import blank, clean_grade, contains_text

ALL = "all"


def search(df: DataFrame, query: str, columns: tuple[str, ...] = ("title", "subject", "grade")) -> DataFrame:
    """Rows of which any column contains the query, whatever the case; an empty query keeps all."""
    return df if not query else df.where(reduce(or_, (contains_text(F.col(c), query) for c in columns)))


def facets(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal in each facet; ``"all"`` and empty values switch a facet off."""
    for name, value in wanted.items():
        if value not in (None, "", ALL):
            df = df.where(F.col(name) == F.lit(value))
    return df


def active_filters(**wanted: object) -> int:
    return sum(value not in (None, "", ALL) for value in wanted.values())


def by_id(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    """At most one row; the filter reaches the scan."""
    return df.where(F.col(column) == F.lit(key)).limit(1)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in code order."""
    return df.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def leading_int(x: Column) -> Column:
    return F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def grade_order(column: str = "grade") -> list[Column]:
    return [leading_int(F.col(column)).asc_nulls_last(), F.col(column)]


def distinct_grades(df: DataFrame, column: str = "grade") -> DataFrame:
    """Cleaned distinct grades: those with a leading number first, by number, then the others by text.

    One total order, where comparing pairs by number or else by text would not be one.
    """
    cleaned = df.select(clean_grade(F.col(column)).alias("grade")).where(F.col("grade") != "").distinct()
    return cleaned.orderBy(*grade_order())


def last_by_first_seen(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Each key with its last value, at the place where it was first seen."""
    return df.groupBy(key).agg(F.max_by(value, position).alias(value), F.min(position).alias(position))


def dedupe_questions(questions: Column) -> Column:
    """Questions by identifier: the place of the first, the value of the last (A11). No shuffle."""
    ids = F.transform(questions, lambda q: q["id"])
    last = F.transform(questions, lambda q: F.get(F.reverse(questions), F.array_position(F.reverse(ids), q["id"]).cast("int") - 1))
    return F.filter(last, lambda q, i: F.array_position(ids, q["id"]) == i + 1)


def has_sections(questions: Column) -> Column:
    return F.exists(questions, lambda q: ~blank(q["section"]))


def newest_order(column: str = "created_at", *then: str) -> list[Column]:
    """By creation time, the newest first; rows without any come last (O1, O5). ``then`` orders equal times."""
    return [F.coalesce(F.col(column), F.lit("")).desc(), *map(F.col, then)]


def newest_first(df: DataFrame, column: str = "created_at", *then: str) -> DataFrame:
    return df.orderBy(*newest_order(column, *then))


def newest_per_key(rows: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """One row for each key: that of the highest version, of equal ones the greatest by its columns in their order, so that
    the choice doesn't depend on how rows are dealt."""
    order = [F.desc(c) for c in ([version] if version else []) + [c for c, kind in rows.dtypes if c not in (key, version) and "map<" not in kind]]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order or [F.lit(0)])))
    return ranked.where("_rank = 1").drop("_rank")


def first_row(df: DataFrame, *order: Column | str) -> DataFrame:
    """The default selection."""
    return df.orderBy(*order).limit(1)


def limit_rows(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first n rows in an explicit order; None keeps all."""
    return df if n is None else df.orderBy(*order).limit(n)


def merge_batches(df: DataFrame, key: str, batch: str, text: str) -> DataFrame:
    """Batch results of each key in batch order, empty ones dropped, a blank line between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(batch, text))), lambda p: p[text])
    return df.groupBy(key).agg(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n").alias(text))


def first_uses(df: DataFrame, partition: str, value: str, position: str) -> DataFrame:
    """Rows at which a value first appears within its partition (U4)."""
    w = Window.partitionBy(partition, value).orderBy(position)
    return df.withColumn("_use", F.row_number().over(w)).where("_use = 1").drop("_use")


def replace_by_id(df: DataFrame, changed: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """``df`` with rows of the same key taken from ``changed``, one for each key."""
    new = newest_per_key(changed, key, version).select(*df.columns)
    return df.join(new, key, "left_anti").unionByName(df.select(key).distinct().join(new, key).select(*df.columns))


def remove_by_id(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(key)))


def running(tasks: DataFrame) -> DataFrame:
    """Tasks that wait or run (P20)."""
    return tasks.where(F.col("status").isin("pending", "processing"))
