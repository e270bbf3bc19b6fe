"""Table states: snapshots, upserts, deletes. Each is a plan from the old state to the new one; writing it is the sink's part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions.text import identity
from examweft.operators.catalog import newest_per_key


def upsert(table: DataFrame, rows: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """``table`` with ``rows`` put in by key; of several new rows for a key the highest version counts, of equal ones
    the greatest by its other columns (K2).

    Only the old keys that are replaced move: an anti join, and a window over the new rows.
    """
    newest = newest_per_key(rows, key, version).select(*table.columns)
    return table.join(newest.select(key), key, "left_anti").select(*table.columns).unionByName(newest)


def migrated(table: DataFrame, legacy: DataFrame) -> DataFrame:
    """``table``, or where it is still empty the rows of a legacy store (K7, gated by S2)."""
    return upsert(table, legacy) if table.isEmpty() else table


def sync(table: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """The state after a full sync: rows whose key isn't current go, current ones are put in; all go if none is (K1)."""
    return upsert(table.join(current.select(key).distinct(), key, "left_semi"), current, key)


def deleted(table: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """What a full sync deletes; null-safe, unlike NOT IN."""
    return table.join(current.select(key).distinct(), key, "left_anti")


def numbered_repeats(rows: DataFrame, token: Column, name: str = "request_key") -> DataFrame:
    """``rows`` with a key for each: of the request's token, the row's whole content and its number among equal rows.

    The same request gives the same keys again, another one others. Rows that are equal in all columns are
    interchangeable; they are numbered in one window over their content.
    """
    whole = [F.to_json(F.col(c)) if "<" in kind else F.col(c) for c, kind in rows.dtypes]
    named = rows.withColumn(name, identity("", token, *whole))
    repeat = F.row_number().over(Window.partitionBy(name).orderBy(F.lit(0)))
    return named.withColumn(name, F.concat(name, F.lit("."), repeat.cast("string")))


def insert_exam(exams: DataFrame, new: DataFrame, created_at: Column, *id_keys: str) -> DataFrame:
    """Exams with new ones, which get an identifier of ``id_keys`` and their creation time, by which the newest come first (K3).

    New exams that are equal in all of ``id_keys`` get equal identifiers: a caller for whom each row is an exam of
    its own names a key that tells them apart (``numbered_repeats``).
    """
    made = new.withColumns({"id": identity("exam_", *map(F.col, id_keys)), "created_at": created_at})
    return exams.unionByName(made.select(*exams.columns))


def update_exam(exams: DataFrame, changes: DataFrame, version: str | None = None) -> DataFrame:
    """title, subject, grade, duration_minutes and questions from ``changes`` by id; id and created_at stay (K4).

    Of several changes for an id the highest version counts. Null keeps what was, but where ``changes`` names its
    fields in an array column ``fields``: those are set, to null as well, and no others.
    """
    fields = [f for f in ("title", "subject", "grade", "duration_minutes", "questions") if f in changes.columns]
    named = "fields" in changes.columns
    new = newest_per_key(changes, "id", version).select("id", *(F.col(f).alias(f"_{f}") for f in fields), *([F.col("fields").alias("_fields")] if named else []))
    out = exams.join(new, "id", "left")

    def value(c: str):
        if c not in fields:
            return F.col(c)
        if named:
            return F.when(F.coalesce(F.array_contains("_fields", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        return F.coalesce(f"_{c}", c).alias(c)

    return out.select(*map(value, exams.columns))


def delete_exams(exams: DataFrame, submissions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exams and submissions without those of the deleted identifiers."""
    ids = gone.select("id").distinct()
    return exams.join(ids, "id", "left_anti"), submissions.join(ids.withColumnRenamed("id", "exam_id"), "exam_id", "left_anti").select(*submissions.columns)


def delete_by_id(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def missing(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Wanted keys that the table hasn't: what a caller answers with "not found"."""
    return wanted.select(key).distinct().join(table.select(key), key, "left_anti")


def latest(changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Partial updates folded by key: of each column the last value that isn't null."""
    return changes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def continuity(pairs: DataFrame, key: str = "dir") -> DataFrame:
    """Numbered example pairs (dir, kind "in" or "out", n) up to the first gap, from 1 on."""
    both = pairs.groupBy(key, "n").agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("n"))).where("rank = n").select(key, "n")
