"""Runs of equal neighbours (gaps and islands), and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions import scoring
from examweft.functions.text import section_title


def run_ids(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str = "run") -> DataFrame:
    """``df`` with the number of each row's run from 1: a row opens one where its value differs from the row's before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    opens = F.when(~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")


def section_key(section: Column) -> Column:
    return F.coalesce(section, F.lit(""))


def stimulus_key(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def run_groups(df: DataFrame, keys: list[str], position: str, value: Column, name: str = "run") -> DataFrame:
    """One row for each run: its value, size, and start index, which is the sum of the sizes before it."""
    numbered = run_ids(df.withColumn("_value", value), keys, [position], F.col("_value"), name)
    groups = numbered.groupBy(*keys, name).agg(F.first("_value", ignorenulls=True).alias("value"), F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def section_groups(questions: DataFrame, keys: list[str], position: str = "pos", section: str = "section") -> DataFrame:
    """Sections as runs, with their titles."""
    groups = run_groups(questions, keys, position, section_key(F.col(section)))
    return groups.withColumn("title", section_title(F.col("value"), F.col("run")))


def section_progress(questions: DataFrame, keys: list[str], answer: str, position: str = "pos", section: str = "section") -> DataFrame:
    """Answered and all questions of each section."""
    numbered = run_ids(questions, keys, [position], section_key(F.col(section)))
    return numbered.groupBy(*keys, "run").agg(F.count_if(scoring.answered(F.col(answer))).alias("answered"), F.count("*").alias("total"))


def section_results(questions: DataFrame, results: DataFrame, keys: list[str], position: str = "pos", section: str = "section") -> DataFrame:
    """Right and all questions of each section; results are joined by position, not by identifier."""
    numbered = run_ids(questions, keys, [position], section_key(F.col(section)))
    joined = numbered.join(results.select(*keys, position, "is_correct"), [*keys, position], "left")
    return joined.groupBy(*keys, "run").agg(F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"), F.count("*").alias("total"))


def active_section(numbered: DataFrame, keys: list[str], index: Column, position: str = "pos") -> DataFrame:
    """The run that holds an index."""
    return numbered.where(F.col(position) == index).select(*keys, "run")


def carry_forward(df: DataFrame, keys: list[str], position: str, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def status_changes(snapshots: DataFrame, key: str = "id", ts: str = "ts", status: str = "status") -> DataFrame:
    """Rows at which a task's status differs from the one seen before."""
    w = Window.partitionBy(key).orderBy(ts)
    return snapshots.withColumn("previous", F.lag(status).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)))
