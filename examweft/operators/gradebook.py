"""Gradebook: submissions with their exams, and the figures over a filtered set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examweft.functions import scoring
from examweft.operators.catalog import facets, search


def rows(submissions: DataFrame, exams: DataFrame, query: str = "", **wanted: object) -> DataFrame:
    """Submissions by title and exam, each with the duration of its exam, ``---`` where the exam is gone.

    A left join on the identifier: Spark broadcasts the exams only if they are below its threshold.
    """
    chosen = facets(search(submissions, query, ("exam_title",)), **wanted)
    known = exams.select(F.col("id").alias("exam_id"), "duration_minutes")
    duration = F.coalesce(F.col("duration_minutes").cast("string"), F.lit("---"))
    return chosen.join(known, "exam_id", "left").withColumn("duration", duration).drop("duration_minutes")


def summary(submissions: DataFrame) -> DataFrame:
    """n, average ("0.00" where empty) and pass rate ("0.0") as they are shown (A4)."""
    average, rate = F.avg("score"), F.avg(scoring.passed(F.col("score")).cast("double")) * 100
    shown = lambda pattern, x: F.format_string(pattern, F.coalesce(x, F.lit(0.0)))
    return submissions.agg(F.count("*").alias("n"), shown("%.2f", average).alias("average"), shown("%.1f", rate).alias("pass_rate"))


def exam_options(submissions: DataFrame, position: str) -> DataFrame:
    """The exams that submissions name, in order of appearance, each with its last title (A10)."""
    return submissions.groupBy("exam_id").agg(F.max_by("exam_title", position).alias("exam_title"), F.min(position).alias("pos")).orderBy("pos")


def totals(submissions: DataFrame) -> DataFrame:
    """What a result summary shows of each submission."""
    return submissions.select("id", "score", F.concat_ws("/", F.col("correct_count").cast("string"), F.col("total_questions").cast("string")).alias("correct"), "percentage", scoring.verdict(F.col("score")).alias("verdict"))
