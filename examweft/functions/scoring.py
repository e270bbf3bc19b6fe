"""Scores and outcomes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examweft.functions.text import blank

PASS_MARK = 5.0


def score(correct: Column, total: Column) -> Column:
    """Out of ten, two places, halves to even (A2)."""
    return F.bround(correct / F.greatest(F.lit(1), total) * F.lit(10.0), 2)


def percentage(correct: Column, total: Column) -> Column:
    return F.bround(correct / F.greatest(F.lit(1), total) * F.lit(100.0), 1)


def passed(score: Column) -> Column:
    return score >= PASS_MARK


def verdict(score: Column) -> Column:
    return F.when(passed(score), "PASS").otherwise("FAIL")


def outcomes(answer: Column, is_correct: Column) -> dict[str, Column]:
    """Three predicates, not one class: a blank answer to a blank key is both correct and empty."""
    return {"correct": is_correct, "incorrect": ~is_correct & ~blank(answer), "empty": blank(answer)}


def answered(answer: Column) -> Column:
    """Whether anything was chosen, white space included."""
    return F.coalesce(answer, F.lit("")) != ""


def or_default(value: Column, default: object) -> Column:
    """``default`` for null, empty text and zero alike."""
    return F.coalesce(F.when(value.cast("string").isin("", "0"), None).otherwise(value), F.lit(default))
