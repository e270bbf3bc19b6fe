"""Continued annotation: rounds of tagged text are placed in the full text and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions.text import continuation_offset, is_complete, without_end_marker
from examweft.operators.tokens import raw_text, spans

MOST_ROUNDS = 5


def rounds_in_use(rounds: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(doc_id, round, tagged) up to the first complete round, at most five, without the end marker."""
    done = F.max(is_complete(F.col("tagged")).cast("int")).over(Window.partitionBy("doc_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    ranked = rounds.withColumns({"done": F.coalesce(done, F.lit(0)), "k": F.row_number().over(Window.partitionBy("doc_id").orderBy("round"))})
    return ranked.where(F.col("k") <= most).where("done = 0").select("doc_id", "k", without_end_marker(F.col("tagged")).alias("tagged"))


def round_offsets(docs: DataFrame, rounds: DataFrame) -> DataFrame:
    """doc_id, k, offset: where each round's text begins in the document; the first begins at its start."""
    raws = rounds.select("doc_id", "k", raw_text("tagged").alias("raw")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "raw"))).alias("rs"))
    empty = F.array().cast("array<struct<k:int,offset:int>>")
    start = F.struct(F.lit(0).alias("expected"), empty.alias("out"))

    def step(acc, r):
        at = F.when(r["k"] == 1, F.lit(0)).otherwise(continuation_offset(acc["expected"], r["raw"], F.col("text"))).cast("int")
        end = F.when(r["k"] == 1, F.length(r["raw"])).otherwise(F.least(F.length("text"), at + F.length(r["raw"])))
        return F.struct(end.cast("int").alias("expected"), F.concat(acc["out"], F.array(F.struct(r["k"].cast("int").alias("k"), at.alias("offset")))).alias("out"))

    return docs.join(raws, "doc_id").select("doc_id", F.inline(F.aggregate("rs", start, step)["out"]))


def annotated_spans(docs: DataFrame, rounds: DataFrame) -> DataFrame:
    """The spans of all rounds in the document's own offsets, in order of rounds and closing."""
    used = rounds_in_use(rounds)
    key = F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("k").cast("string"))
    keyed = used.withColumn("key", key)
    found = spans(keyed.select(F.col("key").alias("doc_id"), "tagged")).withColumnRenamed("doc_id", "key")
    placed = found.join(keyed.select("key", "doc_id", "k"), "key").join(round_offsets(docs, used), ["doc_id", "k"])
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "close_order"))
    return placed.select("doc_id", order.alias("close_order"), (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "label", "text", "params")


def preservation(docs: DataFrame, tagged: DataFrame) -> DataFrame:
    """Whether tagging kept each text: exactly, and but for white space."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    both = docs.select("doc_id", "text").join(tagged.select("doc_id", raw_text("tagged").alias("raw")), "doc_id")
    return both.select("doc_id", (F.col("raw") == F.col("text")).alias("exact"), (bare("raw") == bare("text")).alias("but_for_space"))
