"""BIO labels from tokens and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions.text import WS
from examweft.schemas import BASE_TAGS

#: Code points in a join bucket: a long document's tokens and spans meet in many tasks, not in one.
STRIDE = 512


def label_ids(tags: tuple[str, ...] = BASE_TAGS) -> dict[str, int]:
    """O is 0, then B- and I- of each tag in turn."""
    return {"O": 0} | {f"{k}-{tag}": 2 * i + j for i, tag in enumerate(tags) for j, k in ((1, "B"), (2, "I"))}


def trim_spans(spans: DataFrame) -> DataFrame:
    """Bounds without the white space at either end; blank spans go (X11)."""
    left = F.length("text") - F.length(F.regexp_replace("text", rf"(?U)^[{WS}]+", ""))
    right = F.length("text") - F.length(F.regexp_replace("text", rf"(?U)[{WS}]+$", ""))
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return spans.where(empty | ~F.rlike("text", F.lit(rf"(?U)^[{WS}]*$"))).select(
        "doc_id", "close_order", "label", (F.col("start") + F.when(empty, 0).otherwise(left)).alias("cs"), (F.col("end") - F.when(empty, 0).otherwise(right)).alias("ce")
    )


def align(tokens: DataFrame, spans: DataFrame, tags: tuple[str, ...] = BASE_TAGS, stride: int = STRIDE) -> DataFrame:
    """``tokens`` with tag and label_id: of the spans that hold a token's start the first that closed counts.

    An equi-join on document and stride of offsets with the range as the rest of the condition, so that
    it is a hash or sort-merge join whatever the length of a document.
    """
    clean = trim_spans(spans).where("ce > cs").withColumn("stride", F.explode(F.sequence(F.floor(F.col("cs") / stride), F.floor((F.col("ce") - 1) / stride))))
    held = tokens.withColumn("stride", F.floor(F.col("start") / stride)).alias("t")
    holds = (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.stride") == F.col("s.stride")) & (F.col("t.start") >= F.col("cs")) & (F.col("t.start") < F.col("ce"))
    keys = [F.col(f"t.{c}") for c in (*tokens.columns, "stride")]
    # The groups hold the join's keys, so that the join's partitioning serves them too.
    first = held.join(clean.alias("s"), holds, "left").groupBy(*keys).agg(F.min_by(F.struct("label", "cs"), "close_order").alias("span"))
    tag = F.when(F.col("span.label").isNull(), "O").otherwise(F.concat(F.when(F.col("start") == F.col("span.cs"), "B-").otherwise("I-"), F.col("span.label")))
    ids = F.create_map(*[F.lit(x) for pair in label_ids(tags).items() for x in pair])
    return first.withColumn("tag", tag).select(*tokens.columns, "tag", F.coalesce(F.try_element_at(ids, F.col("tag")), F.lit(0)).alias("label_id"))


def invalid(labelled: DataFrame) -> DataFrame:
    """Tokens whose I- tag follows O or opens the document (W6); a document without any is valid."""
    previous = F.lag("tag", 1, "O").over(Window.partitionBy("doc_id").orderBy("pos"))
    return labelled.withColumn("previous", previous).where((F.col("previous") == "O") & F.startswith("tag", F.lit("I-")))


def validity(labelled: DataFrame) -> DataFrame:
    bad = invalid(labelled).groupBy("doc_id").agg(F.count("*").alias("n_invalid"))
    return labelled.select("doc_id").distinct().join(bad, "doc_id", "left").select("doc_id", F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"))


def conll(labelled: DataFrame) -> DataFrame:
    """Each document as lines of token, tab, tag, without a last line end."""
    line = F.concat_ws("\t", "tok", "tag")
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return labelled.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("conll"))


def conll_of_arrays(tokens, tags):
    """The same from parallel arrays, cut to the shorter of the two."""
    n = F.least(F.size(tokens), F.size(tags))
    pairs = F.arrays_zip(F.slice(tokens, 1, n).alias("tok"), F.slice(tags, 1, n).alias("tag"))
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("\t", p["tok"], p["tag"])), "\n")
