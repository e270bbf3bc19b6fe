"""Questions out of labelled spans (X16): what opens a question is decided by windows, its parts by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions.text import clean_option_label, identity, strip
from examweft.plans.common import joined, ordered, with_placeholders

HEADS = ("question", "question_label")


def param(name: str) -> Column:
    return F.nullif(F.try_element_at(F.col("params"), F.lit(name)), F.lit(""))


def reading_order(spans: DataFrame) -> DataFrame:
    """Spans with ``seq``: by start, the outer before the inner, then as they closed."""
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "close_order")
    return spans.withColumn("seq", F.row_number().over(w)).withColumn("text", strip(F.coalesce("text", F.lit(""))))


def stimuli(spans: DataFrame) -> DataFrame:
    """doc_id, seq, stimulus_id, text of each passage; one without an identifier gets the next number.

    The number counts the distinct passages before it. An explicit identifier that looks like a later
    number is not told apart from it.
    """
    rows = reading_order(spans).where("label = 'stimulus'").withColumn("own", F.try_element_at(F.col("params"), F.lit("id")))
    first = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy("seq")) == 1
    fresh = F.when(F.col("own").isNull() | first, 1).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("fresh", fresh).withColumn("n", F.coalesce(F.sum("fresh").over(before), F.lit(0)) + 1)
    return numbered.select("doc_id", "seq", F.coalesce("own", F.concat(F.lit("stim_"), F.col("n").cast("string"))).alias("stimulus_id"), "text")


def parse_spans(spans: DataFrame) -> DataFrame:
    """doc_id, n, id, question_number, stem, options, correct_answer, explanation, stimulus_id, stimulus_text, section.

    A ``question`` always opens one; a ``question_label`` does if there is none, or text has come since
    the last head; a ``stem`` if there is none. A section ends the passage in force. A question's passage
    is the last one that its head or stems name, or else the one in force, with its text as known there.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    known = stimuli(spans)
    rows = reading_order(spans).join(known.select("doc_id", "seq", F.col("stimulus_id").alias("defined")), ["doc_id", "seq"], "left")
    label = F.col("label")
    passage = F.when(label.isin("section", "stimulus"), F.struct("defined"))
    rows = rows.withColumns({
        "section": F.coalesce(F.last(F.when(label == "section", F.col("text")), ignorenulls=True).over(so_far), F.lit("")),
        "active": F.last(passage, ignorenulls=True).over(so_far)["defined"],
        "open": F.coalesce(F.max(label.isin(*HEADS, "stem")).over(before), F.lit(False)),
    })
    content = ((label == "stem") & (F.col("text") != "")) | ((label == "option_text") & F.col("open"))
    rows = rows.withColumn("c", F.count_if(content).over(so_far))
    rows = rows.withColumns({"c_before": F.coalesce(F.lag("c").over(w), F.lit(0)), "c_head": F.coalesce(F.last(F.when(label.isin(*HEADS), F.col("c")), ignorenulls=True).over(before), F.lit(0))})
    starts = (label == "question") | ((label == "question_label") & (~F.col("open") | (F.col("c_before") > F.col("c_head")))) | ((label == "stem") & ~F.col("open"))
    rows = rows.withColumn("q", F.count_if(starts).over(so_far)).where("q > 0")
    named = F.when(label.isin(*HEADS), F.coalesce(param("stimulus_id"), param("refer_to_stimulus"), param("stimulus_ref"), F.nullif("active", F.lit(""))))
    named = named.when(label == "stem", F.coalesce(param("stimulus_id"), F.nullif("active", F.lit(""))))
    rows = rows.withColumn("named", named)
    grouped = rows.groupBy("doc_id", "q").agg(ordered("seq", "label", "text", "named", "section").alias("rs"), F.min_by("params", "seq").alias("params"))
    of = lambda *kinds: F.filter("rs", lambda r: r["label"].isin(*kinds))
    last = lambda rs, name: F.try_element_at(F.transform(rs, lambda r: r[name]), F.lit(-1))
    head = F.col("rs")[0]
    marks = of("option_label", "option_text")
    # Shifted by one instead of looked up by place, so that an option's cost doesn't grow with their number.
    previous = F.concat(F.array(F.lit(None).cast("string")), F.transform(marks, lambda r: F.when(r["label"] == "option_label", r["text"])))
    labelled = F.zip_with(marks, previous, lambda r, p: F.struct(r["label"].alias("kind"), r["text"].alias("text"), F.when(p.isNotNull(), clean_option_label(p)).alias("before")))
    options = F.transform(F.filter(labelled, lambda r: r["kind"] == "option_text"), lambda r, k: F.struct(F.coalesce(r["before"], F.concat(F.lit("Option "), (k + 1).cast("string"))).alias("label"), r["text"].alias("text")))
    source = F.try_element_at(F.filter("rs", lambda r: r["named"].isNotNull()), F.lit(-1))
    found = grouped.select(
        "doc_id", "q", "params", head["section"].alias("section"), head["label"].alias("opened_by"),
        last(of("question_label"), "text").alias("number"), joined(F.transform(of("stem"), lambda r: r["text"])).alias("stem"), options.alias("options"),
        F.coalesce(last(of("explanation"), "text"), F.lit("")).alias("explanation"), source["named"].alias("stimulus_id"), source["seq"].alias("at"),
    )
    kept = found.where((F.col("stem") != "") | (F.size("options") > 0)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("q")))
    texts = (
        kept.select("doc_id", "q", "stimulus_id", "at").join(known.withColumnRenamed("text", "known"), ["doc_id", "stimulus_id"])
        .where("seq < at").groupBy("doc_id", "q").agg(F.max_by("known", "seq").alias("stimulus_text"))
    )
    default = F.concat(F.lit("Câu "), F.col("n").cast("string"))
    own_number = F.when(F.col("opened_by") == "question", param("question_number"))
    return kept.join(texts, ["doc_id", "q"], "left").select(
        "doc_id", "n", F.coalesce(param("id"), identity("q_", F.col("doc_id"), F.col("n"))).alias("id"),
        F.coalesce("number", own_number, default).alias("question_number"), "stem", with_placeholders(F.col("options")).alias("options"),
        F.when(F.col("opened_by") == "stem", "").otherwise(F.coalesce(F.try_element_at("params", F.lit("correct_answer")), F.lit(""))).alias("correct_answer"),
        "explanation", "stimulus_id", F.coalesce("stimulus_text", F.lit("")).alias("stimulus_text"), "section",
    )


def structured(spans: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Questions from spans; documents whose spans give none are parsed line by line instead."""
    from examweft.plans.parse_lines import parse_lines

    found = parse_spans(spans)
    rest = parse_lines(docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti"), text)
    return found.unionByName(rest.withColumns({"stimulus_text": F.lit(""), "section": F.lit("")}))
