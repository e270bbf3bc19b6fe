"""Questions out of plain text, line by line (X17): kinds of lines, then runs between question lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions.text import identity, lines, strip
from examweft.plans.common import joined, ordered, with_placeholders

#: Patterns of lines (fixed values); a question's number is group 2 and its text group 4.
QUESTION = r"(?siuU)^(\*\*|\b)?((?:Câu|Question)\s*\p{Nd}+[.:*]*)(\*\*)?\s*(.*)"
OPTION = r"(?sU)^(?:[-*]\s*)?(\*\*|\b)?([A-D])[.:)](\*\*)?\s*(.*)"
STIMULUS = r"""(?iU)(?:stimulus_id|refer_to_stimulus)\s*=\s*["']?([a-zA-Z0-9_\-]+)"""
EXPLANATIONS = ("hướng dẫn", "lời giải", "giải thích")


def explains(line: Column) -> Column:
    low = F.lower(line)
    out = F.startswith(low, F.lit(EXPLANATIONS[0]))
    for start in EXPLANATIONS[1:]:
        out = out | F.startswith(low, F.lit(start))
    return out


def parse_lines(docs: DataFrame, text: str = "text", question: str = QUESTION, option: str = OPTION) -> DataFrame:
    """doc_id, n, id, question_number, stem, options, correct_answer, explanation, stimulus_id for (doc_id, text).

    A question runs from its line to the next one; what precedes the first is dropped. Lines before the
    first option continue the stem, later ones the option before them. The last line that explains
    counts, and the first stimulus reference. Questions without stem and options don't count.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.select("doc_id", F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    kind = F.when(F.rlike("line", F.lit(question)), "q").when(F.rlike("line", F.lit(option)), "o").when(explains(F.col("line")), "e").otherwise("t")
    rows = rows.withColumn("kind", kind).withColumn("q", F.count_if(F.col("kind") == "q").over(so_far)).where("q > 0")
    in_question = Window.partitionBy("doc_id", "q").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("o", F.count_if(F.col("kind") == "o").over(in_question)).withColumn("stimulus", F.nullif(F.regexp_extract("line", STIMULUS, 1), F.lit("")))
    grouped = rows.groupBy("doc_id", "q").agg(ordered("pos", "kind", "o", "line", "stimulus").alias("ls"))
    of = lambda test: F.filter("ls", test)
    stem = joined(F.transform(of(lambda x: (x["o"] == 0) & x["kind"].isin("q", "t")), lambda x: F.when(x["kind"] == "q", strip(F.regexp_extract(x["line"], question, 4))).otherwise(x["line"])))
    # An option's lines are those from its own to the next one's: two lists of places, side by side.
    begins = F.filter(F.transform("ls", lambda x, i: F.when(x["kind"] == "o", i + 1)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins), F.lit(1))), F.array(F.size("ls") + 1))
    places = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda p: p["a"].isNotNull())
    options = F.transform(F.transform(places, lambda p: F.slice("ls", p["a"], p["n"])), lambda ys: F.struct(
        F.upper(F.regexp_extract(ys[0]["line"], option, 2)).alias("label"),
        joined(F.transform(F.filter(ys, lambda y: y["kind"].isin("o", "t")), lambda y: F.when(y["kind"] == "o", strip(F.regexp_extract(y["line"], option, 4))).otherwise(y["line"]))).alias("text"),
    ))
    number = strip(F.replace(F.regexp_extract(F.col("ls")[0]["line"], question, 2), F.lit("*"), F.lit("")))
    explanation = F.coalesce(F.try_element_at(F.transform(of(lambda x: x["kind"] == "e"), lambda x: x["line"]), F.lit(-1)), F.lit(""))
    stimulus = F.try_element_at(F.transform(of(lambda x: x["stimulus"].isNotNull()), lambda x: x["stimulus"]), F.lit(1))
    found = grouped.select("doc_id", "q", number.alias("question_number"), stem.alias("stem"), options.alias("options"), explanation.alias("explanation"), stimulus.alias("stimulus_id"))
    kept = found.where((F.col("stem") != "") | (F.size("options") > 0)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("q")))
    return kept.select(
        "doc_id", "n", identity("q_", F.col("doc_id"), F.col("n")).alias("id"), "question_number", "stem",
        with_placeholders(F.col("options")).alias("options"), F.lit("").alias("correct_answer"), "explanation", "stimulus_id",
    )
