"""The exam markup language: reading it into exams (X18) and writing exams in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft import schemas
from examweft.functions.text import identity, strip
from examweft.plans.common import with_placeholders

#: Patterns and defaults of the language (fixed values).
OPTION = r"(?U)^(?:(?:\(?([A-Da-d])\s*[./])|(?:\(([A-Da-d])\))|(?:\[([A-Da-d])\]))\s+(.*)$"
NUMBER = r"(?iuU)^(\**(?:Câu|Question|[0-9]+)?\s*[0-9]+\**[.:*]*)\s*(.*)"
INLINE = r"(?iU)(?:\s+|^)[(\[]?([A-D])[)\].]+\s+(.*?)(?=\s+[(\[]?[A-D][)\].]+\s+|$)"
META = {"title": "Đề Thi Mới", "subject": "Toán Học", "grade": "Lớp 12"}
LEAST_INLINE = 3  # options within a stem count from so many on (W8)


def _after_colon(line: Column) -> Column:
    return strip(F.substr(line, F.instr(line, F.lit(":")) + 1))


def _blocks(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, meta, block, mode, ls: the lines after each marker with their kind, cut within the row; one row with nulls without any
    marker. Lines of the exam's own data belong to no block."""
    begins = lambda low, *words: F.rlike(low, F.lit(f"^(?:{'|'.join(words)}):"))

    def line(x: Column, i: Column) -> Column:
        low = F.lower(strip(x))
        kind = F.when(begins(low, *META, "duration"), "meta").when(low.isin("[stimulus]", "[question]"), "marker")
        return F.struct(i.alias("pos"), kind.alias("kind"), x.alias("line"), strip(x).alias("trimmed"))

    whole = docs.where(F.col(text).isNotNull()).select("doc_id", F.transform(F.split(text, r"\r?\n"), line).alias("all"))
    starts = F.transform(F.filter("all", lambda x: x["kind"] == "marker"), lambda x: x["pos"])
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(0))), F.array(F.size("all")))
    metas = F.filter("all", lambda x: x["kind"] == "meta")
    last = lambda name: _after_colon(F.try_element_at(F.filter("metas", lambda x: F.startswith(F.lower(x["trimmed"]), F.lit(f"{name}:"))), F.lit(-1))["line"])
    placed = whole.withColumns({"starts": starts, "metas": metas}).withColumn("ends", ends)
    lists = F.zip_with("starts", F.slice("ends", F.lit(1), F.size("starts")), lambda a, b: F.struct(
        F.lower(F.col("all")[a]["trimmed"]).alias("mode"), F.filter(F.slice("all", a + 2, b - a - 1), lambda x: x["kind"].isNull()).alias("ls")))
    minutes = F.regexp_extract(F.coalesce(last("duration"), F.lit("")), r"^([+-]?[0-9]+)", 1).try_cast("int")
    meta = F.struct(*(F.coalesce(last(name), F.lit(default)).alias(name) for name, default in META.items()), F.coalesce(F.nullif(minutes, F.lit(0)), F.lit(schemas.DEFAULT_DURATION)).alias("duration_minutes"))
    cut = placed.select("doc_id", meta.alias("meta"), F.posexplode_outer(lists).alias("block", "b"))

    def kind(x: Column) -> Column:
        low = F.lower(x["trimmed"])
        return (
            F.when(F.startswith(low, F.lit("id:")), "id")
            .when(F.col("b.mode") == "[stimulus]", "text")
            .when(F.startswith(low, F.lit("refer:")), "refer")
            .when(F.rlike(low, F.lit("^(?:answer|correct):")), "answer")
            .when(F.startswith(low, F.lit("explanation:")), "explanation")
            .when(F.rlike(x["trimmed"], F.lit(OPTION)), "option")
            .otherwise("text")
        )

    ls = F.transform("b.ls", lambda x: F.struct(x["pos"].alias("pos"), kind(x).alias("kind"), x["line"].alias("line"), x["trimmed"].alias("trimmed")))
    return cut.select("doc_id", "meta", "block", F.col("b.mode").alias("mode"), ls.alias("ls"))


def _parsed(blocks: DataFrame) -> DataFrame:
    """The blocks with what they say as a question, ``keeps`` where they are one, and as a passage: ``passage_id`` and ``passage``."""
    of = lambda kind: F.filter("ls", lambda x: x["kind"] == kind)
    last = lambda kind: F.try_element_at(of(kind), F.lit(-1))["trimmed"]
    explained = F.transform(of("explanation"), lambda x: F.struct(x["pos"].alias("pos"), strip(F.substr(x["line"], F.instr(F.lower(x["line"]), F.lit("explanation:")) + 12)).alias("value")))
    own = strip(F.array_join(F.transform(of("text"), lambda x: x["line"]), "\n"))
    base = blocks.select(
        "doc_id", "meta", "mode", "block", "ls", own.alias("own"), explained.alias("es"), strip(F.substr(last("id"), F.lit(4))).alias("id"), strip(F.substr(last("refer"), F.lit(7))).alias("refer"),
        F.upper(_after_colon(last("answer"))).alias("answer"),
        F.transform(of("option"), lambda x: F.struct(
            F.upper(F.concat(*(F.regexp_extract(x["trimmed"], OPTION, g) for g in (1, 2, 3)))).alias("label"), strip(F.regexp_extract(x["trimmed"], OPTION, 4)).alias("text"))).alias("options"),
    )
    # A text line belongs to the explanation where the last explanation line before it says anything.
    in_force = lambda x: F.try_element_at(F.filter("es", lambda e: e["pos"] < x["pos"]), F.lit(-1))
    texts = F.filter("ls", lambda x: x["kind"] == "text")
    parted = base.select(
        "*", F.filter(texts, lambda x: F.coalesce(in_force(x)["value"], F.lit("")) == "").alias("ss"),
        F.try_element_at("es", F.lit(-1)).alias("e"),
    )
    more = F.transform(F.filter("ls", lambda x: (x["kind"] == "text") & (x["pos"] > F.col("e.pos"))), lambda x: x["line"])
    explanation = F.when(F.coalesce("e.value", F.lit("")) == "", "").otherwise(strip(F.array_join(F.concat(F.array("e.value"), more), "\n")))
    numbered = F.try_element_at(F.filter("ss", lambda x: F.rlike(x["trimmed"], F.lit(NUMBER))), F.lit(1))
    parted = parted.withColumns({"explanation": explanation, "first": numbered})
    tail = F.transform(F.filter("ss", lambda x: F.col("first").isNull() | (x["pos"] > F.col("first.pos"))), lambda x: x["line"])
    head = F.when(F.col("first").isNull(), F.array().cast("array<string>")).otherwise(F.array(strip(F.regexp_extract("first.trimmed", NUMBER, 2))))
    parted = parted.withColumn("parts", F.concat(head, tail)).withColumns({
        "stem": strip(F.array_join("parts", "\n")),
        "number": strip(F.regexp_replace(F.regexp_extract("first.trimmed", NUMBER, 1), "[.:*]", "")),
    })
    keeps = (F.col("mode") == "[question]") & (F.exists("parts", lambda p: p != "") | (F.size("options") > 0))
    passage = (F.col("mode") == "[stimulus]") & (F.coalesce("id", F.lit("")) != "") & (F.col("own") != "")
    labels, values = (F.regexp_extract_all("stem", F.lit(INLINE), F.lit(g)) for g in (1, 2))
    inline = (F.size("options") == 0) & (F.size(labels) >= LEAST_INLINE)
    found = F.transform(F.arrays_zip(labels.alias("a"), values.alias("b")), lambda z: F.struct(F.upper(z["a"]).alias("label"), strip(z["b"]).alias("text")))
    return parted.withColumn("inline", inline).select(
        "doc_id", "meta", "block", F.coalesce(keeps, F.lit(False)).alias("keeps"), F.when(passage, F.col("id")).alias("passage_id"), F.when(passage, F.col("own")).alias("passage"), "id", "number",
        F.when(F.col("inline"), strip(F.split("stem", INLINE, 2)[0])).otherwise(F.col("stem")).alias("stem"),
        F.when(F.col("inline"), found).otherwise(F.col("options")).alias("options"), F.coalesce("answer", F.lit("")).alias("correct_answer"), "explanation", F.coalesce("refer", F.lit("")).alias("stimulus_id"),
    )


def parse_markup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, title, subject, grade, duration_minutes, questions for (doc_id, text).

    Passages are known to the questions after them. What is no exam is one with defaults and no questions. A text is cut
    into blocks within its row; blocks, not lines, are then put in order, once, without a join.
    """
    order = Window.partitionBy("doc_id").orderBy("block")
    named = Window.partitionBy("doc_id", F.coalesce("passage_id", "stimulus_id")).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = _parsed(_blocks(docs, text)).withColumn("known", F.last("passage", ignorenulls=True).over(named))
    placed = known.withColumn("n", F.count_if("keeps").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    blank = F.lit("")
    question = F.struct(
        "n", F.coalesce(F.nullif("id", blank), identity("q_", F.col("doc_id"), F.col("n"))).alias("id"),
        F.coalesce(F.nullif("number", blank), F.concat(F.lit("Câu "), F.col("n").cast("string"))).alias("question_number"),
        "stem", with_placeholders(F.col("options")).alias("options"), "correct_answer", "explanation", "stimulus_id", F.coalesce("known", blank).alias("stimulus_text"), F.lit(None).cast("string").alias("section"),
    )
    lists = F.transform(F.array_sort(F.collect_list(F.when(F.col("keeps"), question))), lambda q: F.struct(*(q[f].alias(f) for f in _FIELDS)))
    none = F.array().cast(f"array<{schemas.QUESTION}>")
    found = placed.groupBy("doc_id").agg(F.first("meta").alias("meta"), lists.alias("questions"))
    return found.select("doc_id", "meta.*", F.coalesce("questions", none).alias("questions"))


_FIELDS = ("id", "question_number", "stem", "options", "correct_answer", "explanation", "stimulus_id", "stimulus_text", "section")


def serialize(title: Column, subject: Column, grade: Column, duration: Column, questions: Column) -> Column:
    """An exam in the markup language: each passage once, before the first question that names it and has its text."""
    has = lambda q: (F.coalesce(q["stimulus_id"], F.lit("")) != "") & (F.coalesce(q["stimulus_text"], F.lit("")) != "")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))

    def question(q: Column, i: Column) -> Column:
        first = has(q) & ~F.exists(F.slice(questions, F.lit(1), i), lambda p: has(p) & (p["stimulus_id"] == q["stimulus_id"]))
        return F.concat(
            F.when(first, say("[Stimulus]\nId: ", q["stimulus_id"], "\n", strip(q["stimulus_text"]), "\n\n")).otherwise(""),
            F.lit("[Question]\n"),
            F.when(F.coalesce(q["stimulus_id"], F.lit("")) != "", say("Refer: ", q["stimulus_id"], "\n")).otherwise(""),
            say(q["question_number"], ": ", strip(q["stem"]), "\n"),
            F.array_join(F.transform(q["options"], lambda o: say(o["label"], ". ", o["text"], "\n")), ""),
            say("Answer: ", q["correct_answer"], "\n"),
            F.when(F.coalesce(q["explanation"], F.lit("")) != "", say("Explanation: ", strip(q["explanation"]), "\n")).otherwise(""),
            F.lit("\n"),
        )

    head = say("Title: ", title, "\nSubject: ", subject, "\nGrade: ", grade, "\nDuration: ", duration.cast("string"), "\n\n")
    return strip(F.concat(head, F.array_join(F.transform(questions, question), "")))
