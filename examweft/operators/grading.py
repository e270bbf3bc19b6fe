"""Grading: one pass over each submission's own questions, without exploding them and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examweft import schemas
from examweft.functions import scoring
from examweft.functions.text import identity, json_object, normalize_answer


def detailed_results(questions: Column, answers: Column) -> Column:
    """One result for each question in order, repeated identifiers included; no answer counts as an empty one."""

    def result(q: Column) -> Column:
        given = F.coalesce(F.try_element_at(answers, q["id"]), F.lit(""))
        key = F.coalesce(q["correct_answer"], F.lit(""))
        return F.struct(
            q["id"].alias("question_id"), q["question_number"].alias("question_number"), q["stem"].alias("stem"), q["options"].alias("options"),
            given.alias("student_answer"), key.alias("correct_answer"), (normalize_answer(given) == normalize_answer(key)).alias("is_correct"),
            q["explanation"].alias("explanation"), q["stimulus_text"].alias("stimulus_text"),
        )

    return F.transform(F.coalesce(questions, F.array().cast(f"array<{schemas.QUESTION}>")), result)


def grade(requests: DataFrame, exams: DataFrame, submitted_at: Column | None = None) -> DataFrame:
    """Submissions for requests (exam_id, student_name, student_code, answers); those for unknown exams go (404).

    Exams are joined by identifier; Spark broadcasts them only where they are small. Identifiers are digests of exam,
    student, code, answers and, where the requests have it, a column ``request_key`` (``storage.numbered_repeats``), so that a
    task that runs again makes the same ones. Without that column equal requests get equal identifiers.
    """
    keyed = requests.join(exams.select(F.col("id").alias("exam_id"), F.col("title").alias("exam_title"), "questions"), "exam_id")
    return grade_in_place(keyed, submitted_at)


def grade_in_place(keyed: DataFrame, submitted_at: Column | None = None) -> DataFrame:
    """The same for requests that have their exam's title (exam_title) and questions at hand: no join, no shuffle."""
    graded = keyed.withColumn("detailed_results", detailed_results(F.col("questions"), F.col("answers")))
    total = F.size("detailed_results")
    correct = F.size(F.filter("detailed_results", lambda r: r["is_correct"]))
    return graded.withColumns({"total_questions": total, "correct_count": correct}).select(
        identity("sub_", *map(F.col, ("exam_id", "student_name", "student_code")), F.to_json("answers"), *([F.col("request_key")] if "request_key" in keyed.columns else [])).alias("id"),
        "exam_id", F.coalesce("exam_title", F.lit("")).alias("exam_title"), "student_name",
        F.coalesce("student_code", F.lit(schemas.DEFAULT_STUDENT_CODE)).alias("student_code"),
        (submitted_at if submitted_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("submitted_at"),
        "total_questions", "correct_count",
        scoring.score(F.col("correct_count"), F.col("total_questions")).alias("score"),
        scoring.percentage(F.col("correct_count"), F.col("total_questions")).alias("percentage"),
        "detailed_results",
    )


def outcome_counts(submissions: DataFrame) -> DataFrame:
    """total, correct, incorrect, empty for each submission (A5); the last three may overlap."""
    def having(outcome: str) -> Column:
        return F.size(F.filter("detailed_results", lambda r: scoring.outcomes(r["student_answer"], r["is_correct"])[outcome])).alias(outcome)

    return submissions.select("id", F.size("detailed_results").alias("total"), *map(having, ("correct", "incorrect", "empty")))


def results_with_outcome(submissions: DataFrame, outcome: str) -> DataFrame:
    """The results of one outcome, with their place in the submission."""
    rows = submissions.select("id", F.posexplode("detailed_results").alias("pos", "r")).select("id", "pos", "r.*")
    return rows if outcome == "all" else rows.where(scoring.outcomes(F.col("student_answer"), F.col("is_correct"))[outcome])


def option_highlight(label: Column, chosen: Column, key: Column, mode: str = "normalized") -> Column:
    """How an option shows: chosen and right, chosen and wrong, right, or plain.

    Modes compare labels normalised, raw, or raw with both sides non-empty.
    """
    if mode == "normalized":
        label, chosen, key = normalize_answer(label), normalize_answer(chosen), normalize_answer(key)
    same = lambda a: (a == label) & ((a != "") & (label != "") if mode == "nonempty" else F.lit(True))
    return F.when(same(chosen) & same(key), "chosen-correct").when(same(chosen), "chosen-wrong").when(same(key), "correct").otherwise("plain")


def prune_questions(questions: Column) -> Column:
    """Only what answer mapping needs: identifier, number, option labels."""
    return F.transform(questions, lambda q: F.struct(q["id"].alias("id"), q["question_number"].alias("question_number"), F.transform(q["options"], lambda o: o["label"]).alias("options")))


def edit_question(questions: Column, index: int, **fields: str) -> Column:
    """The question at ``index`` with new stem, correct_answer or explanation."""

    def edited(q: Column, i: Column) -> Column:
        new = q
        for name, value in fields.items():
            new = new.withField(name, F.lit(value))
        return F.when(i == index, new).otherwise(q)

    return F.transform(questions, edited)


def edit_option(questions: Column, index: int, option: int, text: str) -> Column:
    def edited(q: Column, i: Column) -> Column:
        options = F.transform(q["options"], lambda o, k: F.when(k == option, o.withField("text", F.lit(text))).otherwise(o))
        return F.when(i == index, q.withField("options", options)).otherwise(q)

    return F.transform(questions, edited)


def merge_answer(answers: Column, question_id: Column, label: Column) -> Column:
    """The answer map with one more answer; a later one for the same question counts."""
    rest = F.map_filter(F.coalesce(answers, F.create_map().cast("map<string,string>")), lambda k, v: k != question_id)
    return F.map_concat(rest, F.create_map(question_id, label))


def answer_mapping(reply: Column) -> Column:
    """Question identifiers and labels out of a model's reply: from the first brace to the last, as a map."""
    return F.from_json(json_object(reply), "map<string,string>")


def import_answers(questions: Column, mapping: Column) -> Column:
    """Keys replaced where the mapping has the question, trimmed and in upper case; others stay."""
    return F.transform(questions, lambda q: F.when(
        F.coalesce(F.map_contains_key(mapping, q["id"]), F.lit(False)),
        q.withField("correct_answer", F.upper(F.trim(F.try_element_at(mapping, q["id"])))),
    ).otherwise(q))


def answer_sheet(submissions: DataFrame) -> DataFrame:
    """A graded submission as plain text."""
    def line(r: Column, i: Column) -> Column:
        given = F.when(r["student_answer"] == "", "No response").otherwise(r["student_answer"])
        end = F.when(r["is_correct"], "CORRECT").otherwise(F.concat(F.lit("INCORRECT (Correct answer: "), r["correct_answer"], F.lit(")")))
        return F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(": Selected "), given, F.lit(" - "), end, F.lit("\n"))

    head = F.concat(
        F.lit("EXAM RESULTS: "), "exam_title", F.lit("\nStudent: "), "student_name", F.lit("\nScore: "), F.col("score").cast("string"), F.lit("/10 ("),
        F.col("correct_count").cast("string"), F.lit("/"), F.col("total_questions").cast("string"), F.lit(" correct)\nAccuracy rate: "), F.col("percentage").cast("string"), F.lit("%\n\nGRADED BREAKDOWN:\n"),
    )
    return submissions.select("id", F.concat(head, F.array_join(F.transform("detailed_results", line), "")).alias("sheet"))
