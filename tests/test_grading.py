import pytest
from pyspark.sql import functions as F

from examweft import schemas
from examweft.functions import scoring
from examweft.operators import catalog, gradebook, grading
from examweft.plans import storage
from examweft.sources import readers, sinks


def question(i, key="A", number="", section="", stimulus="", stem="s", options=(("A", "a"), ("B", "b"))):
    return (i, number or i, stem, [{"label": a, "text": b} for a, b in options], key, "", None, stimulus, section)


def exams(spark, rows):
    return spark.createDataFrame(rows, schemas.EXAMS)


@pytest.fixture(scope="module")
def graded(spark):
    many = [question(f"m{i}") for i in range(16)]
    papers = exams(spark, [
        ("e1", "Một", "s", "g", 45, "2024", [question("q1"), question("q2", "(b)"), question("q3", ""), question("q4", None), question("q1", "B")]),
        ("e2", "None", "s", "g", 45, "2024", []),
        ("e3", "Many", "s", "g", 45, "2024", many),
    ])
    asked = spark.createDataFrame([
        ("e1", "An", None, {"q1": "(a) ", "q2": "B\t", "extra": "C"}),
        ("e2", "An", "X", {}),
        ("e3", "An", "X", {"m0": "a", **{f"m{i}": "  " for i in range(1, 16)}}),
        ("gone", "An", "X", {}),
    ], schemas.REQUESTS)
    return {r.exam_id: r for r in grading.grade(asked, papers, F.lit("t")).collect()}, grading.grade(asked, papers, F.lit("t"))


def test_grades(graded):
    rows, _ = graded
    assert set(rows) == {"e1", "e2", "e3"}
    assert [r.is_correct for r in rows["e1"].detailed_results] == [True, True, True, True, False]
    assert rows["e1"].student_code == schemas.DEFAULT_STUDENT_CODE
    assert (rows["e2"].score, rows["e2"].total_questions) == (0.0, 0)
    assert (rows["e3"].score, rows["e3"].percentage) == (0.62, 6.2)


def test_outcomes_overlap(graded):
    counts = {r.id: r for r in grading.outcome_counts(graded[1]).collect()}
    r = counts[graded[0]["e1"].id]
    assert (r.total, r.correct, r.incorrect, r.empty) == (5, 4, 1, 2)
    r = counts[graded[0]["e3"].id]
    assert (r.total, r.correct, r.incorrect, r.empty) == (16, 1, 0, 15)


def test_answer_sheet(graded):
    sheet = {r.id: r.sheet for r in grading.answer_sheet(graded[1]).collect()}[graded[0]["e1"].id]
    assert sheet.startswith("EXAM RESULTS: Một\nStudent: An\nScore: 8.0/10 (4/5 correct)\n")
    assert sheet.endswith("Question 5: Selected (a)  - INCORRECT (Correct answer: B)\n")


def test_scores_like_python(spark):
    rows = spark.range(121).select(F.col("id").cast("int").alias("n")).crossJoin(spark.range(121).select(F.col("id").cast("int").alias("c"))).where("c <= n")
    for r in rows.select("n", "c", scoring.score(F.col("c"), F.col("n")).alias("s"), scoring.percentage(F.col("c"), F.col("n")).alias("p")).collect():
        assert r.s == round(r.c / max(1, r.n) * 10.0, 2) and r.p == round(r.c / max(1, r.n) * 100, 1)


def test_import_and_edit(spark):
    df = exams(spark, [("e", "t", "s", "g", 45, "", [question("q1"), question("q2")])])
    reply = F.lit('Sure: ```{"q2": " c ", "qx": "A"}```')
    got = df.select(grading.import_answers(F.col("questions"), grading.answer_mapping(reply)).alias("q"), grading.edit_question(F.col("questions"), 1, stem="new").alias("e"), grading.prune_questions(F.col("questions")).alias("p"), grading.import_answers(F.col("questions"), grading.answer_mapping(F.lit("no json"))).alias("n")).first()
    assert [q.correct_answer for q in got.q] == ["A", "C"] and [q.correct_answer for q in got.n] == ["A", "A"]
    assert [q.stem for q in got.e] == ["s", "new"] and got.p[0].options == ["A", "B"]


def test_dedupe_keeps_place_and_last_value(spark):
    df = exams(spark, [("e", "t", "s", "g", 45, "", [question("a", stem="1"), question("b", stem="2"), question("a", stem="3")])])
    assert [(q.id, q.stem) for q in df.select(catalog.dedupe_questions(F.col("questions")).alias("q")).first().q] == [("a", "3"), ("b", "2")]


def test_gradebook(spark):
    subs = spark.createDataFrame([("1", "e1", "TOÁN", 5.0, 1), ("2", "gone", "Lý", 4.9, 2), ("3", "e1", "Toán mới", 10.0, 3)], "id string, exam_id string, exam_title string, score double, pos int")
    known = exams(spark, [("e1", "t", "s", "g", 60, "", [])])
    assert {r.id: r.duration for r in gradebook.rows(subs, known).collect()} == {"1": "60", "2": "---", "3": "60"}
    assert {r.id for r in gradebook.rows(subs, known, "toán", exam_id="all").collect()} == {"1", "3"}
    assert tuple(gradebook.summary(subs).first()) == (3, "6.63", "66.7")
    assert tuple(gradebook.summary(subs.where("false")).first()) == (0, "0.00", "0.0")
    assert [(r.exam_id, r.exam_title) for r in gradebook.exam_options(subs, "pos").collect()] == [("e1", "Toán mới"), ("gone", "Lý")]


def test_catalog(spark):
    df = spark.createDataFrame([("Lớp 12",), ("LỚP 9",), ("Đại học",), ("",), (None,), ("12",)], "grade string")
    assert [r.grade for r in catalog.distinct_grades(df).collect()] == ["9", "12", "Đại học"]
    rows = spark.createDataFrame([("Toán", "a"), ("Lý", None)], "title string, subject string")
    assert catalog.search(rows, "toÁN", ("title", "subject")).count() == 1 and catalog.search(rows, "", ("title",)).count() == 2
    assert catalog.facets(rows, title="Lý", subject="all").count() == 1 and catalog.active_filters(a="all", b=None, c=1) == 1
    assert catalog.remove_by_id(rows, "Lý", "title").count() == 1


def test_storage(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "n")], "id string, v string")
    new = spark.createDataFrame([("2", "c"), ("2", "d"), ("3", "e")], "id string, v string").withColumn("n", F.monotonically_increasing_id())
    assert {tuple(r) for r in storage.upsert(old, new, version="n").collect() if r.id} >= {("1", "a"), ("3", "e")}
    assert {r.id for r in storage.sync(old, new.drop("n").dropDuplicates(["id"])).collect()} == {"2", "3"}
    assert storage.sync(old, new.drop("n").where("false")).count() == 0
    assert {r.id for r in storage.deleted(old, new).collect()} == {"1", None}
    subs = spark.createDataFrame([("s1", "1"), ("s2", "2")], "id string, exam_id string")
    left, rest = storage.delete_exams(old, subs, spark.createDataFrame([("1",)], "id string"))
    assert {r.id for r in left.collect()} == {"2", None} and [r.id for r in rest.collect()] == ["s2"]
    changes = spark.createDataFrame([("t", 1, "pending", 10), ("t", 2, None, 99), ("t", 3, "completed", None), ("t", 4, None, 80)], "id string, seq int, status string, progress int")
    assert tuple(storage.latest(changes, "id", "seq", ["status", "progress"]).first()) == ("t", "completed", 80)


def test_sink_files(spark, tmp_path):
    docs = spark.createDataFrame([("in_1", "in_1.md", "a\tO")], "stem string, name string, conll string")
    named = sinks.named_outputs(docs, "name")
    assert named.first().output == "real_exam_8c54c334"
    sinks.write_texts(named, str(tmp_path / "many"), "conll")
    assert [(r.name, r.text) for r in readers.named_texts(spark, str(tmp_path / "many")).collect()] == [("real_exam_8c54c334", "a\tO")]
    sinks.write_files(named, str(tmp_path / "conll"), "conll")
    assert next((tmp_path / "conll" / "output=real_exam_8c54c334").glob("*.txt")).read_text().rstrip("\n") == "a\tO"
    assert '"stem":"in_1"' in sinks.annotation_json(named).first().value


def test_repeated_changes(spark):
    """Several changes for one identifier make one row; the highest version counts, and null can be set where it is named."""
    exams = spark.createDataFrame([("a", "t", 1), ("b", "u", 2)], "id string, title string, duration_minutes int")
    changes = spark.createDataFrame([("a", "n1", 7, 1), ("a", "n2", 8, 2), ("b", None, None, 1)], "id string, title string, duration_minutes int, v int").repartition(3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(storage.update_exam(exams, changes, "v")) == [("a", "n2", 8), ("b", "u", 2)]
    named = changes.withColumn("fields", F.array(F.lit("title")))
    assert [tuple(r) for r in storage.update_exam(exams, named, "v").orderBy("id").collect()] == [("a", "n2", 1), ("b", None, 2)]
    new = changes.select("id", "title", "duration_minutes", "v").where("id = 'a'")
    assert rows(catalog.replace_by_id(exams, new, version="v")) == [("a", "n2", 8), ("b", "u", 2)]
    for n in (1, 4):
        assert rows(storage.upsert(exams, new.repartition(n))) == [("a", "n2", 8), ("b", "u", 2)]
    assert rows(storage.migrated(exams, exams)) == rows(exams) and rows(storage.migrated(exams.where("false"), exams)) == rows(exams)


def test_places_without_one_task(spark):
    from examweft.operators import ranks

    rows = [(i, (i * 37) % 101 if i % 9 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, key long").repartition(7).withColumns({"row": F.lit(1), "at": F.lit(2), "part": F.lit(3), "a.b": F.lit(4)})
    found = ranks.placed(df, F.col("key").desc_nulls_last(), "id")
    got = {r.id: r.place for r in found.collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [i for i, _ in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1000))
    assert found.columns == [*df.columns, "place"] and ranks.placed(df.where("false"), "id").count() == 0
