import random

import pytest
from pyspark.sql import functions as F

from examweft import schemas
from examweft.plans import markup
from examweft.plans.parse_lines import parse_lines
from examweft.plans.parse_spans import parse_spans, structured
from examweft.plans.routing import annotator_endpoint, chat_endpoint, target_model

LINES = """Preamble
**Câu 1:** What stimulus_id="s1"
goes on
A. one
more
**B.** two
(C) not an option
a. nor this
Lời giải: first
Giải thích: second
Question 2. 
Câu 3
- C) three
câu 4* last
Hướng dẫn x"""


def test_lines(spark):
    docs = spark.createDataFrame([("d", LINES), ("e", "nothing here"), ("n", None), ("z", "")], "doc_id string, text string")
    rows = parse_lines(docs).orderBy("n").collect()
    assert [(r.n, r.question_number, r.stem, r.explanation, r.stimulus_id) for r in rows] == [
        (1, "Câu 1:", 'What stimulus_id="s1" goes on', "Giải thích: second", "s1"), (2, "Câu 3", "", "", None), (3, "câu 4", "last", "Hướng dẫn x", None)]
    assert [(o.label, o.text) for o in rows[0].options] == [("A", "one more"), ("B", "two (C) not an option a. nor this")]
    assert [(o.label, o.text) for o in rows[1].options] == [("C", "three")] and len(rows[2].options) == 4
    assert len({r.id for r in rows}) == 3


def span(doc, *parts):
    return [(doc, k, k, k + 1, label, text, params) for k, (label, text, *rest) in enumerate(parts) for params in [rest[0] if rest else {}]]


def test_spans(spark):
    rows = [
        *span("a", ("section", "S1"), ("stimulus", "text one", {"id": "p1"}), ("question_label", "Câu 1"), ("stem", "what"), ("option_label", "**A.**"), ("option_text", "x"), ("option_text", "y"),
              ("question_label", "Câu 2", {"refer_to_stimulus": "later"}), ("question_label", "Câu 2b"), ("stem", "two"), ("section", "S2"), ("question", "", {"question_number": "Q3", "id": "own", "correct_answer": "B"}),
              ("stem", "three"), ("explanation", "because"), ("stimulus", "late", {"id": "later"})),
        *span("b", ("stem", "alone"), ("explanation", "e1"), ("question_label", "5"), ("explanation", "only")),
        *span("c", ("question_label", "7"), ("explanation", "nothing else")),
    ]
    df = spark.createDataFrame(rows, schemas.SPANS)
    got = {}
    for r in parse_spans(df).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r)
    a = got["a"]
    assert [(r.question_number, r.stem, r.stimulus_id, r.stimulus_text, r.section) for r in a] == [
        ("Câu 1", "what", "p1", "text one", "S1"), ("Câu 2b", "two", "p1", "text one", "S1"), ("Q3", "three", None, "", "S2")]
    assert [(o.label, o.text) for o in a[0].options] == [("A", "x"), ("Option 2", "y")]
    assert (a[2].id, a[2].correct_answer, a[2].explanation, len(a[2].options)) == ("own", "B", "because", 4)
    assert [(r.question_number, r.stem, r.explanation) for r in got["b"]] == [("Câu 1", "alone", "e1")]
    assert "c" not in got
    docs = spark.createDataFrame([("a", "x"), ("c", "Câu 1. by lines")], "doc_id string, text string")
    assert {r.doc_id: r.stem for r in structured(df, docs).where("doc_id = 'c'").collect()} == {"c": "by lines"}


MARKUP = """Title: T1
Duration: abc

[Stimulus]
Id: s1
Passage

line two
[Question]
Refer: s1
**Câu 1.** stem one
more stem
A. first
(b) second
[C] third
Answer: b
Explanation: why
and more
Subject: mid
[Question]
Id: own
Refer: s2
text before
2: pick (A) red (B) green (C) blue
[Question]
3. few (A) red (B) green
correct: a
[Stimulus]
Id: s2
too late
[Question]

[Question]
D/ only option"""


def test_markup(spark):
    docs = spark.createDataFrame([("m", MARKUP), ("w", MARKUP.replace("\n", "\r\n")), ("x", "no markup")], "doc_id string, text string")
    rows = {r.doc_id: r for r in markup.parse_markup(docs).collect()}
    for key in "mw":
        r = rows[key]
        assert (r.title, r.subject, r.grade, r.duration_minutes) == ("T1", "mid", "Lớp 12", 45)
        q = r.questions
        assert [x.question_number for x in q] == ["Câu 1", "2", "3", "Câu 4"]
        assert [x.stem for x in q] == ["stem one\nmore stem", "pick", "few (A) red (B) green", ""]
        assert [(o.label, o.text) for o in q[0].options] == [("A", "first"), ("B", "second"), ("C", "third")]
        assert [(o.label, o.text) for o in q[1].options] == [("A", "red"), ("B", "green"), ("C", "blue")]
        assert (q[0].correct_answer, q[0].explanation, q[0].stimulus_text) == ("B", "why\nand more", "Passage\n\nline two")
        assert (q[1].id, q[1].stimulus_id, q[1].stimulus_text) == ("own", "s2", "")
        assert (q[2].correct_answer, len(q[2].options), [o.label for o in q[3].options]) == ("A", 4, ["D"])
    assert rows["x"].questions == [] and rows["x"].title == "Đề Thi Mới"


def test_round_trip(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["sum", "Việt", "x y", "2+2", "end."])
    exams = []
    for e in range(40):
        qs = [(f"q{i}", f"Câu {i + 1}", f"{word()} {word()}", [{"label": a, "text": word()} for a in "ABC"[: rng.randint(1, 3)]], rng.choice("ABC"), rng.choice(["", word()]), sid, f"passage {sid}" if sid else "", None)
              for i in range(rng.randint(0, 5)) for sid in [rng.choice(["", "s1", "s2"])]]
        exams.append((str(e), f"t {e}", word(), word(), rng.randint(1, 90), "", qs))
    df = spark.createDataFrame(exams, schemas.EXAMS)
    text = df.select(F.col("id").alias("doc_id"), markup.serialize(F.col("title"), F.col("subject"), F.col("grade"), F.col("duration_minutes"), F.col("questions")).alias("text"))
    back = {r.doc_id: r for r in markup.parse_markup(text).collect()}
    shape = lambda q: (q["question_number"] if isinstance(q, dict) else q.question_number, q.stem, [(o.label, o.text) for o in q.options], q.correct_answer, q.explanation, q.stimulus_id or "", q.stimulus_text)
    for r in df.collect():
        b = back[r.id]
        assert (b.title, b.subject, b.grade, b.duration_minutes) == (r.title, r.subject, r.grade, r.duration_minutes)
        assert [shape(q) for q in b.questions] == [shape(q) for q in r.questions]


@pytest.mark.parametrize(("provider", "model", "primary", "gateway", "chat", "annotator", "target"), [
    (None, "deepseek-v4-pro", True, False, "hosted", "hosted", "deepseek-ai/deepseek-v4-pro"), (None, "a/b", True, True, "gateway", "gateway", "a/b"),
    (None, "mn/x", True, True, "gateway", "gateway", "mn/x"), ("primary", "a/b", False, True, "primary", "primary", "a/b"), (None, "MiniMax", True, True, "gateway", "gateway", "mn/MiniMax"),
    (None, "deepseek-chat", False, True, "gateway", "gateway", "deepseek/deepseek-chat"), (None, "deepseek-chat", True, True, "primary", "primary", "deepseek-chat"),
])
def test_routing(spark, provider, model, primary, gateway, chat, annotator, target):
    df = spark.createDataFrame([(provider, model, primary, gateway)], "p string, m string, a boolean, b boolean")
    args = [F.col(c) for c in "pmab"]
    r = df.select(chat_endpoint(*args).alias("c"), annotator_endpoint(*args).alias("x"), target_model(chat_endpoint(*args), F.col("m")).alias("t")).first()
    assert tuple(r) == (chat, annotator, target)


def test_markup_is_read_without_joins(spark):
    """One shuffle, of blocks; passages of one name change from question to question."""
    text = "Title: t\n[Stimulus]\nId: s\none\n[Question]\nRefer: s\n1. a\n[Stimulus]\nId: s\ntwo\n[Question]\nRefer: s\n2. b\nGrade: g\n[Question]\n\n[Question]\nRefer: x\n3. c"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Duration: 7")], "doc_id int, text string")
    parsed = markup.parse_markup(docs)
    got = {r.doc_id: (r.title, r.grade, r.duration_minutes, [(q.stem, q.stimulus_text) for q in r.questions]) for r in parsed.collect()}
    assert got[1] == ("t", "g", 45, [("a", "one"), ("b", "two"), ("c", "")]) and got[4][2:] == (7, []) and got[2][3] == [] and set(got) == {1, 2, 4}
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "MergeJoin" not in plan and "HashJoin" not in plan
