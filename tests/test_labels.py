import random
import re

import pytest
from pyspark.sql import functions as F

from examweft.operators import bio, tokens
from examweft.plans import annotation
from examweft.schemas import BASE_TAGS

TEXTS = ["", "a $x+1$ b", "$$y\nz$$, q", "odd $ sign", "<|page|>Page 12 x", "Câu 1. Tiếng Việt", "é x²", "😀ab\tc d\u001ce", " lead _x_ ", "a$b$c$d"]


def brute_tokens(text):
    """Characters in turn: a formula, a page mark, a word, or one character; white space stands between."""
    out, i = [], 0
    word = lambda c: c == "_" or c.isalnum()
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        j = 0
        if text.startswith("$$", i) and (k := text.find("$$", i + 2)) >= 0:
            j = k + 2
        elif text[i] == "$" and (k := text.find("$", i + 1)) >= 0:
            j = k + 1
        elif m := re.compile(r"<\|page\|>Page \d+").match(text, i):
            j = m.end()
        elif word(text[i]):
            j = next((k for k in range(i, len(text)) if not word(text[k])), len(text))
        j = j or i + 1
        out.append((text[i:j], i, j))
        i = j
    return out


def test_tokens(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id int, text string")
    got = {}
    for r in tokens.tokens(docs).orderBy("doc_id", "pos").collect():
        assert r.pos == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.tok, r.start, r.end))
    assert {i: v for i, t in enumerate(TEXTS) if (v := brute_tokens(t))} == got


TAG = re.compile(r"<(/?)([A-Za-z_0-9-]+)(\s[^>]*)?>")


def brute_spans(tagged, allowed=BASE_TAGS):
    raw, spans, opened, i = "", [], {}, 0
    while i < len(tagged):
        m = TAG.match(tagged, i)
        if not m or m[2] not in allowed:
            raw += m[0] if m else tagged[i]
            i = m.end() if m else i + 1
            continue
        i = m.end()
        stack = opened.setdefault(m[2], [])
        if not m[1]:
            params = {}
            for a in re.finditer(r"""([A-Za-z_0-9-]+)=("[^"]*"|'[^']*'|\S+)""", m[3] or ""):
                params[a[1]] = a[2][1:-1] if a[2][0] in "\"'" and len(a[2]) > 1 else a[2]
            stack.append((len(raw), params))
        elif stack:
            start, params = stack.pop()
            spans.append([start, len(raw), m[2], params, tagged[i : i + 2] == "**"])
    for s in spans:
        if s[2].endswith("_label") and s[4] and s[0] >= 2 and raw[s[0] - 2 : s[0]] == "**":
            s[0], s[1] = s[0] - 2, s[1] + 2
    return raw, [(a, b, t, raw[a:b], p) for a, b, t, p, _ in spans]


def soup(rng):
    names = ["stem", "question", "option_label", "question_label", "u", "section"]
    parts = []
    for _ in range(rng.randint(0, 14)):
        parts.append(rng.choice(["a ", "**", "😀x", "\n", "<", "b c", " "]) if rng.random() < 0.5 else rng.choice([f"<{n}>", f"</{n}>", f'<{n} id="s 1">', f"<{n} k='v' k=w>"]) if (n := rng.choice(names)) else "")
    return "".join(parts)


@pytest.fixture(scope="module")
def soups():
    rng = random.Random(5)
    return [soup(rng) for _ in range(300)] + ["**<option_label>A</option_label>** x", "<u <section>x</section>", "</stem>a<stem>b", None]


def test_spans(spark, soups):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(soups)], "doc_id int, tagged string")
    got = {}
    for r in tokens.spans(docs).orderBy("doc_id", "close_order").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.label, r.text, r.params))
    assert got == {i: v for i, t in enumerate(soups) if t and (v := brute_spans(t)[1])}
    raws = {r.doc_id: r.raw for r in docs.select("doc_id", tokens.raw_text().alias("raw")).collect()}
    assert all(raws[i] == (brute_spans(t)[0] if t is not None else None) for i, t in enumerate(soups))


@pytest.mark.parametrize("stride", [3, 512])
def test_labels(spark, soups, stride):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(soups)], "doc_id int, tagged string")
    found = tokens.tokens(docs.select("doc_id", tokens.raw_text().alias("text")))
    labelled = bio.align(found, tokens.spans(docs), stride=stride)
    want, lines, bad = {}, {}, {}
    for i, t in enumerate(soups):
        raw, spans = brute_spans(t or "")
        tags = []
        for tok, a, _ in brute_tokens(raw):
            tag = "O"
            for s, e, name, text, _p in spans:
                if text.strip():
                    cs, ce = s + len(text) - len(text.lstrip()), e - len(text) + len(text.rstrip())
                    if cs <= a < ce:
                        tag = ("B-" if a == cs else "I-") + name
                        break
            tags.append((tok, tag))
        if tags:
            want[i], lines[i] = tags, "\n".join(f"{a}\t{b}" for a, b in tags)
            bad[i] = sum(b[0] == "I" and p == "O" for (_, b), p in zip(tags, ["O", *(x[1] for x in tags)], strict=False))
    got = {}
    for r in labelled.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.tok, r.tag))
        assert r.label_id == bio.label_ids()[r.tag]
    assert got == want
    assert {r.doc_id: r.conll for r in bio.conll(labelled).collect()} == lines
    assert {r.doc_id: r.n_invalid for r in bio.validity(labelled).collect()} == bad


def test_label_ids():
    ids = bio.label_ids()
    assert len(ids) == 17 and ids["O"] == 0 and all((v % 2 == 1) == (k[0] == "B") for k, v in ids.items() if v)


def test_rounds(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rounds = spark.createDataFrame([
        ("d", 1, "<stem>one two</stem> three"), ("d", 2, " <stem>four</stem> five"), ("d", 3, " six <stem>seven</stem><|END|>"), ("d", 4, "<stem>eight</stem>"),
    ], "doc_id string, round int, tagged string")
    got = annotation.annotated_spans(docs, rounds).orderBy("close_order").collect()
    assert [(r.text, text[r.start : r.end]) for r in got] == [("one two", "one two"), ("four", "four"), ("seven", "seven")]
    assert [tuple(r)[1:] for r in annotation.preservation(docs, docs.select("doc_id", F.lit("<stem>one</stem> " + text[4:]).alias("tagged"))).collect()] == [(True, True)]


def test_every_document_is_continued(spark, tmp_path):
    """Short and empty texts, repeated passages and white space at the seam, against the original's rule."""
    from examweft.plans.queries import QUERIES

    texts = ["", "a", "ab", "short text", "la " * 40, "same line\n" * 60, "x" * 500, "word " * 9 + " " * 150 + "end", " ".join(f"w{i}" for i in range(300)), "ab" * 25 + " " + "ab" * 25]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def want(text):
        half = len(text) // 2
        low, high, anchor = max(0, half - 80), min(len(text), half + 80), text[half:][:100]
        for a in (anchor, anchor.strip()):
            if a and (i := text.find(a, low, high)) >= 0:
                return i
        return half

    got = {r.doc_id: r.second_offset for r in QUERIES["continuation_offsets"](spark, str(tmp_path)).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)} and any(v != len(texts[i]) // 2 for i, v in got.items())


def test_token_sums_are_those_of_the_tokens(spark):
    """The same as by rows, without moving any."""
    texts = ["a b, $x y$ é😀\u2003z", "", None, " \x1c\n", "<|page|>Page 12 w", "$$a\nb$$", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sums = tokens.token_sums(docs)
    rows = tokens.tokens(docs).groupBy("doc_id").agg(F.count("*"), F.sum("start"), F.sum("end"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda t: t["tok"]))
    got = sorted((tuple(r) for r in sums.collect()), key=lambda r: r[0])
    assert got == sorted((tuple(r) for r in rows.collect()), key=lambda r: r[0]) and [r[0] for r in got] == [0, 4, 5, 6]
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()


def test_label_vocabulary_moves_no_text_of_tokens(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "<p>a b</p> c"), (2, "<h1>d</h1>"), (3, "")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = entry.queries()["label_vocabulary"](spark, str(tmp_path))
    assert {r.tag: r.n_tokens for r in df.collect() if r.n_tokens} == {"B-p": 1, "I-p": 1, "O": 1, "B-h1": 1} and df.count() == 15
    assert " AS tok" not in df._jdf.queryExecution().optimizedPlan().toString()
