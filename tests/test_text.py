import re

import pytest
from pyspark.sql import functions as F

from examweft.functions import text as X


def values(spark, fn, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_and_strip(spark):
    assert values(spark, X.normalize_answer, "(a) ", "\tB\n", None, "a)b(", " c\x1c") == ["A", "B", "", "AB", "C"]
    assert values(spark, X.clean_grade, "Lớp 12", "lỚP10", "Grade 5", "a Lớp b Lớp c") == ["12", "10", "Grade 5", "a b Lớp c"]
    assert values(spark, X.clean_option_label, "**A.** ", " : ", "B)") == ["A", "A", "B)"]
    assert values(spark, X.shown_option_label, "A", "A.", "A)") == ["A.", "A.", "A)"]


def test_markdown(spark):
    assert values(spark, X.strip_markdown, "# H\n**b** _i_ `c` [l](u)\n> q\n- x\n2. y", None) == ["H\nb i c l\nq\nx\ny", ""]
    assert values(spark, X.mark_gaps, "a ____ b --- c .. d ....") == ["a {{GAP}} b {{GAP}} c .. d {{GAP}}"]
    parts = values(spark, X.underlined_parts, "a<u>b</u>c<U>d</U>")[0]
    assert [(p.hit, p.text) for p in parts] == [(False, "a"), (True, "<u>b</u>"), (False, "c"), (True, "<U>d</U>")]
    assert [p.hit for p in values(spark, X.html_table_parts, "x<table>1</table>y\n<TABLE a>\n2</TABLE>")[0]] == [False, True, False, True]


def test_section_titles(spark):
    got = values(spark, lambda c: X.section_title(c, F.lit(3)), "part  ii: x", "Section 4\nread the", "\n short line\nmore", "a line that is much too long for it", "Read the text", None, "")
    assert got == ["PART  II", "SECTION 4", "SHORT LINE", "Section 3", "Section 3", "Section 3", "Section 3"]


def test_tables(spark):
    assert values(spark, X.table_cells, "| a | b|", "||", "|") == [["a", "b"], [""], []]
    assert values(spark, lambda c: X.is_separator_row(X.table_cells(c)), "|---|:-:|", "| a |", "| |") == [True, False, False]
    assert values(spark, X.is_divider, "---", "***  ", "-- -") == [True, True, False]


@pytest.mark.parametrize(("raw", "want"), [
    ("<think>a</think> b", "b"), ("x <think>y", "x"), ("```xml\n<a>\n```", "<a>"), ("```\na\nb", "a\nb"), ("```", "```"), ("<think>\n1</think>```\nz\n``` ", "z"),
])
def test_clean_reply(spark, raw, want):
    assert values(spark, X.clean_reply, raw) == [want]


def test_attributes(spark):
    assert values(spark, X.attributes, """a="1" b='2' c=3 a="4" d=""", "", 'x=""') == [{"a": "4", "b": "2", "c": "3"}, {}, {"x": ""}]


def test_continuation(spark):
    full = "x" * 200 + "the anchor text that follows here" + "y" * 50
    def at(expected, following):
        return spark.range(1).select(X.continuation_offset(F.lit(expected), F.lit(following), F.lit(full)).alias("o")).first().o
    def want(expected, following):
        a, lo, hi = following[:100], max(0, expected - 80), min(len(full), expected + 80)
        if not a:
            return expected
        i = full.find(a, lo, hi)
        if i < 0 and a.strip() and a.strip() != a:
            i = full.find(a.strip(), lo, hi)
        return expected if i < 0 else i
    for args in ((190, "the anchor"), (190, "  the anchor "), (0, "the anchor"), (5, ""), (200, "nowhere"), (233, "y" * 30)):
        assert at(*args) == want(*args), args


def test_small_ones(spark):
    assert values(spark, lambda c: X.format_seconds(c.cast("int")), "61", "6000") == ["01:01", "100:00"]
    assert values(spark, X.shown_date, "2024-03-05T10:00:00", "x", None) == ["05/03/2024", "---", "---"]
    assert values(spark, X.token_estimate, "a b c", " ".join(["w"] * 100)) == [54, 234]
    assert values(spark, X.page_count, "<|page|>Page 1\n\na<|page|>Page 2") == [2]
    assert [tuple(r) for r in values(spark, lambda c: X.batch_ranges(c.cast("int"), F.lit(3)), "7")[0]] == [(0, 3), (3, 6), (6, 7)]
    assert values(spark, lambda c: X.batch_ranges(c.cast("int"), F.lit(3)), "0") == [[]]
    assert values(spark, X.lines, "a\r\nb\x85c\n") == [re.split("x", "axbxc")]


def test_section_titles_in_capitals_of_the_sql(spark, tmp_path):
    """The operator writes ß as the original does, the query as its SQL."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    texts = ["Zutz. Dem er erßch.", "einü ßbe", "ŉ ǰ ﬁ ΐ ᾳ ÿ", "😀 ß x", "part ii ß", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(entry.oracle_sql()["section_titles"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    got = entry.queries()["section_titles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and (0, "ZUTZ. DEM ER ERẞCH.") in want
    assert values(spark, lambda c: X.section_title(c, F.lit(1)), "einü ßbe") == ["EINÜ SSBE"]
