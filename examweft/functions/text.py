"""Column expressions over exam text. All of them stay in the JVM; none is a Python function at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F, as a Java class body.
WS = r"\s\x1c-\x1f"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def strip(x: Column) -> Column:
    """Without white space at either end (``trim`` would drop spaces only)."""
    return F.regexp_replace(x, rf"(?U)^[{WS}]+|[{WS}]+$", "")


def blank(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit(""))) == ""


def lines(x: Column) -> Column:
    """Lines at every Unicode line end; a final line end opens no further line."""
    cut = F.split(x, LINE_END)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def normalize_answer(x: Column) -> Column:
    """An answer for comparison: no parentheses, no white space around, upper case; null is empty."""
    return F.upper(strip(F.translate(F.coalesce(x, F.lit("")), "()", "")))


def contains_text(column: Column, query: str) -> Column:
    """Case-insensitive substring test; an empty query fits everything, null text fits no other."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(F.lit(query)))


def strip_markdown(x: Column) -> Column:
    """Plain text of markdown: headers, emphasis, code, links, quotes and list marks go, in this order."""
    steps = (
        (r"(?mU)^#+\s+", ""),
        (r"(\*\*|__)(.*?)\1", "$2"),
        (r"(\*|_)(.*?)\1", "$2"),
        (r"`([^`]+)`", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?mU)^\s*>\s+", ""),
        (r"(?mU)^\s*[-*+]\s+", ""),
        (r"(?mU)^\s*[0-9]+\.\s+", ""),
    )
    out = F.coalesce(x, F.lit(""))
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


#: Characters whose upper case is longer than one, and their capitals of one.
_CAPITALS = ("ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ")


def upper_by_character(x: Column) -> Column:
    """Upper case as SQL has it, a character for a character: what has no such capital stays, and ß is ẞ (``upper`` makes it SS)."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, *_CAPITALS))
    return F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(F.array_join(F.transform(F.split(x, ""), one), ""))


def section_title(text: Column, ordinal: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    """A heading for a section: its PART or SECTION number, else a short first line, else ``Section n``."""

    def found(word: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?i){word}(?U:\s)+[I|V|X|0-9]+", 0), F.lit(""))

    first = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.lit(1))
    short = F.when((F.length(first) < 20) & ~F.rlike(first, F.lit("(?i)directions|in the|read the")), first)
    return F.coalesce(upper(F.coalesce(found("PART"), found("SECTION"), short)), F.concat(F.lit("Section "), ordinal.cast("string")))


def gap_count(x: Column) -> Column:
    """Fill-in gaps: runs of three or more underscores, hyphens or full stops."""
    return F.coalesce(F.regexp_count(x, F.lit(r"_{3,}|-{3,}|\.{3,}")), F.lit(0))


def mark_gaps(x: Column, mark: str = "{{GAP}}") -> Column:
    """Plain text in which each gap is ``mark``."""
    return strip_markdown(F.regexp_replace(F.coalesce(x, F.lit("")), r"_{3,}|-{3,}|\.{3,}", mark))


def text_parts(x: Column, pattern: str) -> Column:
    """``x`` cut at the matches of ``pattern``: array<struct<hit:boolean,text:string>> in order, no empty part."""
    pieces = F.regexp_extract_all(x, F.lit(rf"(?s)({pattern})|((?:(?!{pattern}).)+)"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.rlike(p, F.lit(rf"(?s)^(?:{pattern})$")).alias("hit"), p.alias("text")))


def underlined_parts(x: Column) -> Column:
    return text_parts(x, "(?i:<u>.*?</u>)")


def html_table_parts(x: Column) -> Column:
    """Text and ``<table>`` elements in order."""
    return text_parts(x, "(?i:<table.*?</table>)")


def html_tables(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?is)<table.*?</table>"), F.lit(0))


def is_table_row(line: Column) -> Column:
    return F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|"))


def table_cells(line: Column) -> Column:
    """The stripped cells of a stripped pipe row; a lone ``|`` has none."""
    cells = F.split(line, r"\|")
    return F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0))), strip)


def is_separator_row(cells: Column) -> Column:
    joined = strip(F.array_join(cells, ""))
    return F.rlike(joined, F.lit(r"(?U)^[|\-:\s]+$")) & F.contains(joined, F.lit("-"))


def is_divider(line: Column) -> Column:
    return F.rlike(line, F.lit(r"(?U)^[-*_]{3,}\s*$"))


def prune_thinking(x: Column) -> Column:
    """Without closed thought blocks, nor an unclosed one to the end."""
    return strip(F.regexp_replace(F.regexp_replace(x, "(?s)<think>.*?</think>", ""), "(?s)<think>.*", ""))


def clean_reply(x: Column) -> Column:
    """A model's reply without thoughts and without the code fence around it."""
    text = prune_thinking(x)
    rows = lines(text)
    inner = F.size(rows) - F.when(strip(F.element_at(rows, -1)) == "```", 2).otherwise(1)
    fenced = F.startswith(text, F.lit("```")) & (F.size(rows) >= 2)
    return F.when(fenced, strip(F.array_join(F.slice(rows, 2, F.greatest(inner, F.lit(0))), "\n"))).otherwise(text)


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), rf"(?U)[{WS}]+"), lambda w: w != ""))


def token_estimate(x: Column) -> Column:
    """Expected tokens of the reply to a text: 1.3 a word and 30 at least, then 1.8 times as many."""
    return (F.greatest(F.lit(30), (word_count(x) * 1.3).cast("int")) * 1.8).cast("int")


def clean_option_label(x: Column) -> Column:
    cleaned = F.regexp_replace(x, rf"(?U)[*.:{WS}]", "")
    return F.when(cleaned == "", "A").otherwise(cleaned)


def shown_option_label(x: Column) -> Column:
    """A label with a full stop unless it ends with one or with a parenthesis."""
    return F.when(F.rlike(x, F.lit("[.)]$")), x).otherwise(F.concat(x, F.lit(".")))


def clean_grade(x: Column) -> Column:
    """A grade without the first word for "class" (X22)."""
    return strip(F.regexp_replace(x, r"(?isU)^(.*?)Lớp\s*(.*)$", "$1$2"))


def format_seconds(x: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(x / 60), F.pmod(x, F.lit(60)))


def shown_date(x: Column, pattern: str = "dd/MM/yyyy", missing: str = "---") -> Column:
    """An ISO timestamp string for display; what is no timestamp shows as missing."""
    return F.coalesce(F.date_format(F.try_to_timestamp(x), pattern), F.lit(missing))


def short_id(prefix: str, *keys: Column) -> Column:
    """A repeatable name for display: prefix and eight hex digits of the keys' digest (X26, K11). It tells few rows apart;
    rows are kept by ``identity``."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("\x1f", *keys)), 1, 8))


def identity(prefix: str, *keys: Column) -> Column:
    """A repeatable identifier by which rows are kept: prefix and 128 bits of the keys' digest (X26, K3). Each key goes in
    with its length before it, null as ``-``, so that no two lists of keys are the same text."""
    texts = [k.cast("string") for k in keys]
    return F.concat(F.lit(prefix), F.md5(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts))))


def output_name(name: Column) -> Column:
    return F.concat(F.lit("real_exam_"), F.substring(F.md5(name), 1, 8))


def json_object(x: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def attributes(x: Column) -> Column:
    """``k="v"``, ``k='v'`` and ``k=v`` as a map; of a repeated key the last value counts."""
    pattern = r"""([a-zA-Z_0-9\-]+)=(?:"([^"]*)"|'([^']*)'|(\S+))"""
    keys = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    values = F.arrays_zip(*(F.regexp_extract_all(x, F.lit(pattern), F.lit(g)).alias(f"v{g}") for g in (2, 3, 4)))
    texts = F.transform(values, lambda v: F.concat(*(F.coalesce(v[f"v{g}"], F.lit("")) for g in (2, 3, 4))))
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"].alias("key"), F.get(texts, e["i"]).alias("value"))))


def continuation_offset(expected: Column, following: Column, full: Column) -> Column:
    """Where a continued chunk begins in the full text: its first 100 characters within 80 of the ``expected`` place,
    else the same without white space around, else the expected place (X14)."""
    low, high = F.greatest(expected - 80, F.lit(0)), F.least(F.length(full), expected + 80)
    window = F.substr(full, low + 1, F.greatest(high - low, F.lit(0)))
    anchor = F.substring(following, 1, 100)
    at, again = F.instr(window, anchor), F.instr(window, strip(anchor))
    return (
        F.when(anchor == "", expected)
        .when(at > 0, low + at - 1)
        .when((strip(anchor) != "") & (again > 0), low + again - 1)
        .otherwise(expected)
    )


def is_complete(x: Column) -> Column:
    return F.contains(x, F.lit("<|END|>"))


def without_end_marker(x: Column) -> Column:
    return F.replace(x, F.lit("<|END|>"), F.lit(""))


def page_count(x: Column) -> Column:
    return F.size(F.split(x, r"<\|page\|>")) - 1


def page_text(number: Column, body: Column) -> Column:
    """A page with its header, as the text-layer fallback writes it."""
    return F.concat(F.lit("<|page|>Page "), number.cast("string"), F.lit("\n\n"), body)


def batch_ranges(n: Column, size: Column) -> Column:
    """Half-open ranges of ``size`` up to ``n``: array<struct<start,end>>."""
    starts = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), size.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).cast("int").alias("end")))


def clamp_progress(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), x))


def ocr_progress(done: Column, total: Column) -> Column:
    return F.lit(10) + (done / F.greatest(F.lit(1), total) * 39).cast("int")


def annotate_progress(streamed: Column, estimated: Column, span: int = 49) -> Column:
    return F.least(F.lit(99), F.lit(50) + (streamed / F.greatest(F.lit(1), estimated) * span).cast("int"))
