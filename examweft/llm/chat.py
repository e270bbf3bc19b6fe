"""Relational chat formatting with Spark expressions only.

A conversation becomes ``<s>``, its blocks, ``</s>``. An array aggregation merges adjacent turns of one role
into a block, ``<|=role|>text`` and for each further turn ``<|+role|>text``. Inside roles and texts
a backslash, ``<`` and ``[`` (in roles ``|`` as well) are written as two characters that hold none of
them, so that no text can hold a control string, and reading back is exact.

Turn structs are collected in two steps, first for stretches of ``CHUNK`` turns at most, then for the
conversation: a long conversation is sorted, merged and escaped in many tasks, and only its finished
stretches meet. A stretch is cut by turn number and then, where turns are tied or repeated, by rank. A conversation's formatted text is one value, so Spark's 2 GB limit of a value holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
BEGIN, END = "<s>", "</s>"
#: The escapes, fixed values: what stands in a text, and the letter written after a backslash for it.
ESCAPES = {"<": "l", "[": "b", "|": "p"}


def escape(text: Column, characters: str = "<[") -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in characters:
        out = F.replace(out, F.lit(c), F.lit("\\" + ESCAPES[c]))
    return out


def unescape(text: Column) -> Column:
    """Pairs of backslashes first cut the text; what lies between them holds only the other escapes."""

    def part(x: Column) -> Column:
        for c, letter in ESCAPES.items():
            x = F.replace(x, F.lit("\\" + letter), F.lit(c))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted string, n_turns, loss_spans array<struct<start,end>> in code points of ``formatted``.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns go by number, then role,
    then text, so that ties and repeated rows have one defined order, and each of them is written. A null
    role or text counts as empty, a null turn comes first, rows of a null conv_id form one conversation.
    The spans cover the texts of ``loss_roles``, one for each turn, without the marks around them.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / CHUNK).alias("chunk"),
        F.struct("turn", role.alias("role"), text.alias("text")).alias("t"),
    )
    rank = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("t")) - 1
    ranked = rows.withColumn("part", F.floor(rank / CHUNK))
    stretch = ranked.groupBy("conv_id", "chunk", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def merged(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        block = lambda texts: F.array(F.struct(t["role"].alias("role"), texts.alias("texts")))
        grown = F.concat(F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))), block(F.concat(last["texts"], F.array(t["text"]))))
        return F.when(last["role"] == t["role"], grown).otherwise(F.concat(blocks, block(F.array(t["text"]))))

    def written(block: Column, i: Column) -> Column:
        """The parts of a block; a stretch's first part gets its mark where stretches are joined."""

        def part(text: Column, j: Column) -> Column:
            mark = F.when(j > 0, "<|+").when(i > 0, "<|=").otherwise("")
            head, body = F.concat(mark, escape(block["role"], "<[|"), F.lit("|>")), escape(text)
            return F.struct(F.concat(head, body).alias("s"), F.length(head).alias("h"), F.length(body).alias("b"), block["role"].isin(*loss_roles).alias("loss"))

        return F.transform(block["texts"], part)

    spans_type = "array<struct<start:int,end:int>>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["h"]
        span = F.array(F.struct(start.alias("start"), (start + p["b"]).alias("end")))
        return F.struct((start + p["b"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans_type).alias("spans"))
    stretch = stretch.withColumn("blocks", F.aggregate("ts", none, merged)).withColumn("ps", F.flatten(F.transform("blocks", written))).select(
        "conv_id",
        F.struct(
            "chunk",
            "part",
            F.col("ts")[0]["role"].alias("first"),
            F.element_at("ts", -1)["role"].alias("last"),
            F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("s"),
            F.aggregate("ps", start, step).alias("mask"),
            F.size("ts").alias("n"),
        ).alias("c"),
    )
    whole = stretch.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))

    def joined(c: Column, i: Column) -> Column:
        same = (i > 0) & (F.col("cs")[F.greatest(i - 1, F.lit(0))]["last"] == c["first"])
        return F.concat(F.when(same, "<|+").otherwise("<|="), c["s"])

    def shifted(c: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("cs", 1, i), F.lit(len(BEGIN)), lambda at, x: at + x["mask"]["at"] + 3)
        return F.transform(c["mask"]["spans"], lambda s: F.struct((s["start"] + before + 3).alias("start"), (s["end"] + before + 3).alias("end")))

    return whole.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("cs", joined), ""), F.lit(END)).alias("formatted"),
        F.aggregate("cs", F.lit(0).cast("long"), lambda n, c: n + c["n"]).alias("n_turns"),
        F.flatten(F.transform("cs", shifted)).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>, one for each row that went in."""
    parts = F.filter(F.split(formatted, "<"), lambda p: p.startswith("|"))

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(3)), "|>", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + 5)).alias("text"))

    return F.transform(parts, turn)


#: Spans that are read together: bounds how often a stretch of the text is passed over.
TOGETHER = 64


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the spans of the loss mask cover, unescaped, one after another. Spans are in order; groups of them are cut out
    of the text first, and each span out of its group's part."""

    def cut(text: Column, span: Column, before: Column) -> Column:
        return F.substr(text, span["start"] - before + 1, span["end"] - span["start"])

    def group(i: Column) -> Column:
        own = F.slice(spans, i * TOGETHER + 1, F.lit(TOGETHER))
        begin, end = own[0]["start"], F.element_at(own, -1)["end"]
        part = F.array(F.struct(F.substr(formatted, begin + 1, end - begin).alias("text"), begin.alias("begin"), own.alias("own")))
        return F.array_join(F.flatten(F.transform(part, lambda p: F.transform(p["own"], lambda s: unescape(cut(p["text"], s, p["begin"]))))), "")

    groups = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / TOGETHER).cast("int"))
    return F.when(F.size(spans) == 0, "").otherwise(F.array_join(F.transform(groups, group), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations: turns read back from the formatted text, loss text by its mask."""
    back = formatted.withColumn("back", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
