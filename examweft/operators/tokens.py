"""Tagged and plain text to tokens and spans with exact code-point offsets.

A text is cut into pieces that cover all of it, and offsets are running sums of piece lengths: positions
from the regular-expression engine would count UTF-16 units. Windows are partitioned by document, so work
spreads by documents; one document's pieces are ordered together. Texts are dealt over partitions before they
are cut, so that no piece is shuffled, and spans carry no text while they are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft.functions.text import WS, attributes
from examweft.schemas import BASE_TAGS

#: Formulas, page marks, words, other characters; or white space.
TOKEN = rf"(?sU)((?:\$\$.*?\$\$|\$.*?\$|<\|page\|>Page \p{{Nd}}+|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}])|[{WS}]+)"
PIECE = r"(?sU)(</?[a-zA-Z_0-9\-]+(?:\s+[^>]*)?>|[^<]+|<)"
TAG = r"(?sU)^<(/?)([a-zA-Z_0-9\-]+)(?:\s+([^>]*))?>$"
#: The characters of ``WS``.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BOLD_LABELS = ("option_label", "question_label")


def _pieces(df: DataFrame, text: str, pattern: str) -> DataFrame:
    whole = df.select("doc_id", text).repartition("doc_id")
    return whole.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("p", "piece"))


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, tok, start, end for (doc_id, text); a null or empty text has no tokens."""
    w = Window.partitionBy("doc_id").orderBy("p")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = _pieces(docs, text, TOKEN).select(
        "doc_id", "p", "piece", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int").alias("start")
    )
    kept = placed.where(~F.rlike("piece", F.lit(rf"(?U)^[{WS}]+$")))
    return kept.select(
        "doc_id", (F.row_number().over(w) - 1).alias("pos"), F.col("piece").alias("tok"), "start", (F.col("start") + F.length("piece")).alias("end")
    )


def token_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n, starts, stops, toks (in order) of each document that has tokens: what ``tokens`` gives, without a row for each of
    them, a sort or a shuffle. The memory is that of one text."""
    cut = docs.select("doc_id", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)).alias("pieces"))
    word = lambda p: ~F.contains(F.lit(BLANKS), F.left(p, F.lit(1)))  # noqa: E731  no token begins with white space
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("at", "starts", "stops")))

    def add(s: Column, p: Column) -> Column:
        end, counts = s["at"] + F.length(p), word(p)
        return F.struct(end.alias("at"), (s["starts"] + F.when(counts, s["at"]).otherwise(0)).alias("starts"), (s["stops"] + F.when(counts, end).otherwise(0)).alias("stops"))

    summed = cut.select("doc_id", F.aggregate("pieces", zero, add).alias("s"), F.filter("pieces", word).alias("toks"))
    return summed.select("doc_id", F.size("toks").cast("long").alias("n"), "s.starts", "s.stops", "toks").where("n > 0")


def raw_text(tagged: str = "tagged", tags: tuple[str, ...] = BASE_TAGS):
    """The text without its allowed tags; any other tag is text. A column expression, no shuffle."""
    pieces = F.regexp_extract_all(tagged, F.lit(PIECE), F.lit(1))
    return F.array_join(F.filter(pieces, lambda p: ~F.regexp_extract(p, TAG, 2).isin(*tags)), "")


def spans(docs: DataFrame, tagged: str = "tagged", tags: tuple[str, ...] = BASE_TAGS) -> DataFrame:
    """doc_id, close_order, start, end, label, text, params for (doc_id, tagged), numbered as they close.

    Each tag name is a stack of its own: a close belongs to the innermost open of its name. Closes without
    an open, and opens without a close, make no span. Bold marks around a label belong to it.
    """
    w = Window.partitionBy("doc_id").orderBy("p")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    name = F.regexp_extract("piece", TAG, 2)
    pieces = _pieces(docs, tagged, PIECE).select("doc_id", "p", "piece", F.when(name.isin(*tags), name).alias("tag"))
    placed = pieces.select(
        "doc_id", "p", "tag", "piece",
        F.coalesce(F.sum(F.when(F.col("tag").isNull(), F.length("piece")).otherwise(0)).over(before), F.lit(0)).cast("int").alias("at"),
        F.coalesce(F.startswith(F.lead("piece").over(w), F.lit("**")), F.lit(False)).alias("bold_after"),
    ).where("tag is not null")
    by_tag = Window.partitionBy("doc_id", "tag").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.regexp_extract("piece", TAG, 1) == "/", -1).otherwise(1)
    summed = placed.withColumn("step", step).withColumn("level", F.sum("step").over(by_tag))
    floored = summed.withColumn("low", F.least(F.min("level").over(by_tag), F.lit(0)))
    floored = floored.withColumn("depth", F.col("level") - F.col("low") + F.when(F.col("step") < 0, 1).otherwise(0))
    lag = Window.partitionBy("doc_id", "tag", "depth").orderBy("p")
    orphan = (F.col("step") < 0) & (F.col("low") < F.coalesce(F.lag("low").over(Window.partitionBy("doc_id", "tag").orderBy("p")), F.lit(0)))
    paired = (
        floored.withColumn("orphan", orphan)
        .where("not orphan")
        .withColumn("open", F.lag(F.struct("at", "piece", "step")).over(lag))
        .where((F.col("step") < 0) & (F.col("open.step") > 0))
    )
    mine = paired.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "tag", F.col("open.at").alias("begin"), F.col("at").alias("finish"), F.regexp_extract("open.piece", TAG, 3).alias("attrs"), "bold_after"))).alias("found"))
    both = mine.join(docs.select("doc_id", raw_text(tagged, tags).alias("raw")), "doc_id")

    def wide(x: Column) -> Column:
        bold = x["tag"].isin(*BOLD_LABELS) & (x["begin"] >= 2) & x["bold_after"] & (F.substr("raw", x["begin"] - 1, F.lit(2)) == "**")
        w = F.when(bold, 2).otherwise(0)
        start, end = x["begin"] - w, x["finish"] + w
        return F.struct(start.alias("start"), end.alias("end"), x["tag"].alias("label"), F.substr("raw", start + 1, end - start).alias("text"), x["attrs"].alias("attrs"))

    closed = both.select("doc_id", F.posexplode(F.transform("found", wide)).alias("k", "s"))
    return closed.select("doc_id", (F.col("k") + 1).alias("close_order"), "s.start", "s.end", "s.label", "s.text", attributes(F.col("s.attrs")).alias("params"))
