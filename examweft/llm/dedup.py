"""Exact dedup as a log-structured merge index over text digests, in DataFrame operations only.

Each task is a memtable: it digests its rows, sorts them by digest and flushes them as one sorted run,
a Parquet file with a Bloom filter and min/max statistics on the digest, which serve lookups of given
texts. Compaction merges runs, and levels made of runs, into one level: an entry for each digest, with
the identifier that stays and the number of rows. Digests of more than one row are hits.

Hits are verified over all their bytes where they are read: each row's memtable entry also has its text's length and a
second digest, of 512 bits and another kind, and compaction keeps the least and the greatest of each. Where these are equal a
group's texts agree in length and in both digests. Where they aren't, two texts share the first digest: the rows of
that digest, and no others, are grouped by the whole text, which compares them byte for byte. No text moves otherwise,
however many rows are hits.

Some 120 bytes a row move in compaction. A Bloom filter of the hits keeps rows that are alone out of the join that hands the
result back; where hits are too many for it, more of these small rows move in vain, but no texts. Groups are
pre-aggregated in each task, so that a text which a third of all rows hold costs one row a task, and the join is one that
adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import materialize, may_be_in, whole_text, without


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: Digests hardly repeat within a run: a dictionary would gain nothing, and the writer leaves the filter out beside one.
SORTED_RUN = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.enable.dictionary#digest": "false"}


def flush(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The sorted runs: (id, digest, exact, length), one file for each memtable, filtered by digest."""
    text = whole_text(text_col)
    runs = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), F.unhex(F.sha2(text, 512)).alias("exact"), F.octet_length(text).cast("long").alias("length"))
    return materialize(runs.sortWithinPartitions("digest", "id"), "runs", **SORTED_RUN)


def lookup(runs: DataFrame, texts: list[str], digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The (id, digest) entries of a few given texts: the digests reach the scan as an IN list, so that each run's
    statistics and Bloom filter pass it over where it has none of them."""
    spark = runs.sparkSession
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(digest(F.col("text"))).collect()]
    return runs.where(F.col("digest").isin([F.lit(bytes(w)) for w in wanted]))


def compact(runs: DataFrame, keep: str = "min") -> DataFrame:
    """Runs as one level: digest, keep_id, n, and the least and greatest ``exact`` and ``length``. ``keep``: which identifier of a
    digest stays, "min" or "max"."""
    bounds = [F.col(c).alias(f"{end}_{c}") for c in ("exact", "length") for end in ("least", "most")]
    return merge([runs.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), *bounds)], keep)


def merge(levels: list[DataFrame], keep: str = "min") -> DataFrame:
    """Levels merged into the next one, sorted like a run; so a growing corpus needs only its new runs read."""
    best = {"min": F.min, "max": F.max}[keep]
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    bounds = [(F.min if end == "least" else F.max)(f"{end}_{c}").alias(f"{end}_{c}") for c in ("exact", "length") for end in ("least", "most")]
    merged = every.groupBy("digest").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"), *bounds)
    return materialize(merged.sortWithinPartitions("digest"), "level", **SORTED_RUN)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size, kept, digest (binary).

    Texts are equal when identical without any change; null counts as empty, so null and empty texts
    form one group. Repeated rows (equal identifier and text) each count, and each that bears the kept
    identifier is marked kept. A null identifier is kept only where its group has no other. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    runs = flush(docs, id_col, text_col, digest)
    hits = compact(runs, keep).where("n > 1")
    same = (F.col("least_exact") == F.col("most_exact")) & (F.col("least_length") == F.col("most_length"))
    collided = materialize(hits.where(~same).select("digest"), "collided")
    runs, hits = runs.select("id", "digest"), hits.where(same).select("digest", "keep_id", "n")
    is_hit = may_be_in(hits.select("digest"))
    shared, rest = runs.where(is_hit(F.col("digest"))), runs.where(~is_hit(F.col("digest")))
    if not collided.isEmpty():
        shared, rest = (part.join(collided, "digest", "left_anti") for part in (shared, rest))
    found = shared.join(hits, "digest", "left").unionByName(rest.withColumns({"keep_id": F.lit(None).cast(runs.schema["id"].dataType), "n": F.lit(None).cast("long")}))
    alone = F.col("n").isNull()  # or let through by the filter in vain
    merged = found.select("id", "digest", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
    if not collided.isEmpty():
        merged = merged.unionByName(_by_text(docs, id_col, text_col, keep, digest, collided))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return merged.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def _by_text(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Callable[[Column], Column], collided: DataFrame) -> DataFrame:
    """(id, digest, keep_id, n) of the rows whose digest several texts share, by the texts themselves."""
    best = {"min": F.min, "max": F.max}[keep]
    maybe = may_be_in(collided)
    text = whole_text(text_col)
    rows = docs.where(maybe(digest(text))).select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest")).join(collided, "digest", "left_semi")
    rows = materialize(rows, "rows")
    return rows.join(rows.groupBy("text").agg(best("id").alias("keep_id"), F.count("*").alias("n")), "text").select("id", "digest", "keep_id", "n")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` without those whose text a row with a preferred identifier holds; all columns stay.

    Identifiers should be unique. Rows that share one stay or go together, and stay where any of them would.
    """
    found = groups(docs, id_col, text_col, keep)
    gone = materialize(found.groupBy(F.col(id_col).alias("_gone")).agg(F.bool_or("kept").alias("kept")).where("not kept").select("_gone"), "gone")
    return without(docs, gone, id_col)
