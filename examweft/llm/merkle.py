"""Merkle manifest of a dataset: window-based levels over groups of rows, and for each row a proof.

1. Each row becomes a leaf: the SHA-256 of its fields, each with its length before it.
2. Leaves are numbered within their group in order, without gathering a group: rows are dealt by range and sorted,
   counted by partition and group, and these few counts give each stretch its first number.
3. A level is one window over group and parent index (eight rows at most, whatever the group's size). Its ordered
   full-frame ``collect_list`` is the parent's preimage and holds each child's siblings; the first child of each run
   passes the parent on, so that parents are one row each.
4. The groups' ends, in order of their names, are the leaves of one more tree, whose end is the root.
5. Proofs go down again: a node's steps are its own siblings and then its parent's steps, joined on group and parent
   index. What all rows of a group share comes down this way too, so that no join has a group as its key.

Levels are written tables. All rows move three times at most, as digests only; texts never move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examweft.llm.common import materialize

ARITY = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A field within a preimage: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps lead to."""
    return F.aggregate(steps, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) in their ``bucket`` by ``order``, and the bucket's number of rows ``n``.

    Rows that are equal in all of ``order`` are numbered in any order.
    """
    dealt = rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
    placed = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    stretches = placed.groupBy("bucket", part.alias("part")).agg(F.count("*").alias("here"), F.min("at").alias("first"))
    by_part = Window.partitionBy("bucket").orderBy("part")  # a row for each partition at most
    before = F.coalesce(F.sum("here").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("here").over(Window.partitionBy("bucket"))
    stretches = materialize(stretches.select("bucket", "part", (before - F.col("first")).alias("shift"), whole.alias("n")), "stretches")
    return placed.withColumn("part", part).join(stretches, ["bucket", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _up() -> Column:
    return F.floor(F.col("pos") / ARITY)


def _runs(level: DataFrame) -> DataFrame:
    """The nodes of a level that have a parent, with its index ``up`` and its children's digests in order."""
    run = Window.partitionBy("bucket", "up").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return level.where("n > 1").withColumn("up", _up()).withColumn("run", F.collect_list("digest").over(run))


def tree(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels over numbered leaves (bucket, pos, n, digest), and the end of each bucket (bucket, digest)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        first = _runs(levels[-1].select("bucket", "pos", "n", "digest")).where(F.col("pos") % ARITY == 0)
        parents = first.select("bucket", F.col("up").alias("pos"), F.ceil(F.col("n") / ARITY).alias("n"), F.sha2(F.array_join("run", ""), 256).alias("digest"))
        levels.append(materialize(parents, "level"))
        most = -(-most // ARITY)
    ends = reduce(DataFrame.unionByName, [level.where("n = 1").select("bucket", "digest") for level in levels])
    return levels, ends


def _steps_down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with what ``above`` (bucket, steps, and more) says of their bucket; ``steps`` lead to where its steps lead."""
    shared = [c for c in above.columns if c not in ("bucket", "steps")]
    left = F.array_join(F.slice("run", F.lit(1), F.col("at")), "")
    right = F.array_join(F.slice("run", F.col("at") + 2, F.lit(ARITY)), "")
    known = None
    for number in range(len(levels) - 1, -1, -1):
        level = levels[number]
        ends = level.where("n = 1").join(above, "bucket")
        if known is not None:
            own = _runs(level).withColumn("at", (F.col("pos") % ARITY).cast("int")).withColumn("step", F.struct(left.alias("left"), right.alias("right"))).drop("run", "at")
            parents = known.select("bucket", F.col("pos").alias("up"), "steps", *shared)
            below = own.join(parents, ["bucket", "up"]).withColumn("steps", F.concat(F.array("step"), "steps"))
            ends = ends.unionByName(below.select(*ends.columns))
        known = materialize(ends, "steps") if number else ends
    return known


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), **more: Column) -> DataFrame:
    """One row for each row of ``docs``: id_col, leaf, subroot, root, steps, and the columns ``more``, taken from its row.

    ``steps`` is the row's proof: for each level the digests left and right of it, joined; ``fold(leaf, steps)`` is the root.
    Groups are those of ``group_col``; null is a group, the first. Within one, leaves go by id_col (nulls first), equal
    identifiers by their leaves; equal rows each have a place of their own. A null field counts as ``-``, an empty one as
    ``0:``. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    own = docs.select(group.alias("bucket"), F.col(id_col).alias("id"), leaf(*map(F.col, fields)).alias("digest"), F.struct(F.lit(0).alias("_"), *(c.alias(k) for k, c in more.items())).alias("more"))
    leaves = materialize(numbered(materialize(own, "leaves"), "id", "digest"), "leaves")
    levels, ends = tree(leaves)
    ends = materialize(ends.withColumnRenamed("bucket", "name"), "ends")
    tops, root = tree(materialize(numbered(ends.select(F.lit("").alias("bucket"), "name", "digest"), "name"), "tops"))
    whole = root.select("bucket", F.array().cast(f"array<{_STEP}>").alias("steps"), F.col("digest").alias("root"))
    above = _steps_down(tops, whole).select(F.col("name").alias("bucket"), F.col("digest").alias("subroot"), "steps", "root")
    found = _steps_down(levels, materialize(above, "above"))
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "steps", *(F.col("more")[k].alias(k) for k in more))
