"""Substring search over a large catalog by an inverted index of trigrams (P3, P5): the rarest gram first, hits verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examweft.operators import catalog

GRAM = 3
#: Grams of a query that are looked up: the rarest ones leave few rows to verify.
ASKED = 3


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none of a shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))


def write_index(df: DataFrame, path: str, key: str = "id", columns: tuple[str, ...] = ("title", "subject", "grade")) -> None:
    """(gram, id) of all rows, clustered by gram so that a look-up skips files; and (gram, n), how many rows have each."""
    lists = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.concat(*(grams(F.col(c)) for c in columns)))).alias("gram"))
    ordered = lists.select("gram", "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
    ordered.write.option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{path}/lists")
    df.sparkSession.read.schema(ordered.schema).parquet(f"{path}/lists").groupBy("gram").agg(F.count("*").alias("n")).sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def search(df: DataFrame, path: str, query: str, key: str = "id", columns: tuple[str, ...] = ("title", "subject", "grade")) -> DataFrame:
    """The rows that ``catalog.search`` finds, by the index at ``path``. Queries of less than three characters scan all rows.

    Some characters change their number in lower case; query and texts are lowered alike, so that what contains the query
    has all its grams. The lists of the rarest grams are met by a count, and what is in all of them is verified.
    """
    spark, low = df.sparkSession, query.lower()
    if len(low) < GRAM:
        return catalog.search(df, query, columns)
    wanted = spark.range(1).select(F.explode(grams(F.lit(query))).alias("gram"))
    asked = [r.gram for r in wanted.collect()]  # of one query: as many as it has characters
    counts = spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(asked)).collect()
    if len(counts) < len(asked):
        return df.where(F.lit(False))  # a gram that no row has
    rarest = [r.gram for r in sorted(counts, key=lambda r: (r.n, r.gram))[:ASKED]]
    kind = df.schema[key].dataType.simpleString()
    hits = spark.read.schema(f"gram string, id {kind}").parquet(f"{path}/lists").where(F.col("gram").isin(rarest))
    all_of = hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select(F.col("id").alias(key))
    found = df.join(all_of, key, "left_semi").select(*df.columns)
    return catalog.search(found, query, columns)
