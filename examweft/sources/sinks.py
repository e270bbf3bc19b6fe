"""Sinks: tables, JSON, text and CoNLL files, request logs, event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examweft.functions.text import output_name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset the warehouse, if all share it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if (warehouse.startswith("file:") or ":" not in warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
    return warehouse


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Replaces a table by the rows of ``df``, which must not be read from it (K1)."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def named_outputs(docs: DataFrame, by: str = "stem") -> DataFrame:
    """Documents with their output names: digests of the stem, or of the whole file name."""
    return docs.withColumn("output", output_name(F.col(by)))


def annotation_json(annotated: DataFrame) -> DataFrame:
    """(output, value): each annotation as one JSON text (K8)."""
    return annotated.select("output", F.to_json(F.struct(*[c for c in annotated.columns if c != "output"])).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str, column: str, key: str = "output") -> None:
    """Texts by name as one Parquet table, for texts that Spark reads again; ``readers.named_texts`` does. As files: ``named.write_named``."""
    df.select(F.col(key).cast("string").alias("name"), F.col(column).alias("text")).write.mode("overwrite").parquet(path)


def write_files(df: DataFrame, path: str, column: str, key: str = "output") -> None:
    """The same as plain text files, a folder for each key: for an export of a few documents."""
    df.select(key, F.col(column).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def request_folder() -> Column:
    """The folder name of a request (request_id, ts)."""
    return F.concat(F.lit("req_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.substring("request_id", 1, 8))


def request_log(requests: DataFrame) -> DataFrame:
    """Log rows of requests: counts, rounded duration, date, folder name."""
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return requests.select(
        "request_id", request_folder().alias("folder"),
        F.to_date("ts").alias("date"), "source", "status", F.bround("duration", 4).alias("duration"),
        count("spans").alias("spans_count"), count("tokens").alias("tokens_count"), count("questions").alias("questions_count"),
    )


def write_request_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("date", "source").json(path)


def sse_frame(event: Column) -> Column:
    """A struct as one server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))
