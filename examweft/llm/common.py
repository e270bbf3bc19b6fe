"""What the operators of this subpackage share: table reading, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at a time, where the session doesn't say: bounds a task's memory
#: whatever the length of its texts.
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, and bounds their batches."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset the warehouse, if all share it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if (warehouse.startswith("file:") or ":" not in warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
    return warehouse


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage is cut, and work is done once.

    Lost executors cost nothing that was written. The columns keep their types and order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/examweft/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``df`` through a function of one Arrow batch, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Bits of a Bloom filter for each key, bits at most (8 MB, whatever the input), places of a key.
KEY_BITS, FILTER_BITS, PLACES = 16, 1 << 26, 4


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(PLACES)]


def may_be_in(keys: DataFrame, most_bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test of columns against a Bloom filter of ``keys`` (a table of one column): false only where a value isn't in it.

    The filter is one array of words in a written table, which plans read as a scalar. Its size is bounded; beyond
    ``most_bits / KEY_BITS`` keys more values pass the test than need to, and what tests them further has more to do.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    bits = 1 << 16
    while bits < min(most_bits, KEY_BITS * keys.count()):
        bits *= 2
    places = keys.select(F.explode(F.array(*_places(F.col(name), bits))).alias("place"))
    word = F.shiftrightunsigned("place", 6).alias("word")
    words = places.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits"))
    every = spark.range(bits // 64).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    row = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda w: w["bits"]).alias("words"))
    row = materialize(row, "filter")

    def test(key: Column) -> Column:
        words = row.scalar()
        found = F.lit(True)
        for place in _places(key, bits):
            found = found & (F.getbit(words[F.shiftrightunsigned(place, 6)], place.bitwiseAND(63).cast("int")) == 1)
        return found

    return test


def without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` isn't in ``gone`` (a table of one column), null-safe. Only rows that pass a filter
    of what goes are shuffled."""
    maybe = may_be_in(gone)
    name = gone.columns[0]
    asked = df.where(maybe(F.col(column)))
    return df.where(~maybe(F.col(column))).unionByName(asked.join(gone, asked[column].eqNullSafe(gone[name]), "left_anti"))
