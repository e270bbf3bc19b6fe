"""From raw documents to packed training sequences: the corpus pipeline, counted as part of examweft.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as a table
in the shared folder and hands them to the next. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examweft.llm import dedup, jaccard, packing, pii, quality
from examweft.llm.common import materialize, read, prepare
from examweft.llm.queries import bpe_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null or empty text is scored like any other; of repeated rows all stay or
    all go; without labels all stay."""
    prepare(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays. A null text counts as empty, a null doc_id as smaller than any;
    rows that share a doc_id stay or go together."""
    return dedup.deduplicate(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect the one with the smallest doc_id stays, with other rows of that doc_id.
    Texts without words are linked with nothing and stay."""
    prepare(spark)
    return jaccard.first_of_each(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and n_chars follows the text. A null text stays null; every row stays."""
    prepare(spark)
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null or empty text is one piece of one token; repeated rows are packed each."""
    prepare(spark)
    return packing.pack(packing.token_pieces(docs, bpe_path()))


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("pack_sequences", pack_sequences),
]

#: The classifier's decisions can't be stated in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
