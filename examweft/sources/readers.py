"""Sources: tables, JSON stores, text folders, page folders, event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examweft import schemas
from examweft.functions.text import page_text
from examweft.plans.storage import continuity

TABLES = {"exams": schemas.EXAMS, "submissions": schemas.SUBMISSIONS}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_documents(rows: DataFrame, kind: str, column: str = "data") -> DataFrame:
    """Rows of a JSON text column as typed columns; what is no JSON gives nulls, not an error."""
    parsed = F.from_json(F.col(column), f"struct<{', '.join(_fields(TABLES[kind]))}>", {"mode": "PERMISSIVE"})
    return rows.select(parsed.alias("_row")).select("_row.*")


def _fields(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return out


def jdbc_documents(spark: SparkSession, url: str, table_name: str, kind: str, **options: str) -> DataFrame:
    """A document table of a database: id and JSON text (S1, S13). Needs the database's driver on the class path."""
    return json_documents(spark.read.format("jdbc").options(url=url, dbtable=table_name, **options).load(), kind)


def is_empty(df: DataFrame) -> bool:
    """The probe that gates a migration: one row at most is read."""
    return df.isEmpty()


def legacy_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The single-file store with both lists, as two tables in list order (S3, K7)."""
    types = {name: f"array<struct<{','.join(_fields(ddl))}>>" for name, ddl in TABLES.items()}
    whole = spark.read.schema(", ".join(f"{n} {t}" for n, t in types.items())).option("multiLine", True).json(path)
    return {name: whole.select(F.posexplode(name).alias("pos", "_row")).select("pos", "_row.*") for name in TABLES}


def text_files(spark: SparkSession, folder: str, suffix: str = ".md", limit: int | None = None) -> DataFrame:
    """(path, name, stem, text) of the text files under a folder, whatever the case of their suffix, in path order."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    found = found.where(F.endswith(F.lower("name"), F.lit(suffix.lower()))).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    return found if limit is None else found.orderBy("path").limit(limit)


def named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what ``sinks.write_texts`` wrote."""
    return spark.read.schema("name string, text string").parquet(path)


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(path, name, stem, content) of files by pattern; those whose stem is in ``done`` are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    found = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content").withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    if done is not None:
        found = found.join(done.select("stem").distinct(), "stem", "left_anti")
    return found if limit is None else found.orderBy("path").limit(limit)


def example_pairs(files: DataFrame) -> DataFrame:
    """Numbered examples ``in_i``/``out_i`` up to the first gap: (n, given, wanted) from files (stem, text)."""
    numbered = files.select(F.regexp_extract("stem", "^(in|out)_([0-9]+)$", 1).alias("kind"), F.regexp_extract("stem", "^(in|out)_([0-9]+)$", 2).try_cast("int").alias("n"), "text").where("n is not null").withColumn("dir", F.lit(""))
    pairs = numbered.groupBy("n").pivot("kind", ["in", "out"]).agg(F.first("text")).select("n", F.col("in").alias("given"), F.col("out").alias("wanted"))
    return pairs.join(continuity(numbered).select("n"), "n").orderBy("n")


def example_images(files: DataFrame, texts: DataFrame) -> DataFrame:
    """The same with images as base64."""
    images = files.select("stem", F.base64("content").alias("text"))
    return example_pairs(images.where(F.startswith("stem", F.lit("in_"))).unionByName(texts.select("stem", "text").where(F.startswith("stem", F.lit("out_")))))


def page_fallback(pages: DataFrame) -> DataFrame:
    """Text-layer pages (doc_id, page, text) as documents, in page order with page headers."""
    parts = F.array_sort(F.collect_list(F.struct("page", page_text(F.col("page"), F.col("text")).alias("body"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n\n").alias("text"))


def upload(spark: SparkSession, text: str, name: str = "") -> DataFrame:
    """A form's text as a one-row table."""
    return spark.createDataFrame([(name, text)], "name string, text string")


def routed(uploads: DataFrame) -> DataFrame:
    """Uploads (name, text) with what they are: "pdf" by suffix, else "text", else "missing" (P16)."""
    kind = F.when(F.endswith(F.lower(F.coalesce("name", F.lit(""))), F.lit(".pdf")), "pdf").when(F.coalesce("text", F.lit("")) != "", "text").otherwise("missing")
    return uploads.withColumn("kind", kind)


def config(settings: dict | None, defaults: dict) -> dict:
    """Settings over defaults, section by section."""
    settings = settings or {}
    return {k: config(settings.get(k), v) if isinstance(v, dict) else settings.get(k, v) for k, v in defaults.items()} | {k: v for k, v in settings.items() if k not in defaults}


def sse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Server-sent events of a frame each as progress events; malformed frames are left out."""
    body = F.regexp_extract(column, r"(?s)^\s*data: (.*)$", 1)
    return lines.select(F.from_json(body, schemas.PROGRESS_EVENTS).alias("e")).where("e.type is not null").select("e.*")


def sse_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a folder of event logs, as a stream: frames end at blank lines."""
    return sse_events(spark.readStream.text(folder, lineSep="\n\n"))


def latest_drafts(changes: DataFrame) -> DataFrame:
    """The last draft of each exam and student, without those that were submitted."""
    last = F.row_number().over(Window.partitionBy("exam_id", "student").orderBy(F.desc("version")))
    return changes.withColumn("_rank", last).where("_rank = 1 and not submitted").drop("_rank")
