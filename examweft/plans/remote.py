"""Model calls as injected functions, over partitions of Arrow batches; queries themselves never call out (M1, M2, M3).

``call`` asks for every row. ``kept_replies`` asks once for each distinct prompt and keeps what comes, so that neither a
repeated text nor a task that runs again is asked for a second time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examweft.functions.text import clean_reply
from examweft.operators.grading import answer_mapping

ATTEMPTS, DELAY = 3, 2.0
#: Calls at a time within a task, replies in a file.
TOGETHER, IN_FILE = 4, 64


def asked(client: Callable[[str], str], text: str | None, attempts: int, delay: float) -> tuple[str | None, str | None]:
    """(reply, error): what the client says, after ``attempts`` with a pause between them; the last failure where all fail."""
    if text is None:
        return None, None
    for left in range(attempts - 1, -1, -1):
        try:
            return client(text), None
        except Exception as failed:  # noqa: BLE001  whatever a remote client raises counts as one failed attempt
            error = f"{type(failed).__name__}: {failed}"
            time.sleep(delay if left else 0)
    return None, error


def call(df: DataFrame, client: Callable[[str], str], column: str, out: str, parallel: int | None = None, attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """``df`` with the client's reply to each row's text; null where every attempt fails, and then the last failure in ``out``_error.

    ``parallel`` bounds the calls at a time by dealing the rows over so many partitions; what makes the rows keeps its own.
    """
    rows = df.repartition(parallel) if parallel else df

    def run(batches):
        for pdf in batches:
            found = [asked(client, t, attempts, delay) for t in pdf[column]]
            yield pdf.assign(**{name: pd.Series([f[i] for f in found], dtype=object, index=pdf.index) for i, name in enumerate((out, f"{out}_error"))})

    return rows.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {out} string, {out}_error string")


KEPT = "digest string, reply string, error string"


def keep_replies(batches: Iterator[pa.RecordBatch], client: Callable[[str], str], place: str, attempts: int, delay: float, together: int, in_file: int) -> int:
    """Asks for the prompts (digest, prompt) of one partition and writes replies under ``place``, a file for each few of them; those
    whose file is there, of an attempt before, aren't asked again. Returns how many were asked."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(place)
    store.create_dir(root.rpartition("/")[0], recursive=True)
    number = count = 0
    with ThreadPoolExecutor(together) as pool:
        for batch in batches:
            for at in range(0, batch.num_rows, in_file):
                path, number = f"{root}-{number:06d}.parquet", number + 1
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    continue
                part = batch.slice(at, in_file)
                found = list(pool.map(lambda t: asked(client, t, attempts, delay), part.column("prompt").to_pylist()))
                count += len(found)
                table = pa.table({"digest": part.column("digest"), "reply": pa.array([f[0] for f in found], pa.string()), "error": pa.array([f[1] for f in found], pa.string())})
                _put(store, table, path)
    return count


def _put(store, table: pa.Table, path: str) -> None:
    import pyarrow.parquet as pq

    folder, _, name = path.rpartition("/")
    pending = f"{folder}/_{uuid.uuid4().hex}-{name}"  # Spark's readers pass over names that begin so
    pq.write_table(table, pending, filesystem=store)
    store.move(pending, path)


def kept_replies(df: DataFrame, client: Callable[[str], str], column: str, out: str, folder: str, parallel: int = 5, attempts: int = ATTEMPTS, delay: float = DELAY, together: int = TOGETHER, in_file: int = IN_FILE) -> DataFrame:
    """``df`` with ``out`` and ``out``_error like ``call``, by a table of replies at ``folder``, which is kept and grows.

    Prompts are told apart by SHA-256. Only distinct ones without a reply in the table are asked, ``parallel`` tasks
    with ``together`` calls each at a time; failures are kept as well, and asked again next time. A null text is not asked.
    """
    spark = df.sparkSession
    replies = f"{folder.rstrip('/')}/replies"
    spark.createDataFrame([], KEPT).write.mode("ignore").parquet(f"{replies}/none")
    read = lambda: spark.read.schema(KEPT).option("recursiveFileLookup", True).parquet(replies)
    run = uuid.uuid4().hex
    prompts = df.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("digest"), F.col(column).alias("prompt")).dropDuplicates(["digest"])
    prompts.join(read().where("error is null").select("digest"), "digest", "left_anti").repartition(parallel, "digest").write.parquet(f"{folder}/asked/{run}")
    # Written first: whenever a task runs again, its partition has the same prompts in the same order.
    new = spark.read.schema("digest string, prompt string").parquet(f"{folder}/asked/{run}")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = keep_replies(batches, client, f"{replies}/{run}/{TaskContext.get().partitionId():05d}", attempts, delay, together, in_file)
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["n"])

    new.mapInArrow(ask, "n long").write.format("noop").mode("overwrite").save()
    found = read().groupBy("digest").agg(F.max("reply").alias(out), F.max("error").alias("_error"))
    found = found.select(F.col("digest").alias("_digest"), out, F.when(F.col(out).isNull(), F.col("_error")).alias(f"{out}_error"))
    return df.join(found, F.sha2(F.col(column), 256) == F.col("_digest"), "left").select(*df.columns, out, f"{out}_error")


def recognise(pages: DataFrame, client: Callable[[str], str], parallel: int = 5, delay: float = DELAY) -> DataFrame:
    """Page batches (doc_id, batch, image, fallback) to text: the client's, or the text layer where it fails (M1)."""
    read = call(pages, client, "image", "reply", parallel, delay=delay)
    return read.select("doc_id", "batch", F.coalesce("reply", "fallback").alias("text"))


def annotate(docs: DataFrame, client: Callable[[str], str], delay: float = DELAY) -> DataFrame:
    """(doc_id, text) to (doc_id, text, tagged), with thoughts and fences removed (M2)."""
    return call(docs, client, "text", "reply", delay=delay).select("doc_id", "text", clean_reply(F.col("reply")).alias("tagged"))


def map_answers(prompts: DataFrame, client: Callable[[str], str], delay: float = DELAY) -> DataFrame:
    """(exam_id, prompt) to (exam_id, mapping) (M3)."""
    return call(prompts, client, "prompt", "reply", delay=delay).select("exam_id", answer_mapping(F.col("reply")).alias("mapping"))
