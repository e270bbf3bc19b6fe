"""The engine's front: what a caller can ask of its tables, one method for each request.

The state is one table of changes: a request that changes anything appends its changed documents, as JSON text, and its
deletions in one write, and costs what it changes. The last change of a document counts. ``tidy`` writes the state
without its history elsewhere, clustered by identifier.

What an append guarantees is what Spark's committer does: a job that fails leaves none of its rows, but a reader may list
the folder while files of one append are being moved in, and sees some of them. Versions are the writer's
clock: of two writers that change one document at a time the later clock wins, whatever the order of their commits. One
writer at a time, or readers that wait for its call to return, see whole requests.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from examweft import schemas
from examweft.functions.text import clean_grade, clean_reply
from examweft.operators import bio, catalog, grading, tokens
from examweft.plans import parse_lines, parse_spans, remote, storage

TABLES = {"exams": schemas.EXAMS, "submissions": schemas.SUBMISSIONS, "tasks": schemas.TASKS}
CHANGES = "kind string, id string, version long, gone boolean, data string"


class NotFound(KeyError):
    """No row has the identifier that was asked for."""


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], CHANGES).write.mode("ignore").partitionBy("kind").parquet(self.root)

    # --- state ------------------------------------------------------------------------------------

    def table(self, name: str, *keys: str) -> DataFrame:
        """The documents of a kind that are in force; with ``keys`` only those, by a filter that reaches the files."""
        return self._parsed(name, self._last(name, *keys).where("not c.gone").select("c.data"))

    def _last(self, name: str, *keys: str) -> DataFrame:
        """(id, c): the last change of each document."""
        changes = self.spark.read.schema(CHANGES).parquet(self.root).where(F.col("kind") == name)
        changes = changes.where(F.col("id").isin(*keys)) if keys else changes
        return changes.groupBy("id").agg(F.max_by(F.struct("data", "gone"), "version").alias("c"))

    def _parsed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.from_json("data", self._schema(name)).alias("d")).select("d.*")

    def _schema(self, name: str) -> StructType:
        return self.spark.createDataFrame([], TABLES[name]).schema

    def _write(self, *changes: DataFrame) -> int:
        """All changes of a request, in one append; returns its version."""
        version = time.time_ns()
        rows = reduce(DataFrame.unionByName, changes).withColumn("version", F.lit(version))
        written = rows.select("kind", "id", "version", "gone", "data").write.mode("append").partitionBy("kind")
        written.option("parquet.bloom.filter.enabled#id", "true").parquet(self.root)
        return version

    def _changed(self, name: str, rows: DataFrame) -> DataFrame:
        columns = self._schema(name).names
        whole = catalog.newest_per_key(rows.select(*columns))
        return whole.select(F.lit(name).alias("kind"), "id", F.lit(False).alias("gone"), F.to_json(F.struct(*columns)).alias("data"))

    def _gone(self, name: str, ids: DataFrame) -> DataFrame:
        return ids.select(F.lit(name).alias("kind"), "id", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("data"))

    def save(self, name: str, rows: DataFrame) -> None:
        """Puts documents in by identifier."""
        self._write(self._changed(name, rows))

    def replace(self, **current: DataFrame) -> None:
        """A full sync: of each kind given, its documents become those rows and no others (K1). All kinds change in one write."""
        changes = []
        for name, rows in current.items():
            changes += [self._changed(name, rows), self._gone(name, storage.deleted(self._last(name).where("not c.gone").select("id"), rows))]
        self._write(*changes)

    def _of(self, version: int, name: str) -> DataFrame:
        """The documents that one write put in."""
        rows = self.spark.read.schema(CHANGES).parquet(self.root).where((F.col("kind") == name) & (F.col("version") == version))
        return self._parsed(name, rows.select("data"))

    def _add(self, name: str, made: DataFrame, retried: bool) -> DataFrame:
        """Puts new documents in and returns them. With a caller's own token those that are there already stay as they are."""
        if not retried:
            return self._of(self._write(self._changed(name, made)), name)
        known = self._last(name).select("id")
        version = self._write(self._changed(name, made.join(known, "id", "left_anti")))
        return self._of(version, name).unionByName(self.table(name).join(made.select("id"), "id", "left_semi").join(self._of(version, name).select("id"), "id", "left_anti"))

    def tidy(self, root: str, files: int | None = None) -> Engine:
        """The state in force as an engine of its own at ``root``, in ranges of identifiers, each sorted and with a filter of its
        identifiers: a look-up by identifier reads the files that may have it, and of these the row groups that may."""
        other = Engine(self.spark, root)
        rows = reduce(DataFrame.unionByName, (self._changed(name, self.table(name)) for name in TABLES))
        ranges = rows.repartitionByRange(*([files] if files else []), "kind", "id").sortWithinPartitions("kind", "id")
        other._write(ranges)
        return other

    def _one(self, name: str, key: str) -> DataFrame:
        """One document by identifier, fetched in one run; it is one row."""
        found = self.table(name, key).collect()
        if not found:
            raise NotFound(key)
        return self.spark.createDataFrame(found, self._schema(name))

    def _delete(self, name: str, key: str) -> None:
        self._write(self._gone(name, self._one(name, key)))

    def health(self) -> dict[str, int]:
        """The number of rows of each table."""
        return {name: self.table(name).count() for name in TABLES}

    # --- exams ------------------------------------------------------------------------------------

    def exams(self, query: str = "", **facets: object) -> DataFrame:
        """The bank, newest first, by text and facets; ``grade`` is compared as it is shown."""
        rows = catalog.search(self.table("exams"), query)
        if grade := facets.pop("grade", None):
            rows = catalog.facets(rows.withColumn("_grade", clean_grade(F.col("grade"))), _grade=grade).drop("_grade")
        return catalog.newest_first(catalog.facets(rows, **facets))

    def exam(self, exam_id: str) -> DataFrame:
        return self._one("exams", exam_id)

    def create_exams(self, new: DataFrame, created_at: Column | None = None, token: str | None = None) -> DataFrame:
        """Puts exams (title, subject, grade, duration_minutes, questions) into the bank and returns them.

        Each row is an exam of its own, whatever others are equal to it. A caller that may have to repeat a request gives it
        a ``token``: the same rows under the same token are put in once.
        """
        at = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        keyed = storage.numbered_repeats(new, F.lit(token or uuid.uuid4().hex)).withColumn("duration_minutes", F.coalesce("duration_minutes", F.lit(schemas.DEFAULT_DURATION)))
        none = self.spark.createDataFrame([], TABLES["exams"])
        return self._add("exams", storage.insert_exam(none, keyed, at, "request_key"), bool(token))

    def update_exam(self, changes: DataFrame) -> None:
        """Overlays title, subject, grade, duration_minutes and questions of exams by id."""
        for row in storage.missing(self.table("exams"), changes).limit(1).collect():
            raise NotFound(row["id"])
        known = self.table("exams").join(changes.select("id").distinct(), "id", "left_semi")
        self.save("exams", storage.update_exam(known, changes))

    def delete_exam(self, exam_id: str) -> None:
        """Removes an exam and its submissions."""
        gone = self._one("exams", exam_id).select("id")
        taken = self.table("submissions").where(F.col("exam_id") == exam_id).select("id")
        self._write(self._gone("exams", gone), self._gone("submissions", taken))

    def import_answers(self, exam_id: str, reply: str) -> None:
        """Sets an exam's keys from a model's reply that names question identifiers and labels."""
        exam = self._one("exams", exam_id)
        self.save("exams", exam.withColumn("questions", grading.import_answers(F.col("questions"), grading.answer_mapping(F.lit(reply)))))

    # --- submissions ------------------------------------------------------------------------------

    def submissions(self, exam_id: str | None = None) -> DataFrame:
        return catalog.newest_first(catalog.facets(self.table("submissions"), exam_id=exam_id), "submitted_at")

    def submit(self, requests: DataFrame, submitted_at: Column | None = None, token: str | None = None) -> DataFrame:
        """Grades requests (exam_id, student_name, student_code, answers), keeps and returns the submissions.

        Each row is a submission of its own: students of one name, second attempts and equal rows all stay. ``token`` as
        in ``create_exams``.
        """
        exams = self.table("exams").join(requests.select(F.col("exam_id").alias("id")).distinct(), "id", "left_semi")
        for row in storage.missing(exams.withColumnRenamed("id", "exam_id"), requests, "exam_id").limit(1).collect():
            raise NotFound(row["exam_id"])
        keyed = storage.numbered_repeats(requests, F.lit(token or uuid.uuid4().hex))
        return self._add("submissions", grading.grade(keyed, exams, submitted_at), bool(token))

    def delete_submission(self, submission_id: str) -> None:
        self._delete("submissions", submission_id)

    # --- documents --------------------------------------------------------------------------------

    def annotate(self, docs: DataFrame, client: Callable[[str], str]) -> DataFrame:
        """(doc_id, text) through the injected annotator to (doc_id, text, tagged)."""
        return remote.annotate(docs, client)

    def label(self, annotated: DataFrame) -> DataFrame:
        """Tokens of (doc_id, text, tagged) with offsets, BIO tags and label ids."""
        cleaned = annotated.withColumn("tagged", clean_reply(F.col("tagged")))
        return bio.align(tokens.tokens(annotated.select("doc_id", "text")), tokens.spans(cleaned.select("doc_id", "tagged")))

    def parse(self, docs: DataFrame) -> DataFrame:
        """Questions of (doc_id, text) line by line, or of (doc_id, text, tagged) by spans, else line by line."""
        if "tagged" not in docs.columns:
            return parse_lines.parse_lines(docs)
        return parse_spans.structured(tokens.spans(docs.where("tagged is not null").select("doc_id", "tagged")), docs.select("doc_id", "text"))

    # --- tasks ------------------------------------------------------------------------------------

    def tasks(self) -> DataFrame:
        return catalog.newest_first(self.table("tasks"))

    def task(self, task_id: str) -> DataFrame:
        return self._one("tasks", task_id)

    def put_tasks(self, rows: DataFrame) -> None:
        """New tasks, or new states of known ones."""
        self.save("tasks", rows)

    def delete_task(self, task_id: str) -> None:
        self._delete("tasks", task_id)
