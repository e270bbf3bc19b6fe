import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from examweft import schemas
from examweft.plans import remote
from examweft.sources import readers, sinks
from examweft.streaming import progress


def stream(spark, tmp_path, df, files=1, name="in"):
    path = str(tmp_path / name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode="append", sizes=None):
    with progress.with_state_store(df.sparkSession, 2):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    if sizes is not None:
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return df.sparkSession.table(name)


EVENTS = [("t", ms, tok, 100) for ms, tok in ((0, 1), (79, 2), (80, 3), (100, 100), (150, 100), (170, 4), (240, 5))] + [("u", 10, 1, 100), ("u", 20, 2, 100)]
PASSED = {("t", 0), ("t", 80), ("t", 100), ("t", 150), ("t", 240), ("u", 10)}


def test_throttle(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, progress.EVENT)
    assert {(r.task_id, r.ms) for r in progress.throttle(df).collect()} == PASSED
    later = df.withColumn("ms", F.col("ms") + 1000)  # nothing is before the first watermark, 1970
    out = drain(progress.throttle_stream(stream(spark, tmp_path, later)), "throttled")
    assert {(r.task_id, r.ms - 1000) for r in out.collect()} == PASSED


def test_throttle_before_1970_and_without_times(spark, tmp_path):
    """Times before 1970 are divided as SQL does and aren't late; a null says nothing for an event."""
    rows = [("a", ms, tok, 90) for ms, tok in ((-200, 1), (-150, 2), (-120, 3), (-90, 90), (0, 4), (None, 5), (None, 95))] + [("b", None, None, 90), ("b", None, 1, 90)]
    df = spark.createDataFrame(rows, progress.EVENT)
    want = {("a", -200, 1), ("a", -120, 3), ("a", -90, 90), ("a", 0, 4), ("a", None, 95), ("b", None, 1)}
    assert {r[:3] for r in progress.throttle(df).collect()} == want
    out = drain(progress.throttle_stream(stream(spark, tmp_path, df)), "early")
    assert {r[:3] for r in out.collect()} == want


def test_throttle_queries_equal_their_sql_before_1970(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    at = lambda n: dt.datetime(1969, 12, 1) + dt.timedelta(hours=7 * n)
    rows = [(n, at(n), n % 3, "view", float(n * 37 % 120), "{}") for n in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("throttled", "streamed_throttle"):
        want = sorted(con.sql(entry.oracle_sql()[name]).fetchall())
        assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == want and want[0][1] < 0, name


UPDATE = "task_id string, seq long, ts timestamp, status string, progress int, message string, error string"
at_minute = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_task_states_and_transitions(spark, tmp_path):
    rows = [("a", 1, "pending", 0, "m", None), ("a", 2, "processing", None, None, None), ("a", 3, None, 99, None, None), ("a", 4, None, 80, "saving", None), ("a", 5, "completed", 100, None, None), ("b", 1, "pending", 0, None, None), ("b", 2, "failed", None, None, "boom"), ("c", 1, "completed", 1, None, None), ("c", 2, "pending", None, None, None), ("c", 3, "odd", None, None, None)]
    df = spark.createDataFrame([(t, n, at_minute(n), *r) for t, n, *r in rows], UPDATE)
    out = {r.task_id: r for r in drain(progress.task_states(stream(spark, tmp_path, df)), "states", "update").collect()}
    assert (out["a"].status, out["a"].progress, out["a"].message, out["a"].refused) == ("completed", 100, "saving", 0)
    assert (out["b"].error, out["b"].progress, out["b"].refused) == ("boom", 0, 0) and (out["c"].status, out["c"].refused) == ("odd", 1)
    got = drain(progress.transitions(stream(spark, tmp_path, df.where("status is not null"), name="in2")), "transitions").collect()
    assert {(r.task_id, r.previous, r.status) for r in got} == {("a", "pending", "processing"), ("a", "processing", "completed"), ("b", "pending", "failed"), ("c", "completed", "pending"), ("c", "pending", "odd")}


def test_states_go_and_late_rows_stay_out(spark, tmp_path):
    """Done tasks are forgotten soon, idle ones later; what is behind the watermark changes nothing."""
    source = str(tmp_path / "in")
    batches = [
        [(f"d{i}", 1, at_minute(0), "completed", 100, None, None) for i in range(50)] + [("idle", 1, at_minute(0), "processing", 5, None, None)],
        [("x", 1, at_minute(60), "pending", 0, None, None)],
        [("idle", 2, at_minute(30), None, 7, None, None), ("d1", 2, at_minute(1), None, 1, None, None), ("x", 2, at_minute(61), "processing", 1, None, None)],
        [("y", 1, at_minute(3000), "pending", 0, None, None)],
        [("z", 1, at_minute(3001), "pending", 0, None, None)],
    ]
    seen, sizes = [], []
    for number, rows in enumerate(batches):  # a run each, restarted from the checkpoint
        spark.createDataFrame(rows, UPDATE).coalesce(1).write.mode("append").parquet(source)
        states = progress.task_states(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "1 minute", keep=24 * 3_600_000, linger=60_000)
        with progress.with_state_store(spark, 2):
            q = states.writeStream.outputMode("update").foreachBatch(lambda batch, _, n=number: seen.extend((n, r.task_id, r.progress) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    changed = {(n, t) for n, t, _ in seen}
    assert (2, "x") in changed and (2, "d1") not in changed and (2, "idle") not in changed  # late
    assert max(sizes) >= 50 and sizes[-1] <= 6, sizes


def test_debounce(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    df = spark.createDataFrame([("e", at(0), "a"), ("e", at(300), "b"), ("e", at(640), "c"), ("e", at(1100), "d"), ("z", at(3_600_000), "end")], "exam string, ts timestamp, text string")
    want = {("e", "c"), ("e", "d")}
    assert {(r.exam, r.text) for r in progress.debounce(df, "exam", "ts", "text").collect()} == want | {("z", "end")}
    out = drain(progress.debounce_stream(stream(spark, tmp_path, df), "exam", "ts", "text", watermark="1 second"), "debounced")
    assert {(r.exam, r.text) for r in out.collect()} == want


def test_countdown(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([("a", "start", at(0), 45), ("b", "start", at(0), 45), ("b", "submit", at(20), None), ("z", "start", at(300), 45)], "attempt_id string, kind string, ts timestamp, duration_minutes int")
    got = {r.attempt_id: (r.ended, r.automatic) for r in drain(progress.countdown_stream(stream(spark, tmp_path, df)), "countdown").collect()}
    assert got == {"a": (at(45), True), "b": (at(20), False)}
    starts = df.where("kind = 'start'").select("attempt_id", F.col("ts").alias("started"), "duration_minutes")
    submits = spark.createDataFrame([("b", at(20)), ("z", at(400))], "attempt_id string, submitted timestamp")
    assert {r.attempt_id: (r.ended, r.automatic) for r in progress.submission_time(starts, submits).collect()} == {"a": (at(45), True), "b": (at(20), False), "z": (at(345), True)}


def test_counters(spark):
    df = spark.createDataFrame([("t", 1, 1, "a b"), ("t", 1, 2, ""), ("t", 2, 3, "c"), ("t", 2, 4, "d e f")], "task_id string, attempt int, seq int, chunk string")
    assert [r.streamed for r in progress.streamed_tokens(df).orderBy("seq").collect()] == [2, 3, 1, 4]
    assert [r.seq for r in progress.last_attempt(df).orderBy("seq").collect()] == [3, 4]


def test_sse(spark, tmp_path):
    events = [{"type": "ocr_start", "step": 1, "message": "x\ny"}, {"type": "complete", "progress": 100}]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "log.txt").write_text("".join(f"data: {json.dumps(e)}\n\n" for e in events) + "data: {broken\n\n: comment\n\n")
    got = drain(readers.sse_stream(spark, str(tmp_path / "logs")), "sse").collect()
    assert {(r.type, r.progress) for r in got} == {("ocr_start", None), ("complete", 100)}
    frames = spark.createDataFrame(events, schemas.PROGRESS_EVENTS).select(sinks.sse_frame(F.struct("type", "progress")).alias("value"))
    assert "data: {\"type\":\"complete\",\"progress\":100}\n\n" in [r.value for r in frames.collect()]


def test_drafts(spark, tmp_path):
    df = spark.createDataFrame([("e", "s", 1, {"q": "A"}, False), ("e", "s", 2, {"q": "B"}, False), ("e", "r", 1, {}, False), ("e", "r", 2, {}, True)], "exam_id string, student string, version int, answers map<string,string>, submitted boolean")
    q = progress.save_drafts(stream(spark, tmp_path, df), str(tmp_path / "drafts"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.student, r.answers) for r in readers.latest_drafts(spark.read.parquet(str(tmp_path / "drafts"))).collect()] == [("s", {"q": "B"})]


def test_readers(spark, tmp_path):
    folder = tmp_path / "docs" / "deep"
    folder.mkdir(parents=True)
    for n, text in (("in_1.md", "a"), ("out_1.MD", "b"), ("in_2.md", "c"), ("out_2.md", "d"), ("in_4.md", "x"), ("out_4.md", "y"), ("note.txt", "z")):
        (folder / n).write_text(text)
    (folder / "p.pdf").write_bytes(b"%PDF")
    (folder / "q.pdf").write_bytes(b"%PDF2")
    files = readers.text_files(spark, str(tmp_path / "docs"))
    assert files.count() == 6 and readers.text_files(spark, str(tmp_path / "docs"), limit=1).first().stem == "in_1"
    assert [(r.n, r.given, r.wanted) for r in readers.example_pairs(files).collect()] == [(1, "a", "b"), (2, "c", "d")]
    pdfs = readers.binary_files(spark, str(tmp_path / "docs"), done=spark.createDataFrame([("q",)], "stem string"))
    assert [(r.stem, bytes(r.content)) for r in pdfs.collect()] == [("p", b"%PDF")]
    store = {"exams": [{"id": "e2", "title": "t", "questions": [{"id": "q", "options": [{"label": "A", "text": "x"}]}]}, {"id": "e1"}], "submissions": []}
    (tmp_path / "db.json").write_text(json.dumps(store, indent=1))
    legacy = readers.legacy_store(spark, str(tmp_path / "db.json"))
    assert [(r.pos, r.id) for r in legacy["exams"].orderBy("pos").collect()] == [(0, "e2"), (1, "e1")] and readers.is_empty(legacy["submissions"])
    rows = spark.createDataFrame([(json.dumps(store["exams"][0]),), ("no json",)], "data string")
    assert [r.id for r in readers.json_documents(rows, "exams").collect()] == ["e2", None]
    assert readers.config({"a": {"b": 2}, "z": 1}, {"a": {"b": 1, "c": 3}, "d": 4}) == {"a": {"b": 2, "c": 3}, "d": 4, "z": 1}
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one")], "doc_id string, page int, text string")
    assert readers.page_fallback(pages).first().text == "<|page|>Page 1\n\none\n\n<|page|>Page 2\n\ntwo"


def test_remote(spark):
    def client(x):
        if "bad" in x:
            raise OSError("no answer")
        return f"<think>hm</think><stem>{x}</stem>"

    docs = spark.createDataFrame([("a", "good"), ("b", "bad")], "doc_id string, text string")
    assert {r.doc_id: r.tagged for r in remote.annotate(docs, client).collect()} == {"a": "<stem>good</stem>", "b": None}
    pages = spark.createDataFrame([("a", 0, "img", "layer"), ("a", 1, "bad img", "layer")], "doc_id string, batch int, image string, fallback string")
    assert [r.text for r in remote.recognise(pages, lambda x: client(x)[-12:], 1).orderBy("batch").collect()][1] == "layer"
    got = remote.map_answers(spark.createDataFrame([("e", "p")], "exam_id string, prompt string"), lambda p: 'x {"q1": "B"} y').first()
    assert got.mapping == {"q1": "B"}


def test_request_log(spark, tmp_path):
    df = spark.createDataFrame([("abcdefghij", dt.datetime(2024, 5, 6, 7, 8, 9), "api", "success", 1.23456, None, ["t"], [])], "request_id string, ts timestamp, source string, status string, duration double, spans array<string>, tokens array<string>, questions array<string>")
    log = sinks.request_log(df)
    r = log.first()
    assert (r.folder, r.duration, r.spans_count, r.tokens_count) == ("req_20240506_070809_abcdefgh", 1.2346, 0, 1)
    sinks.write_request_log(log, str(tmp_path / "log"))
    assert (tmp_path / "log" / "date=2024-05-06" / "source=api").exists()


@pytest.mark.parametrize("name", ["x.PDF", None])
def test_uploads(spark, name):
    kinds = readers.routed(spark.createDataFrame([(name, "t"), ("a", None)], "name string, text string")).collect()
    assert [r.kind for r in kinds] == ["pdf" if name else "text", "missing"]
