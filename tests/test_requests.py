import datetime as dt
import json
import os
import random
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from examweft.sources import named, readers, requests


class Handler(BaseHTTPRequestHandler):
    pages: dict = {}
    asked: list = []
    ranges = True

    def answer(self, body):
        Handler.asked.append((self.command, self.path))
        found = Handler.pages.get(self.path)
        if callable(found):
            found = found()
        if found is None:
            return self.send_error(404)
        if found == b"!":
            return self.send_error(503)
        first, last = 0, len(found)
        if Handler.ranges and (asked := self.headers.get("Range")):
            a, _, b = asked.removeprefix("bytes=").partition("-")
            first, last = int(a), int(b) + 1 if b else len(found)
            self.send_response(206)
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(len(found[first:last])))
        self.end_headers()
        if body:
            self.wfile.write(found[first:last])

    def do_GET(self):
        self.answer(True)

    def do_HEAD(self):
        self.answer(False)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}"
    running.shutdown()


def frame(n):
    return f"data: {json.dumps({'type': 'ocr_progress', 'progress': n, 'message': 'é😀' * (n % 4) + 'x' * n}, ensure_ascii=False)}\n\n"


def test_json_requests(spark, server):
    exams = [{"id": "e1", "title": "Toán", "questions": [{"id": "q", "options": [{"label": "A", "text": "é"}]}]}, {"id": "e2"}]
    calls = iter([b"!", json.dumps(exams, ensure_ascii=False).encode()])
    Handler.pages = {"/exams": lambda: next(calls), "/one": json.dumps({"id": "e3", "duration_minutes": 30}).encode()}
    got = requests.requested(spark, [f"{server}/exams", f"{server}/one", f"{server}/none"], "exams", delay=0).collect()
    assert {(r.id, r.title, r.duration_minutes) for r in got} == {("e1", "Toán", None), ("e2", None, None), ("e3", None, 30)}
    Handler.pages = {"/exams": b"!"}
    with pytest.raises(Exception, match="503"):
        requests.requested(spark, [f"{server}/exams"], "exams", delay=0, attempts=2).collect()


@pytest.mark.parametrize("chunk, ranges", [(1, True), (7, True), (65536, False)])
def test_frames_cut_anywhere(spark, server, chunk, ranges):
    Handler.ranges, Handler.pages = ranges, {"/a": "".join(map(frame, range(20))).encode() + b": comment\n\ndata: {oops\n\ndata: not ended", "/b": b""}
    got = requests.progress_events(spark, [f"{server}/a", f"{server}/b"], chunk=chunk).collect()
    assert sorted((r.progress, r.message) for r in got) == [(n, "é😀" * (n % 4) + "x" * n) for n in range(20)]


@pytest.mark.parametrize("ranges", [True, False])
def test_frames_of_any_two_ranges(server, ranges):
    """Wherever a run stops, the frames of both runs are the frames, once each."""
    Handler.ranges, Handler.pages = ranges, {"/a": "".join(map(frame, range(5))).encode()}
    url, whole = f"{server}/a", Handler.pages["/a"]
    read = lambda a, b: [v for _, _, v in requests._FrameReader({"urls": url, "chunk": "9"}).read(requests._Url(url, a, b))]
    want = [frame(n).strip("\n") for n in range(5)]
    for cut in range(0, len(whole) + 1, 1 if ranges else 17):
        assert [x.strip("\n") for x in read(0, cut) + read(cut, len(whole))] == want, cut


def test_frames_as_a_stream(spark, server, tmp_path):
    Handler.ranges, whole, seen = True, "".join(map(frame, range(30))).encode(), []
    for end in (0, 100, 101, 900, 901, len(whole)):  # the log grows, by parts of frames; the stream goes on from its checkpoint
        Handler.pages = {"/log": whole[:end]}
        events = requests.progress_events(spark, [f"{server}/log"], stream=True, chunk=64)
        q = events.writeStream.foreachBatch(lambda batch, _: seen.extend(r.progress for r in batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(120)
    assert sorted(seen) == list(range(30))


def test_recorded_chunks(spark):
    rng, rows, want = random.Random(4), [], []
    for stream in range(5):
        data = "".join(frame(n) + rng.choice(["", "\n", "\n\n"]) for n in range(12)).encode() + b"data: open"
        seq = 0
        while data:
            n = rng.choice([0, 1, 1, 2, 3, 50])
            rows.append((stream, seq, bytearray(data[:n])))
            data, seq = data[n:], seq + 1
        want += [(stream, frame(n).strip("\n")) for n in range(12)]
    found = requests.frames_of_chunks(spark.createDataFrame(rows, "stream int, seq int, data binary").repartition(3))
    assert sorted((r.stream, r.value.strip("\n")) for r in found.collect()) == sorted(want)
    assert readers.sse_events(found).count() == 60


def test_named_files(spark, tmp_path):
    path = str(tmp_path / "out")
    names = {"plain", "a b", "x/y", "100%", "_hidden", ".dot", "é+ü", "a%2Fb"}
    docs = spark.createDataFrame([(n, f"text of {n}") for n in names] + [(f"d{i}", f"<p>{i}</p>") for i in range(1000)], "output string, tagged string")
    named.write_named(docs.repartition(3), path, "tagged")
    back = {r.name: bytes(r.content).decode() for r in named.read_named(spark, path, ".xml").collect()}
    assert back == {r.output: r.tagged for r in docs.collect()}
    files = [f for d, _, fs in os.walk(path) for f in fs]
    assert len(files) == len(back) and not any(d.startswith("_pending") for d in os.listdir(path)) and len(os.listdir(path)) == 3
    named.write_named(docs.limit(5), path, "tagged", mode="overwrite")
    assert named.read_named(spark, path).count() == 5


def test_equal_names_nulls_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3"), ("b", None)], "output string, t string").coalesce(1)
    named.write_named(rows, str(tmp_path / "o"), "t", suffix=".md")
    assert {(r.name, bytes(r.content)) for r in named.read_named(spark, str(tmp_path / "o"), ".md").collect()} == {("a", b"1"), ("a~2", b"2"), ("unnamed", b"3")}
    assert "b.md" in [f for _, _, fs in os.walk(tmp_path / "o") for f in fs]  # empty: Spark doesn't read it
    named.write_named(rows.where("false"), str(tmp_path / "n"), "t")
    assert os.listdir(tmp_path / "n") == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.range(0, 400, 1, 4).select(F.col("id").cast("string").alias("output"), F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("tagged"))
    with pytest.raises(Exception, match="no"):
        named.write_named(docs, path, "tagged")
    assert [f for _, _, fs in os.walk(path) for f in fs] == [] and not [d for d in os.listdir(path) if d.startswith(("part-", "_pending"))]


def test_log_files(spark, tmp_path):
    rows = spark.createDataFrame([("abcdefghij", dt.datetime(2024, 5, 6, 7, 8, 9), "<p>", None, "a\tO", None, None, "{}")], "request_id string, ts timestamp, tagged string, text string, conll string, spans string, questions string, metadata string")
    from examweft.sources import sinks

    named.log_files(rows.withColumn("folder", sinks.request_folder()), str(tmp_path / "log"))
    got = {r.name: bytes(r.content) for r in named.read_named(spark, str(tmp_path / "log")).collect()}
    assert got == {f"req_20240506_070809_abcdefgh--{n}": c for n, c in (("annotated.xml", b"<p>"), ("tags.conll", b"a\tO"), ("metadata.json", b"{}"))}


def test_recorded_chunks_are_never_broadcast(spark):
    """Chunks cut out of a small table are many: no side of them may go through the driver, whatever size Spark guesses."""
    frames = spark.range(50).select((F.col("id") % 3).alias("stream"), "id", F.encode(F.concat(F.lit("data: é"), F.col("id").cast("string"), F.lit("\n\n")), "utf-8").alias("data"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("data"), F.lit(2)), lambda p: F.substring(F.col("data"), p, F.lit(2)))
    cut = frames.select("stream", "id", F.posexplode(pieces).alias("at", "data")).select("stream", (F.col("id") * 1000 + F.col("at")).alias("seq"), "data")
    found = requests.frames_of_chunks(cut)
    assert {r.value.strip("\n") for r in found.collect()} == {f"data: é{n}" for n in range(50)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("packed", [False, True])
def test_named_files_in_many_folders(spark, tmp_path, packed):
    """A task goes on in a new folder or archive; the driver lists only these."""
    path = str(tmp_path / "out")
    rows = spark.range(0, named.ROLL + 500, 1, 1).select(F.concat(F.lit("n+ é"), F.col("id").cast("string")).alias("output"), F.repeat(F.lit("x"), (F.col("id") % 400).cast("int")).alias("text"))
    named.write_named(rows, path, "text", suffix=".md", packed=packed)
    named.write_named(rows.limit(3), path, "text", suffix=".png", packed=packed)
    assert len(os.listdir(path)) == 3 and all(os.path.isfile(f"{path}/{p}") == packed for p in os.listdir(path))
    back = named.read_named(spark, path, ".md")
    assert back.rdd.getNumPartitions() == 2
    for archive in os.listdir(path) if packed else ():
        with zipfile.ZipFile(f"{path}/{archive}") as opened:
            assert opened.testzip() is None and all(n.startswith("n+ é") for n in opened.namelist())
    want = rows.where("text <> ''").select("output", F.encode("text", "utf-8"))
    assert back.count() == want.count() and want.exceptAll(back).isEmpty()
    named.write_named(rows.limit(2), path, "text", suffix=".md", mode="overwrite", packed=packed)
    assert len(os.listdir(path)) == 1


def test_queries_of_files_list_none_on_the_driver(spark, tmp_path):
    """Spark's reader of files keeps all their names on the driver."""
    import __spark_entry__ as entry

    spark.range(1, 200).selectExpr("id AS p_partkey", "concat('Part ', id) AS p_name").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 200).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "'s' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(5).selectExpr("id AS page_id", "concat('<p>a ', id, '</p>') AS html").write.parquet(str(tmp_path / "pages.parquet"))
    for name, n in (("example_image_pairs", 149), ("pdf_pages", 2 * 196 + 3), ("exported_files", 10)):
        df = entry.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == n and "named_files" in plan and not any(x in plan for x in ("binaryFile", "Relation [value", "Relation [path")), name


def test_log_files_take_no_block_each(spark, tmp_path):
    rows = spark.range(2_000).select(F.concat(F.lit("req_"), "id").alias("folder"), F.lit("view").alias("text"), F.lit("{}").alias("metadata"))
    named.log_files(rows.coalesce(2), str(tmp_path / "log"))
    assert named.read_named(spark, str(tmp_path / "log")).count() == 4_000
    assert sum(os.stat(os.path.join(d, f)).st_blocks * 512 for d, _, fs in os.walk(tmp_path / "log") for f in fs) < 4_000 * 256
