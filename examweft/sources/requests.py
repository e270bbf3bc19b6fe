"""What comes over HTTP, as Spark data sources: JSON answers, and streams of server-sent events.

``register`` makes both known to a session. A url is a partition; bodies are read by the tasks, never by the driver.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from examweft.sources.readers import json_documents, sse_events

ATTEMPTS, DELAY, TIMEOUT, CHUNK = 3, 2.0, 60.0, 1 << 16
SEPARATOR = b"\n\n"


def _opened(url: str, headers: dict[str, str], options: dict[str, str], method: str = "GET"):
    """An answer, after ``attempts`` with a pause between them; an answer that refuses the request is one as well."""
    left = int(options.get("attempts", ATTEMPTS))
    while True:
        try:
            return urllib.request.urlopen(urllib.request.Request(url, headers=headers, method=method), timeout=float(options.get("timeout", TIMEOUT)))  # noqa: S310
        except urllib.error.HTTPError as refused:
            if refused.code < 500:
                return refused
            error = refused
        except OSError as failed:
            error = failed
        left -= 1
        if left <= 0:
            raise error
        time.sleep(float(options.get("delay", DELAY)))


class _Url(InputPartition):
    def __init__(self, url: str, start: int = 0, end: int | None = None):
        self.url, self.start, self.end = url, start, end


class _JsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Url(url) for url in self.options["urls"].split()]

    def read(self, partition: _Url) -> Iterator[tuple]:
        with _opened(partition.url, {"Accept": "application/json"}, self.options) as answer:
            yield partition.url, answer.status, answer.read().decode("utf-8", "replace")


class JsonRequests(DataSource):
    """url, status, body of each url of the option ``urls`` (separated by white space). A url without an answer fails the task."""

    @classmethod
    def name(cls) -> str:
        return "json_requests"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _JsonReader(dict(self.options))


def frames(chunks: Iterator[bytes], at: int = 0) -> Iterator[tuple[int, str]]:
    """(where it ends, text) of each frame in the bytes that ``chunks`` make up from ``at`` on. A frame ends with a blank line; what
    no blank line ends is no frame yet. What a chunk leaves over, parts of a character included, goes before the next chunk."""
    rest = b""
    for chunk in chunks:
        rest += chunk
        *whole, rest_after = rest.split(SEPARATOR)
        for frame in whole:
            at += len(frame) + len(SEPARATOR)
            if frame.strip():
                yield at, frame.decode("utf-8", "replace")
        rest = rest_after


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.chunk = options, int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        return [_Url(url) for url in self.options["urls"].split()]

    def _bytes(self, url: str, start: int, end: int | None) -> Iterator[bytes]:
        """The bytes of a range, a chunk at a time; from a server that knows no ranges what is before is read and left."""
        headers = {"Accept": "text/event-stream"} | ({"Range": f"bytes={start}-{'' if end is None else end - 1}"} if start or end is not None else {})
        with _opened(url, headers, self.options) as answer:
            if answer.status >= 300:
                raise OSError(f"{url}: {answer.status}")
            skip, left = (0 if answer.status == 206 else start), (None if end is None else end - start)
            while (left is None or left > 0) and (data := answer.read(self.chunk)):
                data, skip = data[skip:], max(0, skip - len(data))
                data = data if left is None else data[:left]
                left = None if left is None else left - len(data)
                yield data

    def read(self, partition: _Url) -> Iterator[tuple]:
        """The frames that end in the range. Their first may begin before it: bytes are fetched backwards up to the blank line there."""
        lead, at = b"", partition.start
        while at and SEPARATOR not in lead:
            before = max(0, at - self.chunk)
            lead, at = b"".join(self._bytes(partition.url, before, at)) + lead, before
        lead = lead[lead.rfind(SEPARATOR) + len(SEPARATOR) :] if SEPARATOR in lead else lead

        def chunks() -> Iterator[bytes]:
            yield lead
            yield from self._bytes(partition.url, partition.start, partition.end)

        if partition.end is None or partition.end > partition.start:
            for end, frame in frames(chunks(), partition.start - len(lead)):
                yield partition.url, end, frame


class _FrameStream(_FrameReader, DataSourceStreamReader):
    """Offsets are bytes by url; how many there are is asked of the server."""

    def initialOffset(self) -> dict:
        return {url: 0 for url in self.options["urls"].split()}

    def latestOffset(self) -> dict:
        found = {}
        for url in self.options["urls"].split():
            with _opened(url, {}, self.options, "HEAD") as answer:
                found[url] = int(answer.headers.get("Content-Length") or 0)
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Url(url, start.get(url, 0), to) for url, to in end.items() if to > start.get(url, 0)]


class EventFrames(DataSource):
    """url, end (where in its bytes the frame ends) and value (the frame) of each url of the option ``urls``; as a stream, what has
    come since. Options ``chunk`` (bytes read at a time), ``attempts``, ``delay`` and ``timeout`` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "event_frames"

    def schema(self) -> str:
        return "url string, end long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FrameStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonRequests)
    spark.dataSource.register(EventFrames)


def requested(spark: SparkSession, urls: list[str], kind: str, **options: object) -> DataFrame:
    """Documents of a kind ("exams" or "submissions") from urls that answer with a list of them, or with one."""
    register(spark)
    answers = spark.read.format("json_requests").options(urls=" ".join(urls), **options).load().where("status between 200 and 299")
    lists = F.when(F.startswith(F.ltrim("body"), F.lit("[")), F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    each = answers.select(F.explode(F.from_json(lists, "array<variant>")).alias("v")).select(F.to_json("v").alias("data"))
    return json_documents(each, kind)


def progress_events(spark: SparkSession, urls: list[str], stream: bool = False, **options: object) -> DataFrame:
    """Progress events of urls that send them, as a table of what there is or as a stream."""
    register(spark)
    source = (spark.readStream if stream else spark.read).format("event_frames").options(urls=" ".join(urls), **options)
    return sse_events(source.load())


def frames_of_chunks(chunks: DataFrame) -> DataFrame:
    """(stream, number, value): the frames of recorded chunks (stream, seq, data binary), cut anywhere, parts of a character included.

    A chunk is cut at blank lines; whether one begins at its start depends on the last byte of the chunk before. Chunks are
    dealt by stream once, and numbered and gathered by frame where they are: without a join, whose sides Spark would take for as
    small as what they are cut out of and broadcast. Empty chunks count for nothing; what no blank line ends is no frame.
    """
    text = F.decode("data", "ISO-8859-1")  # a character for each byte
    full = chunks.where(F.length("data") > 0).select("stream", "seq", text.alias("text"))
    order = Window.partitionBy("stream").orderBy("seq")
    follows = F.coalesce(F.lag(F.right("text", F.lit(1)) == "\n").over(order), F.lit(False))
    parts = F.split(F.when(F.col("follows"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text")), "\n\n+")
    cut = full.withColumn("follows", follows).select("stream", "seq", "follows", parts.alias("parts"))
    before = F.sum(F.size("parts") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.withColumn("before", F.coalesce(before, F.lit(0)))
    pieces = numbered.select("stream", "seq", "before", "follows", F.posexplode("parts").alias("at", "piece"), F.size("parts").alias("parts"))
    # The line end that was put before a chunk goes again where no blank line took it.
    piece = F.when(F.col("follows") & (F.col("at") == 0) & F.startswith("piece", F.lit("\n")), F.substr("piece", F.lit(2))).otherwise(F.col("piece"))
    pieces = pieces.select("stream", (F.col("before") + F.col("at")).alias("number"), (F.col("at") < F.col("parts") - 1).alias("ended"), F.struct("seq", piece.alias("piece")).alias("p"))
    whole = pieces.groupBy("stream", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"), F.bool_or("ended").alias("ended"))
    value = F.decode(F.encode("text", "ISO-8859-1"), "UTF-8")
    return whole.where("ended").select("stream", "number", value.alias("value")).where(F.trim("value") != "")
