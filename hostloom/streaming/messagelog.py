"""A log of messages in shared storage as a streaming source and sink: topics, consumer groups, a bound of messages a batch, exactly once.

Tasks write files of messages that nobody reads until a commit names them. A commit is one file, numbered in order, with the messages' files and how many they
hold; an offset is a number of messages from the log's beginning, so a batch may end within a file. A batch that is written again after a failure is known by its
number and leaves no second commit. A log has one writer at a time and any number of readers; the storage is one that Arrow opens.
"""

from __future__ import annotations

import itertools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs  # noqa: F401  as pa.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "topic string, key string, value string"


class Log:
    """The folder of a log."""

    def __init__(self, path: str):
        self.system, self.path = pa.fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith(("/", "file:")) else path)

    def _listed(self, folder: str) -> list[str]:
        found = self.system.get_file_info(pa.fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))

    def put(self, folder: str, name: str, data: bytes) -> None:
        """A file that is there whole or not at all."""
        self.system.create_dir(f"{self.path}/{folder}", recursive=True)
        with self.system.open_output_stream(f"{self.path}/{folder}/.{name}", compression=None) as f:
            f.write(data)
        self.system.move(f"{self.path}/{folder}/.{name}", f"{self.path}/{folder}/{name}")

    def get(self, folder: str, name: str) -> bytes | None:
        if self.system.get_file_info(f"{self.path}/{folder}/{name}").type != pa.fs.FileType.File:
            return None
        with self.system.open_input_stream(f"{self.path}/{folder}/{name}", compression=None) as f:
            return f.read()

    def remove(self, folder: str, name: str) -> None:
        if self.get(folder, name) is not None:
            self.system.delete_file(f"{self.path}/{folder}/{name}")

    def commits(self) -> list[tuple[int, int, str, str]]:
        """From and to which message, the batch and the name of each commit, in order: all of it is in the names."""
        out = []
        for name in self._listed("commits"):
            found = re.fullmatch(r"(\d{20})-(\d+)-(.*)\.json", name)
            out.append((int(found[1]), int(found[1]) + int(found[2]), found[3], name))
        return out

    def end(self) -> int:
        held = self.commits()
        return held[-1][1] if held else 0

    def commit(self, files: list[tuple[str, int]], batch: str) -> None:
        """Makes files of messages part of the log. A batch that is in it already isn't added again, and its new files go."""
        held = self.commits()
        n = sum(k for _, k in files)
        if any(b == batch for *_, b, _ in held) or not n:
            for name, _ in files:
                self.remove("messages", name)
            return
        start = held[-1][1] if held else 0
        self.put("commits", f"{start:020}-{n}-{batch}.json", json.dumps(files).encode())

    def pieces(self, start: int, end: int) -> Iterator[tuple[str, int, int]]:
        """The files between two offsets, and the lines of each."""
        for low, high, _, name in self.commits():
            if high <= start or low >= end:
                continue
            at = low
            for file, n in json.loads(self.get("commits", name)):
                if at + n > start and at < end:
                    yield file, max(start - at, 0), min(end - at, n)
                at += n

    def group(self, name: str) -> tuple[int, int] | None:
        """How far a consumer group has come, and where the batch ends that was planned last."""
        held = self.get("groups", name)
        return tuple(json.loads(held)) if held else None

    def advance(self, name: str, done: int, planned: int) -> None:
        before = self.group(name) or (0, 0)
        after = max(done, before[0]), max(planned, before[1])
        if after != before:
            self.put("groups", name, json.dumps(after).encode())


def metrics(path: str) -> dict:
    """Messages and commits of a log, and how many messages each consumer group has yet to acknowledge: Spark acknowledges a batch when it
    begins another, so the last one counts until then."""
    log = Log(path)
    held = log.commits()
    return {"messages": held[-1][1] if held else 0, "commits": len(held), "behind": {g: log.end() - log.group(g)[0] for g in log._listed("groups")}}


# The sink


@dataclass
class Written(DS.WriterCommitMessage):
    files: list


class _Writer:
    def __init__(self, path: str, batch: str):
        self.path, self.name = path, batch

    def write(self, iterator: Iterator[Row]) -> Written:
        """A task's messages, in files of bounded size; where the task fails, nobody knows them."""
        log, files = Log(self.path), []
        for part in itertools.batched(iterator, 10_000):
            name = f"{uuid.uuid4().hex}.jsonl"
            log.put("messages", name, b"".join(json.dumps([r.topic, r.key, r.value]).encode() + b"\n" for r in part))
            files.append((name, len(part)))
        return Written(files)

    def _files(self, messages) -> list:
        return [tuple(f) for m in messages if m is not None for f in m.files]

    def _abort(self, messages) -> None:
        log = Log(self.path)
        for name, _ in self._files(messages):
            log.remove("messages", name)


class BatchWriter(_Writer, DS.DataSourceWriter):
    def commit(self, messages) -> None:
        Log(self.path).commit(self._files(messages), self.name)

    def abort(self, messages) -> None:
        self._abort(messages)


class StreamWriter(_Writer, DS.DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        Log(self.path).commit(self._files(messages), f"{self.name}.{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self._abort(messages)


# The source


class Lines(DS.InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__(file)
        self.start, self.end = start, end


def _lines(path: str, part: Lines, topics: list[str]) -> Iterator[tuple]:
    held = Log(path).get("messages", part.value)
    for line in held.splitlines()[part.start : part.end]:
        topic, key, value = json.loads(line)
        if not topics or topic in topics:
            yield topic, key, value


class StreamReader(DS.DataSourceStreamReader):
    """Spark's checkpoint tells where a query goes on; the group's offset is what metrics() reports and where a query without a checkpoint begins."""

    def __init__(self, path: str, topics: list[str], group: str, most: int | None, starting: str):
        self.path, self.topics, self.name, self.most = path, topics, group, most
        self.starting, self.at = starting, None

    def initialOffset(self) -> dict:
        """Where the group stands. It is noted at the first call, for a query whose first batch failed asks again and must get the same answer."""
        log = Log(self.path)
        held = log.group(self.name)
        if held is None:
            start = 0 if self.starting == "earliest" else log.end()
            held = start, start
            log.put("groups", self.name, json.dumps(held).encode())
        return {"message": held[0]}

    def latestOffset(self) -> dict:
        """Spark doesn't tell where the next batch begins: where the last one was to end, which partitions() has noted."""
        log = Log(self.path)
        if self.at is None:
            self.at = max(self.initialOffset()["message"], log.group(self.name)[1])
        self.at = max(self.at, min(log.end(), self.at + self.most) if self.most else log.end())
        return {"message": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[DS.InputPartition]:
        log = Log(self.path)
        log.advance(self.name, 0, end["message"])
        self.at = max(self.at or 0, end["message"])
        return [Lines(*p) for p in log.pieces(start["message"], end["message"])]

    def read(self, partition: Lines) -> Iterator[tuple]:
        yield from _lines(self.path, partition, self.topics)

    def commit(self, end: dict) -> None:
        Log(self.path).advance(self.name, end["message"], end["message"])


class BatchReader(DS.DataSourceReader):
    def __init__(self, path: str, topics: list[str]):
        self.path, self.topics = path, topics

    def partitions(self) -> Sequence[DS.InputPartition]:
        log = Log(self.path)
        return [Lines(*p) for p in log.pieces(0, log.end())]

    def read(self, partition: Lines | None) -> Iterator[tuple]:
        if partition is not None:
            yield from _lines(self.path, partition, self.topics)


class MessageLog(DS.DataSource):
    """Options: path; topics (with commas between, all by default); group, messages (at most a batch) and starting (earliest or latest) to read; writer (a name
    that a restarted stream keeps) to write."""

    @classmethod
    def name(cls) -> str:
        return "messagelog"

    def schema(self) -> str:
        return SCHEMA

    def _topics(self) -> list[str]:
        return [t for t in self.options.get("topics", "").split(",") if t]

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options["path"], self._topics())

    def streamReader(self, schema) -> StreamReader:
        most = self.options.get("messages")
        return StreamReader(self.options["path"], self._topics(), self.options.get("group", "inventory"), int(most) if most else None, self.options.get("starting", "latest"))

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self.options.get("writer", "writer"))


def publish(df: DataFrame, path: str) -> None:
    """Messages (topic, key, value) as one commit of the log."""
    df.sparkSession.dataSource.register(MessageLog)
    df.select("topic", "key", "value").write.format("messagelog").option("path", path).mode("append").save()


def subscribe(spark: SparkSession, path: str, topics: list[str] = (), group: str = "inventory", messages: int | None = None, starting: str = "latest") -> DataFrame:
    """A stream of messages; those that a batch takes are bounded by messages."""
    spark.dataSource.register(MessageLog)
    bound = {"messages": str(messages)} if messages else {}
    return spark.readStream.format("messagelog").options(path=path, topics=",".join(topics), group=group, starting=starting, **bound).load()


def forward(stream: DataFrame, path: str, checkpoint: str, writer: str) -> StreamingQuery:
    """A stream of messages into a log, each once."""
    stream.sparkSession.dataSource.register(MessageLog)
    return stream.select("topic", "key", "value").writeStream.format("messagelog").options(path=path, writer=writer).option("checkpointLocation", checkpoint).outputMode("append").start()


def consume(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, idle: float = 1.0, most: int | None = None) -> int:
    """Batches of a stream go to handler until none has come for idle seconds, or most messages have; gives how many messages came. The stream is
    then stopped between batches; started again with its checkpoint, it goes on."""
    seen, last = [0], [time.time()]

    def count(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        n = batch.count()
        if n:
            handler(batch, number)
        batch.unpersist()
        seen[0] += n
        last[0] = time.time()

    query, begun = stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(), False
    try:
        while query.isActive and time.time() - last[0] < idle and not (most and seen[0] >= most):
            time.sleep(0.05)
            status = query.status
            begun = begun or status["message"] == "Waiting for data to arrive"
            if not begun or status["isDataAvailable"]:
                last[0] = time.time()
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return seen[0]
