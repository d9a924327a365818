"""Recordings as a Spark data source: SQLite message logs read in ranges, streamed by offsets, and written with their manifests.

    register(spark)
    spark.read.format("recording").load(folder).where("topic = '/points' and timestamp >= 5")
    spark.readStream.format("recording").load(folder)
    write_recordings(messages, folder)

A log is split by ranges of message ids, about ``partition_bytes`` of file each, so a log of any size is read by many tasks, each of which
walks its own part of the log's tree and never holds the log; small logs share a task.  Filters on topic, timestamp and id go into the log's own query.
The stream's offset is the last id of each log: a batch holds what logs grew by, and new logs.  The offset itself tells them, or, with ``offsets``,
a folder of this one stream that is kept as long as its checkpoint, it names a file there that does.

Nothing on the driver grows with the number of logs but that: with ``plans``, a folder that all share, what a task reads stands in a file there, and logs
are written, named and moved to their recordings by tasks.

SQLite opens files by name, so the folder must be mounted at the same path on the driver and all executors (a plain path or
``file:``); logs in other stores are read whole by ``recordings.read_messages``.

Cases: a file that is no log is one row with ``error``; a log without messages gives none; topics without a type have a null one;
hidden folders are left out; an id, time or topic may be null in no log.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing, suppress
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from ..session import discard
from .folders import in_chunks, is_local, lines, local_path, place, put_lines, walked
from .recordings import read_in_batches

MESSAGES = "bag string, file string, topic string, type string, id long, timestamp long, data binary, error string"
TOPICS = "bag string, file string, topic string, type string, n long, first_ns long, last_ns long, error string"
_MADE = "bag string, file string, first long, last long, topics string"
#: Bytes of log a task, rows and bytes of an output batch.
PARTITION_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 4096, 8 << 20
#: What opening a log costs in bytes read; small logs are dealt out to so many tasks at most.
OPEN_BYTES, TASKS = 64 << 10, 1024
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_COLUMNS = {"topic": "t.name", "timestamp": "+m.timestamp", "id": "m.id"}  # "+": the range of ids is walked, not the index of times
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def each_log(path: str) -> Iterator[str]:
    """The logs of a folder and those below it, or the one log that is named."""
    root = local_path(path)
    return iter([root]) if os.path.isfile(root) else walked(root, (".db3",))


def find_logs(path: str) -> list[str]:
    """The logs of a folder in one list."""
    return sorted(each_log(path))


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def bag_of(file: str) -> str:
    """A log belongs to the recording of its folder."""
    return os.path.basename(os.path.dirname(file))


@dataclass
class Span:
    """Messages of a log with ids from ``lo`` to ``hi``, where they are told, about ``size`` bytes of it."""

    file: str
    lo: int | None = None
    hi: int | None = None
    error: str | None = None
    size: int = 0


@dataclass
class Task(InputPartition):
    """Spans of one task: a part of a large log, or many small logs; told here, or in a file from one byte to another."""

    spans: list[Span]
    listed: tuple[str, int, int] | None = None

    def __post_init__(self) -> None:
        super().__init__(None)

    def each(self) -> Iterator[Span]:
        return (Span(*row) for row in lines(*self.listed)) if self.listed else iter(self.spans)


def packed(spans: list[Span], size: int) -> list[Task]:
    """Spans in their order, as many a task as fit in ``size`` bytes, or more if that made over ``TASKS`` tasks; a log counts ``OPEN_BYTES`` at least."""
    size = max(size, sum(max(OPEN_BYTES, s.size) for s in spans) // TASKS)
    out: list[Task] = []
    held = size
    for s in spans:
        cost = max(OPEN_BYTES, s.size)
        if not out or held + cost > size:
            out.append(Task([]))
            held = 0
        out[-1].spans.append(s)
        held += cost
    return out


def planned(spans: Iterable[Span], size: int, folder: str | None) -> list[Task]:
    """``packed``, with the spans in a file of ``folder`` where one is told."""
    if folder is None:
        return packed(list(spans), size)
    path, total = os.path.join(folder, f"spans-{uuid.uuid4().hex}.jsonl"), 0

    def rows() -> Iterator[list]:
        nonlocal total
        for s in spans:
            total += max(OPEN_BYTES, s.size)
            yield [s.file, s.lo, s.hi, s.error, s.size]

    put_lines(path, rows())
    size = max(size, total // TASKS)
    out: list[Task] = []
    start = at = held = 0
    with open(path, "rb") as f:
        for line in f:
            cost = max(OPEN_BYTES, json.loads(line)[-1])
            if held and held + cost > size:
                out.append(Task([], (path, start, at)))
                start, held = at, 0
            at, held = at + len(line), held + cost
    return [*out, Task([], (path, start, at))] if held else out


def spans(file: str, lo: int | None, hi: int | None, size: int) -> list[Span]:
    """A log's ids in ranges of about ``size`` bytes of file; the two ends are found in the log's tree without a scan.

    A log of ``size`` bytes or less is one range, and left to its task to open.
    """
    whole = os.path.getsize(file)
    if whole <= size:
        return [Span(file, lo, hi, size=whole)]
    try:
        with closing(opened(file)) as db:
            a, b = db.execute("select min(id) from messages").fetchone()[0], db.execute("select max(id) from messages").fetchone()[0]
    except sqlite3.Error as e:
        return [Span(file, error=str(e))]
    if a is None:
        return []
    a, b = max(a, a if lo is None else lo), min(b, b if hi is None else hi)
    n = max(1, min(b - a + 1, -(-whole // size)))
    step = -(-(b - a + 1) // n)
    return [Span(file, k, min(b, k + step - 1), size=whole // n) for k in range(a, b + 1, step)]


def _row_batches(rows: Iterator[tuple], fields: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    pairs = [c.split() for c in fields.split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in pairs])
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, bytes))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def _type_column(db: sqlite3.Connection) -> str:
    return "t.type" if any(r[1] == "type" for r in db.execute("pragma table_info(topics)")) else "null"


@dataclass
class Wanted:
    """What a log's own query is asked for."""

    where: list[str] = field(default_factory=list)
    values: list = field(default_factory=list)
    head: int = 0
    first: int = 0
    at: int = -1

    def messages(self, span: Span) -> Iterator[tuple]:
        """Rows of a span; with ``head`` only the first bytes of a message are read, with ``first`` or ``at`` only some messages of each topic."""
        bag, file = bag_of(span.file), os.path.basename(span.file)
        if span.error:
            yield (bag, file, None, None, None, None, None, span.error)
            return
        try:
            with closing(opened(span.file)) as db:
                kind = _type_column(db)
                ends = [(f"m.id {op} ?", v) for op, v in ((">=", span.lo), ("<=", span.hi)) if v is not None]
                where = " and ".join([*(e for e, _ in ends), *self.where]) or "true"
                values = [*(v for _, v in ends), *self.values]
                data = "null" if self.head else "m.data"
                sql = f"select t.name, {kind}, m.id, m.timestamp, {data} from messages m join topics t on t.id = m.topic_id where {where}"
                if self.first or self.at >= 0:
                    rank = "row_number() over (partition by m.topic_id order by m.timestamp, m.id) - 1"
                    keep = f"k < {self.first}" if self.first else f"k = {self.at}"
                    ids = f"select id from (select m.id as id, {rank} as k from messages m join topics t on t.id = m.topic_id where {where}) where {keep}"
                    sql, values = f"{sql} and m.id in ({ids})", [*values, *values]
                for topic, kind, k, ns, raw in db.execute(sql + " order by m.id", values):
                    if self.head:
                        with db.blobopen("messages", "data", k, readonly=True) as blob:
                            raw = blob.read(self.head)
                    yield (bag, file, topic, kind, k, ns, raw, None)
        except sqlite3.Error as e:
            yield (bag, file, None, None, None, None, None, str(e))

    def topics(self, span: Span) -> Iterator[tuple]:
        """A log's topics with their counts and times, told by the log without reading a message."""
        bag, file = bag_of(span.file), os.path.basename(span.file)
        try:
            with closing(opened(span.file)) as db:
                times = "count(m.id), min(m.timestamp), max(m.timestamp)"
                for row in db.execute(f"select t.name, {_type_column(db)}, {times} from topics t left join messages m on m.topic_id = t.id group by t.id"):
                    yield (bag, file, *row, None)
        except sqlite3.Error as e:
            yield (bag, file, None, None, None, None, None, str(e))


class RecordingReader(DataSourceReader):
    """Tasks of a batch read."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.topics = options.get("mode") == "topics"
        self.plans = local_path(options["plans"]) if options.get("plans") else None
        self.wanted = Wanted(head=int(options.get("head_bytes", 0)), first=int(options.get("first", 0)), at=int(options.get("at", -1)))
        if options.get("topic"):
            self.wanted.where, self.wanted.values = ["t.name = ?"], [options["topic"]]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = _COLUMNS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 and not self.topics else None
            # what picks messages by their rank must see the rank first, so only the topic may go before it
            if column is None or ((self.wanted.first or self.wanted.at >= 0) and column != "t.name"):
                yield f
            elif type(f) in _OPERATORS and f.value is not None:
                self.wanted.where.append(f"{column} {_OPERATORS[type(f)]} ?")
                self.wanted.values.append(f.value)
            elif isinstance(f, In) and None not in f.value:
                self.wanted.where.append(f"{column} in ({', '.join('?' * len(f.value))})")
                self.wanted.values += f.value
            else:
                yield f

    def partitions(self) -> Sequence[Task]:
        logs = each_log(self.path)
        if self.topics:
            return planned((Span(f) for f in logs), self.size, self.plans) or [Task([])]
        # what picks messages of a whole log by their rank is one span a log
        size = self.size if not (self.wanted.first or self.wanted.at >= 0) else 1 << 62
        cut = in_chunks(lambda f: spans(f, None, None, size), logs)
        return planned((s for some in cut for s in some), self.size, self.plans) or [Task([])]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        rows = self.wanted.topics if self.topics else self.wanted.messages
        yield from _row_batches((r for s in partition.each() for r in rows(s)), TOPICS if self.topics else MESSAGES)


class RecordingStream(DataSourceStreamReader):
    """Batches of what logs grew by: the offset is each log's last id, or names a file of ``offsets`` that tells them in the order of ``place``."""

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.wanted = options["path"], int(options.get("partition_bytes", PARTITION_BYTES)), Wanted()
        self.offsets = local_path(options["offsets"]) if options.get("offsets") else None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        def last(f: str) -> tuple[str, int | None]:
            try:
                with closing(opened(f)) as db:
                    return f, db.execute("select max(id) from messages").fetchone()[0] or 0
            except sqlite3.Error:  # it is being written, or broken: looked at again with the next batch
                return f, None

        found = (one for one in in_chunks(last, each_log(self.path)) if one[1] is not None)
        if self.offsets is None:
            return dict(found)
        digest, n, part = hashlib.sha256(), 0, os.path.join(self.offsets, f"new-{uuid.uuid4().hex}")

        def told() -> Iterator[tuple]:
            nonlocal n
            for one in found:
                digest.update(repr(one).encode("utf-8", "surrogateescape"))
                n += 1
                yield one

        put_lines(part, told())
        # the same logs give the same name, so Spark sees that nothing came
        os.replace(part, self._told(digest.hexdigest()))
        return {"logs": digest.hexdigest()} if n else {}

    def _told(self, name: str) -> str:
        return os.path.join(self.offsets, f"logs-{name}.jsonl")

    def _logs(self, offset: dict) -> Iterator[Sequence]:
        return lines(self._told(offset["logs"])) if "logs" in offset else iter(sorted(offset.items(), key=lambda one: place(one[0])))

    def _grown(self, start: dict, end: dict) -> Iterator[tuple[str, int, int]]:
        """Logs of ``end`` with the first and last id that ``start`` did not have."""
        before = self._logs(start)
        held = next(before, None)
        for f, hi in self._logs(end):
            while held is not None and place(held[0]) < place(f):
                held = next(before, None)
            lo = held[1] + 1 if held is not None and held[0] == f else 0
            if hi >= lo:
                yield f, lo, hi

    def partitions(self, start: dict, end: dict) -> Sequence[Task]:
        cut = in_chunks(lambda g: spans(*g, self.size), self._grown(start, end))
        return planned((s for some in cut for s in some), self.size, self.offsets)

    def commit(self, end: dict) -> None:
        """Files of offsets before ``end`` are not asked for again."""
        if self.offsets is None or "logs" not in end:
            return
        with suppress(FileNotFoundError):
            at = os.stat(self._told(end["logs"])).st_mtime_ns
            for one in os.scandir(self.offsets):
                if one.stat().st_mtime_ns < at:
                    os.remove(one.path)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        yield from _row_batches((r for s in partition.each() for r in self.wanted.messages(s)), MESSAGES)


class _Log:
    """A log that is being written, in the order of its messages."""

    def __init__(self, bag: str, file: str) -> None:
        self.bag, self.file, self.topics, self.first, self.last = bag, file, {}, None, None
        self.db = sqlite3.connect(file)
        self.db.executescript("pragma journal_mode = off; pragma synchronous = off; pragma locking_mode = exclusive; begin")
        self.db.execute("create table topics (id integer primary key, name text not null, type text, serialization_format text not null)")
        self.db.execute("create table messages (id integer primary key, topic_id integer not null, timestamp integer not null, data blob not null)")

    def put(self, name: str, kind: str | None, ns: int, data: bytes) -> None:
        topic = self.topics.get(name)
        if topic is None:
            topic = self.topics[name] = [len(self.topics) + 1, kind, 0]
            self.db.execute("insert into topics values (?, ?, ?, 'cdr')", (topic[0], name, kind))
        self.db.execute("insert into messages (topic_id, timestamp, data) values (?, ?, ?)", (topic[0], ns, data))
        topic[2] += 1
        self.first, self.last = ns if self.first is None else min(self.first, ns), ns if self.last is None else max(self.last, ns)

    def close(self) -> tuple:
        """What is told of the log: a row of ``_MADE``."""
        self.db.execute("create index timestamp_idx on messages (timestamp)")
        self.db.commit()
        self.db.close()
        return self.bag, self.file, self.first, self.last, json.dumps(self.topics)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _logs_made(batches: Iterator[pa.RecordBatch], staging: str) -> Iterator[pa.RecordBatch]:
    """Write rows ``bag, slice, topic, type, timestamp, data``, in order, as logs of the staging folder; each slice of a recording is one."""
    folder = os.path.join(staging, uuid.uuid4().hex)

    def made() -> Iterator[tuple]:
        for k, ((bag, _), rows) in enumerate(groupby(_rows(batches), key=lambda r: r[:2])):
            os.makedirs(folder, exist_ok=True)
            log = _Log(bag, os.path.join(folder, f"{k}.db3"))
            with closing(log.db):
                for r in rows:
                    log.put(*r[2:])
                yield log.close()

    return _row_batches(made(), _MADE)


def _logs_settled(batches: Iterator[pa.RecordBatch], root: str, staging: str) -> Iterator[pa.RecordBatch]:
    """Give the logs of a recording, rows of ``_MADE`` in order, their names and a manifest and put them in place; a task that is run again goes on where the other ended."""

    def settled() -> Iterator[tuple]:
        for bag, rows in groupby(_rows(batches), key=lambda r: r[0]):
            logs = [{"file": file, "first": first, "last": last, "topics": json.loads(topics), "name": f"{bag}_{k}.db3"} for k, (_, file, first, last, topics) in enumerate(rows)]
            made, home = os.path.join(staging, f"bag-{hashlib.sha256(bag.encode()).hexdigest()}"), os.path.join(root, bag)
            if os.path.isdir(made) or any(os.path.exists(x["file"]) for x in logs):
                os.makedirs(made, exist_ok=True)
                for x in logs:
                    if not os.path.exists(os.path.join(made, x["name"])):
                        os.replace(x["file"], os.path.join(made, x["name"]))
                with open(os.path.join(made, "metadata.yaml"), "w", encoding="utf-8") as f:
                    f.write(manifest(logs))
                if os.path.exists(home):
                    os.replace(home, os.path.join(staging, f"old-{uuid.uuid4().hex}"))
                os.replace(made, home)
            yield (bag,)

    return _row_batches(settled(), "bag string")


def manifest(logs: list[dict]) -> str:
    """``metadata.yaml`` of a recording, from its logs in order."""
    topics: dict[str, list] = {}
    for log in logs:
        for name, (_, kind, n) in log["topics"].items():
            topics.setdefault(name, [kind, 0])[1] += n
    first, last = min(x["first"] for x in logs), max(x["last"] for x in logs)
    text = lambda v: "'" + str(v).replace("'", "''") + "'"
    out = ["rosbag2_bagfile_information:", "  version: 5", "  storage_identifier: sqlite3", "  duration:", f"    nanoseconds: {last - first}"]
    out += ["  starting_time:", f"    nanoseconds_since_epoch: {first}", f"  message_count: {sum(n for _, n in topics.values())}", "  topics_with_message_count:"]
    for name, (kind, n) in sorted(topics.items()):
        out += ["    - topic_metadata:", f"        name: {text(name)}", f"        type: {text(kind or '')}", "        serialization_format: cdr", f"      message_count: {n}"]
    out += ["  compression_format: ''", "  compression_mode: ''", "  relative_file_paths:", *[f"    - {text(x['name'])}" for x in logs]]
    return "\n".join(out) + "\n"


class RecordingSource(DataSource):
    """Format ``recording``; options ``topic``, ``partition_bytes``, ``head_bytes``, ``first``, ``at``, ``mode`` (``topics``), ``plans`` and, of a stream, ``offsets``."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return TOPICS if self.options.get("mode") == "topics" else MESSAGES

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def streamReader(self, schema: StructType) -> RecordingStream:  # noqa: N802
        return RecordingStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters through to it."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(RecordingSource)


def read_recordings(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and is_local(shared):
        options = {"plans": f"{shared.rstrip('/')}/recording-plans"} | options
    return spark.read.format("recording").options(**options).load(path)


def recording_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics of each log, with counts and times, without reading messages."""
    return read_recordings(spark, path, mode="topics")


def message_at(spark: SparkSession, path: str, topic: str, index: int) -> DataFrame:
    """The ``index``-th message of a topic of each log, by time; the only message that is read."""
    return read_recordings(spark, path, topic=topic, at=index)


def write_recordings(messages: DataFrame, path: str, mode: str = "append", file_ns: int | None = None) -> None:
    """Write ``bag, topic, type, timestamp, data`` as recordings, in the order of time.

    With ``file_ns`` a recording has a log a span of so much time, so a long one is written by several tasks.  Tasks write logs to a staging folder;
    when all are there, tasks give them their names and their recordings a manifest.  A recording that is there already is an error, or is replaced
    by mode ``overwrite``.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode is append or overwrite, not {mode}")
    spark, root = messages.sparkSession, local_path(path)
    staging = os.path.join(root, f"_staging-{uuid.uuid4().hex}")
    part = F.lit(0).cast("long") if file_ns is None else F.floor(F.col("timestamp") / file_ns)
    rows = messages.select("bag", part.alias("slice"), "topic", "type", "timestamp", "data")
    # logs cost by their number more than by their bytes, so the number of tasks is told and not left to what bytes need
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = None
    try:
        rows = rows.repartition(tasks, "bag", "slice").sortWithinPartitions("bag", "slice", "timestamp", "topic")
        made = read_in_batches(rows.mapInArrow(lambda batches: _logs_made(batches, staging), _MADE), "recordings-made")
        if mode == "append":

            def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                return _row_batches((r for r in _rows(batches) if os.path.exists(os.path.join(root, r[0]))), "bag string")

            names = [r.bag for r in made.select("bag").mapInArrow(there, "bag string").limit(5).collect()]
            if names:
                raise FileExistsError(f"recordings that are there already: {sorted(set(names))}")
        logs = made.repartition(tasks, "bag").sortWithinPartitions("bag", "first", "last", "file")
        logs.mapInArrow(lambda batches: _logs_settled(batches, root, staging), "bag string").write.format("noop").mode("overwrite").save()
    finally:
        shutil.rmtree(staging, ignore_errors=True)
        if made is not None:
            discard(made)
