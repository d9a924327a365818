"""Recordings: SQLite message logs, JSON result logs, and an incremental manifest of files."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written
from .folders import in_chunks, is_local, local_path, put_lines, walked

CAND = "struct<distance_m:double,forward_m:double,lateral_m:double,height_m:double,n_points:long,confidence:double,confirmed:boolean>"
#: One JSON object a frame; never inferred.
RESULT = f"""bag string, topic string, frame_index long, bag_time_ns long, relative_time_s double, header_time_ns long, frame_id string, status string,
distance_m double, forward_m double, reset boolean, processing_ms double, read_ms double, detector struct<status_raw:string,reason:string,n_total:long,n_valid:long,
n_roi:long,n_box:long,verified_to_m:double,timings_ms:map<string,double>,candidates:array<{CAND}>>"""


def read_results(spark: SparkSession, path: str, corrupt: str = "keep") -> DataFrame:
    """A result log.  Broken lines: ``keep`` as rows with ``_corrupt``, ``skip`` or ``fail``."""
    mode = {"keep": "PERMISSIVE", "skip": "DROPMALFORMED", "fail": "FAILFAST"}[corrupt]
    schema = RESULT + (", _corrupt string" if corrupt == "keep" else "")
    return spark.read.schema(schema).json(path, mode=mode, columnNameOfCorruptRecord="_corrupt")


def ordered_results(spark: SparkSession, path: str, corrupt: str = "keep") -> DataFrame:
    """A result log in order of recording and frame."""
    return read_results(spark, path, corrupt).orderBy("bag", "frame_index")


#: Changes when what is kept of a file changes, so that manifests of older code are made again.
MANIFEST_VERSION = 2
_OPEN_COST = "spark.sql.files.openCostInBytes"


def listed_files(spark: SparkSession, root: str, *names: str) -> DataFrame | None:
    """``path, bytes, modified`` of the files of a mounted folder whose names end so: listed in a file, as Spark's own listing holds them all on the driver.

    None where that can't be: the folder, or the one that all share, is in another store.
    """
    shared = shared_dir(spark)
    if not (is_local(root) and is_local(shared) and os.path.isdir(local_path(root))):
        return None

    def told(path: str) -> dict | None:
        try:
            at = os.stat(path)
        except FileNotFoundError:  # gone since
            return None
        return {"path": f"file:{path}", "bytes": at.st_size, "modified": at.st_mtime_ns // 1_000_000}

    path = f"{local_path(shared)}/files-{uuid.uuid4().hex}.jsonl"
    put_lines(path, (row for row in in_chunks(told, walked(os.path.abspath(local_path(root)), names, follow=True)) if row))
    files = spark.read.schema("path string, bytes long, modified long").json(f"file://{path}")
    return files.where(~F.col("path").rlike(r"/[._][^/]*$")).withColumn("modified", F.timestamp_millis("modified"))


def find_recordings(spark: SparkSession, root: str, max_depth: int = 5) -> DataFrame:
    """``path, bytes, modified, version, depth`` of message logs below a folder, read by no one yet.

    Hidden files and folders are left out, as are logs more than ``max_depth`` folders down, and logs inside a folder of
    another recording (one with a ``metadata.yaml``).
    """
    files = listed_files(spark, root, ".db3", "metadata.yaml")
    if files is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.db3,metadata.yaml}").load(root)
        files = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    top = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    below = F.substring_index("path", top, -1)
    f = files.where(~F.col("path").rlike(r"/\.")).select("path", "bytes", "modified", below.alias("below"))
    # files are listed once and only named here: what Spark adds to each one's bytes for its opening would make a task of every 32 small logs
    before = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, "4096")
    try:
        f = written(f, "recordings-found")
    finally:
        spark.conf.set(_OPEN_COST, before)
    f = f.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("depth", F.size(F.split("below", "/")) - 1)
    homes = f.where(F.col("path").endswith("/metadata.yaml")).select(F.col("folder").alias("home")).distinct()
    logs = f.where(F.col("path").endswith(".db3") & (F.col("depth") <= max_depth))
    # a log is inside another recording if one of the folders above its own has a manifest
    parts = F.split("folder", "/")
    above = logs.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("home"))
    inside = above.join(homes, "home", "left_semi").select("path").distinct()
    return logs.join(inside, "path", "left_anti").select("path", "bytes", "modified", F.lit(MANIFEST_VERSION).alias("version"), "depth")


def changed(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest does not have with this size, time and version."""
    key = ["path", "bytes", "modified", "version"]
    return found.join(manifest.select(*key), key, "left_anti")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small files of a mounted folder with their bytes."""
    for b in batches:
        for k in range(0, b.num_rows, 64):
            names = b.column("path")[k : k + 64].to_pylist()
            held = []
            for n in names:
                with open(n.removeprefix("file:"), "rb") as f:
                    held.append(f.read())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["path", "content"])


def expected_counts(spark: SparkSession, root: str) -> DataFrame:
    """``folder, topic, kind, expected`` of the topics that recordings' ``metadata.yaml`` list."""
    found = listed_files(spark, root, "metadata.yaml")
    if found is None:
        text = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.yaml").load(root)
    else:
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        text = found.where("path like '%/metadata.yaml'").select("path").repartition(tasks).mapInArrow(_contents, "path string, content binary")
    topics = F.regexp_extract_all(F.decode("content", "utf-8"), F.lit(r"(topic_metadata:\s+name: [^\n]*(?:\n(?!\s*- topic_metadata)[^\n]*)*)"), F.lit(1))
    t = text.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.explode(topics).alias("t"))
    field = lambda name: F.trim(F.regexp_extract("t", rf"\b{name}: *'?\"?([^\s'\"]+)", 1))
    return t.select("folder", field("name").alias("topic"), field("type").alias("kind"), field("message_count").cast("long").alias("expected"))


def completeness(counts: DataFrame, expected: DataFrame, stride: int = 1) -> DataFrame:
    """``folder, topic, n, expected, wanted, complete``: what was read of what a recording's manifest tells."""
    wanted = F.ceil(F.col("expected") / stride).cast("long")
    j = expected.join(counts.groupBy("folder", "topic").agg(F.sum("n").alias("n")), ["folder", "topic"], "left").fillna(0, ["n"])
    return j.select("folder", "topic", "n", "expected", wanted.alias("wanted"), (F.col("n") == wanted).alias("complete"))


def read_messages(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """``bag, topic, i, bag_time_ns, raw, error``: messages of SQLite logs in the order of storage.

    Files come through Spark's reader, so any store serves; that reader takes files of up to 2 GB, so larger
    logs become rows with ``error``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.db3").load(path)
    big = F.col("length") >= (1 << 31) - 1
    none = F.lit(None)
    late = files.where(big).select(F.col("path").alias("bag"), none.cast("string").alias("topic"), none.cast("long").alias("i"), none.cast("long").alias("bag_time_ns"), none.cast("binary").alias("raw"), F.lit("over 2 GB").alias("error"))
    return unpack(files.where(~big).select("path", "content"), topic).unionByName(late)


#: Bytes of logs that a Python worker is handed at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_in_batches(df: DataFrame, label: str) -> DataFrame:
    """What is read of whole logs ``path, content``, written while batches are bounded by bytes: Spark bounds them by 10,000 rows, whatever a log's size."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return written(df, label)
    finally:
        conf.set(_BATCH, before)


def _queried(files: DataFrame, sql: str, args: tuple, names: list[str], kinds: list[pa.DataType], fields: str, numbered: bool) -> DataFrame:
    """Rows of a query on each SQLite log ``path, content``, with the log's path before them; a file that is no log becomes a row with ``error``.

    Without ``content`` logs are opened where they lie, in a mounted folder, and of them only what the query needs is read.
    """
    whole = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one log at a time: all of a batch's logs again as Python's bytes took as much memory as the batch
                name = b.column("path")[k].as_py()
                db = sqlite3.connect(":memory:" if whole else f"file:{quote('/' + name.removeprefix('file:').lstrip('/'))}?mode=ro", uri=True)
                try:
                    if whole:
                        db.deserialize(b.column("content")[k].as_py())
                    cursor = db.execute(sql, args)
                    i = 0
                    while rows := cursor.fetchmany(64):
                        cols = [[name] * len(rows), *([list(c) for c in zip(*rows)]), [None] * len(rows)]
                        if numbered:
                            cols.insert(2, list(range(i, i + len(rows))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                        i += len(rows)
                except sqlite3.Error as e:
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip([name, *[None] * (len(names) - 2), str(e)], kinds, strict=True)], names)
                finally:
                    db.close()

    return files.select("path", *["content"] * whole).mapInArrow(run, fields)


def unpack(files: DataFrame, topic: str | None = None) -> DataFrame:
    """Messages of SQLite logs ``path, content``, as ``read_messages`` gives them; ``topic`` is pushed into each log's query."""
    sql = "select t.name, m.timestamp, m.data from messages m join topics t on t.id = m.topic_id" + (" where t.name = ?" if topic else "") + " order by m.timestamp, m.id"
    names, kinds = ["bag", "topic", "i", "bag_time_ns", "raw", "error"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return _queried(files, sql, (topic,) if topic else (), names, kinds, "bag string, topic string, i long, bag_time_ns long, raw binary, error string", True)


def count_messages(files: DataFrame, topic: str | None = None) -> DataFrame:
    """``bag, topic, n, error`` counted by each log itself: no message is read."""
    sql = "select t.name, count(m.id) from topics t left join messages m on t.id = m.topic_id" + (" where t.name = ?" if topic else "") + " group by t.name"
    return _queried(files, sql, (topic,) if topic else (), ["bag", "topic", "n", "error"], [pa.string(), pa.string(), pa.int64(), pa.string()], "bag string, topic string, n long, error string", False)


def inspect_logs(files: DataFrame) -> DataFrame:
    """``bag, topic, n, backward, error``: messages and steps back in time as they were logged, counted by each log itself: no payload is read."""
    rows = "select t.name, m.timestamp, lag(m.timestamp) over (partition by t.name order by m.id) as before from messages m join topics t on t.id = m.topic_id"
    sql = f"select name, count(*), coalesce(sum(timestamp < before), 0) from ({rows}) group by name"
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return _queried(files, sql, (), ["bag", "topic", "n", "backward", "error"], kinds, "bag string, topic string, n long, backward long, error string", False)


def message_at(files: DataFrame, topic: str, index: int) -> DataFrame:
    """The ``index``-th message of a topic of each log, found by the log's own order and offset."""
    sql = "select t.name, m.timestamp, m.data from messages m join topics t on t.id = m.topic_id where t.name = ? order by m.timestamp, m.id limit 1 offset ?"
    names, kinds = ["bag", "topic", "bag_time_ns", "raw", "error"], [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return _queried(files, sql, (topic, index), names, kinds, "bag string, topic string, bag_time_ns long, raw binary, error string", False)


def topic_counts(messages: DataFrame) -> DataFrame:
    """Messages a recording and topic, with backward steps of time."""
    w = Window.partitionBy("bag", "topic").orderBy("i")
    back = (F.col("bag_time_ns") < F.lag("bag_time_ns").over(w)).cast("int")
    return messages.where("error is null").withColumn("_b", back).groupBy("bag", "topic").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("backward"))


def pick_topic(counts: DataFrame, wanted: str | None = None) -> str:
    """The topic asked for, or the only one; several are an error."""
    names = sorted(r.topic for r in counts.select("topic").distinct().collect())  # a recording's topics, a few dozen names
    if wanted is not None:
        if wanted not in names:
            raise ValueError(f"no topic {wanted}; there are {names}")
        return wanted
    if len(names) != 1:
        raise ValueError(f"choose one of {names}")
    return names[0]


def inspect(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """``topic, n, problem, note``: a recording that lacks messages or topics has a problem, steps back in time are noted."""
    e = expected.groupBy("topic").agg(F.sum("expected").alias("expected"))
    c = counts.groupBy("topic").agg(F.sum("n").alias("n"), F.sum("backward").alias("backward"))
    j = e.join(c, "topic", "full").fillna(0, ["n", "backward"])
    problem = F.when(F.col("n") == 0, "no messages").when(F.col("expected").isNull(), "not in the manifest").when(F.col("n") < F.col("expected"), "messages missing")
    note = F.when(F.col("backward") > 0, F.concat(F.col("backward").cast("string"), F.lit(" steps back in time"))).when(F.col("n") > F.col("expected"), "more than the manifest tells")
    return j.select("topic", "n", problem.alias("problem"), note.alias("note"))
