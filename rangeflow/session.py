"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Drops a statement's shuffle files when the statement ends, instead of whenever the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of ``written`` that are still there, oldest first.
_live: dict[str, DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale-factor directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share (``spark.checkpoint.dir``).

    Where the session names none, a local session (one machine) gets a temporary folder; a cluster gets an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/rangeflow-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Statements that end within leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None, **options) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back.

    This cuts the lineage durably: a lost executor rereads files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _without_shuffle_files(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if not _live:
        atexit.register(_discard_all)
    _live[path] = out
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, as all that came of them is written too."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(conf).delete(path, True)
        _live.pop(t.written_path, None)


@contextmanager
def scratch(keep: list[DataFrame] | None = None) -> Iterator[list[DataFrame]]:
    """Tables written within are deleted at the end, but for those put in the list that this gives."""
    before, kept = set(_live), [] if keep is None else keep
    yield kept
    stay = before | {t.written_path for t in kept}
    discard(*[t for path, t in list(_live.items()) if path not in stay])


def _discard_all() -> None:
    """At the end of the process no table is read any more; a session that has stopped keeps its files."""
    with suppress(Exception):
        if next(iter(_live.values())).sparkSession.sparkContext._jsc is not None:
            discard(*_live.values())
