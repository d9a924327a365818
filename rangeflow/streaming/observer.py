"""An observer beside a stream: what each stage saw of each batch, told by Spark with the batch's progress.

``watched`` marks a stage of a stream; its rows, the first and last stamp and a digest of all stamps are gathered in the tasks that run anyway.
``StampAudit`` is a listener that keeps these by query, batch and stage and never touches the stream; ``coverage`` compares stages: equal digests
mean that the very same stamps went on, none lost and none twice.

Cases: null stamps are counted apart; a batch without rows has nothing to tell; a stage that a plan runs twice is told once.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "query string, batch long, stage string, rows long, unstamped long, first long, last long, digest string"


def watched(df: DataFrame, stage: str, stamp: str) -> DataFrame:
    """``df`` with an observed stage; ``stamp`` is a whole number."""
    digest = F.sum(F.xxhash64(stamp).cast("decimal(38,0)")).cast("string")
    return df.observe(stage, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(stamp).isNull()).alias("unstamped"), F.min(stamp).cast("long").alias("first"), F.max(stamp).cast("long").alias("last"), digest.alias("digest"))


class StampAudit(StreamingQueryListener):
    """What the watched stages of queries saw: at most ``keep`` batches of all queries, the oldest go first."""

    def __init__(self, keep: int = 10_000) -> None:
        self.keep = keep
        self.seen: dict[tuple[str, int], dict[str, tuple]] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, query: str) -> threading.Event:
        return self.ended.setdefault(query, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._end(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        got = {stage: (m["rows"], m["unstamped"], m["first"], m["last"], m["digest"]) for stage, m in p.observedMetrics.items()}
        if any(m[0] for m in got.values()):
            self.seen[str(p.id), p.batchId] = got
            while len(self.seen) > self.keep:
                self.seen.pop(next(iter(self.seen)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end(str(event.id)).set()

    def wait(self, query: str, seconds: float = 30.0) -> bool:
        """Whether all that a query that has ended told has arrived."""
        return self._end(query).wait(seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(q, b, stage, *m) for (q, b), stages in list(self.seen.items()) for stage, m in stages.items()]
        return spark.createDataFrame(rows, METRICS)


def coverage(audit: DataFrame, sent: str, later: str) -> DataFrame:
    """``query, batch, sent, later, lost, same``: what of stage ``sent`` reached stage ``later``."""
    side = lambda stage, name: audit.where(F.col("stage") == stage).select("query", "batch", F.col("rows").alias(name), F.col("digest").alias(f"_{name}"))
    j = side(sent, "sent").join(side(later, "later"), ["query", "batch"], "left").fillna(0, ["later"])
    return j.select("query", "batch", "sent", "later", (F.col("sent") - F.col("later")).alias("lost"), F.col("_sent").eqNullSafe(F.col("_later")).alias("same"))
