"""Packing by non-negative least squares over shallow length combinations.

Each document is cut into whole windows and a rest.  Rests are binned by length in units of
``UNIT`` ids, rounded down; the histogram of bins is explained by combinations of at most ``DEPTH``
bins that fill a window exactly, whose repeat counts a non-negative least-squares fit finds.  Counts
are rounded down to what the bins hold.  In a sequence of a combination the true lengths overrun the
window a little: what sticks out, and the rests of no combination, are packed greedily one after the
other, cut at window ends.  Only the last of those sequences is padded.

Only the histogram (4096 / UNIT numbers) and the chosen combinations reach the driver.  Everything
a document needs besides is a rank among its bin, a prefix sum over partitions.

Cases: a null or empty text is the end id alone; repeated rows and doc_ids are packed each on its
own; an empty table gives an empty result; a text of any length is cut; input columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, read_table, written
from .tokens import released, slices, word_tokenizer

WINDOW = 4096
UNIT = 128
DEPTH = 6
END = 2


def combinations(units: int, depth: int) -> np.ndarray:
    """Rows: how many rests of each bin (1 to ``units``) a combination of at most ``depth`` takes."""
    out: list[list[int]] = []

    def grow(left: int, most: int, room: int, taken: list[int]) -> None:
        if not left:
            out.append(taken)
        elif room and most * room >= left:
            for u in range(min(most, left), 0, -1):
                grow(left - u, u, room - 1, [*taken, u])

    grow(units, units, depth, [])
    rows = np.zeros((len(out), units + 1), np.int64)
    for k, taken in enumerate(out):
        np.add.at(rows[k], taken, 1)
    return rows


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x of least squared error of a @ x against b, by active sets until no combination helps any more."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    error = np.inf
    while True:
        rest = b - a @ x
        slope = a.T @ rest
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if active.all() or slope[k] <= 1e-9 * scale or rest @ rest >= error:  # every step lowers the error, up to rounding
            break
        error = rest @ rest
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min(initial=0) >= -1e-12 * scale or not len(at):
                break
            low = z < 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            drop = at[(x[at] <= 1e-12 * scale) & low]
            active[drop if len(drop) else at[np.argmin(z)]] = False
            x[~active] = 0
        x[:] = 0
        x[at] = np.maximum(z, 0)
    return x


class Plan:
    """For each bin, which ranks go to which combination, and where its sequences begin."""

    def __init__(self, histogram: np.ndarray, units: int, depth: int, first: int) -> None:
        rows = combinations(units, depth)
        rows = rows[((rows == 0) | (histogram > 0)).all(1)]
        want = nnls(rows[:, 1:].T.astype(float), histogram[1:].astype(float)) if len(rows) else np.empty(0)
        left = histogram.copy()
        self.ends: list[list[int]] = [[] for _ in range(units + 1)]
        self.to: list[list[tuple[int, int, int]]] = [[] for _ in range(units + 1)]  # first sequence, rests each, first slot
        used = np.zeros(units + 1, np.int64)
        for k in np.argsort(-want, kind="stable"):
            takes = np.flatnonzero(rows[k])
            n = int(min([np.floor(want[k] + 1e-6), *(left[takes] // rows[k][takes])]))
            if n <= 0:
                continue
            slot = 0
            for u in takes:  # ascending: the longest rest stands last and is the one cut
                used[u] += n * rows[k][u]
                self.ends[u].append(int(used[u]))
                self.to[u].append((first, int(rows[k][u]), slot))
                slot += int(rows[k][u])
            left[takes] -= n * rows[k][takes]
            first += n
        self.next = first

    def place(self, unit: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (-1: none) and slot of rests by bin and rank."""
        seq, slot = np.full(len(unit), -1, np.int64), np.zeros(len(unit), np.int64)
        for u in np.unique(unit):
            if not self.ends[u]:
                continue
            at = np.flatnonzero(unit == u)
            ends, to = np.array(self.ends[u]), np.array(self.to[u])
            k = np.searchsorted(ends, rank[at], side="right")
            at, k = at[k < len(ends)], k[k < len(ends)]
            past = rank[at] - np.concatenate([[0], ends])[k]
            seq[at] = to[k, 0] + past // to[k, 1]
            slot[at] = to[k, 2] + past % to[k, 1]
        return seq, slot


def encode(docs: DataFrame, vocabulary: str, end: int, window: int, unit: int) -> DataFrame:
    """A written table: each document's ids, its place (part, row), and counts up to it in its part."""
    kind = dict(docs.dtypes)["doc_id"]
    units = window // unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row = full = 0
        seen = np.zeros(units + 1, np.int64)
        for b in slices(released(batches)):
            ids, n = word_tokenizer(vocabulary).closed(b.column("text"), end)
            ends = 4 * np.cumsum(n)
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
            u = (n % window) // unit
            order = np.argsort(u, kind="stable")
            rank = np.empty(len(n), np.int64)
            begins = np.searchsorted(u[order], u[order])
            rank[order] = np.arange(len(n)) - begins + seen[u[order]]
            seen += np.bincount(u, minlength=units + 1)
            cum = full + np.cumsum(n // window) - n // window
            full += int((n // window).sum())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(np.full(len(n), part), pa.int32()), pa.array(row + np.arange(len(n)), pa.int64()),
                    pa.array(n, pa.int64()), pa.array(u, pa.int32()), pa.array(rank, pa.int64()), pa.array(cum, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, raw]),
                ],
                ["doc_id", "part", "row", "n", "unit", "rank", "full_before", "ids"],
            )
            row += len(n)

    schema = f"doc_id {kind}, part int, row long, n long, unit int, rank long, full_before long, ids binary"
    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "op4-ids", compression="zstd")


def plan_pieces(table: DataFrame, window: int, unit: int, depth: int) -> DataFrame:
    """``part, row, pieces``: each document's pieces ``(start, length, sequence_id, offset)``."""
    units = window // unit
    docs = table.select("part", "row", "n", "unit", "rank", "full_before")
    full = (F.col("n") / window).cast("long")
    counts = written(docs.groupBy("part", "unit").agg(F.count(F.lit(1)).alias("c"), F.sum(full).alias("f")), "op4-counts")
    by_unit = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "unit", F.coalesce(F.sum("c").over(by_unit), F.lit(0)).alias("rank_base"))
    total_full = 0
    histogram = np.zeros(units + 1, np.int64)
    for r in counts.groupBy("unit").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).collect():  # one row a bin
        histogram[r.unit], total_full = r.c, total_full + r.f
    histogram[0] = 0
    plan = Plan(histogram, units, depth, total_full)
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the table
    fulls = counts.groupBy("part").agg(F.sum("f").alias("f")).select("part", F.coalesce(F.sum("f").over(by_part), F.lit(0)).alias("full_base"))
    shared = table.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            seq, slot = shared.value.place(b.column("unit").to_numpy(), b.column("rank").to_numpy())
            rest = [c for c in b.schema.names if c not in ("unit", "rank")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(seq), pa.array(slot)], [*rest, "seq", "slot"])

    ranked = docs.join(ranks, ["part", "unit"]).join(fulls, "part").select(
        "part", "row", "n", "unit", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("full_before") + F.col("full_base")).alias("full_first")
    )
    placed = written(ranked.mapInArrow(place, "part int, row long, n long, full_first long, seq long, slot long"), "op4-placed")
    size = F.col("n") % window
    in_seq = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    combined = placed.where("seq >= 0").withColumn("off", F.coalesce(F.sum(size).over(in_seq), F.lit(0)))
    combined = combined.withColumn("keep", F.greatest(F.lit(0), F.least(size, window - F.col("off"))))
    alone = placed.where("seq < 0").withColumn("off", F.lit(0).cast("long")).withColumn("keep", F.lit(0).cast("long"))
    every = written(combined.unionByName(alone).withColumn("left", size - F.col("keep")), "op4-plan")
    discard(counts, placed)
    sums = every.groupBy("part").agg(F.sum("left").alias("s"))
    sums = sums.select("part", F.coalesce(F.sum("s").over(by_part), F.lit(0)).alias("left_base"))
    in_part = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    at = every.withColumn("before", F.coalesce(F.sum("left").over(in_part), F.lit(0))).join(sums, "part")
    at = at.withColumn("pos", F.col("before") + F.col("left_base"))
    w = F.lit(window)
    n_full = (F.col("n") / window).cast("long")
    piece = lambda start, length, seq, off: F.struct(
        start.cast("long").alias("start"), length.cast("long").alias("length"), seq.cast("long").alias("sequence_id"), off.cast("long").alias("offset")
    )
    wholes = F.transform(
        F.when(n_full > 0, F.sequence(F.lit(0).cast("long"), n_full - 1)).otherwise(F.array().cast("array<long>")),
        lambda k: piece(k * w, w, F.col("full_first") + k, F.lit(0)),
    )
    head = F.array(piece(n_full * w, F.col("keep"), F.col("seq"), F.col("off")))
    first = (F.col("pos") / window).cast("long")
    last = ((F.col("pos") + F.col("left") - 1) / window).cast("long")

    def cut(k):
        lo, hi = F.greatest(F.col("pos"), k * w), F.least(F.col("pos") + F.col("left"), (k + 1) * w)
        return piece(n_full * w + F.col("keep") + lo - F.col("pos"), hi - lo, F.lit(plan.next) + k, lo - k * w)

    tail = F.transform(F.when(F.col("left") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<long>")), cut)
    return at.select("part", "row", F.filter(F.concat(wholes, head, tail), lambda p: p["length"] > 0).alias("pieces"))


def pack(docs: DataFrame, vocabulary: str, end: int = END, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """All documents as pieces: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (binary, unsigned 32-bit)."""
    table = encode(docs, vocabulary, end, window, unit)
    joined = table.select("doc_id", "part", "row", "n", "ids").join(plan_pieces(table, window, unit, depth), ["part", "row"])
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            lists = b.column("pieces")
            flat = lists.flatten()
            at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            raws = b.column("ids").to_pylist()
            start, length = flat.field("start"), flat.field("length")
            cuts = [raws[i][4 * s : 4 * (s + m)] for i, s, m in zip(at.tolist(), start.to_pylist(), length.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at)), start, length, b.column("n").take(pa.array(at)), flat.field("sequence_id"), flat.field("offset"), pa.array(cuts, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return joined.select("doc_id", "n", "ids", "pieces").mapInArrow(cut, schema)


def with_crc(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` in place of the ids."""
    rest = [c for c in pieces.columns if c != "ids"]
    return pieces.select(*rest, F.crc32("ids").alias("ids_crc32"))


def op4_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return with_crc(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
