"""Suffix-array dedup of bytes by column-wise construction over a collection of texts.

Every 100-byte window has an anchor: the least-hashed 16-byte string in it, with the 42 bytes before it
where the window has so many, else the 42 bytes after it, which it then has.  Only windows of one anchor can be equal, and then
they lie alike around it; neighbouring windows of one anchor are a block.  Blocks whose anchor stands
nowhere else go no further, and of equal blocks (by 128-bit names) one stands for all.  The distinct
surroundings of an anchor are the collection to be sorted: aligned at the anchor, one symbol of each is
inserted a round, from the last column to the first.  A round keeps the order of all suffixes that begin in its
column and the common prefixes of neighbours.  The symbols before those suffixes, in that order, are
the column's part of the Burrows-Wheeler transform: stably sorting them is the order of the next
column, and the next common prefixes are one more than the least common prefix between two that the
same symbol precedes.  Neighbours with a common prefix of 100 or more are equal windows.

Collections stream through each task in anchor order.  Their symbols lie column by column in a
sequential file of the task, one column of which is read a round; the transform is appended to a second
file, and a third carries the common prefixes from round to round.  What a task holds in memory are some
sixty bytes a surrounding, whatever its length, so an anchor may have millions of them.

Cases: a null or empty text, or one under 100 bytes, loses nothing; rows with a null doc_id lose
nothing and are no source; rows of one doc_id are ordered by a hash of their text, equal rows all
keep what the first keeps; an empty table gives an empty result; long texts are cut into overlapping
pieces of ``PIECE`` windows; input columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, read_table, written
from .blocks import settle, spans_by_document
from .text import as_bytes, mix, signed
from .tokens import released, slices

WINDOW = 100
GRAM = 16
PIECE = 2_000_000
BATCH_BYTES = 150_000
TASK_SEGMENTS = 20_000
CHUNK = 2_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x94D049BB133111EB)
_PLACE = 27  # bits of a place, in the low end of a rank


class Sums:
    """Prefix sums of a byte string, from which any span's hash follows."""

    table: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: np.uint64) -> None:
        n = len(data)
        power, back = self.table.get(int(base), (np.empty(0), np.empty(0)))
        if len(power) <= n:
            inv = np.uint64(pow(int(base), -1, 2**64))
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1000, base)]), dtype=np.uint64)
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1000, inv)]), dtype=np.uint64)
            self.table[int(base)] = power, back
        letters = mix(np.arange(1, 257, dtype=np.uint64) ^ base)
        self.back = back
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(letters[data] * power[:n], dtype=np.uint64)])

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] ^ (hi - lo).astype(np.uint64))

    def grams(self, q: int) -> np.ndarray:
        m = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:-q]) * self.back[:m])


def least_in_window(rank: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours: minima from both ends of blocks of ``w``."""
    n = len(rank)
    size = -(-n // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = rank
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def block_rows(texts: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks ``(row, lo, n, key, bh, off)``; ``off``: from the first window to the anchor."""
    pieces = [
        (k, at, t[at : at + PIECE + window - 1])
        for k, t in enumerate(texts)
        for at in range(0, len(t) - window + 1, PIECE)
    ]
    k = 0
    while k < len(pieces):
        some, size = [], 0
        while k < len(pieces) and (not some or size + len(pieces[k][2]) <= BATCH_BYTES):
            some.append(pieces[k])
            size += len(pieces[k][2])
            k += 1
        lengths = np.array([len(p[2]) for p in some])
        begins = np.cumsum(lengths) - lengths
        sums = Sums(np.frombuffer(b"".join(p[2] for p in some), np.uint8), _A)
        gram = sums.grams(GRAM)
        rank = (gram >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(gram), dtype=np.uint64)
        place = (least_in_window(rank, window - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        starts = np.arange(len(place))
        of = np.searchsorted(begins, starts, side="right") - 1
        inside = starts + window <= (begins + lengths)[of]
        new = np.ones(len(place), bool)
        half = (window - GRAM) // 2
        before = place - starts >= half  # else so many bytes of the window lie behind the string
        new[1:] = (place[1:] != place[:-1]) | ~inside[:-1] | (of[1:] != of[:-1]) | (before[1:] != before[:-1])
        at = np.flatnonzero(new & inside)
        ends = np.append(np.flatnonzero(new | ~inside), len(place))
        n = ends[np.searchsorted(ends, at, side="right")] - at
        row, shift = np.array([p[0] for p in some]), np.array([p[1] for p in some])
        off = place[at] - at
        left, p = before[at], place[at]
        key = sums.span(np.where(left, p - half, p), np.where(left, p + GRAM, np.minimum(p + GRAM + half, len(gram) + GRAM - 1)))
        key = signed(mix(key ^ np.where(left, _B, _C)))
        bh = signed(mix(sums.span(at, at + n - 1 + window) ^ mix(off.astype(np.uint64) + _A)))
        yield row[of[at]], at - begins[of[at]] + shift[of[at]], n, key, bh, off


class Collection:
    """Surroundings of anchors, aligned, in sequential files: symbols by column, transform and common prefixes by round."""

    def __init__(self, folder: str, low: int, high: int) -> None:
        self.low, self.high, self.rows = low, high, 0
        self.chunks: list[tuple[int, int]] = []  # where a chunk's columns begin, and its surroundings
        self.columns, self.transform, self.prefixes = (open(f"{folder}/{n}", "w+b") for n in ("columns", "transform", "prefixes"))  # noqa: SIM115

    def add(self, segments: list[bytes], off: np.ndarray) -> None:
        """Append surroundings whose anchor lies ``off`` bytes from their beginning; symbol 0 stands for nothing."""
        lengths = np.array([len(x) for x in segments], np.int64)
        row = np.repeat(np.arange(len(segments)), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths + off, lengths) - self.low
        grid = np.zeros((self.high - self.low, len(segments)), np.uint16)
        grid[column, row] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
        self.chunks.append((self.columns.tell(), len(segments)))
        self.columns.write(grid.tobytes())
        self.rows += len(segments)

    def column(self, x: int) -> np.ndarray:
        """The symbols of a column, in the order of adding."""
        out = np.empty(self.rows, np.uint16)
        at = 0
        for begin, m in self.chunks:
            self.columns.seek(begin + 2 * m * (x - self.low))
            out[at : at + m] = np.frombuffer(self.columns.read(2 * m), np.uint16)
            at += m
        return out

    def emit(self, symbols: np.ndarray) -> None:
        """Append a column's part of the transform."""
        self.transform.write(symbols.tobytes())

    def common(self) -> np.ndarray:
        """Common prefixes of neighbours after the last round."""
        self.prefixes.seek(0)
        return np.frombuffer(self.prefixes.read(self.rows), np.uint8)

    def keep(self, common: np.ndarray) -> None:
        self.prefixes.seek(0)
        self.prefixes.write(common.astype(np.uint8).tobytes())

    def clear(self) -> None:
        """Begin another collection in the same files."""
        self.rows, self.chunks = 0, []
        for f in (self.columns, self.transform, self.prefixes):
            f.seek(0)
            f.truncate()

    def close(self) -> None:
        for f in (self.columns, self.transform, self.prefixes):
            f.close()


def equal_windows(group: np.ndarray, held: Collection, off: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Column-wise construction over the surroundings of several anchors (``group`` ascending).

    Surrounding k begins ``off[k]`` before its anchor.  Yields, for each column with windows that equal others:
    ``(surrounding, window, class)`` of those in classes of two or more.
    """
    order = np.arange(held.rows)
    held.keep(np.zeros(held.rows, np.uint8))
    for x in range(held.high - 1, held.low - 1, -1):
        symbol = held.column(x)
        if not symbol.any():  # a column without symbols ends all prefixes
            held.keep(np.zeros(held.rows, np.uint8))
            continue
        ranked = symbol[order]
        held.emit(ranked)
        g = group[order]
        by = np.argsort(g * 257 + ranked, kind="stable")
        g, ranked = g[by], ranked[by]
        same = np.zeros(held.rows, bool)
        same[1:] = (g[1:] == g[:-1]) & (ranked[1:] == ranked[:-1]) & (ranked[1:] > 0)
        to = np.flatnonzero(same)
        common = np.zeros(held.rows, np.uint8)
        if len(to):
            ranges = np.stack([by[to - 1] + 1, by[to] + 1], 1).ravel()
            least = np.minimum.reduceat(np.append(held.common(), np.uint8(0)), ranges)[::2]
            common[to] = np.minimum(least, window - 1) + 1
        held.keep(common)
        order = order[by]
        if x > 0:
            continue
        begins = common < window
        if begins.all():
            continue
        cls = np.cumsum(begins)
        size = np.bincount(cls)[cls]
        some = order[size > 1]
        yield some, x + off[some], cls[size > 1]


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, h, spans``: byte spans that earlier windows cover, of documents with any."""
    kind = dict(docs.dtypes)["doc_id"]
    usable = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            for row, lo, n, key, bh, off in block_rows(as_bytes(b.column("text")), window):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("h").take(at), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(off, pa.int32()), pa.array(key), pa.array(bh)],
                    ["doc_id", "h", "lo", "n", "off", "key", "bh"],
                )

    blocks = usable.mapInArrow(cut, f"doc_id {kind}, h long, lo int, n int, off int, key long, bh long")
    matter = settle(blocks, F.struct("doc_id", "h", "lo"), F.col("ord") == F.col("first"))
    some = F.struct("key", "lo", "n", "off", "contents")
    open_ = matter.where("not settled").groupBy("doc_id", "h").agg(F.collect_list(some).alias("open"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            for k, (text, spans) in enumerate(zip(as_bytes(b.column("text")), b.column("open").to_pylist(), strict=True)):
                m = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("doc_id")[k].as_py()] * m, b.column("doc_id").type), pa.array([b.column("h")[k].as_py()] * m, pa.int64()),
                        *(pa.array([s[c] for s in spans], t) for c, t in (("key", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("contents", pa.int64()))),
                        pa.array([text[s["lo"] : s["lo"] + s["n"] - 1 + window] for s in spans], pa.binary()),
                    ],
                    ["doc_id", "h", "key", "lo", "n", "off", "contents", "bytes"],
                )

    pool = usable.join(open_, ["doc_id", "h"]).select("doc_id", "h", "text", "open")
    segments = written(
        pool.mapInArrow(fetch, f"doc_id {kind}, h long, key long, lo int, n int, off int, contents long, bytes binary"), "op6-segments", compression="zstd"
    )
    later = written(_by_columns(segments, kind, window), "op6-later")
    discard(segments)
    spans = matter.where("settled").select("doc_id", "h", "lo", (F.col("lo") + F.col("n") - 1 + window).alias("hi")).unionByName(later)
    out = written(spans_by_document(spans), "op6-spans")
    discard(matter, later)
    return out


def _by_columns(segments: DataFrame, kind: str, window: int) -> DataFrame:
    """``doc_id, h, lo, hi``: spans of segments' windows that equal earlier ones, by column-wise construction."""
    # equal keys together, in the order of their documents: the first of a class is the earliest
    placed = segments.repartition("key").sortWithinPartitions("key", "doc_id", "h", "lo")

    names = ["key", "doc_id", "h", "lo", "off"]

    def solve(rows: list[pa.RecordBatch], held: Collection) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        key = t["key"].to_numpy()
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        lo, h, segs, wins = t["lo"].to_numpy(), t["h"].to_numpy(), [], []
        doc = t["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        for seg, win, cls in equal_windows(group, held, t["off"].to_numpy().astype(np.int64), window):
            least = np.full(cls.max() + 1, len(key))
            np.minimum.at(least, cls, seg)
            best = least[cls]
            at = lo[seg] + win
            itself = (doc[seg] == doc[best]) & (h[seg] == h[best])  # a repeated row
            np.maximum.at(where := np.full(cls.max() + 1, -1), cls, np.where(seg == best, at, -1))
            drop = (seg != best) & ~(itself & (at == where[cls]))
            segs.append(seg[drop])
            wins.append(win[drop])
        seg = np.concatenate([np.empty(0, np.int64), *segs])
        win = np.concatenate([np.empty(0, np.int64), *wins])
        order = np.lexsort([win, seg])
        seg, win = seg[order], win[order]
        new = np.ones(len(seg), bool)  # neighbouring windows make one span
        new[1:] = (seg[1:] != seg[:-1]) | (win[1:] != win[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(seg))[: len(a)] - 1
        cols = [t[c].combine_chunks().take(pa.array(seg[a])) for c in ("doc_id", "h")]
        lo = lo[seg[a]].astype(np.int64)
        return pa.RecordBatch.from_arrays([*cols, pa.array(lo + win[a], pa.int32()), pa.array(lo + win[b] + window, pa.int32())], ["doc_id", "h", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:  # this task's own files
            held, rows, last = Collection(folder, GRAM - window, window), [], None
            for b in slices(released(batches), CHUNK):
                key = b.column("key").to_numpy()
                at = 0
                while at < b.num_rows:
                    if held.rows < TASK_SEGMENTS:
                        to = min(b.num_rows, at + TASK_SEGMENTS - held.rows)
                    else:  # enough, once the last anchor is complete
                        to = int(np.searchsorted(key, last, side="right"))
                        if to <= at:
                            yield solve(rows, held)
                            held.clear()
                            rows = []
                            continue
                    part = b.slice(at, to - at)
                    held.add(part.column("bytes").to_pylist(), part.column("off").to_numpy().astype(np.int64))
                    rows.append(part.select(names))
                    at, last = to, key[to - 1]
            if held.rows:
                yield solve(rows, held)
            held.close()

    return placed.mapInArrow(run, f"doc_id {kind}, h long, lo int, hi int")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns of ``docs`` and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_bytes``."""
    added = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    rest = [c for c in docs.columns if c not in added]
    spans = find_repeats(docs, window)
    src = docs.select(*rest, F.xxhash64("text").alias("__h")).join(
        spans.select(F.col("doc_id").alias("__d"), F.col("h").alias("__k"), F.col("spans").alias("__spans")),
        (F.col("doc_id") == F.col("__d")) & (F.col("__h") == F.col("__k")), "left",
    ).select(*rest, "__spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            sizes, gone, runs, kept = [], [], [], []
            for text, spans in zip(as_bytes(b.column("text")), b.column("__spans").to_pylist(), strict=True):
                out, end, count, removed = [], 0, 0, 0
                for s in spans or []:
                    if s["lo"] > end or not count:
                        out.append(text[end : s["lo"]])
                        count, removed, end = count + 1, removed + s["hi"] - s["lo"], s["hi"]
                    elif s["hi"] > end:
                        removed, end = removed + s["hi"] - end, s["hi"]
                out.append(text[end:])
                sizes.append(len(text))
                gone.append(removed)
                runs.append(count)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                [*rest, *added],
            )

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in rest)
    return src.mapInArrow(strip, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_bytes binary")


def op6_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


#: The same by windows of the bytes' hexadecimal digits.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i - 1, {2 * WINDOW})) AS k FROM d, unnest(range(1, n - {WINDOW - 2})) AS u(i) WHERE n >= {WINDOW}),
f AS (SELECT k, min(doc_id * 1000000000::HUGEINT + i) AS first FROM win GROUP BY k HAVING count(*) > 1),
h AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW}, true) AS new FROM win JOIN f USING (k) WHERE doc_id * 1000000000::HUGEINT + i > first),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + {WINDOW - 1} AS hi FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h) GROUP BY doc_id, run),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
s AS (SELECT doc_id, sum(hi - lo + 1)::BIGINT AS gone, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (lo - before - 1)), '' ORDER BY lo) AS kept, max(hi) AS last FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
