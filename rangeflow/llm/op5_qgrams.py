"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

Texts and benchmark items are compared as UTF-8 bytes with A-Z lower-cased and each run of ASCII
white space made one space.  An item of m bytes may differ by an edit budget of k, ``EDITS`` per cent of
m; an occurrence within k edits shares at least m - q + 1 - k * q of the item's q-grams, all within a
diagonal band of width k.  q is ``Q``, or less where m would leave no shared q-gram, down to m // (k + 1).

1. The item's q-grams at multiples of q, its seeds, do not overlap, so an edit changes one of them at most: of D different
   seeds an occurrence holds D - k unchanged, and one in any case; so seeds that very many items share can be left out
   as long as k + 1 stay.  A bitmap of all seeds' hashes, of ``BITS`` bits whatever the
   benchmark's size, is what is broadcast; one pass over the texts keeps those with as many q-grams of it as any item
   needs, within the length of the longest, and the hits.
2. Hits meet the seeds by an equi-join, and are counted: pairs of texts and items with enough different seeds stay.
3. Each pair's shared q-grams are counted in overlapping diagonal bands; bands that meet the bound are
   aligned with the item in a band, the rest can't hold an occurrence.

Cases: null or empty texts and items match nothing; an item without a budget is looked for as it is;
repeated rows are judged each on its own, rows with a null doc_id too; an empty table on either side gives no rows; long
texts are scanned whole, in overlapping pieces; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, read_table, written
from .text import as_bytes, mix
from .tokens import released, slices

Q = 10
EDITS = 7
BITS = 24
COMMON = 100
PIECE = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) ^ _BASE)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each place: Horner's rule over q shifted copies."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    letters = _LETTER[data]
    out = letters[:n].copy()
    for k in range(1, q):
        out *= _BASE
        out += letters[k : n + k]
    return mix(out)


def budget_and_q(m: int) -> tuple[int, int]:
    """Edits that an item of m bytes may have, and the length of its q-grams."""
    k = m * EDITS // 100
    return k, min(Q, m // (k + 1))


def seeds(text: bytes) -> tuple[int, int, np.ndarray]:
    """q, the edit budget, and the hashes of an item's different seeds."""
    k, q = budget_and_q(len(text))
    return q, k, np.unique(grams(np.frombuffer(text, np.uint8), q)[:: q])


class Items:
    """Some benchmark items and the index of their q-grams, by q."""

    def __init__(self, ids: list, texts: list[bytes]) -> None:
        self.ids, self.texts = ids, [normal(t) for t in texts]
        m = np.array([len(t) for t in self.texts], np.int64)
        both = [budget_and_q(n) for n in m.tolist()]
        self.budget, self.q = np.array([k for k, _ in both], np.int64), np.array([q for _, q in both], np.int64)
        self.bound = m - self.q + 1 - self.budget * self.q
        step = 1
        while step < self.budget.max(initial=0) + 1:
            step *= 2
        self.step = step  # bands overlap by half their width of two steps
        self.index = {}
        for q in sorted(set(self.q[m > 0].tolist())):
            held = [k for k in range(len(ids)) if self.q[k] == q and m[k]]
            found = [grams(np.frombuffer(self.texts[k], np.uint8), q) for k in held]
            h = np.concatenate(found)
            item = np.repeat(held, [len(g) for g in found])
            place = np.concatenate([np.arange(len(g)) for g in found])
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            self.index[q] = keys, first, count, item[order], place[order]

    def regions(self, data: np.ndarray) -> np.ndarray:
        """Rows ``(item, lowest diagonal)`` of the bands of a text that meet an item's bound."""
        out = [np.empty((0, 2), np.int64)]
        for q, (keys, first, count, of, where) in self.index.items():
            h = grams(data, q)
            k = np.searchsorted(keys, h)
            k[k == len(keys)] = 0
            at = np.flatnonzero(keys[k] == h)
            k = k[at]
            if not len(at):
                continue
            n = count[k]
            to = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, diagonal = of[to], np.repeat(at, n) - where[to]
            band = diagonal // self.step
            wide = 1 << 40
            bands = np.concatenate([item * wide + band + (1 << 20), item * wide + band - 1 + (1 << 20)])
            bands, n = np.unique(bands, return_counts=True)
            item = bands // wide
            good = n >= self.bound[item]
            out.append(np.stack([item[good], (bands[good] % wide - (1 << 20)) * self.step], 1))
        return np.concatenate(out)

    def verify(self, text: bytes, item: int, low: int) -> tuple[int, int, int] | None:
        """``(edits, start, end)`` of the item's best alignment from a diagonal of the band, if in budget."""
        t, k = self.texts[item], int(self.budget[item])
        m, high = len(t), low + 2 * self.step
        lo, hi = max(0, low - k), min(len(text), high + m + k)
        at = text.find(t, lo, hi)
        if at >= 0:
            return 0, at, at + m
        return banded(np.frombuffer(t, np.uint8), np.frombuffer(text, np.uint8), low - k, high + k, k)


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item within diagonals ``low`` to ``high`` of a text, free at its ends."""
    width, far = high - low + 1, len(item) + len(text) + 1
    j = low + np.arange(width)  # text bytes taken before row i's, on each diagonal
    cost = np.where((j >= 0) & (j <= len(text)), 0, far)
    start = np.clip(j, 0, len(text))
    along = np.arange(width)
    for i in range(1, len(item) + 1):
        end = j + i
        valid = (end >= 0) & (end <= len(text))
        letter = text[np.clip(end - 1, 0, len(text) - 1)]
        swap = cost + np.where((end >= 1) & valid, letter != item[i - 1], far)
        drop = np.append(cost[1:] + 1, far)  # the item's byte is not in the text
        best = np.minimum(swap, drop)
        begin = np.where(swap <= drop, start, np.append(start[1:], 0))
        reach = np.minimum.accumulate(best - along)
        source = np.maximum.accumulate(np.where(best - along == reach, along, 0))
        cost, start = np.where(valid, reach + along, far), begin[source]
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), int(j[k] + len(item))


def matches(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """``(row, item, start, end, edits)``: the best, leftmost occurrence of each item in each text."""
    for row, raw in enumerate(texts):
        text = normal(raw)
        best: dict[int, tuple[int, int, int]] = {}
        overlap = max((len(t) for t in items.texts), default=0) * 2
        for at in range(0, max(1, len(text)), PIECE):
            piece = text[at : at + PIECE + overlap]
            for item, low in items.regions(np.frombuffer(piece, np.uint8)).tolist():
                got = items.verify(piece, item, low)
                if got and got[0] <= items.budget[item]:
                    got = (got[0], got[1] + at, got[2] + at)
                    best[item] = min(best.get(item, got), got)
        for item, (edits, start, end) in sorted(best.items()):
            yield row, item, start, end, edits


def _arrow_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()


def seed_table(benchmark: DataFrame) -> DataFrame:
    """``seed, q, need, item_id, item``: an item's seeds, how many of them an occurrence has, and its normal form.

    Seeds that over ``COMMON`` items share, such as those of a common heading, are left out where enough others are left.
    """
    kind = dict(benchmark.dtypes)["item_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            texts = [normal(x) for x in as_bytes(b.column("text"))]
            found = [seeds(t) if t else (0, 0, np.empty(0, np.uint64)) for t in texts]
            at = np.repeat(np.arange(len(texts)), [len(h) for *_, h in found])
            rows = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.empty(0, np.uint64), *(h for *_, h in found)]).view(np.int64)), pa.array([found[k][0] for k in rows], pa.int32()),
                    pa.array([found[k][1] for k in rows], pa.int32()), b.column("item_id").take(pa.array(at, pa.int64())), pa.array([texts[k] for k in rows], pa.binary()),
                ],
                ["seed", "q", "k", "item_id", "item"],
            )

    every = benchmark.select("item_id", "text").mapInArrow(cut, f"seed long, q int, k int, item_id {kind}, item binary").distinct()
    every = written(every, "op5-seeds")
    shared = every.join(every.groupBy("seed").agg(F.count(F.lit(1)).alias("items")), "seed")
    own = Window.partitionBy("item_id", "item")
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("items", "seed"))).withColumn("all", F.count(F.lit(1)).over(own))
    kept = ranked.where((F.col("all") <= F.col("k")) | (F.col("rank") <= F.col("k") + 1) | (F.col("items") <= COMMON))
    need = F.greatest(F.lit(1), F.count(F.lit(1)).over(own) - F.col("k")).cast("int")
    out = written(kept.withColumn("need", need).select("seed", "q", "need", "item_id", "item"), "op5-seeds")
    discard(every)
    return out


def bitmap(table: DataFrame) -> tuple[list[int], int, int, np.ndarray]:
    """Lengths of all seeds, the least that an item needs, the longest occurrence, and a bitmap of the leading ``BITS`` bits of seeds' hashes.

    A task gives one bitmap, or none.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = np.zeros(1 << BITS, bool), False
        for b in batches:
            bits[(b.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)] = True
            some |= b.num_rows > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in table.select("seed").mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    lengths, need, longest = table.agg(F.sort_array(F.collect_set("q")), F.min("need"), F.max(F.length("item"))).first()
    return list(lengths), need or 1, (longest or 0) * (100 + EDITS) // 100, out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, end, edits`` of each item that a text holds (places in the normal form)."""
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    table = seed_table(benchmark.where("text is not null"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(table))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with enough seeds, perhaps, and what they hit; rows are numbered, as doc_ids may be null or repeated."""
        lengths, need, longest, bits = shared.value
        part, row = TaskContext.get().partitionId(), 0
        for b in slices(released(batches)):
            at, texts, found, rows = [], [], [], []
            for k, raw in enumerate(as_bytes(b.column("text"))):
                text = normal(raw)
                data, hit, places = np.frombuffer(text, np.uint8), [], []
                for q in lengths:
                    h = grams(data, q)
                    p = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    places.append(np.flatnonzero(bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1))
                    hit.append(h[places[-1]])
                place = np.sort(np.concatenate([np.empty(0, np.int64), *places]))
                if len(place) >= need and (place[need - 1 :] - place[: len(place) - need + 1] <= longest).any():
                    at.append(k)
                    texts.append(text)
                    found.append(np.unique(np.concatenate(hit)).view(np.int64))
                    rows.append((part << 40) + row + k)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(rows, pa.int64()), pa.array(texts, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "row", "text", "hits"]
            )

    some = written(docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, row long, text binary, hits array<long>"), "op5-texts")
    pairs = some.select("row", F.explode("hits").alias("seed")).join(table.select("seed", "need", "item_id", "item"), "seed")
    pairs = pairs.groupBy("row", "item_id", "item", "need").agg(F.count_distinct("seed").alias("c")).where("c >= need")
    wanted = pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    item_type = _arrow_type(item_kind)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            asked = [{(x["item_id"], x["item"]) for x in row} for row in b.column("items").to_pylist()]
            every = sorted(set().union(*asked), key=lambda x: (x[0] is not None, x))
            items = Items([i for i, _ in every], [t for _, t in every])
            rows = list(matches(items, as_bytes(b.column("text"))))
            row, item, start, end, edits = zip(*rows, strict=True) if rows else ([],) * 5
            doc = b.column("doc_id").take(pa.array(row, pa.int64()))
            cols = [doc, pa.array([items.ids[k] for k in item], item_type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start", "end", "edits"])

    met = some.select("doc_id", "row", "text").join(wanted, "row").select("doc_id", "text", "items")
    out = written(met.mapInArrow(verify, f"doc_id {kind}, item_id {item_kind}, start long, end long, edits int"), "op5-leaks")
    discard(table, some)
    return out


def op5_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
