"""Substring dedup by recompression: consistent naming of token runs and pairs.

A text's words are named by hashes.  Rounds rename it: runs of one symbol become a symbol, and each
neighbouring pair of a left and a right symbol (a hash of the round and the symbol says which it is)
becomes a symbol.  Names are hashes of what they stand for, so all tasks name globally alike without
exchanging dictionaries, and equal substrings get equal symbols except near their ends.  What a round
can't tell from the inside of a substring, a symbol that may go on beyond its end, is popped there;
the popped symbols of all rounds and the symbols left in its middle are the substring's name, which
depends on its content alone.  All comparisons are of such names:

1. Each 50-word window has an anchor, the least-hashed symbol left in its middle after the last round;
   neighbouring windows of one anchor are a block.  Equal windows share the anchor's symbol and, as it lies in
   both, the words on one side of it up to the middle of what is left: a block is looked at further if the name of
   one of its sides, with the anchor, stands in another block too (an aggregation and an equi-join).
2. A block whose name stands earlier is settled at once.
3. The windows of the other blocks are named, and those whose name stands in a smaller doc_id go.

A window nothing is left of (a few words, repeated) has no anchor; it is compared by its name.  Words are 64-bit hashes, names
128 bits of them.

Cases: a null or empty text, or one shorter than a window, loses nothing; rows with a null doc_id
lose nothing and are no source; rows of one doc_id are documents of their own, none earlier than the
other; of equal texts the smallest doc_id stays; a text of any length is named whole, in one batch; an
empty table gives an empty result; input columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, read_table, written
from .blocks import spans_by_document
from .text import as_bytes, mix, signed, word_ids
from .tokens import released, slices

WINDOW = 50
ROUNDS = 6
RUN_ROUNDS = (0, 3)
BATCH_BYTES = 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SIDE = mix(np.arange(1, 65, dtype=np.uint64))
_INV = {int(x): np.uint64(pow(int(x), -1, 2**64)) for x in (_A, _B)}


class Rounds:
    """Symbols of some texts, one after the other, in all rounds.

    ``h``: word names; ``first``: where a text begins.  A round is a step of runs, in ``RUN_ROUNDS``, and one of pairs.
    """

    def __init__(self, h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> None:
        self.steps: list[tuple] = []
        sym, pos, head = h, np.arange(len(h)), first.copy()
        for r in range(rounds):
            if r in RUN_ROUNDS:
                begin = head.copy()
                begin[1:] |= sym[1:] != sym[:-1]
                at = np.flatnonzero(begin)
                to = np.cumsum(begin) - 1
                self.steps.append((sym, to, np.append(at, len(sym)), None))
                length = np.diff(np.append(at, len(sym))).astype(np.uint64)
                name = np.where(length > 1, mix(sym[at] ^ mix(length)), sym[at])
                sym, pos, head = name, pos[at], head[at]
            right = (mix(sym + _SIDE[r]) & np.uint64(1)).astype(bool)
            joined = np.zeros(len(sym), bool)  # the second of a pair
            joined[1:] = ~right[:-1] & right[1:] & ~head[1:]
            self.steps.append((sym, np.cumsum(~joined) - 1, None, right))
            at = np.flatnonzero(~joined)
            pair = np.append(joined[1:], False)[at]
            second = sym[np.minimum(at + 1, len(sym) - 1)]
            sym, pos, head = np.where(pair, mix(sym[at] * _A + mix(second)), sym[at]), pos[at], head[at]
        self.top, self.pos = sym, pos
        self.width = np.diff(np.append(pos, len(h)))

    def middle(self, lo: np.ndarray, hi: np.ndarray, pops: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What is left of each span of words after all rounds: symbols a to b of the top.

        ``pops`` gets what each step popped: on the left, then on the right, a symbol and how often (0: nothing).
        """
        a, b = lo.copy(), hi.copy()
        for sym, to, runs, right in self.steps:
            ok = a < b
            x, y = np.minimum(a, len(sym) - 1), np.maximum(b, 1) - 1
            if runs is not None:
                one = to[x] == to[y]
                if pops is not None:
                    pops.append((sym[x], np.where(ok, np.minimum(runs[to[x] + 1], b) - a, 0)))
                    pops.append((sym[y], np.where(ok & ~one, b - np.maximum(runs[to[y]], a), 0)))
                a, b = np.where(ok, to[x] + 1, 1), np.where(ok, to[y], 0)
                continue
            if pops is not None:
                pops.append((sym[x], np.where(ok, right[x], 0).astype(np.int64)))
                pops.append((sym[y], np.where(ok, ~right[y], 0).astype(np.int64)))
            a = np.where(ok, a + right[x], 1)
            b = np.where(ok, b - ~right[y], 0)
            ok = a < b
            a, b = np.where(ok, to[np.minimum(a, len(sym) - 1)], 1), np.where(ok, to[np.maximum(b, 1) - 1] + 1, 0)
        return a, b

    def names(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of each span of words: its popped symbols and its middle."""
        pops: list[tuple[np.ndarray, np.ndarray]] = []
        a, b = self.middle(lo, hi, pops)
        a, b = np.where(a < b, a, 0), np.where(a < b, b, 0)
        out = []
        for base in (_A, _B):
            n = len(self.top)
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INV[int(base)])]), dtype=np.uint64)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.top ^ base) * power[:n], dtype=np.uint64)])
            name = mix((sums[b] - sums[a]) * back[a] ^ (b - a).astype(np.uint64))
            for sym, count in pops:
                some = np.flatnonzero(count)
                name[some] = mix(name[some] * base + mix(sym[some] ^ base) + count[some].astype(np.uint64))
                none = count == 0
                name[none] = name[none] * base + np.uint64(1)
            out.append(mix(name))
        return out[0], out[1]

    def anchors(self, starts: np.ndarray, window: int) -> np.ndarray:
        """For each window ``[s, s + window)`` its anchor, an index of the top; -1: none is left."""
        a, b = self.middle(starts, starts + window)
        sym = self.top
        rank = (mix(sym ^ _A) >> np.uint64(1)) | ((self.width < 4).astype(np.uint64) << np.uint64(63))
        # least rank of each range, the leftmost of equals: doubling ranges
        out = np.full(len(starts), -1)
        span = b - a
        level, step = np.arange(len(sym)), 1
        while (todo := (span >= step) & (span < 2 * step)).any() or (span >= 2 * step).any():
            x, y = level[a[todo]], level[b[todo] - step]
            out[todo] = np.where(rank[x] <= rank[y], x, y)
            if len(level) <= step:
                break
            x, y = level[:-step], level[step:]
            level, step = np.where(rank[x] <= rank[y], x, y), 2 * step
        return out


def batches_of(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Rounds]]:
    """Texts of a window or more, some at a time: ``(row, begins, lengths, rounds)``."""
    k = 0
    while k < len(texts):
        at, size = k, 0
        while k < len(texts) and (at == k or size < BATCH_BYTES):
            size += len(texts[k])
            k += 1
        h, lengths = word_ids(texts[at:k])
        rows = np.flatnonzero(lengths >= window)
        if not len(rows):
            continue
        h = h[np.repeat(lengths >= window, lengths)]
        lengths = lengths[rows]
        begins = np.cumsum(lengths) - lengths
        first = np.zeros(len(h), bool)
        first[begins] = True
        yield rows + at, begins, lengths, Rounds(h, first)


def block_rows(texts: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of a list of texts: ``(row, lo, n, left, right, b1, b2, single)`` in batches.

    ``left`` and ``right`` name the anchor with the words on one side of it, as many as one side of any window has at
    least; 0 where the text has fewer.  ``b1, b2`` name the block's words and the anchor's place in them.
    ``single``: windows without an anchor, all of one name, which then names the block.
    """
    for rows, begins, lengths, rounds in batches_of(texts, window):
        keep = lengths - window + 1
        starts = np.repeat(begins - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())
        of = np.repeat(np.arange(len(rows)), keep)
        anchor = rounds.anchors(starts, window)
        some = anchor >= 0
        starts, of, anchor, single = starts[some], of[some], anchor[some], starts[~some]
        new = np.ones(len(starts), bool)
        new[1:] = (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(starts)))
        lo, of = starts[at], of[at]
        p, width = rounds.pos[anchor[at]], rounds.width[anchor[at]]
        side = -(-(window - width) // 2)  # of the words around an anchor, a window has so many on one side
        end = begins[of] + lengths[of]
        b1, b2 = rounds.names(lo, lo + n - 1 + window)
        off = mix((p - lo).astype(np.uint64) + _B)
        left, _ = rounds.names(np.maximum(p - side, begins[of]), p + width)
        right, _ = rounds.names(p, np.minimum(p + width + side, end))
        left = np.where(p - side >= begins[of], mix(left ^ _A), 0)
        right = np.where(p + width + side > end, 0, mix(right ^ _B))
        yield rows[of], lo - begins[of], n, signed(left), signed(right), signed(mix(b1 ^ off)), signed(mix(b2 ^ off)), np.zeros(len(n), bool)
        if not len(single):
            continue
        # windows without an anchor repeat a few words: those of one name are one row while they overlap
        of = np.searchsorted(begins, single, side="right") - 1
        b1, b2 = rounds.names(single, single + window)
        order = np.lexsort([single, b2, b1, of])
        single, of, b1, b2 = single[order], of[order], b1[order], b2[order]
        new = np.ones(len(single), bool)
        new[1:] = (of[1:] != of[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]) | (single[1:] > single[:-1] + window)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(single)) - 1
        lo, n, of = single[at], single[last] - single[at] + 1, of[at]
        yield rows[of], lo - begins[of], n, signed(mix(b1[at] ^ b2[at])), np.zeros(len(n), np.int64), signed(b1[at]), signed(b2[at]), np.ones(len(n), bool)


def window_rows(texts: list[bytes], spans: list[list[tuple[int, int]]], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Names of the windows of some blocks ``(lo, n)`` of each text: ``(row, i, w1, w2)`` in batches."""
    for rows, begins, _, rounds in batches_of(texts, window):
        pairs = [(k, begin + lo, n) for k, (row, begin) in enumerate(zip(rows.tolist(), begins.tolist(), strict=True)) for lo, n in spans[row]]
        if not pairs:
            continue
        k, lo, n = np.array(pairs, np.int64).T
        at = np.repeat(np.arange(len(n)), n)
        i = lo[at] + np.arange(len(at)) - (np.cumsum(n) - n)[at]
        w1, w2 = rounds.names(i, i + window)
        yield rows[k[at]], i - begins[k[at]], signed(w1), signed(w2)


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, h, spans``: word spans that windows of a smaller doc_id cover, of documents with any.

    ``h`` is ``xxhash64(text)``.
    """
    kind = dict(docs.dtypes)["doc_id"]
    usable = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    names = ["left", "right", "b1", "b2", "single"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            for row, lo, n, *of in block_rows(as_bytes(b.column("text")), window):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("h").take(at), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), *map(pa.array, of)], ["doc_id", "h", "lo", "n", *names]
                )

    blocks = written(usable.mapInArrow(cut, f"doc_id {kind}, h long, lo int, n int, {', '.join(f'{c} long' for c in names[:-1])}, single boolean"), "op7-blocks")
    sides = blocks.select(F.explode(F.array("left", "right")).alias("side")).where("side <> 0")
    often = written(sides.groupBy("side").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("side"), "op7-sides")
    # a block with a side that stands elsewhere too, and what is left of blocks without
    some = blocks.join(often.withColumnRenamed("side", "left"), "left", "left_semi")
    rest = blocks.join(often.withColumnRenamed("side", "left"), "left", "left_anti").join(often.withColumnRenamed("side", "right"), "right", "left_semi")
    shared = written(some.unionByName(rest).select("doc_id", "h", "lo", "n", *names[2:]), "op7-shared")
    discard(blocks, often)
    firsts = shared.groupBy("b1", "b2").agg(F.min("doc_id").alias("first"))
    matter = written(shared.join(firsts, ["b1", "b2"]).select("doc_id", "h", "lo", "n", "single", (F.col("doc_id") > F.col("first")).alias("settled")), "op7-matter")
    discard(shared)
    open_ = matter.where("not settled and not single").groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "n")).alias("open"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            spans = [[(s["lo"], s["n"]) for s in x] for x in b.column("open").to_pylist()]
            for row, i, w1, w2 in window_rows(as_bytes(b.column("text")), spans, window):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("h").take(at), pa.array(i, pa.int32()), pa.array(w1), pa.array(w2)], ["doc_id", "h", "i", "w1", "w2"]
                )

    pool = usable.join(open_, ["doc_id", "h"]).select("doc_id", "h", "text", "open")
    wins = written(pool.mapInArrow(windows, f"doc_id {kind}, h long, i int, w1 long, w2 long"), "op7-windows")
    firsts = wins.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = written(wins.join(firsts.select("w1", "w2", "first"), ["w1", "w2"]).where("doc_id > first").select("doc_id", "h", "i"), "op7-later")
    discard(wins)
    spans = matter.where("settled").select("doc_id", "h", "lo", (F.col("lo") + F.col("n") - 1 + window).alias("hi")).unionByName(
        later.select("doc_id", "h", F.col("i").alias("lo"), (F.col("i") + window).alias("hi"))
    )
    out = written(spans_by_document(spans), "op7-spans")
    discard(matter, later)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns of ``docs`` and ``n_words``, ``n_removed``, ``kept_text`` (kept words, one space between)."""
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    spans = find_repeats(docs, window)
    src = docs.select(*rest, F.xxhash64("text").alias("__h")).join(
        spans.select(F.col("doc_id").alias("__d"), F.col("h").alias("__k"), F.col("spans").alias("__spans")),
        (F.col("doc_id") == F.col("__d")) & (F.col("__h") == F.col("__k")), "left",
    ).select(*rest, "__spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            total, gone, kept = [], [], []
            for text, spans in zip(as_bytes(b.column("text")), b.column("__spans").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["lo"] for s in spans], 1)
                    np.add.at(change, [s["hi"] for s in spans], -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [*rest, "n_words", "n_removed", "kept_text"],
            )

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in rest)
    return src.mapInArrow(strip, f"{fields}, n_words long, n_removed long, kept_text string")


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same by window texts; words of a window have no white space, so its text tells it.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i) WHERE len(w) >= {WINDOW}),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW}, true) AS new FROM win JOIN f USING (k) WHERE doc_id > first),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + {WINDOW - 1} AS hi FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h) GROUP BY doc_id, run),
s AS (SELECT doc_id, sum(hi - lo + 1)::BIGINT AS gone, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, 0) AS gone, CASE WHEN gone IS NULL THEN w ELSE flatten(list_transform(range(1, len(los) + 2), lambda x: w[(CASE WHEN x = 1 THEN 1 ELSE his[x - 1] + 1 END):(CASE WHEN x > len(los) THEN len(w) ELSE los[x] - 1 END)])) END AS kept FROM d LEFT JOIN s USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, gone AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
