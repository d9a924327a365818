"""Exact n-gram Jaccard join with signature trees.

Documents with equal shingle sets are one class, and one document of a class stands for it.  Classes
whose sets may be similar enough share a shingle of their prefixes: with shingles in a fixed order, two
sets of overlap ``a`` share one among the first ``size - a + 1`` of each.  The order puts shingles of very
many documents last, the most frequent at the end, so that prefixes are made of rare ones.

1. Candidates.  The classes of a prefix shingle form a group, cut where sizes are too far apart; equal
   groups are one.  A signature tree finds what may be similar in a group: nodes hold the OR and the AND
   of their members' shingle bitmaps and the range of their sizes, two nodes are walked together, and left
   as soon as the largest overlap that bitmaps and sizes allow is too small.  A group gives no more
   than a forest over what its pairs join: a row a member at most, whatever the group holds.  A group of
   more than ``BLOCK`` members is dealt out by bands of size, two neighbouring bands a part; a part that still
   has more is not walked, its members are all joined with one of them.  A bitmap travels to each of its
   class's groups, whose number grows with the corpus, so it has a bit or two a shingle.
2. Clusters.  All pairs that may be similar lie in one connected component of the forests.  Its texts
   meet in one place, each once, where a second signature tree over them finds the pairs and each that
   would join two components is verified on the shingle sets themselves.
3. Large clusters, of more than ``ROWS`` texts or ``BYTES`` bytes, are cut into blocks within bands of size
   that similar sets differ by one of at most.  First each text is verified against one of its band, which
   joins most of a group of copies; blocks of these, being joined, never meet each other.  All other
   pairs of blocks of near sizes are walked.

So rows grow with the documents and not with the pairs in a group, except the pairs of blocks of a
large cluster whose texts are neither copies of one nor told apart by size: their number is the square of
``1 / ROWS`` of it, which an exact join of such texts cannot go below.  What is broadcast are the
frequent shingles: at most the mean set size divided by ``FREQUENT``.

Cases: null, empty or white-space texts have no shingles and are components of their own; a text of
fewer words than a shingle has is one shingle; rows of one doc_id are taken as equal vertices; rows
with a null doc_id get a null component; an empty table gives an empty result; a text over ``BYTES`` is a
block of its own; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from ..session import discard, read_table, written
from .text import as_bytes, mix, signed, word_ids
from .tokens import released, slices

WORDS = 4
NUM, DEN = 85, 100
FREQUENT = 1 / 500
BLOCK = 2000
ROWS, BYTES = 2000, 6_000_000
LEAF = 16
MIN_BITS, MAX_BITS = 1 << 8, 1 << 17
COUNT_SHINGLES = 2_000_000
_A = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and how many each has."""
    h, n = word_ids(texts, lower=True)
    h = np.append(h, np.zeros(words, np.uint64))
    begins = np.cumsum(n) - n
    m = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    out = np.zeros(len(h) - words, np.uint64)
    for k in range(words):
        out = mix(out * _A + h[k : k + len(out)])
    at = np.cumsum(m) - m
    out = out[np.repeat(begins - at, m) + np.arange(m.sum())]
    for k in np.flatnonzero((n > 0) & (n < words)):  # fewer words: the whole sequence is the shingle
        one = np.zeros(1, np.uint64)
        for x in h[begins[k] : begins[k] + n[k]]:
            one = mix(one * _A + x)
        out[at[k]] = one[0]
    for a, b in zip(at.tolist(), (at + m).tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[m > 0]] = True
    return out[keep], np.bincount(np.repeat(np.arange(len(m)), m)[keep], minlength=len(m))


def overlap_needed(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of sets of sizes x and y with ``den * overlap >= num * union``."""
    return -(-num * (x + y) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of size n that a similar set must meet one of: the overlap is num/den of n at least."""
    return n - -(-num * n // den) + 1


def signature(s: np.ndarray, per: int = 4) -> bytes:
    """Bitmap of a set's shingles: a power of two of bits, ``per`` or more a shingle up to ``MAX_BITS``."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, per * len(s)):
        bits *= 2
    out = np.zeros(bits, bool)
    out[(s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


class Forest:
    """Which members are joined already."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were not joined yet."""
        a, b = self.find(i), self.find(j)
        self.root[a] = b
        return a != b


class Tree:
    """Signature tree over some sets, ordered by size: levels of nodes, each over two of the level below.

    A level has: first and last member, OR map, AND map, least and largest size.
    """

    def __init__(self, sizes: np.ndarray, maps: np.ndarray) -> None:
        at = np.arange(0, len(sizes), LEAF)
        self.levels = [(
            at, np.append(at[1:], len(sizes)), np.bitwise_or.reduceat(maps, at, 0), np.bitwise_and.reduceat(maps, at, 0),
            np.minimum.reduceat(sizes, at), np.maximum.reduceat(sizes, at),
        )]
        while len(self.levels[-1][0]) > 1:
            lo, hi, any_, every, small, large = self.levels[-1]
            k = np.arange(0, len(lo), 2)
            self.levels.append((
                lo[k], np.maximum.reduceat(hi, k), np.bitwise_or.reduceat(any_, k, 0), np.bitwise_and.reduceat(every, k, 0),
                np.minimum.reduceat(small, k), np.maximum.reduceat(large, k),
            ))


def _missing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits of x that y has not."""
    return np.bitwise_count(x & ~y).sum(-1, dtype=np.int64)


def walk(sizes: np.ndarray, maps: np.ndarray, left: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may be similar, some at a time, by dual traversal of the members' signature trees.

    Members come in order of size.  ``left``: members before it and those after are two sides and only
    pairs across are wanted (-1: all pairs).
    """
    if left < 0:
        ta = tb = Tree(sizes, maps)
        base = 0
    else:
        ta, tb, base = Tree(sizes[:left], maps[:left]), Tree(sizes[left:], maps[left:]), left
    same = left < 0
    stack = [(len(ta.levels) - 1, 0, len(tb.levels) - 1, 0)]
    while stack:
        la, ia, lb, ib = stack.pop()
        itself = same and (la, ia) == (lb, ib)
        if itself and la:
            kids = [k for k in (2 * ia, 2 * ia + 1) if k < len(ta.levels[la - 1][0])]
            stack += [(la - 1, x, la - 1, y) for i, x in enumerate(kids) for y in kids[i:]]
            continue
        a, b = ta.levels[la], tb.levels[lb]
        if not itself:
            if den * a[5][ia] < num * b[4][ib] or den * b[5][ib] < num * a[4][ia]:
                continue  # sizes too far apart
            # bits of all members of one node that no member of the other has: what is left of the largest set
            # is the overlap's bound; less size lowers it by more than the overlap needed
            if a[5][ia] - _missing(a[3][ia], b[2][ib]) < overlap_needed(a[5][ia], b[4][ib], num, den):
                continue
            if b[5][ib] - _missing(b[3][ib], a[2][ia]) < overlap_needed(a[4][ia], b[5][ib], num, den):
                continue
        if la or lb:
            if la >= lb:
                stack += [(la - 1, k, lb, ib) for k in (2 * ia, 2 * ia + 1) if k < len(ta.levels[la - 1][0])]
            else:
                stack += [(la, ia, lb - 1, k) for k in (2 * ib, 2 * ib + 1) if k < len(tb.levels[lb - 1][0])]
            continue
        xs, ys = np.arange(a[0][ia], a[1][ia]), np.arange(b[0][ib], b[1][ib]) + base
        x, y = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
        need = overlap_needed(sizes[x], sizes[y], num, den)
        ok = (sizes[x] >= need) & (sizes[y] >= need)
        if same:
            ok &= x < y
        x, y, need = x[ok], y[ok], need[ok]
        # a bit of x that y lacks stands for a shingle at least that y lacks
        ok = (sizes[x] - _missing(maps[x], maps[y]) >= need) & (sizes[y] - _missing(maps[y], maps[x]) >= need)
        if ok.any():
            yield x[ok], y[ok]


def forest(
    sizes: np.ndarray, maps: list[bytes], side: np.ndarray | None, num: int, den: int, verify: Callable[[int, int], bool] | None = None
) -> list[tuple[int, int]]:
    """Pairs that join what all similar pairs among some members join, or those across two sides.

    With ``verify`` pairs are those it finds similar, else those that may be by their maps.
    """
    bits = np.array([len(m) for m in maps])
    joined, out = Forest(len(maps)), []

    def run(left: np.ndarray, right: np.ndarray | None, least: int) -> None:
        if not len(left) or (len(left) < 2 if right is None else not len(right)):
            return
        order = left[np.argsort(sizes[left], kind="stable")]
        if right is not None:
            order = np.concatenate([order, right[np.argsort(sizes[right], kind="stable")]])
        # a map folds to half its length: hashes are taken modulo powers of two
        rows = [np.bitwise_or.reduce(np.frombuffer(maps[k], np.uint8).reshape(-1, least), 0) for k in order]
        for x, y in walk(sizes[order], np.stack(rows).view(np.uint64), -1 if right is None else len(left), num, den):
            for i, j in zip(order[x].tolist(), order[y].tolist(), strict=True):
                if joined.find(i) != joined.find(j) and (verify is None or verify(i, j)):
                    joined.join(i, j)
                    out.append((i, j))

    for b in np.unique(bits).tolist():  # similar sets have maps of one length, or of one and its double
        at, up = np.flatnonzero(bits == b), np.flatnonzero((bits > b) & (num * bits <= 2 * den * b))
        if side is None:
            run(at, None, b)
            run(at, up, b)
        else:
            run(at[~side[at]], at[side[at]], b)
            run(at[~side[at]], up[side[up]], b)
            run(at[side[at]], up[~side[up]], b)
    return out


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets have a Jaccard similarity of num/den or more."""
    if len(x) > len(y):
        x, y = y, x
    if den * len(x) < num * len(y):
        return False
    n = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return den * n >= num * (len(x) + len(y) - n)


def links_among(texts: list[bytes], left: int, words: int, num: int, den: int) -> list[tuple[int, int]]:
    """Similar pairs that join all that similar pairs among the texts join; across ``left`` only, if not -1."""
    flat, sizes = shingle_sets(texts, words)
    ends = np.cumsum(sizes)
    sets = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    side = None if left < 0 else np.arange(len(texts)) >= left
    maps = [signature(s, 16) for s in sets]
    return forest(sizes, maps, side, num, den, lambda i, j: similar(sets[i], sets[j], num, den))


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as a table, of batches that come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in keys:
            v = b.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(b.column(c)[lo].as_py() for c in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _arrow_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()


def similarity_classes(
    docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK, rows: int = ROWS, size: int = BYTES
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; links have a Jaccard similarity of num/den or more.

    ``block``: members that a group may have to be walked; ``rows``, ``size``: texts and bytes of a block of texts.
    """
    src = docs.select("doc_id", "text")
    members, classes, frequent = _sets(src, words)
    near = _candidates(src, classes, frequent, words, num, den, block)
    links = _links(src, near, words, num, den, rows, size)
    discard(near)
    full = connected_components(links)
    discard(links)
    out = classes.join(full.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component")
    )
    return members.join(out, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _sets(src: DataFrame, words: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Documents with the hashes of their sets, classes of equal sets, and frequent shingles, rare ones first."""
    kind = dict(src.dtypes)["doc_id"]
    id_type = _arrow_type(kind)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document, and one for each shingle frequent among some of this task's documents."""
        seen, pending, held = 0, [], 0
        for b in slices(released(batches)):
            flat, size = shingle_sets(as_bytes(b.column("text")), words)
            raw, ends = memoryview(flat.tobytes()), (8 * np.cumsum(size)).tolist()
            cuts = [raw[a:e] for a, e in zip([0, *ends], ends)]
            k1 = [xxhash.xxh3_64_intdigest(c, 1) - 2**63 for c in cuts]
            k2 = [xxhash.xxh3_64_intdigest(c, 2) - 2**63 for c in cuts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * b.num_rows, pa.string()), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())],
                ["what", "doc_id", "n", "k1", "k2"],
            )
            pending.append(flat)
            seen, held = seen + b.num_rows, held + len(flat)
            if held > COUNT_SHINGLES:
                yield often(pending, seen)
                seen, pending, held = 0, [], 0
        if held:
            yield often(pending, seen)

    def often(pending: list[np.ndarray], seen: int) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(pending), return_counts=True)
        keep = n >= max(3, FREQUENT * seen)
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(["shingle"] * k, pa.string()), pa.nulls(k, id_type), pa.array(n[keep]), pa.array(signed(keys[keep])), pa.array(np.zeros(k, np.int64))],
            ["what", "doc_id", "n", "k1", "k2"],
        )

    first = written(src.mapInArrow(sets, f"what string, doc_id {kind}, n long, k1 long, k2 long"), "op3-sets")
    members = first.where("what = 'doc'")
    classes = written(members.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "op3-classes")
    total = members.count()
    # the order is a heuristic: any set of frequent shingles that all tasks share gives the same result
    often_ = first.where("what = 'shingle'").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, FREQUENT * total))
    return members, classes, [r.k1 for r in often_.orderBy("n", "k1").collect()]


def _band(num: int, den: int) -> Column:
    """Band of a set's size ``n``: similar sets' sizes differ by a factor of den / num at most, so by one band."""
    return F.floor(F.log(F.col("n")) / (math.log(den / num) * 1.000001))


def _candidates(src: DataFrame, classes: DataFrame, frequent: list[int], words: int, num: int, den: int, block: int) -> DataFrame:
    """A written table ``id, component, n, bytes`` of texts: clusters that hold all similar pairs of classes."""
    kind = dict(src.dtypes)["doc_id"]
    id_type = _arrow_type(kind)
    keys = np.array(frequent, np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = src.sparkSession.sparkContext.broadcast((keys[order], order))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefix shingles of each class, and one row with its signature and its text's bytes."""
        late, place = shared.value
        for b in slices(released(batches)):
            texts = as_bytes(b.column("text"))
            flat, size = shingle_sets(texts, words)
            rank = np.full(len(flat), -1)
            if len(late):
                at = np.minimum(np.searchsorted(late, flat), len(late) - 1)
                rank = np.where(late[at] == flat, place[at], -1)
            ends = np.cumsum(size).tolist()
            at, token, maps, amount = [], [], [], []
            for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
                if lo == hi:
                    continue
                s, r = flat[lo:hi], rank[lo:hi]
                length = prefix_length(hi - lo, num, den)
                p = s[np.argsort(r, kind="stable")][:length] if r.max() >= 0 else s[:length]
                at.append(np.full(length + 1, k))
                token += [p, np.zeros(1, np.uint64)]
                maps += [None] * length + [signature(s, 1)]
                amount += [None] * length + [len(texts[k])]
            if at:
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at)), pa.array(signed(np.concatenate(token))), pa.array(size[at]), pa.array(maps, pa.binary()), pa.array(amount, pa.int64())],
                    ["rep", "token", "n", "map", "bytes"],
                )

    reps = src.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    posted = written(reps.mapInArrow(post, f"rep {kind}, token long, n long, map binary, bytes long"), "op3-postings", compression="zstd")
    maps = posted.where("map is not null").select("rep", "n", "map", "bytes")  # several of a doc_id that has several texts
    postings = posted.where("map is null").select("token", "rep", "n")
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = written(postings.join(counts, "token"), "op3-shared")

    # similar sets lie in one band of size or in two that follow each other, so each pair meets in the upper one's part
    parts = met.where(F.col("c") > block).withColumn("chain", F.explode(F.array(_band(num, den), _band(num, den) + 1)))
    parts = parts.join(parts.groupBy("token", "chain").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("hub")), ["token", "chain"])
    star = parts.where((F.col("k") > block) & (F.col("rep") != F.col("hub"))).select(F.col("rep").alias("a"), F.col("hub").alias("b"))

    by_size = Window.partitionBy("token").orderBy("n", "rep")
    far = F.coalesce(F.lit(den) * F.lag("n").over(by_size) < F.lit(num) * F.col("n"), F.lit(False))
    chains = met.where(F.col("c") <= block).withColumn("far", far.cast("int")).withColumn("chain", F.sum("far").over(by_size))
    chains = chains.select("token", "chain", "rep").unionByName(parts.where(F.col("k") <= block).select("token", "chain", "rep"))
    lists = chains.groupBy("token", "chain").agg(F.sort_array(F.collect_set("rep")).alias("m")).where(F.size("m") > 1)
    lists = lists.groupBy(F.xxhash64("m").alias("g1"), F.xxhash64(F.lit(1), "m").alias("g2")).agg(F.first("m").alias("m"))
    groups = lists.select("g1", "g2", F.explode("m").alias("rep")).join(maps, "rep").select("g1", "g2", "rep", "n", "map")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = [], []
        for g in groups_of(released(batches), ["g1", "g2"]):
            ids = g["rep"].to_pylist()
            for i, j in forest(g["n"].to_numpy(), g["map"].to_pylist(), None, num, den):
                a.append(ids[i])
                c.append(ids[j])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(c, id_type)], ["a", "b"])
                a, c = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(c, id_type)], ["a", "b"])

    sorted_ = groups.repartition("g1").sortWithinPartitions("g1", "g2", "rep")
    pairs = sorted_.mapInArrow(solve, f"a {kind}, b {kind}").unionByName(star).distinct()
    joined = connected_components(pairs, "a", "b")
    near = written(joined.join(maps.select(F.col("rep").alias("id"), "n", "bytes").distinct(), "id"), "op3-near")
    discard(posted, met, joined)
    return near


def _links(src: DataFrame, near: DataFrame, words: int, num: int, den: int, rows: int, size: int) -> DataFrame:
    """A written table of links ``(src, dst)``, joining within each cluster all that similar pairs join."""
    kind = dict(src.dtypes)["doc_id"]
    id_type = _arrow_type(kind)
    fields = f"src {kind}, dst {kind}"
    both = near.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("s"))
    large = (F.col("c") > rows) | ((F.col("s") > size) & (F.col("c") > 1))

    def as_links(pairs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], id_type), pa.array([p[1] for p in pairs], id_type)], ["src", "dst"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(released(batches), ["component"]):
            ids = g["id"].to_pylist()
            got = links_among([x or b"" for x in g["text"].cast(pa.binary()).to_pylist()], -1, words, num, den)
            yield as_links([(ids[i], ids[j]) for i, j in got])

    near = near.join(both.select("component", large.alias("large")), "component")
    texts = src.withColumnRenamed("doc_id", "id")
    small = texts.join(near.where("not large").select("id", "component").distinct(), "id").repartition("component").sortWithinPartitions("component", "id")
    links = written(small.select("id", "component", "text").mapInArrow(solve, fields), "op3-links")
    big = written(near.where("large"), "op3-large")
    if big.isEmpty():
        discard(big)
        return links
    more = _large_links(texts, big, words, num, den, rows, size, as_links, id_type)
    out = written(links.unionByName(more), "op3-links")
    discard(links, more, big)
    return out


def _large_links(
    texts: DataFrame, big: DataFrame, words: int, num: int, den: int, rows: int, size: int, as_links: Callable[[list[tuple]], pa.RecordBatch], id_type: pa.DataType
) -> DataFrame:
    """A written table of links within clusters of many texts: against one text a band first, then by pairs of blocks."""
    kind = dict(texts.dtypes)["id"]
    fields = f"src {kind}, dst {kind}"
    big = big.withColumn("band", _band(num, den))

    def blocks(keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """Members with a block ``s`` among those of their keys, and the keys' number of blocks and least member."""
        n = F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum("bytes") / size)).cast("int")
        per = placed.groupBy(*keys).agg(n.alias("blocks"), F.min("id").alias("hub"))
        return placed.join(per, keys).withColumn("s", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), per

    placed = big
    members, bands = blocks(["component", "band"])
    at = ["component", "band", "s"]
    hubs = bands.select("component", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("s"), F.col("hub").alias("id"), F.lit(0).alias("rank"))
    rest = members.where("id <> hub").select(*at, "id", F.lit(1).alias("rank"))
    below = bands.select("component", (F.col("band") + 1).alias("band"), F.col("hub").alias("below"))
    tied = bands.join(below, ["component", "band"])  # is one band's copies' text like the next one's?
    rest = rest.unionByName(tied.where("below <> hub").select("component", "band", F.lit(0).alias("s"), F.col("below").alias("id"), F.lit(1).alias("rank"))).distinct()

    def spokes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text against its block's first."""
        key = hub = held = None
        for b in slices(released(batches)):
            flat, n = shingle_sets(as_bytes(b.column("text")), words)
            ends, out = np.cumsum(n).tolist(), []
            ids = b.column("id").to_pylist()
            for k, now in enumerate(zip(*(b.column(c).to_pylist() for c in at), strict=True)):
                own = flat[ends[k] - n[k] : ends[k]]
                if now != key:
                    key, hub, held = now, ids[k], own.copy()
                elif similar(own, held, num, den):
                    out.append((ids[k], hub))
            yield as_links(out)

    lined = texts.join(hubs.unionByName(rest), "id").repartition(*at).sortWithinPartitions(*at, "rank", "id")
    star = written(lined.select("id", *at, "text").mapInArrow(spokes, fields), "op3-star")
    to_hub = star.select(F.col("src").alias("id"), F.col("dst").alias("hub"), F.lit(True).alias("joined")).distinct()
    tied = tied.join(to_hub.withColumnRenamed("id", "below"), ["below", "hub"], "left").select(
        "component", F.col("band").alias("upper"), (F.coalesce("joined", F.lit(False)) | (F.col("below") == F.col("hub"))).alias("tied")
    )
    placed = big.join(bands.select("component", "band", "hub"), ["component", "band"]).join(to_hub, ["id", "hub"], "left")
    placed = placed.withColumn("joined", F.coalesce("joined", F.col("id") == F.col("hub"))).drop("hub")
    members = blocks(["component", "band", "joined"])[0]
    at = ["component", "band", "joined", "s"]
    members = written(members.select("id", *at).distinct(), "op3-places")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one place compressed as one: near copies then take little more than one text."""
        press = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=24, enable_ldm=True))
        for g in groups_of(released(batches), at):
            raws = [x or b"" for x in g["text"].cast(pa.binary()).to_pylist()]
            one = g.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(one[c].combine_chunks() for c in at), pa.array([g["id"].to_pylist()], pa.list_(id_type)),
                    pa.array([np.cumsum([len(x) for x in raws])], pa.list_(pa.int64())), pa.array([press.compress(b"".join(raws))], pa.binary()),
                ],
                [*at, "ids", "ends", "z"],
            )

    lined = texts.join(members, "id").repartition(*at).sortWithinPartitions(*at, "id")
    bundles = written(
        lined.select("id", *at, "text").mapInArrow(bundle, f"component {kind}, band long, joined boolean, s int, ids array<{kind}>, ends array<long>, z binary"), "op3-bundles"
    )
    name = F.struct("band", "joined", "s")
    places = bundles.select("component", name.alias("x"))
    pairs = places.join(places.withColumnRenamed("x", "y"), "component").where("x <= y and abs(x.band - y.band) <= 1")
    upper = F.when(F.col("x.band") < F.col("y.band"), F.col("y.band"))
    pairs = pairs.withColumn("upper", upper).join(tied, ["component", "upper"], "left").where("not (x.joined and y.joined and (upper is null or tied))")
    side = lambda x: bundles.select("component", name.alias(x), F.struct("ids", "ends", "z").alias(f"{x}b"))
    met = pairs.join(side("x"), ["component", "x"]).join(side("y"), ["component", "y"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(max_window_size=1 << 24)
        for b in slices(released(batches), 1):
            itself, held, ids = b.column("itself")[0].as_py(), [], []
            for c in ("xb",) if itself else ("xb", "yb"):
                s = b.column(c)[0]
                raw, lo, left = open_.decompress(s["z"].as_py()), 0, len(ids)
                for end in s["ends"].as_py():
                    held.append(raw[lo:end])
                    lo = end
                ids += s["ids"].as_py()
            yield as_links([(ids[i], ids[j]) for i, j in links_among(held, -1 if itself else left, words, num, den)])

    # many small tasks: a pair of blocks is a task's work for a while
    met = met.select((F.col("x") == F.col("y")).alias("itself"), "xb", "yb").repartition(F.col("itself"), F.xxhash64("xb.ids", "yb.ids"))
    more = met.mapInArrow(check, fields)
    out = written(star.unionByName(more), "op3-large-links")
    discard(star, members, bundles)
    return out


def op3_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same by all pairs that share a shingle.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + {WORDS - 1}], ' ')) AS k FROM d, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)),
e AS (SELECT a AS s, b AS t FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT e.t, r.reach FROM r JOIN e ON e.s = r.id WHERE r.reach < e.t),
m AS (SELECT id, min(reach) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""
