"""Blocks: runs of neighbouring windows of a text that share one content-defined anchor.

An anchor depends on a window's content alone, so equal windows, wherever they are, have equal
anchors at equal offsets.  Windows are hence compared only within an anchor's group, and blocks whose
whole content is equal are settled at once.  Both steps are aggregations with map-side combining and
equi-joins that adaptive execution can split, so a hot anchor (a passage in a third of all documents)
costs no single task more than its share.

Block tables have ``doc_id, h`` (a hash of the text, telling rows of one doc_id apart), ``lo, n``
(first window, number of windows), ``key`` (anchor), ``bh`` (hash of the block's content), and what
else their operator needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def settle(blocks: DataFrame, order: Column, is_first: Column) -> DataFrame:
    """A written table of the blocks that matter, with ``settled`` and ``contents``.

    A block is ``settled`` if it is equal to an earlier one; other blocks are to be compared by window,
    and kept only if their anchor has several contents (``contents`` of them).  ``order``: what makes a
    block earlier, over the block table.  ``is_first``: whether a block is not settled, from its
    ``ord`` and ``first``, the least of its content.
    """
    often = written(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "block-keys")
    shared = written(blocks.join(often, "key").withColumn("ord", order), "blocks")
    firsts = written(shared.groupBy("key", "bh").agg(F.min("ord").alias("first")), "block-contents")
    keys = written(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("contents")), "block-anchors")
    got = shared.join(firsts, ["key", "bh"]).join(keys, "key")
    got = got.withColumn("settled", ~is_first).where("settled or contents > 1")
    out = written(got.drop("ord", "first"), "blocks-settled")
    discard(often, shared, firsts, keys)
    return out


def spans_by_document(spans: DataFrame) -> DataFrame:
    """``doc_id, h, spans``: each document's spans ``(lo, hi)`` in order; bounded by the text's length."""
    return spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
