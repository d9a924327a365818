"""Token ids as Parquet list columns, readable by document or by token range.

Layout: documents in ascending doc_id order over files in name order; each row holds ``doc_id``,
``n_tokens``, ``start_in_file``, ``end_in_file`` and ``ids``.  Ids are dictionary-encoded, and delta-packed
where a dictionary would grow too large; row groups and pages are small and carry indexes.  Reads of
the metadata columns alone skip the ids, filters on doc_id or on places in a file skip row groups and
pages, and a read of a range of all ids opens only the files that hold some of it.

Ids are those of ``encode(text, add_special_tokens=False)``: an added token's text that stands in a document
becomes that token.

Cases: a null or empty text has the end id only; documents of the same doc_id stand next to each
other, ordered by text; null doc_ids come first; a text of any length is one row; an empty table gives an
empty result; input columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import read_table, shared_dir
from .tokens import released, slices, word_tokenizer

ROW_GROUP = 16 << 20
PAGE, PAGE_ROWS = 64 << 10, 256
END = 2
#: Up to so many files (a row of about 100 bytes each) their starts are broadcast; beyond, joined by shuffle.
BROADCAST_FILES = 100_000


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Encode every whole text, close it with ``end`` and write the id files under ``path``."""
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in slices(released(batches)):
            ids, counts = word_tokenizer(vocabulary).closed(b.column("text"), end)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(at + ends - counts, pa.int64()), pa.array(at + ends, pa.int64()), lists],
                ["doc_id", "n_tokens", "start_in_file", "end_in_file", "ids"],
            )
            at += int(counts.sum())

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(encode, f"doc_id {kind}, n_tokens long, start_in_file long, end_in_file long, ids array<int>")
    encoded.write.options(
        compression="zstd",
        **{
            "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS,
            "parquet.enable.dictionary": True, "parquet.writer.version": "PARQUET_2_0",
        },
    ).parquet(path)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """``file, base, n``: each file's number of ids, and how many all files before it have; one row a file."""
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.max("end_in_file").alias("n"))
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (or only those asked for) and ``start``, the ids of all documents before."""
    names = columns or ["doc_id", "n_tokens", "ids"]
    every = spark.read.parquet(path)
    starts = file_starts(spark, path)
    if len(every.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    rows = every.select(*names, "start_in_file", F.col("_metadata.file_name").alias("file"))
    return rows.join(starts, "file").select(*names, (F.col("base") + F.col("start_in_file")).alias("start"))


def read_span(spark: SparkSession, path: str, lo: int, hi: int, columns: list[str] | None = None) -> DataFrame:
    """Documents that hold ids at positions ``lo`` to ``hi`` (exclusive) of all ids.

    Only the files that hold some of them are opened, with filters on the places in each that are pushed down.
    """
    names = columns or ["doc_id", "n_tokens", "ids"]
    out = spark.read.parquet(path).where("false").select(*names, F.lit(0).cast("long").alias("start"))
    held = file_starts(spark, path).where((F.col("base") < hi) & (F.col("base") + F.col("n") > lo))
    for r in held.orderBy("base").collect():  # as many as the range takes
        rows = spark.read.parquet(f"{path}/{r.file}").where((F.col("start_in_file") < hi - r.base) & (F.col("end_in_file") > lo - r.base))
        out = out.unionByName(rows.select(*names, (F.col("start_in_file") + r.base).alias("start")))
    return out


def ids_crc(ids: pa.ListArray) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    ends = np.concatenate([[0], 4 * np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/op2-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = read_tokens(spark, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), b.column("n_tokens"), ids_crc(b.column("ids"))],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return got.mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
