"""A corpus pipeline of five stages: each works on all that its predecessor kept.

1. quality    documents that the quality classifier rejects go (score under its threshold)
2. near_dups  one document of each group of near copies stays, the one of the smallest doc_id
3. repeats    50-word passages that a document of smaller doc_id holds too are cut out
4. leaks      documents that hold a benchmark item within the edit budget go
5. packing    what is left is tokenised and packed; the result is the pieces

All but the last return the columns of ``documents``.  Near copies are those of the n-gram Jaccard
join at five words and a similarity of 0.8 or more.

Cases: a null or empty text is scored like any other, has no near copies, loses no words, holds no benchmark
item and is packed as its end id.  Rows are judged each on its own whatever their doc_id: rows with a null doc_id or one that
other rows have too go through stage 2 under a number made of their doc_id and text, after all others, so of equal ones
one stays; in stage 3 rows with a null doc_id lose nothing and are no source, and of equal ids none is earlier; stage 4
judges a row by its text.  A document none of whose words are left after stage 3 goes.  Ties in stage 2 go to the smaller doc_id.
An empty table gives empty tables; other columns go through as they are; the names ``__row``, ``__odd`` and ``__leak`` are
taken by stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.op1_gam import THRESHOLD, fit_quality, score_quality
from rangeflow.llm.op3_sigtree import similarity_classes
from rangeflow.llm.op4_pack import pack, with_crc
from rangeflow.llm.op5_qgrams import find_leaks
from rangeflow.llm.op7_recompress import remove_repeats
from rangeflow.session import discard, read_table, scratch, written

#: SQL cannot express a trained model's scores, so the result is tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col("score") >= THRESHOLD).drop("score")


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    odd = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").select(F.col("doc_id").alias("__id")), "pipeline-odd")
    if odd.isEmpty():
        discard(odd)
        return _alone(docs.withColumn("__row", F.col("doc_id"))).select(docs.columns)
    marked = docs.join(odd.withColumn("__odd", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    number = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").bitwiseAND((1 << 61) - 1) + F.lit(1 << 61)
    rows = marked.withColumn("__row", F.when(F.col("__odd"), number).otherwise(F.col("doc_id")))
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    again = F.col("__odd").isNotNull() & ~empty
    rows = rows.where(~again).unionByName(rows.where(again).dropDuplicates(["__row"]))
    return _alone(rows).select(docs.columns)


def _alone(docs: DataFrame) -> DataFrame:
    """Rows that stand for their group of near copies, by ``__row``."""
    classes = similarity_classes(docs.select(F.col("__row").alias("doc_id"), "text"), words=5, num=80, den=100)
    drop = classes.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("__row")).distinct()
    return docs.join(drop, "__row", "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = remove_repeats(docs)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    return (
        got.where(~cut | (F.col("n_removed") < F.col("n_words")))
        .withColumn("text", text)
        .withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(docs.columns)
    )


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.md5(F.col("text").cast("binary"))  # whether a row leaks depends on its text alone, and doc_id may be null or repeated
    held = find_leaks(docs.select(key.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return docs.join(held.select(F.col("doc_id").alias("__leak")).distinct(), key == F.col("__leak"), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_crc(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_dups", near_dups), ("repeats", repeats), ("leaks", leaks), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and reread, and what it wrote besides is deleted."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
