"""Quality rules as a bitmask ledger: measure and judge every rule once, apply policies to the bits.

``quality_ledger`` adds each measurement and one failure bit a rule.  A policy is a mask of the rules
that it enforces; policies and ablations (what would be kept without a rule) then need only the
stored bits, as bitwise sums.  Everything is DataFrame functions, without Python on the executors.

Cases: a null or empty text has no words, so it fails ``min_words``; equal rows get equal results,
each on its own; an empty table gives an empty result; very long texts stay in one row, whose 8-word
windows are counted by hash first, and by their words only where hashes repeat; input columns other
than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .text import words_col

WINDOW = 8
#: (rule, condition that fails it), in bit order; never reorder, only append.
RULES = [
    ("min_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 15 * word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
]
#: Policies by version: the rules enforced.
POLICIES = {
    "base": ["min_words", "repeated_words"],
    "v1": ["min_words", "repeated_words", "symbols", "duplicate_lines", "word_length"],
}


def mask(policy: str) -> int:
    """Bits of the rules that a policy enforces."""
    at = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << at[name] for name in POLICIES[policy])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """How many words lie in ``WINDOW``-word windows that are in the text twice or more.

    Windows whose 64-bit hash is unique are unique; only where some hash repeats are the windows
    sorted by their words.  Equal neighbours in that order repeat; the union of their spans, in
    text order, is summed up.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))

    def by_words(w: Column) -> Column:
        rows = F.array_sort(
            F.transform(
                F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                lambda i: F.struct(F.array_join(F.slice(w, i, F.lit(WINDOW)), " ").alias("k"), i.alias("i")),
            )
        )

        def marked(r: Column) -> Column:
            m = F.size(r)
            same = F.filter(
                F.transform(
                    F.sequence(F.lit(1), m),
                    lambda j: F.when(
                        ((j > 1) & (F.get(r, j - 2)["k"] == F.get(r, j - 1)["k"])) | ((j < m) & (F.get(r, j)["k"] == F.get(r, j - 1)["k"])),
                        F.get(r, j - 1)["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))  # end: last word covered so far
            return F.aggregate(
                F.array_sort(same),
                zero,
                lambda a, i: F.struct(
                    (a["sum"] + (i + WINDOW - 1) - F.greatest(a["end"], i - 1)).alias("sum"), (i + WINDOW - 1).alias("end")
                ),
                lambda a: a["sum"],
            )

        return let(rows, marked)

    def by_hash(h: Column) -> Column:
        return F.size(F.array_distinct(F.transform(F.slice(starts, 1, n), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))) < n - (WINDOW - 1)

    repeats = let(F.transform(words, lambda w: F.xxhash64(w)), by_hash)
    return F.when(n < WINDOW + 1, 0).when(repeats, by_words(words)).otherwise(0)


def quality_ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, measurements, ``fail_bits`` (bit k: rule k failed) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = " \t\n\x0b\f\r"
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, spaces, "") != "")
    parts = docs.select(
        "doc_id",
        words_col(F.col("text")).alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    measured = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        let(F.col("words"), repeat_words).cast("long").alias("n_repeat_words"),
    )
    bits = F.lit(0)
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), 1 << k).otherwise(0))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no enforced rule failed."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(mask(policy)) == 0)


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """``rule, n_failed, n_only``: documents a policy's rule fails, and those only it fails.

    One row a rule of the policy from one pass of bitwise sums over the ledger.
    """
    enforced = F.col("fail_bits").bitwiseAND(mask(policy))
    at = {name: k for k, (name, _) in enumerate(RULES)}
    sums = []
    for name in POLICIES[policy]:
        bit = 1 << at[name]
        sums.append(F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(enforced.bitwiseAND(bit) / bit).cast("long"), F.lit(0).cast("long")).alias("n_failed"),
            F.count_if(enforced == bit).alias("n_only"),
        ))
    return ledger.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, under policy v1; the ledger's bits besides."""
    ledger = apply_policy(quality_ledger(read_table(spark, sf_dir, "documents")), "v1")
    failed = F.col("fail_bits").bitwiseAND(mask("base")) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept", "fail_bits",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls
  FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + j) AS n FROM rep, range(0, 8) AS v(j) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (r)
), b AS (
  SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 15 * word_chars)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT)::INT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 fails, alone and with others, over all documents."""
    return ablations(quality_ledger(read_table(spark, sf_dir, "documents")), "v1")


ABLATIONS_SQL = f"WITH l AS ({ORACLE_SQL}) " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER (fail_bits & {1 << k} <> 0) AS n_failed, count(*) FILTER (fail_bits = {1 << k}) AS n_only FROM l" for k, (name, _) in enumerate(RULES)
)
