"""Toxicity by noisy-channel deobfuscation: Viterbi decoding of character lattices, then a score of the restored text.

1. *Character language model*: trigrams of the lower-cased letters of all texts (59 symbols: Latin letters, a word's end,
   anything else that stands in words), counted in tasks and added up by Spark; each order is smoothed by the one below it.
2. *Lattice*: an odd token (one that mixes letters with digits, symbols or marks, or repeats a letter three times) or a run of single characters
   with gaps (``i d i o t``, ``i.d.i.o.t``) becomes a list of places, each with the strings it may stand for and their cost in the
   channel: a digit or symbol for a letter it looks like (``LOOKS``), a repeated letter for one or two, ``*`` for a vowel, a mark or
   gap for nothing or a word's end.  The Viterbi path under the language model is the restored text.  Plain words stay as they are.
3. *Score*: words and their first letters (``PREFIXES``) that toxic documents hold more often than others are the evidence,
   learned from at most ``SAMPLE`` labelled documents, those of the smallest hash of doc_id.  What a document holds of
   it goes through the additive model of ``op1_gam``.  That model is fit on evidence of words learned from the other half of
   the sample, so it does not trust words that one document alone made evidence.

The language model needs no labels and reads all texts.  Broadcast are its table (0.8 MB) and at most ``EVIDENCE`` words.

Cases: a null or empty text, or one without words, has no evidence and is scored like any other; repeated rows and null ids are
scored each; a null doc_id is never held out nor trained on; doubled label rows count once each; no labels, or labels of one class, give
a constant score; an empty table gives an empty result; texts and tokens of any length are decoded whole, in time linear in their
length; other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, read_table, written
from .op1_gam import Gam, held_out_col
from .tokens import released, slices

SAMPLE = 10_000
EVIDENCE = 5_000
THRESHOLD = 0.5
PREFIXES = range(4, 9)
#: Documents of a class that hold a word before it is evidence, and the least logarithm of the odds.
SUPPORT, LEAST = 3, 1.5
#: Tokens that a worker remembers, each of at most ``TOKEN`` letters.
REMEMBERED, TOKEN = 150_000, 48
#: Letters that a digit or symbol looks like.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "¡": "i", "(": "c", "*": "aeiou"}
#: Logarithms of the channel's probabilities.
LOOK, KEPT, ENDED, ONCE, TWICE, FROM_TWO = -0.5, -2.5, -0.7, -0.5, -1.0, -8.0
#: A mark that is nothing, and one that might be a letter but is nothing; a gap between single characters that is nothing, or a word's end.
DROPPED, LETTER_DROPPED, GAP, GAP_ENDED = -4.5, -7.0, -0.1, -3.5
_LETTERS = [*"abcdefghijklmnopqrstuvwxyz", *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
_INDEX = {c: k for k, c in enumerate(_LETTERS, 1)}
OTHER, SYMBOLS = len(_LETTERS) + 1, len(_LETTERS) + 2
_OF_CODE = np.array([_INDEX.get(chr(c), OTHER if chr(c).isalnum() else 0) for c in range(256)] + [OTHER], np.int64)
_ENDS = ".,;:?\"'()[]{}<>#%&=~^`*_-/\\"
_PLAIN = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1")
_ONE = r"[^\s.,;:_\-~'\"/\\]"
_SPACED = re.compile(rf"(?<!\S){_ONE}(?:[ \t._\-~'/\\]+{_ONE}){{2,}}(?=[.,;:?!]*(?!\S))")
_PARTS = re.compile(r"([ \t._\-~'/\\]*)(.)", re.S)
MEASURES = ["hits", "distinct", "most", "best", "worth", "share", "log_words"]


def trigram_codes(texts: Iterable[str]) -> np.ndarray:
    """Counts of the symbols' trigrams in texts; a word's end is two symbols, so the first letter of a word sees nothing before it."""
    joined = "\n".join(texts).lower()
    at = _OF_CODE[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 256)]
    at = np.concatenate([[0], at, [0]])
    end = at == 0
    at = at[~(end & np.concatenate([[False], end[:-1]]))]
    at = np.repeat(at, 1 + (at == 0))
    return np.bincount((at[:-2] * SYMBOLS + at[1:-1]) * SYMBOLS + at[2:], minlength=SYMBOLS**3)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts; a task sends one row a trigram that it saw, and a table of ``SYMBOLS ** 3`` sums comes back at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in slices(released(batches)):
            total += trigram_codes(t for t in b.column("text").to_pylist() if t)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "c"])

    got = docs.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[got["k"].to_numpy()] = got["c"].to_numpy()
    return out


def log_table(counts: np.ndarray, weight: float = 5.0) -> array:
    """Logarithms of a symbol's probability after two others, each order smoothed by ``weight`` counts of the lower one."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2 = c3.sum(0)
    c1 = c2.sum(0)
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
    p3 = (c3 + weight * p2) / (c3.sum(2, keepdims=True) + weight)
    return array("f", np.log(p3).astype(np.float32).ravel())


def _emitted(text: str, cost: float) -> tuple[str, float, tuple[int, ...]]:
    out: list[int] = []
    for c in text:
        out += [0, 0] if c == " " else [_INDEX.get(c, OTHER)]
    return text, cost, tuple(out)


def _options(c: str, k: int) -> list[tuple[str, float, tuple[int, ...]]]:
    """What ``k`` equal characters may stand for inside a token."""
    many = [(1, 0.0)] if k == 1 else [(2, 0.0), (1, FROM_TWO)] if k == 2 else [(1, ONCE), (2, TWICE)]
    if c.isalpha():
        return [_emitted(c * n, cost) for n, cost in many]
    out = [_emitted(x * n, LOOK + cost) for x in LOOKS.get(c, "") for n, cost in many]
    if c.isdigit():
        return [*out, _emitted(c * k, KEPT * k)]
    return [*out, _emitted("", LETTER_DROPPED if out else DROPPED), _emitted(" ", ENDED)]


def token_lattice(token: str) -> list:
    return [_options(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]


def spaced_lattice(run: str) -> list:
    """Places of single characters with gaps between them; a gap wider than the narrowest, or of white space among marks, is a word's end."""
    parts = [(len(g) + len(run) * (" " in g or "\t" in g), c) for g, c in _PARTS.findall(run)]
    narrow = min((g for g, _ in parts[1:]), default=0)
    out, last, k = [], "", 0
    for n, (gap, c) in enumerate(parts):
        wide = n > 0 and gap > narrow
        if c == last and not wide:
            k += 1
            continue
        if last:
            out.append(_options(last, k))
        if n:
            out.append([_emitted(" ", 0.0)] if wide else [_emitted("", GAP), _emitted(" ", GAP_ENDED)])
        last, k = c, 1
    return [*out, _options(last, k)]


def viterbi(lattice: list, logs: array) -> str:
    """The path whose strings, under the language model and the channel, are the likeliest: exact, as a state is the last two symbols."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    square = SYMBOLS * SYMBOLS
    for options in lattice:
        after: dict[int, tuple[float, tuple | None]] = {}
        for at, (score, path) in states.items():
            for text, cost, symbols in options:
                s, x = score + cost, at
                for c in symbols:
                    x = x * SYMBOLS + c
                    s += logs[x]
                    x %= square
                held = after.get(x)
                if held is None or s > held[0]:
                    after[x] = (s, (path, text))
        states = after
    path = max(((s + logs[x * SYMBOLS], p) for x, (s, p) in states.items()), key=lambda v: v[0])[1]
    out = []
    while path is not None:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


class Restorer:
    """Words of restored texts; what tokens stand for is remembered."""

    def __init__(self, logs: array) -> None:
        self.logs = logs
        self.known: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        """Words that one lower-cased token stands for."""
        bare = token.strip(_ENDS).rstrip("!" + _ENDS)
        if _PLAIN.fullmatch(bare) and not _THRICE.search(bare):
            return (bare,)
        if not any(c.isalpha() for c in bare):
            return ()
        return tuple(viterbi(token_lattice(bare), self.logs).split())

    def tokens(self, text: str | None) -> list[str]:
        """Lower-cased tokens, after runs of single characters are restored."""
        return _SPACED.sub(lambda m: f" {viterbi(spaced_lattice(m[0]), self.logs)} ", (text or "").lower()).split()

    def words(self, text: str | None) -> list[str]:
        out: list[str] = []
        for t in self.tokens(text):
            got = self.known.get(t)
            if got is None:
                got = self.token(t)
                if len(t) <= TOKEN:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[t] = got
            out += got
        return out


def signs(word: str) -> list[str]:
    """What may be evidence of a word: itself and its first letters."""
    return [word + "$", *(word[:k] for k in PREFIXES if k <= len(word))]


class Evidence:
    """A document's measures, from words that toxic documents hold more often."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]) -> None:
        self.restorer, self.weights = restorer, weights
        self.known: dict[str, tuple[int, tuple[str, ...]]] = {}

    def token(self, token: str) -> tuple[int, tuple[str, ...]]:
        words = self.restorer.token(token)
        best = (max((s for s in signs(w) if s in self.weights), key=lambda s: (self.weights[s], s), default="") for w in words)
        return len(words), tuple(s for s in best if s)

    def measures(self, text: str | None) -> list[float]:
        tokens = self.restorer.tokens(text)
        known = self.known
        n, seen = 0, Counter()
        for t in tokens:
            got = known.get(t)
            if got is None:
                got = self.token(t)
                if len(t) <= TOKEN:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[t] = got
            n += got[0]
            if got[1]:
                seen.update(got[1])
        hits = sum(seen.values())
        worth = sum(self.weights[s] * math.log1p(c) for s, c in seen.items())
        return [hits, len(seen), max(seen.values(), default=0), max((self.weights[s] for s in seen), default=0.0), worth, hits / max(1, n), math.log1p(n)]


def learned_weights(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The signs of the highest likelihood ratio: ``(sign, toxic documents, other documents)`` to log odds."""

    def gain(a: int, b: int) -> float:
        part = lambda x, n, share: x * math.log(x / (n * share)) if x else 0.0
        p = (a + b) / (toxic + clean)
        return part(a, toxic, p) + part(toxic - a, toxic, 1 - p) + part(b, clean, p) + part(clean - b, clean, 1 - p)

    odds = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    rows = [(gain(a, b), s, odds(a, b)) for s, a, b in counts if a >= SUPPORT]
    return {s: w for _, s, w in sorted(((g, s, w) for g, s, w in rows if w >= LEAST), reverse=True)[:EVIDENCE]}


class Toxicity:
    """The language model's table, the evidence and the additive model of a document's measures."""

    def __init__(self, logs: array, weights: dict[str, float], gam: Gam) -> None:
        self.logs, self.weights, self.gam = logs, weights, gam


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """The model of ``labels.toxic`` from documents that are not held out; the language model is of all ``docs``."""
    context = docs.sparkSession.sparkContext
    logs = log_table(count_trigrams(docs))
    shared = context.broadcast(logs)
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out_col(F.col("doc_id")))
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", (F.col("h") % 2 != 0).alias("odd"), "text")  # at most ``sample`` small rows
    rows = written(rows.repartition(16), "op11-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(shared.value), Counter()
        for b in slices(released(batches)):
            for y, odd, text in zip(b.column("toxic").to_pylist(), b.column("odd").to_pylist(), b.column("text").to_pylist()):
                found = {s for w in set(restorer.words(text)) for s in signs(w)} | {""}
                seen.update((s, y, odd) for s in found)
        cols = list(zip(*((*k, n) for k, n in seen.items()))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.bool_(), pa.int64()))], ["sign", "toxic", "odd", "n"])

    part = lambda y, odd: F.sum(F.when(((F.col("toxic") == 1) == F.lit(y)) & (F.col("odd") == F.lit(odd)), F.col("n")).otherwise(0))
    counted = rows.mapInArrow(count, "sign string, toxic int, odd boolean, n long").groupBy("sign")
    counted = counted.agg(part(True, True).alias("a1"), part(False, True).alias("b1"), part(True, False).alias("a0"), part(False, False).alias("b0"))
    got = [tuple(r) for r in counted.where(f"a1 + a0 >= {SUPPORT} or sign = ''").collect()]  # words of toxic documents of the sample
    whole = next((r[1:] for r in got if not r[0]), (0, 0, 0, 0))
    got = [r for r in got if r[0]]
    halves = {
        True: learned_weights([(s, a, b) for s, _, _, a, b in got], whole[2], whole[3]),  # for odd rows, from the others
        False: learned_weights([(s, a, b) for s, a, b, _, _ in got], whole[0], whole[1]),
    }
    weights = learned_weights([(s, a1 + a0, b1 + b0) for s, a1, b1, a0, b0 in got], whole[0] + whole[2], whole[1] + whole[3])
    crossed = context.broadcast(halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        by_half = {odd: Evidence(restorer, w) for odd, w in crossed.value.items()}
        for b in slices(released(batches)):
            x = [by_half[odd].measures(t) for odd, t in zip(b.column("odd").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    fit = rows.mapInArrow(measure, "toxic int, x array<double>").toArrow()
    discard(rows)
    y = (fit["toxic"].to_numpy() == 1).astype(float)
    x = np.array(fit["x"].to_pylist(), np.float64).reshape(-1, len(MEASURES))
    order = np.lexsort([*x.T[::-1], y])
    return Toxicity(logs, weights, Gam(x[order], y[order]))


def score_toxicity(docs: DataFrame, model: Toxicity, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all of them by default) and ``score``, the model's chance of a toxic text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in keep or docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        evidence = Evidence(Restorer(m.logs), m.weights)
        for b in slices(released(batches)):
            x = np.array([evidence.measures(t) for t in b.column("__text").to_pylist()]).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(m.gam.score(x), pa.float64())], [*rest, "score"])

    src = docs.select(*rest, F.col("text").alias("__text"))
    fields = "".join(f"`{c}` {t}, " for c, t in src.dtypes if c != "__text")
    return src.mapInArrow(run, f"{fields}score double")


def restore_texts(docs: DataFrame, logs: array, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``restored``: the words of each text as the decoder reads them."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for b in slices(released(batches)):
            out = [" ".join(restorer.words(t)) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "restored"])

    src = docs.select(*keep, F.col("text").alias("__text"))
    fields = "".join(f"`{c}` {t}, " for c, t in src.dtypes if c != "__text")
    return src.mapInArrow(run, f"{fields}restored string")


def op11_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, ["doc_id"]).select(
        "doc_id",
        held_out_col(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
