"""The decoder against all paths, the language model against plain counts, scores against held-out and hidden toxic texts."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeflow.llm import op11_toxicity as T

from . import fixtures as fx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return T.fit_toxicity(*tables)


def plain_symbols(texts):
    """Symbols of texts by a walk over their characters: a word's end is two zeros."""
    out = [0, 0]
    for t in texts:
        for c in t.lower() + "\n":
            k = T._INDEX.get(c) or (T.OTHER if ord(c) > 255 or c.isalnum() else 0)
            if k:
                out.append(k)
            elif out[-1]:
                out += [0, 0]
    return out


def test_trigrams_equal_plain_counts(spark):
    texts = [r[1] for r in fx.corpus() if r[1]] + ["İx É 12", "a b", "😀 x"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(1)
    want = Counter()
    s = plain_symbols(texts)
    want.update(zip(s, s[1:], s[2:]))
    got = T.count_trigrams(docs).reshape((T.SYMBOLS,) * 3)
    assert int(got.sum()) == sum(want.values()) and all(got[k] == n for k, n in want.items())
    many = T.count_trigrams(docs.repartition(4)).reshape((T.SYMBOLS,) * 3)
    assert (many[1:, 1:, 1:] == got[1:, 1:, 1:]).all() and (many[0, 0, 1:] == got[0, 0, 1:]).all()
    p = np.exp(np.array(T.log_table(got.ravel())).reshape(got.shape))
    assert np.allclose(p.sum(2), 1, atol=1e-4)


def path_score(symbols, cost, logs):
    a = b = 0
    for c in [*symbols, 0]:
        cost += logs[(a * T.SYMBOLS + b) * T.SYMBOLS + c]
        a, b = b, c
    return cost


@pytest.mark.parametrize("text", ["1d10t", "a$$$b", "id.i-ot", "x*y", "m00000n", "3rd", "i d i", "a.b  c", "!!1|"])
def test_viterbi_is_the_best_of_all_paths(model, text):
    lattice = T.spaced_lattice(text) if re.search(r"^\S[ .]\S", text) else T.token_lattice(text)
    best = max(itertools.product(*lattice), key=lambda p: path_score([s for _, _, e in p for s in e], sum(c for _, c, _ in p), model.logs))
    score = path_score([s for _, _, e in best for s in e], sum(c for _, c, _ in best), model.logs)
    got = T.viterbi(lattice, model.logs)
    same = [p for p in itertools.product(*lattice) if "".join(t for t, _, _ in p) == got]
    assert math.isclose(max(path_score([s for _, _, e in p for s in e], sum(c for _, c, _ in p), model.logs) for p in same), score, abs_tol=1e-3)


@pytest.mark.parametrize("hidden", ["1d10t", "IDI0T", "idiooooot", "i d i o t", "i.d.i.o.t!", "I-D-I-O-T", "iiidiot", "(1d1ot)", "id|ot"])
def test_restores_one_word(model, hidden):
    assert T.Restorer(model.logs).words(f"the {hidden}, and") == ["the", "idiot", "and"]


def test_plain_words_stay(model):
    r = T.Restorer(model.logs)
    assert r.words("The trees well, Über 42 -- 日本") == ["the", "trees", "well", "über", "日本"]
    assert r.words("a an I") == ["a", "an", "i"] and r.words(None) == [] and r.words(" \n\t") == []
    long = "1a" * 20_000
    assert len("".join(r.words(long))) >= 20_000 and len(r.words("x " * 50_000)) >= 1


def test_held_out_and_hidden_texts(spark, tables, model):
    docs, labels = tables
    got = T.score_toxicity(docs, model).join(labels, "doc_id").withColumn("held", T.held_out_col(F.col("doc_id"))).toPandas()
    held = got[got.held]
    assert ((held.score >= T.THRESHOLD) == (held.toxic == 1)).mean() > 0.93
    clean = got[got.toxic == 0]
    assert (clean.score >= T.THRESHOLD).mean() < 0.02
    words = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]
    open_ = [r.text for r in got.itertuples() if r.toxic == 1 and len(re.findall("|".join(words), r.text.lower())) > 2]
    rng = random.Random(3)
    look = dict(zip("oieast", "013457"))

    def hide(m):
        w, k = m[0].lower(), rng.randrange(3)
        return "".join(look.get(c, c) for c in w) if k == 0 else rng.choice(" .-").join(w) if k == 1 else w[:2] + w[2] * 4 + w[3:]

    hidden = [re.sub("|".join(words), hide, t, flags=re.I) for t in open_]
    rows = spark.createDataFrame(list(enumerate(hidden)), "doc_id long, text string")
    caught = T.score_toxicity(rows, model).where(F.col("score") >= T.THRESHOLD).count()
    assert len(hidden) > 20 and caught >= 0.95 * len(hidden)
    back = T.restore_texts(rows, model.logs, ["doc_id"]).toPandas().restored
    assert sum(len(re.findall("|".join(words), t)) for t in back) > 0.7 * sum(len(re.findall("|".join(words), t.lower())) for t in open_)


def test_measures_equal_a_plain_walk(tables, model):
    evidence = T.Evidence(T.Restorer(model.logs), model.weights)
    for r in tables[0].limit(60).collect():
        words = T.Restorer(model.logs).words(r.text)
        best = []
        for w in words:
            found = [(model.weights[s], s) for s in T.signs(w) if s in model.weights]
            best += [max(found)[1]] if found else []
        n = Counter(best)
        want = [len(best), len(n), max(n.values(), default=0), max((model.weights[s] for s in n), default=0.0), sum(model.weights[s] * math.log1p(c) for s, c in n.items()), len(best) / max(1, len(words)), math.log1p(len(words))]
        assert np.allclose(evidence.measures(r.text), want)


def test_weights_by_hand():
    got = T.learned_weights([("bad$", 8, 0), ("the$", 10, 90), ("rare$", 2, 0)], 10, 90)
    assert set(got) == {"bad$"} and math.isclose(got["bad$"], math.log(8.5 / 11) - math.log(0.5 / 91))


def test_odd_tables(spark):
    docs = spark.createDataFrame(fx.corpus(), fx.SCHEMA).repartition(5)
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(40)] + [(3, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit_toxicity(docs, labels)
    got = T.score_toxicity(docs, model).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and set(got.columns) == set(docs.columns)
    for some in (labels.where("false"), labels.where("toxic = 1"), labels.withColumn("toxic", F.lit(0))):
        assert T.score_toxicity(docs, T.fit_toxicity(docs, some)).select("score").distinct().count() == 1
    empty = spark.createDataFrame([], fx.SCHEMA)
    assert T.score_toxicity(empty, model).count() == 0
    assert T.score_toxicity(empty, T.fit_toxicity(empty, labels)).count() == 0
    null_ids = spark.createDataFrame([(None, "you idiot", 1), (None, None, 2), (5, "", 3), (5, "", 3)], "doc_id long, text string, __text long")
    assert T.score_toxicity(null_ids, model, ["doc_id"]).count() == 4


def test_query(spark):
    got = T.op11_deobfuscated_toxicity(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == 200 and all((r.score >= 0.5) == (r.predicted == 1) for r in rows)
