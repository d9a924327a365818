"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from . import fixtures as fx

SF = "/root/testdata/sf0.001"


def brute_score(text: str | None, model) -> float:
    """A text's score by a walk through the model's tables, one feature at a time."""
    import bisect
    import math

    from rangeflow.llm import op1_gam

    x = op1_gam.text_features([(text or "").encode()])[0].tolist()
    at = [bisect.bisect_right(edges.tolist(), v) for v, edges in zip(x, model.edges)]
    total = model.base + sum(table[k] for table, k in zip(model.tables, at)) + sum(table[at[i]][at[j]] for (i, j), table in zip(model.pairs, model.joint))
    return 1 / (1 + math.exp(-total))


def normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def holds(text: bytes, item: bytes, budget: int) -> bool:
    """Whether some part of a text is within the edit budget of an item: the plain dynamic programme, a row an item's byte."""
    import numpy as np

    t = np.frombuffer(text, np.uint8)
    row = np.zeros(len(t) + 1, np.int32)
    k = np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        best = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        now = np.concatenate([[i], best])
        row = np.minimum.accumulate(now - k) + k
    return int(row.min()) <= budget


def test_stages(spark):
    from rangeflow.llm import op5_qgrams

    docs = P.read_table(spark, SF, "documents")
    columns = docs.columns
    model = P.fit_quality(docs, P.read_table(spark, SF, "labels"))
    kept = P.written(P.quality(spark, docs, SF), "t")
    scores = {r.doc_id: brute_score(r.text, model) for r in docs.select("doc_id", "text").collect()}
    assert all(abs(r.score - scores[r.doc_id]) < 1e-6 for r in P.score_quality(docs, model).select("doc_id", "score").collect())
    assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in scores.items() if s >= P.THRESHOLD}
    assert 0.7 * docs.count() < kept.count() < docs.count()

    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    want = {d for d, (_, c) in fx.components(rows, 5, 80, 100).items() if c == d}
    alone = P.written(P.near_dups(spark, kept, SF), "t")
    assert alone.columns == columns and {r.doc_id for r in alone.select("doc_id").collect()} == want

    rows = [tuple(r) for r in alone.select("doc_id", "text").collect()]
    want = {d: v for d, v in fx.without_repeated_words(rows).items() if v[1] < v[0] or not v[0]}
    cut = P.written(P.repeats(spark, alone, SF), "t")
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and set(got) == set(want)
    assert all(len(fx.words(got[d].text)) == n - gone and got[d].n_chars == len(got[d].text) for d, (n, gone, _) in want.items())

    items = [normal(r.text) for r in P.read_table(spark, SF, "benchmark").collect()]
    clean = P.written(P.leaks(spark, cut, SF), "t")
    budgets = op5_qgrams.Items([0] * len(items), items).budget.tolist()
    held = set()
    for d, r in got.items():
        text = normal(r.text or "")
        for item, budget in zip(items, budgets):
            # a part of an occurrence within the budget is whole: one of budget + 1 pieces of the item
            size = len(item) // (budget + 1)
            if any(item[k * size : (k + 1) * size] in text for k in range(budget + 1)) and holds(text, item, budget):
                held.add(d)
                break
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == columns and held and left == set(got) - held

    check_packing(P.packing(spark, clean, SF).collect(), {r.doc_id: r.text for r in clean.select("doc_id", "text").collect()})


def check_packing(pieces: list, texts: dict) -> None:
    """Each id lies in one piece, sequences are gapless and full but for the last."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids, at = t.encode(text or "", add_special_tokens=False).ids + [2], 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == fx.crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    sizes = []
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert max(sizes) <= 4096 and sum(x < 4096 for x in sizes) <= 1


def test_near_dups_of_null_and_repeated_ids(spark):
    import random

    rng = random.Random(1)
    a, b, c = (fx.prose(rng, 60, 10**6) for _ in range(3))
    rows = [(1, a, "x"), (None, a + " end", "x"), (2, b, "x"), (2, b, "x"), (2, c, "x"), (None, c, "x"), (None, None, "x"), (None, None, "x"), (7, "", "x"), (7, "", "x"), (9, fx.prose(rng, 60, 10**6), "x")]
    got = [tuple(r) for r in P.near_dups(spark, spark.createDataFrame(rows, "doc_id long, text string, __leak string"), SF).collect()]
    texts = sorted(str(r[1])[:20] for r in got if r[1])
    assert (1, a, "x") in got and len([r for r in got if r[1] == b]) == 1 and len([r for r in got if r[1] == c]) == 1 and len(texts) == 4
    assert sum(not r[1] for r in got) == 4


def test_stages_on_empty_and_odd_tables(spark):
    docs = P.read_table(spark, SF, "documents")
    none = docs.where("false")
    for name, stage in P.STAGES[1:]:
        assert stage(spark, none, SF).count() == 0, name
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "some words here", 5), (3, "w " * 300, 5), (3, "w " * 300, 5), (4, "long " * 50_000, 5)], "doc_id long, text string, spans int")
    odd = odd.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns if c not in ("doc_id", "text")})
    for name, stage in P.STAGES:
        out = stage(spark, odd, SF)
        if name != "packing":
            assert out.columns == odd.columns and out.count() <= 6, name
        else:
            assert out.select("doc_id").distinct().count() == 5


def test_run_is_its_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dups", "repeats", "leaks", "packing"]
    assert P.run(spark, SF).count() > 0


def test_leaks_of_null_and_repeated_ids(spark):
    item = P.read_table(spark, SF, "benchmark").first().text
    rows = [(None, item), (None, "clean text"), (5, item), (5, "other clean text"), (6, None), (6, item), (7, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in P.leaks(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != item], key=str)
