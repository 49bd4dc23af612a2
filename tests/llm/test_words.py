"""The n-gram model of op4_perplexity against a plain one."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from fathom.llm import perplexity
from fathom.llm.perplexity import CLOSE, FOLDS, KINDS, ORDER, START, classify, discounts, fold_of, scored, train

from .test_operators import SCHEMA, labelled, prose


def symbols(text: str) -> list[int]:
    high = lambda c: 2048 + ((c * 0x9E3779B1 % 2**32) >> 21)
    return [START] * ORDER + [ord(c) + 2 if ord(c) < 2046 else high(ord(c)) for c in text] + [CLOSE]


def plain(texts):
    """P(next symbol | the four before it) under interpolated modified Kneser-Ney."""
    counts = {ORDER: Counter(tuple(s[i - ORDER + 1 : i + 1]) for t in texts if t for s in [symbols(t)] for i in range(ORDER, len(s)))}
    for m in range(ORDER - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    cut = {m: discounts(*(sum(n == k for n in c.values()) for k in (1, 2, 3, 4))) for m, c in counts.items()}
    d = lambda m, n: cut[m][min(n, 3) - 1]
    total, rest = defaultdict(Counter), defaultdict(lambda: defaultdict(float))
    for m, c in counts.items():
        for g, n in c.items():
            total[m][g[:-1]] += n
            rest[m][g[:-1]] += d(m, n)

    def p(gram):
        m = len(gram)
        below = p(gram[1:]) if m > 1 else 1 / KINDS
        if gram[:-1] not in total[m]:
            return below
        n = counts[m].get(gram, 0)
        return (n - d(m, n) if n else 0) / total[m][gram[:-1]] + rest[m][gram[:-1]] / total[m][gram[:-1]] * below

    return p


def test_documents_equal_the_plain_model(spark, monkeypatch):
    """Scores in one chunk and in many; values grow with the text; every context's probabilities sum to one."""
    table = [(k, prose(k % 20, 60)) for k in range(40)] + [(100, " \n two  blanks\t"), (101, "unheard OF words"), (102, " "), (103, "é漢字😀"), (104, "漢"), (105, None), (106, "")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    fold = {r.doc_id: r.fold for r in df.select("doc_id", fold_of().alias("fold")).collect()}
    trusted = df.where("doc_id < 30 or doc_id = 103").select(fold_of().alias("fold"), "text")
    key = {r.doc_id: r.row for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).collect()}
    models = [plain([t for k, t in table if (k < 30 or k == 103) and fold[k] == m]) for m in range(FOLDS)]
    for p in models:
        for context in ((START,) * 4, tuple(symbols("alph")[-5:-1]), tuple(symbols("zzzz")[-5:-1]), tuple(symbols("xqal")[-5:-1])):
            assert abs(sum(p((*context, c)) for c in range(KINDS)) - 1) < 1e-9
    for chunk in (perplexity._CHUNK, 1000):
        monkeypatch.setattr(perplexity, "_CHUNK", chunk)
        model = train(trusted)
        rows = {r.row: r.nll for r in scored(df.union(df.where("doc_id = 1")), model, per_shard=500).collect()}
        assert len(rows) == len(table) - 2
        for k, t in table:
            if t:
                s = symbols(t)
                want = -sum(math.log(models[1 - fold[k]](tuple(s[i - 4 : i + 1]))) for i in range(ORDER, len(s)))
                assert abs(rows[key[k]] - want) < 1e-3 * max(1, want / 100), (k, t)
    assert model[0].count() > 1.5 * train(trusted.where(F.length("text") > 0).limit(10))[0].count()
    assert train(trusted.where("false")) is None


def test_pieces_and_long_texts():
    from fathom.llm.perplexity import grams

    texts = ["ab", "", "x" * 5000, "é"]
    every = [perplexity.symbols(np.frombuffer(t.encode(), dtype=np.uint8)) for t in texts]
    assert [x.tolist() for x in every] == [symbols(t) for t in texts]
    keys = grams(every)
    assert len(keys) == sum(len(t) + 2 for t in texts) and np.flatnonzero(keys == 0).tolist() == [0, 4, 6, 5008]
    assert keys[0] == 0 and keys[2] == (ord("a") + 2) << 12 | ord("b") + 2 and keys[3] == (ord("a") + 2) << 24 | (ord("b") + 2) << 12 | CLOSE


def test_short_texts_have_their_own_limits(spark):
    """Short junk goes as long junk does; short good texts stay."""
    junk = lambda k, n: " ".join(w[::-1].upper() + "q" for w in prose(k, n).split())
    good = [(k, prose(k, 150 if k % 2 else 4), "en", "a", 1) for k in range(160)]
    bad = [(1000 + k, junk(k, 4 if k % 2 else 60), "en", "a", 1) for k in range(20)]
    kept = {r.doc_id: r.kept for r in classify(spark.createDataFrame(good + bad, SCHEMA), labelled(spark, good[:120], lambda r: 1)).collect()}
    assert not any(kept[r[0]] for r in bad)
    assert all(kept[r[0]] for r in good[:120]) and sum(kept[r[0]] for r in good[120:]) >= 38
