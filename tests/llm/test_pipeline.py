"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

from . import brute
from .test_operators import LINE, SCHEMA, check_packing, prose


@pytest.fixture(scope="module")
def made(spark):
    """A folder of tables, and the output of each stage."""
    good = [(k, prose(k, 80 + k) + (f"\n{LINE}\nend" if k % 4 == 0 else ""), "en", f"s{k % 4}", 1) for k in range(60)]
    near = [(100 + k, prose(k, 80 + k) + " more", "en", "s9", 1) for k in range(20, 30)]
    junk = [(200 + k, " ".join(w.upper() + "!!###" for w in prose(k, 70).split()), "en", "s1", 1) for k in range(10)]
    rest = [(300, None, "en", "s1", 0), (301, "", None, None, 0), (302, prose(999, 2500), "en", None, 1)]
    d = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(good + near + junk + rest, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long")).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in [*good[:40], *junk[:3]]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        out.append((name, before, docs))
    return d, {name: (a, b) for name, a, b in out}


def test_stages_keep_columns(made):
    for name, (before, after) in made[1].items():
        if name != "packing":
            assert after.dtypes == before.dtypes, name


def test_classifier_keeps_clean(made):
    before, after = made[1]["quality_classifier"]
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.doc_id for r in before.collect() if r.text and not 200 <= r.doc_id < 300}


def test_lines(made):
    before, after = made[1]["line_dedup"]
    want = brute.lines([(r.doc_id, r.text) for r in before.collect()])
    assert {(r.doc_id, brute.sha(r.text)) for r in after.collect()} == {(w[0], w[3]) for w in want}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicates_go(made):
    before, after = made[1]["minhash"]
    want = {w[0] for w in brute.near([(r.doc_id, r.text) for r in before.collect()]) if w[3]}
    assert {r.doc_id for r in after.collect()} == want and not any(120 <= k < 130 for k in want)


def test_mix(made):
    before, after = made[1]["mixing"]
    size = {r.doc_id: len(brute.WORD.findall(r.text)) for r in before.collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 2 and set(times) <= set(size)
    total = sum(size[k] * n for k, n in times.items())
    assert abs(total - 1.5 * sum(size.values())) <= 5 * max(size.values())


def test_packed(spark, made):
    before, after = made[1]["packing"]
    found = after.collect()
    assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(r.doc_id for r in before.collect())
    check_packing(found, 2048)


def test_run(spark, made):
    d, stages = made
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, cp.run(spark, d).select(*key).collect())) == sorted(map(tuple, stages["packing"][1].select(*key).collect()))
