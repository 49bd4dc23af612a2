"""Decisions that are told of."""

import tempfile

from fathom.operators import expand
from fathom.plans import queries


def test_accepted_documents_with_a_rationale_are_told_of(spark):
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    rows = [(k, f"Some words of {k}.", ("en", "de")[k % 2], f"s{k % 4}") for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["f7_reported_decisions"](spark, folder).collect()}
    assert got == {(k, "Rejected" if k % 3 else "Final", f"Because {source} would be too costly for {lang}.") for k, _, lang, source in rows if k % 3 < 2}


def test_reported_decisions_by_outcome_and_rationale(spark):
    rows = [(1, "Final", "accepted", None), (2, "Final", "accepted", "y" * 501), (3, "Rejected", "failed", None), (4, "Rejected", "failed", "n"), (5, "Active", "open", "a"), (6, "Active", "open", None)]
    decided = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, status string, outcome string, rationale string, resolution string")
    assert {r.doc_id: r.rationale for r in expand.reported_decisions(decided).collect()} == {2: "y" * 500, 3: None, 4: "n", 5: "a"}
