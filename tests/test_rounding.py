"""Scores next to a half."""

from pyspark.sql import functions as F

from fathom.operators import expand, retrieval


def test_scores_are_rounded_as_scaled(spark):
    rows = spark.createDataFrame([(0.5115,), (0.0005,), (0.0015,), (-0.5, ), (1.005,), (0.2125,), (None,)], "x double")
    # round() of C on 1000 * x, over 1000
    assert [r[0] for r in rows.select(retrieval.rounded(F.col("x"))).collect()] == [0.511, 0.001, 0.002, -0.5, 1.005, 0.213, None]
    assert [r[0] for r in rows.select(retrieval.rounded(F.col("x"), 2)).collect()][:5:4] == [0.51, 1.0]


def test_people_are_ranked_by_scores_rounded_so(spark):
    ranked = spark.createDataFrame([(1, 7, 0.5115)], "input_id long, doc_id long, score double")
    roles = spark.createDataFrame([(7, "p", "author", 1.0, 2000)], "doc_id long, person string, role string, weight double, year int")
    assert expand.people_ranking(ranked, roles).first().score == 0.511
