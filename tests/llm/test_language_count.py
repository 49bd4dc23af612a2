"""op6_language_id refuses more languages than it can hold, however few documents they have."""

from __future__ import annotations

import pytest

from fathom.llm import language

from .test_operators import SCHEMA, prose


def test_languages_are_counted(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([(k, prose(k, 20), f"l{k % 3}", "a", 1) for k in range(3)] + [(9, prose(9, 20), None, "a", 1)], SCHEMA)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.fit(df)
    assert set(language.fit(df.where("lang is null or lang <> 'l2'"))["langs"]) == {"l0", "l1"}
