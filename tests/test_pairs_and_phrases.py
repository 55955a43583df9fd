"""Boosts of pairs come from rows that are added up; no text meets a question."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval
from quillspark.plans import catalogue

TEXTS = ["He saw a part of the sea.", "part of theory", "party of the", "PART OF THE\nend", "apart of the", "part  of the", "part of", "of the part", "", None, "the part of the part of the"]


def test_phrases_are_found_as_contains_finds_them(spark):
    units = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "unit_id string, text string")
    asked = spark.createDataFrame([(1, "Is it part of the plan?"), (2, "part of"), (3, "see of the part, end")], "question_id long, question string")
    phrases = {1: ["is it part", "it part of", "part of the", "of the plan"], 2: [], 3: ["see of the", "of the part", "the part end"]}
    got = {(r.question_id, r.unit_id) for r in retrieval.phrase_hits(units, asked).collect()}
    assert got == {(q, str(i)) for q, ps in phrases.items() for i, t in enumerate(TEXTS) if t and any(p in t.lower() for p in ps)}


def test_pairs_carry_no_texts(spark, small):
    """No phrase is looked for in a text pair by pair."""
    plan = catalogue.QUERIES["structural_boost"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "lowered" not in plan


def test_a_title_counts_by_words_that_no_text_holds(spark):
    kind, path = F.lit("paragraph").alias("kind"), F.array(F.lit("Deep harbour")).alias("section_path")
    units = spark.createDataFrame([("a", "ships 7", "harbour_log"), ("b", "boats", "harbour_log"), ("c", None, "ships")], "unit_id string, text string, document_name string").select("*", kind, path)
    asked = spark.createDataFrame([(1, "how many ships harbour")], "question_id long, question string")
    rows = {r.unit_id: r.boost for r in retrieval.boosted(units, asked).collect()}
    assert set(rows) == {"a"}
    n = retrieval.question_features(asked).first().n_terms
    assert rows["a"] == pytest.approx(0.22 * min(1, 2 / n) + 0.10 + 0.12, abs=1e-6)
    sized = retrieval.asked_postings(units, retrieval.question_terms(asked).select("term")).where("term IS NULL")
    assert sized.count() == 3  # a null text counts as a unit, as in SQL
