"""Texts are split into words once for near duplicates, and not again by whoever reads what exact dedup left."""

from quillspark.operators import context, neardup


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def units(spark, texts):
    return spark.createDataFrame([(i, 0, len(t), t) for i, t in enumerate(texts)], "doc_id long, ordinal int, token_estimate int, text string")


LONG = " ".join(f"word{i} stone{i % 7}" for i in range(60))


def test_no_condition_splits_texts_again(spark, monkeypatch):
    kept, keep = [], neardup.keep
    monkeypatch.setattr(neardup, "keep", lambda df: kept.append(plan(df)) or keep(df))
    rows = neardup.pairs(units(spark, [LONG, LONG + " more", "", "other words entirely here now"])).collect()
    assert [(r.a_doc_id, r.b_doc_id) for r in rows] == [(0, 1)]
    assert any("regexp_extract_all" in p for p in kept)
    assert not [line for p in kept for line in p.splitlines() if "Filter" in line and "regexp_extract_all" in line]


def test_few_common_grams_at_the_head_are_looked_through(spark):
    """A common passage of a few grams is no reason to look at all grams; a text of few words is judged by what it has."""
    texts = [" ".join(f"{name}{i}" for i in range(200)) + " alpha beta gamma delta epsilon zeta" for name in ("quartz", "basalt", "marble")]
    pairs = neardup.pairs(units(spark, [*texts, "granite walls hold", "granite walls hold", texts[0] + " omegas"])).collect()
    assert sorted((r.a_doc_id, r.b_doc_id) for r in pairs if r.jaccard >= 0.92) == [(0, 5), (3, 4)]


def test_what_exact_dedup_left_needs_no_keys_again(spark):
    left = context.drop_exact(units(spark, [LONG, LONG.upper(), "other words entirely"]))
    assert "sha2" not in plan(left)
    assert sorted(r.doc_id for r in left.collect()) == [0, 2]
