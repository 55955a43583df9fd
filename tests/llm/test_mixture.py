"""The mixture's expected shares under probabilities of at most one."""

import collections

import pytest

from quillspark.llm import mixing

TARGETS = {"source": {"a": 0.4, "b": 0.3}, "lang": {"en": 0.4, "de": 0.6}, "topic": {"prose": 0.5, "rare": 0.5}}


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_probabilities_meet_marginals(spark, driver_cells):
    """Cells saturate at 0.6 of all tokens; `rare` holds too little for its target and is taken whole."""
    data = []
    for s, many in (("a", 3), ("b", 2), ("c", 2)):
        for lang, times in (("en", 5), ("de", 4)):
            for topic, n in (("prose", 9), ("rare", 1)):
                data += [(len(data) + k, "x" * 399, lang, s, topic) for k in range(many * times * n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, topic string")
    rows = mixing.mix(docs, TARGETS, 0.6, driver_cells=driver_cells).collect()
    total = sum(r.n_tokens for r in rows)
    expected = {d: collections.Counter() for d in mixing.DIMENSIONS}
    for r in rows:
        assert 0 <= r.probability <= 1
        for d in mixing.DIMENSIONS:
            expected[d][r[d]] += r.n_tokens * r.probability / (0.6 * total)
    assert expected["source"] == pytest.approx({"a": 0.4, "b": 0.3, "c": 0.3}, abs=1e-4)
    assert expected["lang"] == pytest.approx({"en": 0.4, "de": 0.6}, abs=1e-4)
    assert expected["topic"] == pytest.approx({"rare": 1 / 6, "prose": 5 / 6}, abs=1e-4)
    assert max(r.probability for r in rows) == 1.0


def test_topic_reads_whole_texts(spark):
    texts = ["word " * 200 + tail for tail in ("Copyright 2020", "under the MIT Licence", "nothing")]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = rows.orderBy("k").select(mixing.topic_of(rows.text).alias("topic")).collect()
    assert [r.topic for r in found] == ["notices", "notices", "prose"]
