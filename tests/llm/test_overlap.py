"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from quillspark.llm import overlap


def brute_groups(texts, least=0.8):
    sets = {}
    for k, text in texts.items():
        words = (text or "").lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    group = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def near_texts():
    """Families of texts whose members differ in words here and there, around a similarity of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [None, "", " \n", "one", "ONE", "two words", "a b c d e", "a b c d e f"]
    for k in range(12):
        base = [word() for _ in range(rng.randint(30, 300))]
        for edits in range(6):
            words = list(base)
            for _ in range(edits * len(base) // 100 + (edits > 0)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    return dict(enumerate(texts))


def test_near_copies_at_jaccard_match_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    expected = brute_groups(texts)
    assert {r.doc_id: r.component_id for r in overlap.near_groups(docs).collect()} == expected
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(expected.values()) and kept.columns == docs.columns
    assert len(set(expected.values())) < len(texts) - 15


def test_near_copies_odd_tables(spark):
    odd = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (4, "x y"), (6, "X  y"), (9, None), (8, "")], "doc_id long, text string")
    assert overlap.drop_near_copies(odd.limit(0)).count() == 0
    assert sorted((r.doc_id, r.component_id) for r in overlap.near_groups(odd).collect()) == [(4, 4)] * 3 + [(6, 4), (8, 8), (9, 8)]
    assert sorted((r.doc_id or 0) for r in overlap.drop_near_copies(odd).collect()) == [0, 4, 4, 4, 8]
