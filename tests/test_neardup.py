"""Near-duplicate units: the fixpoint against the rule unit by unit, candidates against all pairs."""

import random

import pytest

from quillspark.functions import text as T
from quillspark.operators import context, neardup

PAIR = "a_doc_id long, a_ordinal int, b_doc_id long, b_ordinal int, a_token_estimate int, b_token_estimate int"


def one_by_one(pairs, tokens):
    gone = set()
    for b in sorted({b for _, b in pairs}):
        first = next((a for a in sorted(a for a, x in pairs if x == b) if a not in gone), None)
        if first is not None:
            gone.add(b if tokens[b] <= tokens[first] else first)
    return gone


@pytest.mark.parametrize("seed, density, tokens", [(1, 1.0, 9), (2, 0.1, 3), (3, 0.3, 1), (4, 0.02, 50)])
def test_settling_follows_the_rule(spark, seed, density, tokens):
    rng = random.Random(seed)
    units = [(k // 3, k % 3) for k in range(60)]
    size = {u: rng.randint(1, tokens) for u in units}
    pairs = [(a, b) for a in units for b in units if a < b and rng.random() < density]
    rows = [(*a, *b, size[a], size[b]) for a, b in pairs]
    gone, rounds = neardup.settle(spark.createDataFrame(rows, PAIR))
    assert set(map(tuple, gone.collect())) == one_by_one(pairs, size)
    assert rounds <= 12  # records, not units: a clique of 60 takes a handful


def test_a_chain_takes_as_many_rounds_as_it_is_long(spark):
    rows = [(k, 0, k + 1, 0, 5, 5) for k in range(6)]
    gone, rounds = neardup.settle(spark.createDataFrame(rows, PAIR))
    assert {r.doc_id for r in gone.collect()} == {1, 3, 5} and rounds <= 6


def test_nothing_alike(spark):
    gone, rounds = neardup.settle(spark.createDataFrame([], PAIR))
    assert gone.count() == 0 and rounds == 0


def test_pairs_match_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bcdfg") for _ in range(5)) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4, 30, 80, 200]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = ["", "one", None]
    for words in base:
        for edits in (0, 0, 1, 2, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + (" 42" if edits == 2 else ""))
        texts.append(" ".join(passage + words[:5]))
    units = spark.createDataFrame([(k // 4, k % 4, t or "") for k, t in enumerate(texts)], "doc_id long, ordinal int, text string")
    units = units.withColumn("token_estimate", T.token_count(units.text))
    prints = neardup.fingerprints(units).collect()
    want = set()
    for x in prints:
        for y in prints:
            a, b = (x.doc_id, x.ordinal), (y.doc_id, y.ordinal)
            if a < b and x.n and y.n and (x.bucket, x.figures) == (y.bucket, y.figures):
                both = len(set(x.grams) & set(y.grams))
                if both >= 0.92 * (x.n + y.n - both):
                    want.add((a, b))
    got = [((r.a_doc_id, r.a_ordinal), (r.b_doc_id, r.b_ordinal)) for r in context.near_pairs(units).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10
