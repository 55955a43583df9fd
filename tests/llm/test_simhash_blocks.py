"""Cells keyed by combinations of blocks, and components of large tables, lose no link."""

import random

import pytest

from quillspark.llm import simhash


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_any_number_of_blocks_gives_the_same_components(spark, blocks):
    rng = random.Random(9)
    fps = {}
    for k in range(300):
        fp = rng.getrandbits(64) if k % 3 else random.Random(k // 30).getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            fp ^= 1 << rng.randrange(64)
        fps.setdefault(fp, k)
    expected = {k: k for k in fps.values()}
    for a, i in fps.items():
        for b, j in fps.items():
            if i < j and (a ^ b).bit_count() <= 4 and expected[i] != expected[j]:
                old, new = max(expected[i], expected[j]), min(expected[i], expected[j])
                expected = {k: new if g == old else g for k, g in expected.items()}
    assert len(set(expected.values())) < len(expected) - 20
    nodes = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp, k) for fp, k in fps.items()], "fp long, node long")
    found = {r.node: r.component for r in simhash.components(simhash.link_forest(nodes, 4, blocks=blocks)).collect()}
    assert {k: found.get(k, k) for k in expected} == expected


def test_blocks_grow_with_the_corpus():
    assert simhash.block_count(10**5, 4) == 5 and simhash.block_count(10**8, 4) == 6
    for n in (10**9, 10**11):
        blocks = simhash.block_count(n, 4)
        assert n >> (64 * (blocks - 4) // blocks) <= simhash.SHARE


def test_large_stars_are_spread(spark, monkeypatch):
    """The plan for many links: centres of large stars are broadcast."""
    from quillspark.llm import common

    monkeypatch.setattr(simhash, "MOST_ROWS", 10)
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    monkeypatch.setattr(common, "BIG", 10)
    links = [(7, k) for k in range(100, 300)] + [(k, k + 1) for k in range(290, 340)] + [(3, 150), (500, 501)]
    found = {r.node: r.component for r in simhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {k: 3 for k in [7, *range(100, 341)]} | {501: 500}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "A  b c d e"), (3, "other")], "doc_id long, text string").selectExpr("*", "1 AS __gone", "2 AS gone", "3 AS fp")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
