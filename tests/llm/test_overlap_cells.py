"""Near copies when cells overflow, checks are few, and candidates meet across parts."""

import random

import numpy as np
import pytest

from quillspark.llm import overlap

from near import brute_groups, near_texts


@pytest.mark.parametrize(("cell", "tile"), [(3, 256), (40, 20), (8192, 8)])
def test_small_cells_and_tiles_lose_nothing(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(overlap, "CELL", cell)
    monkeypatch.setattr(overlap, "TEXTS", tile)
    monkeypatch.setattr(overlap, "TILE", 8)
    texts = near_texts()
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    for k in range(120):  # one large group of near copies
        words = list(base)
        for j in range(k % 9):  # many of which overlap by less than the bound
            words[rng.randrange(200)] = f"x{k}-{j}"
        texts[1000 + k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in overlap.near_groups(docs).collect()} == brute_groups(texts)


def test_layout_keeps_recall_and_cells():
    """Bands grow with the corpus; a pair at the bound misses all of them with the chance that is stated."""
    for n in (0, 10, 10**5, 10**7, 10**10):
        bits, bands, words = overlap.layout(n)
        assert (1 - (1 - overlap.APART) ** bits) ** bands <= overlap.MISSED and 64 * words >= bits * bands
        assert n / 2**bits <= overlap.SHARE


def test_bits_differ_as_often_as_stated():
    """Sets at 0.8 differ in a bit with a chance of at most APART; 256 bits differ in no more than RADIUS."""
    rng = np.random.default_rng(5)
    apart, first = [], []
    for _ in range(150):
        n = int(rng.integers(150, 600))
        shared = rng.integers(0, 1 << 63, int(n * 0.8 / 0.9), np.uint64)
        own = [rng.integers(0, 1 << 63, len(shared) // 8, np.uint64) for _ in range(2)]
        a, b = (overlap.wide_fingerprint(np.concatenate([shared, x]), 8) for x in own)
        assert overlap.jaccard(*(np.unique(np.concatenate([shared, x])) for x in own)) == pytest.approx(0.8, abs=0.02)
        apart.append(np.bitwise_count(a ^ b).sum() / 512)
        first.append(int(np.bitwise_count(a[:4] ^ b[:4]).sum()))
    assert np.mean(apart) < overlap.APART + 0.01 and max(first) <= overlap.RADIUS


def test_intersections_are_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30_000, rng.integers(0, 9000)).astype(np.uint64)) for _ in range(12)]
    assert (overlap._shared(sets) == [[len(np.intersect1d(a, b)) if len(a) else 0 for b in sets] for a in sets])[~np.eye(12, dtype=bool)].all()


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, "A  b", 2)], "doc_id long, text string, gone int").selectExpr("*", "1 AS component_id", "2 AS node")
    kept = overlap.drop_near_copies(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert overlap.near_groups(docs.limit(0)).count() == 0
