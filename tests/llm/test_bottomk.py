"""Bottom-k near-dedup against all pairs: families around the bound, hot lists, copies, repeats."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from near import near_texts
from quillspark.llm import bottomk, common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, num=80):
    sets = [shingles(t) for _, t in rows]
    group = {k: k for k, _ in rows if k is not None}
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            if i < j and a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    return sorted(((k, len(s), group.get(k), k is None or group[k] == k) for (k, _), s in zip(rows, sets)), key=str)


def passages():
    """Texts with one long passage in common, some of them near copies of others."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    out = []
    for k in range(60):
        own = [word() for _ in range(rng.choice([5, 15, 25, 80]))]
        out.append(" ".join(own) + "\n" + passage)
        if k % 5 == 0:
            own[len(own) // 2] = word()
            out.append(passage + " " + " ".join(own))
    return out


@pytest.mark.parametrize("cell, most", [(4, 1), (8192, 1_000_000)])
def test_groups_match_all_pairs(spark, monkeypatch, cell, most):
    monkeypatch.setattr(bottomk, "CELL", cell)
    monkeypatch.setattr(bottomk, "TEXTS", 8 if cell == 4 else 256)
    monkeypatch.setattr(common, "MOST_ROWS", most)
    monkeypatch.setattr(common, "LEAST_HOT", 20 if cell == 4 else 1000)
    texts = [*near_texts().values(), *passages(), *["a copy of one text in many"] * 40, "x" * 50_000, "long one " * 20_000]
    rows = [(zlib.crc32(b"%d" % k), t) for k, t in enumerate(texts)]
    rows += [(None, texts[20]), (None, None), (rows[5][0], texts[30]), (rows[40][0], texts[60]), rows[50], (rows[0][0], texts[90])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumns({c: F.lit("clash") for c in ("key", "node", "n", "sketch", "value", "group")})
    got = sorted(map(tuple, bottomk.near_groups(docs).collect()), key=str)
    assert got == brute(rows)


def test_sketch_overlap_bounds():
    """Pairs of random sets at the bound share at least what their sketches' lists rest on, and pass the estimate."""
    rng = np.random.default_rng(7)
    for n in [1, 2, 5, 20, 51, 52, 57, 63, 64, 65, 70, 79, 80, 100, 500]:
        for _ in range(60):
            shared = int(rng.integers(0, n + 1))
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 2**64, int(rng.integers(0, n + 1 - shared)), dtype=np.uint64)])
            union = len(a) + len(b) - shared
            if not len(b) or 100 * shared < 80 * union:
                continue
            x, y = np.sort(a)[: bottomk.K], np.sort(b)[: bottomk.K]
            both = len(np.intersect1d(x, y))
            assert both >= max(bottomk.needed(len(x), 0.8), bottomk.needed(len(y), 0.8))
            pad = lambda s: np.concatenate([s.astype(np.float32), np.full(bottomk.K - len(s), np.inf, np.float32)])[None]
            assert bottomk.alike(pad(x), pad(y), 0.8).all()


def test_empty_table(spark):
    assert bottomk.near_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (4, None)]
    got = bottomk.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(k, 0, k, True) for k in (1, 2, 3, 4)]
