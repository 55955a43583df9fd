"""Likeness recomputed from the returned fingerprints alone, and larger sketches where they fail."""

import random

import pytest
import xxhash

from quillspark.llm import paragraph_sketch as P

SIZE = P.CELLS // P.TABLES


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_hash(value, *more):
    """Spark's xxhash64 of a long, then of ints and strings, each hash seeding the next."""
    h = xxhash.xxh64_intdigest((value % (1 << 64)).to_bytes(8, "little"), 42)
    for m in more:
        h = xxhash.xxh64_intdigest(m.encode() if isinstance(m, str) else m.to_bytes(4, "little"), h)
    return h


def place(digest, table, size=SIZE):
    return signed(long_hash(digest, table, 0)) % size + table * size


def read(text):
    """Cells of a fingerprint: count, digests, check sums."""
    assert len(text) == 40 * P.CELLS
    return [[int(text[k : k + 8], 16), int(text[k + 8 : k + 24], 16), int(text[k + 24 : k + 40], 16)] for k in range(0, len(text), 40)]


def subtract_and_peel(a, b):
    """Differing digests of two fingerprints, or None where a plain peeler gets stuck."""
    cells = [[x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(a, b)]
    found = 0
    while True:
        pure = next((c for c in cells if abs(c[0]) == 1 and long_hash(c[1], "check") == c[2]), None)
        if pure is None:
            return None if any(map(any, cells)) else found
        n, x, s = pure
        found += 1
        for t in range(P.TABLES):
            c = cells[place(x, t)]
            c[0], c[1], c[2] = c[0] - n, c[1] ^ x, c[2] ^ s


def likeness(a, b):
    both = (sum(c[0] for c in a) + sum(c[0] for c in b)) // P.TABLES
    d = subtract_and_peel(a, b)
    return None if d is None else 1.0 if not both else (both - d) / (both + d)


def test_likeness_follows_from_the_fingerprints(spark):
    rng = random.Random(2)
    lines = [f"line {k}" for k in range(200)]
    texts = ["\n".join(rng.sample(lines, rng.choice([0, 1, 3, 6, 9, 14, 60]))) for _ in range(150)]
    rows = P.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    solved = larger = 0
    for k, r in enumerate(rows):
        own, edited, after = read(r.fingerprint), read(r.edited_fingerprint), read(rows[(k + 1) % len(rows)].fingerprint)
        for other, got in ((edited, r.near_edited), (after, r.near_next)):
            want = likeness(own, other)
            if want is None:  # too many differences for the fingerprints: larger sketches were peeled
                larger += 1
            else:
                solved += 1
                assert got == pytest.approx(want)
        a, b = set(texts[k].split("\n")) - {""}, set(texts[(k + 1) % len(rows)].split("\n")) - {""}
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert solved > 150 and larger > 20


def test_sketches_grow_until_they_peel(spark, monkeypatch):
    """Pairs that differ by more than the first larger sketches hold are retried, all by their own sizes."""
    levels = []
    real = P._cells

    def counted(pairs):
        levels.append({r.size for r in pairs.select("size").distinct().collect()})
        return real(pairs)

    monkeypatch.setattr(P, "_cells", counted)
    sizes = [(40, 40, 10), (300, 310, 5), (900, 10, 0), (2500, 2400, 100), (5, 5, 5)]
    data = [(k % 2, k, 1, list(range(a)), list(range(a - same, a - same + b))) for k, (a, b, same) in enumerate(sizes)]
    pairs = spark.createDataFrame(data, "bucket int, id long, pair int, a array<long>, b array<long>")
    found = {r.id: r.differing for r in P.differences(pairs).collect()}
    assert found == {k: a + b - 2 * same for k, (a, b, same) in enumerate(sizes) if (a, b) != (5, 5)}
    assert len(levels) >= 3 and all(s % (SIZE * P.GROWTH) == 0 for x in levels for s in x)
