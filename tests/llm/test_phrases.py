"""Collocations against plain counting, with sketches so narrow that everything collides."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, most, covered):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for size in range(1, min(5, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, b in frequent.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= covered * f[q[i : i + k]]}
        scored = []
        for p, a in frequent.items():
            if p not in gone:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "é", "日本", "a", "b", "x\x1cy", " ", "city"] + [f"w{k}" for k in range(40)]
    weights = [30, 25, 8, 8, 5, 5, 4, 4, 3, 3, 3] + [1] * 40
    say = lambda n: rng.choice([" ", "  ", "\t"]).join(rng.choices(words, weights, k=n))
    texts = [None, "", " \t", ".,;", "one", "Alpha beta gamma delta epsilon zeta. " * 12, "a a a a a a a a a a", "no end " * 3000]
    texts += [say(rng.randint(1, 60)) + rng.choice(". , \n ! ? : ;".split(" ")) + say(20) + "\nin New York city\r" for _ in range(120)]
    texts += texts[10:14]
    return [(t, [None, "en", "en", "en", ""][k % 5]) for k, t in enumerate(texts)]


@pytest.mark.parametrize("least, most, covered, bits", [(10, 2000, 100, 4), (3, 25, 60, 16)])
def test_collocations_match_plain_counts(spark, rows, monkeypatch, least, most, covered, bits):
    monkeypatch.setattr(phrases, "CHUNK", 2000)
    monkeypatch.setattr(phrases, "HELD", 200 * least)
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    docs = docs.withColumns({c: F.lit("clash") for c in ("size", "phrase", "a", "n", "key", "part", "f")})
    got = phrases.collocations(docs, least=least, most=most, covered=covered, bits=bits)
    want = brute(rows, least, most, covered)
    assert want and sorted(map(tuple, got.collect())) == want


def test_sketch_never_undercounts_and_prunes(spark, rows):
    """Every frequent phrase passes a sketch; a wide one lets hardly anything else pass."""
    docs = spark.createDataFrame(rows, "text string, lang string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    passed = phrases._merged(common.gathered(docs), 20, 10)
    counts, places = collections.Counter(), {}
    for lang in {"und", "en", ""}:
        words = phrases.Words(lang, "\n".join(t or "" for t, x in rows if (x if x is not None else "und") == lang).encode())
        for size, inside, prints in words.prints():
            if size <= 2:
                counts.update(prints[inside].tolist())
    import numpy as np

    found = passed(np.array(list(counts), np.uint64))
    frequent = np.array([c >= 10 for c in counts.values()])
    assert found[frequent].all() and frequent.any() and (found & ~frequent).sum() <= 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and phrases.collocations(docs).count() == 0


def test_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 10**14, 3 * 10**12 + 1, 7 * 10**12)], "a long, n long, l long, r long")
    got = rows.select(phrases._score(*(F.col(c) for c in "anlr"))).first()[0]
    assert got == 1000 * 10**12 * 10**14 // ((3 * 10**12 + 1) * 7 * 10**12)
