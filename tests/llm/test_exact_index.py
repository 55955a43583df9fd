"""The extendible-hash index: owners, chains of colliding hashes, hot groups, clashing columns."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, exact_index


def expected(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(str.maketrans(common.UPPER, common.LOWER))].append(doc_id)
    return {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


@pytest.fixture(scope="module")
def rows():
    return [(k, ["hot text", "HOT text", None, "", f"own {k}", f"pair {k // 2}", "é É"][k % 7]) for k in range(400)]


@pytest.mark.parametrize("broadcasts", [True, False])
@pytest.mark.parametrize("collide", [True, False])
def test_groups_match_brute_force(spark, rows, monkeypatch, broadcasts, collide):
    """With hashes of two bits, texts of one hash are told apart by their bytes and chained."""
    if collide:
        monkeypatch.setattr(exact_index, "hash_of", lambda norm: F.shiftleft(F.pmod(F.length(norm), F.lit(4)).cast("long"), 61))
    monkeypatch.setattr(exact_index, "LEAST_HOT", 50)
    if not broadcasts:
        monkeypatch.setattr(common, "MOST_ROWS", 3)
        monkeypatch.setattr(exact_index, "MOST_ENTRIES", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_index.exact_groups(docs, capacity=16).collect()
    want = expected(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)
    chains = collections.defaultdict(dict)  # texts of one hash are numbered from 0, in the order of their digests
    for r in got:
        text = (dict(rows)[r.doc_id] or "").translate(str.maketrans(common.UPPER, common.LOWER))
        chains[len(text) % 4 if collide else text][r.text_sha256] = r.chain
    assert all([c for _, c in sorted(x.items())] == list(range(len(x))) for x in chains.values())
    assert max(len(x) for x in chains.values()) > 20 if collide else max(len(x) for x in chains.values()) == 1
    kept = exact_index.drop_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, w in want.items() if w[2])


def test_index_files_hold_key_ranges(spark, rows):
    """A directory of several buckets; each owner's buckets lie side by side and none is overfull."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(3000)], "doc_id long, text string")
    index = exact_index.build_index(docs, capacity=100)
    assert index.directory.global_depth >= 5 and all(n <= 100 for _, _, n in index.directory.buckets)
    owned = collections.defaultdict(set)
    for r in index.keys.select("owner", "bucket").distinct().collect():
        owned[r.owner].add(r.bucket)
    assert all(b == set(range(min(b), max(b) + 1)) for b in owned.values()) and len(owned) > 4
    files = index.keys.withColumn("f", F.input_file_name()).groupBy("owner").agg(F.countDistinct("f").alias("n")).collect()
    assert all(r.n == 1 for r in files)
    assert exact_index.build_index(docs).directory.global_depth > 2  # as the query runs it


def test_columns_of_any_name_pass_through(spark):
    data = [(1, "a", 10), (2, "A", 20), (2, "A", 30), (3, None, 40)]
    names = ["__id", "__sha", "__keep", "__kept_sha", "h", "SHA", "keep", "size", "norm", "owner", "a.b", "again"]
    docs = spark.createDataFrame(data, "doc_id long, text string, v long").withColumns({n: F.lit(n) for n in names})
    kept = exact_index.drop_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r["a.b"], r.SHA) for r in kept.collect())
    assert got == [(2, "a.b", "SHA"), (3, "a.b", "SHA")]
