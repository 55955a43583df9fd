"""Merkle manifests against plain trees: blocks within blocks, odd rows, tampered texts."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return digest(*map(said, (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """The root, and for each node its (left, right) siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run, place = runs[i // 3], i % 3
            paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
        nodes, at = [digest(*run) for run in runs], [i // 3 for i in at]
    return nodes[0], paths


def expected(rows, change):
    groups = {}
    for row in rows:
        groups.setdefault((row[3] is not None, (row[3] or "").encode()), []).append(row)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {k: tree([leaf(r, r[1]) for r in groups[k]]) for k in sorted(groups)}
    root, above = tree([trees[k][0] for k in sorted(groups)])
    out = []
    for k, upper in zip(sorted(groups), above):
        for row, path in zip(groups[k], trees[k][1]):
            node = leaf(row, change(row))
            for left, right in path + upper:
                node = digest(left, node, right)
            out.append((row[0], leaf(row, row[1]), trees[k][0], root, digest(*(a + b for a, b in path + upper)), node, node == root))
    return sorted(out, key=str)


def stripped(row):
    even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return row[1].replace("\n", "") if row[1] is not None and even else row[1]


def column():
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


SHOWN = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "\n", "a\nb", "é\n日本", "x" * 200_000 + "\n", "same", "same"]
    rows = [(k, texts[k % 8], [None, "", "en"][k % 3], "hot" if k % 2 else f"s{k % 14}", [None, k][k % 2]) for k in range(260)]
    rows += [(1000, "only", "en", "lone", 4), (1001, "t", "en", None, 1), (1002, "u", "en", "", 1)]
    rows += [(7, "tie", "en", "hot", 3), (7, "a tie", "en", "hot", 5), (7, "tie", "en", "hot", 3), (None, "n\n", None, "hot", None), (-3, "a\n", "en", "É", 2)]
    return rows


@pytest.mark.parametrize("levels, broadcasts", [(1, False), (2, True)])
def test_trees_match_plain_ones(spark, rows, monkeypatch, levels, broadcasts):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    if not broadcasts:
        monkeypatch.setattr(common, "MOST_ROWS", 1)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = manifest.manifest(docs, tampered=column()).select(*SHOWN).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, stripped)


def test_untampered_rows_are_verified(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("key", "node", "pos", "path", "members", "range", "leaf")})
    got = manifest.manifest(docs).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    for r in got:  # the proof itself folds to the root
        node = r.leaf
        for s in r.proof:
            node = digest(s.left, node, s.right)
        assert node == r.root


@pytest.mark.parametrize("n", [0, 1, 4, 10])
def test_small_tables(spark, n):
    rows = [(k, f"t\n{k}", "en", "s", 3) for k in range(n)]
    got = manifest.manifest(spark.createDataFrame(rows, DOCS), tampered=column()).select(*SHOWN).collect()
    assert sorted(map(tuple, got), key=str) == (expected(rows, stripped) if n else [])
