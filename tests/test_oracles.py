"""Every catalogue query with SQL gives DuckDB's rows; the whole plan's numbers belong together."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import catalogue


def shown(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small)
    result = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted("|".join(map(shown, row)) for row in result.fetchall())
    assert sorted("|".join(shown(r[c]) for c in columns) for r in got.collect()) == expected


def test_all_but_the_whole_plan_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"ask_batch"}


def test_ask_batch(spark, small):
    """Every question has one row; evidence stays within its budget, and the numbers belong together."""
    rows = catalogue.QUERIES["ask_batch"](spark, small).collect()
    asked = catalogue.questions(spark, small).count()
    assert len(rows) == asked and len({r.question_id for r in rows}) == asked
    plain = catalogue.QUERIES["compaction_report"](spark, small).where("stage = 'input'").first().tokens
    tokens = rows[0].corpus_tokens  # of normalised texts, which are a little shorter
    assert 0.99 * plain < tokens <= plain * 1.01
    for r in rows:
        assert r.corpus_tokens == tokens and (r.passages == 0) == (r.context_tokens == 0) and r.prompt_tokens > r.context_tokens
        assert r.passages <= 12 and abs(r.end_to_end_compression - (1 - r.context_tokens / tokens)) < 1e-3
        assert r.passed is not None and r.confidence in ("high", "medium", "low", "insufficient")
    assert sum(r.passages > 0 for r in rows) >= asked // 2
