"""The corpus store: one manifest for both tables, touched buckets only, snapshots by state, logs."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import corpus


@pytest.fixture
def store(spark, tmp_path):
    out = corpus.CorpusStore(spark, str(tmp_path / "store"), buckets=8)
    out.upsert(*tables(spark, range(40)))
    return out


def tables(spark, ids, tag=""):
    d = spark.createDataFrame([(f"d{k}", f"{k}{tag}.md") for k in ids], "document_id string, filename string")
    u = spark.createDataFrame([(f"d{k}", n, 5, f"{tag}c{k}.{n}") for k in ids for n in range(2)], "document_id string, ordinal int, token_estimate int, checksum string")
    return d, u


def folders(store, table):
    return store.manifest()["tables"][table]


def test_an_upsert_rewrites_touched_buckets_only(spark, store):
    before = folders(store, "units")
    store.upsert(*tables(spark, [3, 99], "new"))
    after = folders(store, "units")
    assert 1 <= sum(after[b] != f for b, f in before.items()) <= 2
    rows = {r.document_id: r.filename for r in store.documents().collect()}
    assert len(rows) == 41 and rows["d3"] == "3new.md" and rows["d4"] == "4.md"
    assert [r.checksum for r in store.units(["d3"]).collect()] == ["newc3.0", "newc3.1"]
    store.delete(spark.createDataFrame([("d3",), ("nobody",)], "document_id string"))
    assert store.counts().first() == (40, 80)


def test_a_crash_between_the_writes_shows_the_old_state(spark, store, monkeypatch):
    def crash(self, new):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(corpus.CorpusStore, "_commit", crash)
        with pytest.raises(OSError):
            store.upsert(*tables(spark, [1, 2, 50], "half"))
    assert store.counts().first() == (40, 80) and {r.filename for r in store.documents().collect()} == {f"{k}.md" for k in range(40)}
    gone = store.sweep(states=1)
    assert any(f.startswith("units/") for f in gone)  # what the lost writer left
    assert store.counts().first() == (40, 80)


def test_two_writers_of_one_state(spark, store):
    old = store.manifest()
    store.clear()
    with pytest.raises(RuntimeError, match="COR-003"):
        store._commit(old)
    assert store.counts().first() == (0, 0)
    store.upsert(*tables(spark, [7]))
    assert store.counts().first() == (1, 2)


def test_snapshots_are_kept_by_state(spark, store, monkeypatch):
    first = store.snapshot().first()
    assert (first.documents, first.units, first.tokens) == (40, 80, 400)
    with monkeypatch.context() as m:
        m.setattr(corpus, "snapshot", lambda *a: pytest.fail("computed again"))
        store.record("metrics", spark.createDataFrame([("r", 1)], "request_id string, ms int"))
        assert store.snapshot().first() == first
    store.delete(spark.createDataFrame([("d0",)], "document_id string"))
    assert store.snapshot().first().documents == 39


def test_checksum_is_over_the_ordered_list(spark):
    import hashlib

    rows = [(f"d{k % 7}", k // 7, 1, f"c{k}") for k in range(60)]
    u = spark.createDataFrame(rows, "document_id string, ordinal int, token_estimate int, checksum string").repartition(5)
    want = hashlib.sha256("|".join(r[3] for r in sorted(rows)).encode()).hexdigest()
    assert corpus.snapshot(u).first().corpus_checksum == want


def test_logs_append_and_compact(spark, store):
    at = lambda s: F.to_timestamp(F.lit(f"2026-01-0{s} 00:00:00"))
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "session_id string")
    store.open_sessions(ids("a", "b").withColumns({"profile_id": F.lit("p"), "created_at": at(1)}))
    store.close_sessions(ids("a", "b", "unknown").withColumns({"closed_at": at(2), "requests": F.lit(3)}))
    store.open_sessions(ids("b").withColumns({"profile_id": F.lit("q"), "created_at": at(3)}))
    assert len(store.manifest()["logs"]["sessions"]) == 3
    before = {r.session_id: r for r in store.sessions().collect()}
    assert set(before) == {"a", "b"} and before["a"].requests == 3 and before["b"].profile_id == "q" and before["b"].closed_at is None
    store.compact_sessions()
    assert len(store.manifest()["logs"]["sessions"]) == 1 and {r.session_id: r for r in store.sessions().collect()} == before
    store.close_sessions(ids("b").withColumns({"closed_at": at(4), "requests": F.lit(9)}))
    assert {r.session_id: r.requests for r in store.sessions().collect()} == {"a": 3, "b": 9}
    store.record("metrics", spark.createDataFrame([("r", 1), ("s", 2)], "request_id string, ms int"))
    store.record("metrics", spark.createDataFrame([("r", 5)], "request_id string, ms int"))
    assert {r.request_id: r.ms for r in store.latest("metrics", "request_id").collect()} == {"r": 5, "s": 2}
