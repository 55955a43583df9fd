"""Lifecycles and quantiles against plain loops; streams against batches."""

import random

import numpy as np
import pytest

from quillspark.operators import lifecycle, metrics
from quillspark.streaming import sessions

MOVE = "session_id string, at long, state string"


def walked(rows):
    out, now = [], {}
    for session, at, state in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = now.get(session, "idle")
        legal = state in lifecycle.MOVES[before]
        out.append((session, at, state, before, legal))
        now[session] = state if legal else before
    return sorted(out)


def history(n=3000):
    """One session with most of the moves, and many short ones; some moves go astray, some states are unknown."""
    rng, now, rows = random.Random(2), {}, []
    for at in range(n):
        s = "hot" if rng.random() < 0.7 else f"s{rng.randrange(60)}"
        here = now.get(s, "idle")
        to = rng.choice(lifecycle.MOVES[here]) if rng.random() < 0.8 else rng.choice([*lifecycle.STATES, "unknown"])
        now[s] = to if to in lifecycle.MOVES[here] else here
        rows.append((s, at, to))
    return rows


@pytest.mark.parametrize("chunk", [7, 256])
def test_replay_follows_the_walk(spark, monkeypatch, chunk):
    monkeypatch.setattr(lifecycle, "CHUNK", chunk)
    rows = history()
    got = lifecycle.replay(spark.createDataFrame(rows, MOVE).repartition(5))
    assert sorted(map(tuple, got.collect())) == walked(rows)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Files that come one by one, a query that is stopped between them, and a history that stays bounded."""
    rows = history(400)
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], MOVE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        moves = spark.readStream.schema(MOVE).parquet(str(tmp_path / "in"))
        out = sessions.judged(moves, history=5)
        run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("session_id", "at", "state", "before", "legal").collect())) == walked(rows)
    assert max(r.depth for r in got.collect()) == 5


def test_quantiles_are_exact(spark):
    rng = random.Random(6)
    data = [("wide", rng.uniform(-1e9, 1e9)) for _ in range(700)] + [("few", float(rng.randrange(3))) for _ in range(301)] + [("one", 7.0), ("two", 1.0), ("two", 2.0)]
    data += [("close", 1 + k * 2.0**-52) for k in range(40)] + [("far", v) for v in (-1.7e308, 0.0, 1e-300, 5e-300, 1.7e308)] + [("endless", v) for v in (-float("inf"), 1.0, 2.0, 3.0, float("inf"))] + [("none", None), ("none", float("nan"))]
    got = {r.metric: (r.q25, r.q95) for r in metrics.exact_quantiles(spark.createDataFrame(data, "metric string, value double"), {"q25": 0.25, "q95": 0.95}).collect()}
    assert got["endless"][0] == 1.0 and got["endless"][1] == float("inf")
    for name in {m for m, _ in data} - {"none", "endless"}:
        values = [v for m, v in data if m == name]
        assert got[name] == pytest.approx((np.percentile(values, 25), np.percentile(values, 95)), rel=1e-12)
    assert "none" not in got
