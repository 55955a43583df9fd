"""Session lifecycles over a stream: one state per session, moves judged as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import MOVES

MOST_HISTORY = 50  # legal moves that a session's state remembers


def judged(moves_in: DataFrame, key: str = "session_id", state: str = "state", order: str = "at", moves: dict[str, tuple[str, ...]] = MOVES, start: str = "idle", history: int = MOST_HISTORY) -> DataFrame:
    """key, order, state, before, legal and depth (legal moves that the session's bounded history holds).

    A session's state is its current state and its last legal moves; it lives in the state store, so a
    restarted query goes on where its checkpoint says. Moves of one trigger are taken in order; a move
    that comes after later ones have been judged is judged when it comes.
    """
    rows = moves_in.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(state).alias("to"))
    known = [(f.dataType.simpleString()) for f in rows.schema.fields]

    def judge(of: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now, seen = held.get if held.exists else (start, [])
        seen = list(seen)
        for frame in [pd.concat(list(frames)).sort_values(["at", "to"], ignore_index=True)]:
            before, legal, depth = [], [], []
            for to in frame["to"]:
                fits = to in moves[now]
                before.append(now)
                legal.append(fits)
                if fits:
                    seen, now = [*seen, f"{now}->{to}"][-history:], to
                depth.append(len(seen))
            yield frame.assign(before=before, legal=legal, depth=depth)[["key", "at", "to", "before", "legal", "depth"]]
        held.update((now, seen))

    schema = f"key {known[0]}, at {known[1]}, to {known[2]}, before string, legal boolean, depth int"
    out = rows.groupBy("key").applyInPandasWithState(judge, schema, "now string, seen array<string>", "append", "NoTimeout")
    return out.select(F.col("key").alias(key), F.col("at").alias(order), F.col("to").alias(state), "before", "legal", "depth")
