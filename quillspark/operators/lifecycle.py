"""Lifecycles of sessions: which moves are legal, and the state after each.

A state machine is sequential: an illegal move leaves the state as it was. But what a stretch of moves
does to a session is a table from the state before it to the state after it, and such tables can be put
together. So the moves are sorted into ranges, cut into stretches of CHUNK, and each stretch's table is
made on its own; the tables alone give the state in which every stretch begins, and the stretches are
then replayed side by side. A session that holds a third of all moves is so many ranges and stretches,
and only its tables, ten small numbers for each CHUNK moves, come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.keep import keep

# The states of a runtime session and the moves between them: fixed values.
STATES = ("idle", "loading", "ready", "optimizing", "retrieving", "prompt_ready", "inferencing", "validating", "completed", "failed")
MOVES = {
    "idle": ("loading", "failed"),
    "loading": ("ready", "failed"),
    "ready": ("optimizing", "loading", "idle", "failed"),
    "optimizing": ("retrieving", "ready", "failed"),
    "retrieving": ("prompt_ready", "ready", "failed"),
    "prompt_ready": ("inferencing", "ready", "failed"),
    "inferencing": ("validating", "failed"),
    "validating": ("completed", "failed"),
    "completed": ("ready", "idle", "failed"),
    "failed": ("ready", "idle"),
}
CHUNK = 256


def _codes(moves: dict[str, tuple[str, ...]]) -> tuple[list[str], Column]:
    """State names, and whether a move from code a to code b is legal, at a * number of states + b."""
    names = list(moves)
    return names, F.array(*[F.lit(b in moves[a]) for a in names for b in names])


def replay(history: DataFrame, key: str = "session_id", state: str = "state", order: str = "at", moves: dict[str, tuple[str, ...]] = MOVES, start: str = "idle") -> DataFrame:
    """The rows of a history of moves (`state` is where a move leads) with `before`, the state that it met,
    and `legal`. Unknown states are illegal. Moves of one session at one time go by the state's name."""
    names, table = _codes(moves)
    n = len(names)
    rows = history.withColumn("code", F.array_position(F.array(*map(F.lit, names)), F.col(state)).cast("int") - 1)
    rows = keep(rows.repartitionByRange(key, order, state).sortWithinPartitions(key, order, state).withColumn("place", F.monotonically_increasing_id()))
    rows = rows.withColumn("chunk", F.floor(F.col("place") / CHUNK))
    chunks = keep(rows.groupBy(key, "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]).alias("codes"), F.min("place").alias("first")))
    legal = lambda at, to: (to >= 0) & F.get(table, at * n + to)
    step = lambda at, to: F.when(legal(at, to), to).otherwise(at)
    # null where no move of a stretch is known to this state machine: it leads from each state to itself
    ends = F.transform(F.array(*[F.lit(k) for k in range(n)]), lambda s: F.aggregate("codes", s, step))
    tables = F.sort_array(F.collect_list(F.struct("chunk", "ends")))

    def begins(all_: Column) -> Column:
        empty = F.struct(F.lit(names.index(start)).alias("at"), F.array().cast("array<int>").alias("seen"))
        out = F.aggregate(all_, empty, lambda a, x: F.struct(F.get(x["ends"], a["at"]).alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen")), lambda a: a["seen"])
        return F.arrays_zip(F.transform(all_, lambda x: x["chunk"]).alias("chunk"), out.alias("begin"))

    met = chunks.select(key, "chunk", ends.alias("ends")).groupBy(key).agg(tables.alias("tables")).select(key, F.explode(let(F.col("tables"), begins)).alias("x")).select(key, "x.chunk", "x.begin")
    track = F.aggregate("codes", F.array(F.col("begin")), lambda seen, to: F.concat(seen, F.array(step(F.get(seen, F.size(seen) - 1), to))))
    states = chunks.join(met, [key, "chunk"]).select("chunk", key, "first", F.posexplode(F.slice(track, 1, F.size("codes"))).alias("k", "code_before"))
    states = states.select((F.col("first") + F.col("k")).alias("place"), "code_before")
    out = rows.join(states, "place").withColumn("before", F.get(F.array(*map(F.lit, names)), F.col("code_before"))).withColumn("legal", legal(F.col("code_before"), F.col("code")))
    return out.select(*history.columns, "before", "legal")
