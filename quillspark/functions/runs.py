"""Greedy cutting of ordered arrays into runs, as one fold over numbers and slices of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def cut(items: Column, empty: Column, takes: Callable[[Column, Column], Column], grown: Callable[[Column, Column, Column], Column]) -> Column:
    """Array of runs of `items`: an item joins the open run where takes(state, item) holds, else it starts one.

    grown(state, item, joined) is the run's state with the item in it; `empty` is the state before any. Only
    states and the runs' first places go through the fold; the items themselves are sliced in the end.
    """

    def step(a: Column, i: Column) -> Column:
        def with_item(x: Column) -> Column:
            joins = (F.size(a["starts"]) > 0) & takes(a["state"], x)
            return let(joins, lambda j: F.struct(grown(a["state"], x, j).alias("state"), F.when(j, a["starts"]).otherwise(F.concat(a["starts"], F.array(i))).alias("starts")))

        return let(F.get(items, i), with_item)

    def runs(starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(items))
        return F.transform(starts, lambda s, k: F.slice(items, s + 1, end(k) - s))

    zero = F.struct(empty.alias("state"), F.array().cast("array<int>").alias("starts"))
    places = F.filter(F.sequence(F.lit(0), F.size(items)), lambda i: i < F.size(items))
    return let(F.aggregate(places, zero, step, lambda a: a["starts"]), runs)
