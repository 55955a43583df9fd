"""Control plane: spans, ids, subsets, integrity, events (X5, X6, X8, X12, X13) and the token counter hook."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.keep import keep


def model_token_count(text: Column, tokenize: Callable[[str], list]) -> Column:
    """Tokens by a model's own tokenizer, called inside Arrow batches; an empty text has none."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(tokenize(t)) if t else 0)

    return count(text)


class Spans:
    """Durations of named stages, as rows of (request_id, stage, ms)."""

    def __init__(self, request_id: str):
        self.request_id, self.rows = request_id, []

    @contextmanager
    def span(self, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((self.request_id, stage, (time.perf_counter() - began) * 1000))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "request_id string, stage string, ms double")


def request_ids(questions: DataFrame, session_id: str, order: str = "question_id") -> DataFrame:
    """session#0001 and so on, in the order of a column, whatever the number of questions.

    Sorted ranges count their rows; a row's number is its place in its range and the rows before the range.
    """
    ranged = keep(questions.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("c"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    shifts = sizes.select("part", (before - F.col("first") + 1).alias("shift"))
    rows = ranged.withColumn("part", part).join(F.broadcast(shifts), "part")
    return rows.select(*questions.columns, F.format_string(f"{session_id}#%04d", F.col("place") + F.col("shift")).alias("request_id"))


def subset(units: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The units of the selected documents."""
    return units.join(ids.select(key), key, "left_semi")


def integrity(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, content) against expected digests (path, sha256): missing, changed or sound."""
    seen = files.select("path", F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "sound").otherwise("changed")
    return expected.join(seen, "path", "left").select("path", "sha256", "found", state.alias("state"))


def latest_events(events: DataFrame, most: int = 2000, order: str = "ts") -> DataFrame:
    """The newest events; the bound is the feature."""
    return events.orderBy(F.desc(order)).limit(most)
