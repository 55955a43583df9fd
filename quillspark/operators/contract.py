"""The contract of a run, checked over a log of its stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages of a request in their order: fixed values.
STAGES = (
    "session_creation", "resource_assessment", "document_discovery", "context_optimization", "evidence_retrieval",
    "prompt_assembly", "model_inference", "response_validation", "metrics_finalization", "session_cleanup",
)
REQUIRED = ("total_ms", "prompt_tokens", "peak_rss_mb")


def _found(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("request_id", F.lit(rule).alias("rule"), detail.alias("detail"))


def violations(log: DataFrame, runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, rule, detail: one row for each breach; an empty table is a sound batch of runs.

    log: request_id, n (place in what was executed), stage, status, errors (array). runs: request_id, profile_id,
    usable_tokens (the window less what is kept for the answer) and the REQUIRED metrics. evidence: request_id, label,
    unit_id, document_name. Whether the network was used is the cluster's to say, and is not checked here.
    """
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    known = log.withColumn("place", place).where("place > 0")
    before = Window.partitionBy("request_id").orderBy("n")
    # stages run in order where none comes before the one executed last
    turned = known.withColumn("last", F.lag("stage").over(before)).withColumn("last_place", F.lag("place").over(before)).where("place < last_place")
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    parts = [
        _found(turned, "order", F.concat("stage", F.lit(" after "), "last")),
        _found(log.where(F.coalesce(place, F.lit(0)) == 0), "unknown stage", F.col("stage")),
        _found(log.where((F.col("status") == "failed") & (F.coalesce(F.size("errors"), F.lit(0)) < 1)), "silent failure", F.col("stage")),
        _found(runs.where(blank("profile_id")), "profile", F.lit("none recorded")),
        _found(runs.where(blank("request_id")), "traceability", F.lit("a run without an id")),
        _found(runs.where(F.size(missing) > 0), "metrics", F.array_join(missing, ",")),
        _found(runs.where("prompt_tokens > usable_tokens"), "budget", F.concat(F.col("prompt_tokens").cast("string"), F.lit(" of "), F.col("usable_tokens").cast("string"))),
        _found(evidence.where(blank("unit_id") | blank("document_name")), "traceability", F.col("label")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
