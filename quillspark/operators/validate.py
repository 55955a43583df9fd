"""Answer validation by n-gram grounding and citation (V1 to V9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class ValidationPolicy:
    sentence: float = 0.34
    passing: float = 0.60
    least_chars: int = 2
    need_citations: bool = True
    high: float = 0.85
    medium: float = 0.60
    gram: int = 3


def ground_sentences(answers: DataFrame, evidence: DataFrame, p: ValidationPolicy = ValidationPolicy()) -> DataFrame:
    """V2: question_id, n, sentence, label, overlap, grounded for sentences long enough to judge.

    Sentences meet evidence through shared grams, never pair by pair.
    """
    body = T.strip_citations(T.strip(F.coalesce(F.col("answer"), F.lit(""))))
    rows = answers.select("question_id", F.posexplode(T.sentences(body)).alias("n", "sentence"))
    rows = rows.withColumn("terms", T.content_words(F.col("sentence"))).where(F.size("terms") >= 3)
    rows = rows.withColumn("grams", T.grams(F.col("terms"), p.gram))
    has = evidence.select("question_id").distinct()
    rows = rows.join(has, "question_id", "left_semi")
    mine = rows.select("question_id", "n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    theirs = evidence.select("question_id", "pick", "label", F.explode(T.shingles(F.col("text"), p.gram)).alias("gram"))
    shared = mine.join(theirs, ["question_id", "gram"]).groupBy("question_id", "n", "pick", "label").agg((F.count("*") / F.first("size")).alias("overlap"))
    best = shared.groupBy("question_id", "n").agg(F.max(F.struct("overlap", (-F.col("pick")).alias("first"), "label")).alias("best"))
    out = rows.select("question_id", "n", "sentence").join(best, ["question_id", "n"], "left")
    overlap = F.coalesce(F.col("best.overlap"), F.lit(0.0))
    return out.select("question_id", "n", "sentence", F.coalesce("best.label", F.lit("")).alias("label"), F.round(overlap, 4).alias("overlap"), (overlap >= p.sentence).alias("grounded"))


def validate(answers: DataFrame, evidence: DataFrame, p: ValidationPolicy = ValidationPolicy()) -> DataFrame:
    """V1 to V9: one report per answer. answers: question_id, question, answer."""
    verdicts = ground_sentences(answers, evidence, p)
    failed = F.sort_array(F.collect_list(F.when(~F.col("grounded"), F.struct("n", T.strip(F.col("sentence")).alias("s")))))
    judged = verdicts.groupBy("question_id").agg(F.round(F.avg(F.col("grounded").cast("double")), 4).alias("rate"), failed.alias("failed"))
    labels = evidence.groupBy("question_id").agg(F.sort_array(F.collect_set("label")).alias("available"))
    rows = answers.select("question_id", "question", T.strip(F.coalesce(F.col("answer"), F.lit(""))).alias("answer"))
    rows = rows.join(judged, "question_id", "left").join(labels, "question_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "available": F.coalesce("available", none),
            "grounding_rate": F.coalesce("rate", F.lit(0.0)),
            "cited_labels": T.citations(F.col("answer")),
            "uncertainty_declared": T.declares_insufficient(F.col("answer")),
            "unsupported": F.coalesce(F.transform(F.slice("failed", 1, 5), lambda x: x["s"]), none),
            "asked": F.array_distinct(T.content_words(F.col("question"))),
            "told": F.array_distinct(T.content_words(F.col("answer"))),
        }
    )
    share = lambda part, whole: F.when(F.size(whole) == 0, 0.0).otherwise(F.round(F.size(part) / F.size(whole), 4))
    rows = rows.withColumns(
        {
            "invalid_labels": F.array_except("cited_labels", "available"),
            "evidence_coverage": share(F.array_intersect("cited_labels", "available"), F.col("available")),
            "question_coverage": share(F.array_intersect("asked", "told"), F.col("asked")),
            "has_evidence": F.size("available") > 0,
        }
    )
    declared, cited = F.col("uncertainty_declared"), F.size("cited_labels") > 0
    checks = {
        "non_empty": F.length("answer") >= p.least_chars,
        "citations_valid": F.size("invalid_labels") == 0,
        "grounded": F.when(F.col("has_evidence"), F.col("grounding_rate") >= p.passing).otherwise(declared),
    }
    if p.need_citations:
        checks["has_citations"] = F.when(F.col("has_evidence"), cited | declared).otherwise(F.lit(True))
    rate = F.col("grounding_rate")
    confidence = (
        F.when(~F.col("has_evidence") | declared, "insufficient")
        .when((rate >= p.high) & cited & (F.col("evidence_coverage") >= 0.3) & (F.col("question_coverage") > 0), "high")
        .when((rate >= p.medium) & (cited | (F.col("evidence_coverage") > 0)), "medium")
        .when(rate > 0, "low")
        .otherwise("insufficient")
    )
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    passed = F.when(F.col("has_evidence"), every).otherwise(declared)
    warnings = F.array_compact(
        F.array(
            F.when(F.size("invalid_labels") > 0, F.concat(F.lit("labels never provided: "), F.array_join("invalid_labels", ", "))),
            F.when(~F.col("has_evidence") & ~declared, "content without evidence"),
            F.when(F.col("has_evidence") & (F.col("question_coverage") == 0) & ~declared, "no term in common with the question"),
            F.when(T.hedges(F.col("answer")), "hedging language"),
            F.when(F.size("unsupported") > 0, F.concat(F.size("unsupported").cast("string"), F.lit(" sentence(s) not supported"))),
        )
    )
    return rows.select(
        "question_id", passed.alias("passed"), confidence.alias("confidence"), "grounding_rate", "evidence_coverage", "question_coverage", "cited_labels", "invalid_labels",
        "unsupported", "uncertainty_declared", F.struct(*[c.alias(k) for k, c in checks.items()]).alias("checks"), warnings.alias("warnings"),
    )
