"""Evaluation, scoring and benchmarking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 4), F.lit(0.0))


def probe_check(answer: Column, must: Column, must_not: Column, match: Column) -> Column:
    """All (or any) wanted strings occur, none of the unwanted; substrings, any case."""
    lowered = F.lower(answer)
    held = lambda t: F.contains(lowered, F.lower(t))
    wanted = F.when(match == "any", F.exists(must, held)).otherwise(F.forall(must, held))
    return wanted & ~F.exists(must_not, held)


def probe_outcomes(results: DataFrame) -> DataFrame:
    """Outcome, answered, correct, source_correct, declined, hallucinated, failure.

    results: the probe's columns and answer, error, truncated, confidence, sources.
    """
    answer = T.strip(F.coalesce(F.col("answer"), F.lit("")))
    declined = F.coalesce(F.col("confidence") == "insufficient", F.lit(False))
    outcome = (
        F.when(F.col("error").isNotNull(), "crash")
        .when(F.coalesce("truncated", F.lit(False)), "truncated")
        .when(answer == "", "empty")
        .when(F.col("unanswerable"), "unanswerable")
        .otherwise("checked")
    )
    none = F.array().cast("array<string>")
    held = probe_check(answer, F.coalesce("must_contain", none), F.coalesce("must_not_contain", none), F.coalesce("match", F.lit("all")))
    rows = results.withColumns({"outcome": outcome, "held": held, "declined_": declined})
    judged = F.col("outcome").isin("unanswerable", "checked")
    checked, refusing = F.col("outcome") == "checked", F.col("outcome") == "unanswerable"
    sourced = F.when(checked & (F.coalesce("expected_source", F.lit("")) != ""), F.array_contains("sources", F.col("expected_source")))
    rows = rows.withColumns(
        {
            "answered": judged & ~F.col("declined_"),
            "correct": F.when(checked, F.col("held")).when(refusing, F.col("declined_")).otherwise(False),
            "source_correct": sourced,
            "declined": judged & F.col("declined_"),
            "hallucinated": refusing & ~F.col("declined_"),
        }
    )
    failure = (
        F.when(F.col("outcome") == "crash", F.col("error"))
        .when(F.col("outcome") == "truncated", "cut off")
        .when(F.col("outcome") == "empty", "empty answer")
        .when(F.col("hallucinated"), "answered what the corpus cannot support")
        .when(checked & ~F.col("held"), "wanted strings missing or unwanted ones present")
        .when(checked & ~F.coalesce("source_correct", F.lit(True)), "right figure, other source")
        .otherwise("")
    )
    return rows.withColumn("failure", failure).drop("held", "declined_")


def accuracy_summary(outcomes: DataFrame) -> DataFrame:
    """One row of rates; declining well counts as much as answering well."""
    n = lambda c: F.count_if(c)
    can, cannot = ~F.col("unanswerable"), F.col("unanswerable")
    right, refused = n(can & F.col("correct")), n(cannot & F.col("declined"))
    return outcomes.agg(
        F.count("*").alias("probes"), n(can).alias("answerable"), n(cannot).alias("unanswerable_probes"),
        ratio(right, n(can)).alias("accuracy"), ratio(n(can & F.coalesce("source_correct", F.lit(False))), n(can)).alias("source_accuracy"),
        ratio(refused, n(cannot)).alias("refusal_accuracy"), ratio(right + refused, F.count("*")).alias("overall_accuracy"),
        ratio(n(F.col("hallucinated")), F.count("*")).alias("hallucination_rate"), ratio(n(F.col("outcome") == "truncated"), F.count("*")).alias("truncated"),
    )


def failures(outcomes: DataFrame) -> DataFrame:
    """E4."""
    passed = F.when(F.col("unanswerable"), F.col("declined")).otherwise(F.col("correct") & F.coalesce("source_correct", F.lit(True)))
    return outcomes.where(~passed)


@dataclass(frozen=True)
class Rubric:
    """Weights and limits of the score: fixed values."""

    accuracy: float = 0.5
    throughput: float = 0.3
    efficiency: float = 0.2
    tps: float = 15.0
    ram_gb: float = 7.0
    thermal_c: float = 85.0
    penalty: float = 0.10
    oom_mb: float = 256.0


def score(candidates: DataFrame, r: Rubric = Rubric()) -> DataFrame:
    """E5: total and its parts; disqualification comes first.

    candidates: accuracy, tokens_per_second, peak_rss_mb, available_ram_mb, temperature_c, crashed,
    throttled. An unmeasured value is no failure and earns nothing.
    """
    tps, rss, ram = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("tokens_per_second", "peak_rss_mb", "available_ram_mb"))
    measured = (ram > 0) & (rss > 0)
    out = (
        F.coalesce("crashed", F.lit(False))
        | (measured & (ram < r.oom_mb))
        | (rss > r.ram_gb * 1024)
    )
    part = {
        "accuracy_part": F.round(F.coalesce(F.col("accuracy"), F.lit(0.0)) * r.accuracy, 4),
        "throughput_part": F.round(F.least(F.lit(1.0), tps / r.tps) * r.throughput, 4),
        "efficiency_part": F.round(F.when(rss > 0, F.greatest(F.lit(0.0), (r.ram_gb - rss / 1024) / r.ram_gb)).otherwise(0.0) * r.efficiency, 4),
        "thermal_penalty": F.when(F.coalesce("throttled", F.lit(False)) | F.coalesce(F.col("temperature_c") > r.thermal_c, F.lit(False)), r.penalty).otherwise(0.0),
    }
    rows = candidates.withColumns({"disqualified": out, **part})
    total = F.greatest(F.lit(0.0), F.col("accuracy_part") + F.col("throughput_part") + F.col("efficiency_part") - F.col("thermal_penalty"))
    return rows.withColumn("total", F.when(F.col("disqualified"), 0.0).otherwise(F.round(total, 4)))


def rank_candidates(candidates: DataFrame, r: Rubric = Rubric(), key: str = "model") -> DataFrame:
    """Best first, ties by name."""
    return score(candidates, r).orderBy(F.desc("total"), key)


def hardware_dependence(candidates: DataFrame, r: Rubric = Rubric(), key: str = "model") -> DataFrame:
    """The best candidate as measured and with throughput saturated, and whether they differ."""
    best = lambda df, name: score(df, r).agg(F.max_by(key, F.struct("total", key)).alias(name))
    now, fast = best(candidates, "measured"), best(candidates.withColumn("tokens_per_second", F.lit(r.tps)), "saturated")
    return now.crossJoin(fast).withColumn("depends_on_hardware", F.col("measured") != F.col("saturated"))  # one row each


def campaign_runs(scenarios: DataFrame, repeat: int = 5, warmup: int = 1) -> DataFrame:
    """Scenario, question, iteration, warm_up; a cold start runs once and has no warm-up."""
    rows = scenarios.select("id", "cold_start", F.greatest(F.coalesce("repeat_question", F.lit(1)), F.lit(1)).alias("times"), F.posexplode("questions").alias("q", "question"))
    total = F.when(F.col("cold_start"), 1).otherwise(F.lit(warmup + repeat) * F.col("times"))
    rows = rows.withColumn("iteration", F.explode(F.sequence(F.lit(0), total - 1)))
    return rows.select(F.col("id").alias("scenario"), "q", "question", "iteration", ((F.col("iteration") < warmup * F.col("times")) & ~F.col("cold_start")).alias("warm_up"))


def scenario_verdicts(runs: DataFrame) -> DataFrame:
    """Fail on any error, inconclusive without a run, else by whether refusals were as expected.

    runs: scenario, ok, confidence, expect_insufficient.
    """
    refused = F.bool_and(F.coalesce(F.col("confidence") == "insufficient", F.lit(False)))
    verdict = F.when(~F.bool_and("ok"), "fail").when(F.first("expect_insufficient"), F.when(refused, "pass").otherwise("fail")).when(refused, "inconclusive").otherwise("pass")
    return runs.groupBy("scenario").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("errors"), verdict.alias("verdict"))


def campaign_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Statistics per scenario and over all, of runs that are no warm-up and ended well."""
    from .metrics import aggregate

    long = runs.where("ok AND NOT warm_up").select("scenario", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("scenario", "m.*")
    both = long.withColumn("scenario", F.explode(F.array("scenario", F.lit("all"))))
    keyed = both.withColumn("metric", F.concat_ws("\x1f", "scenario", "metric"))
    out = aggregate(keyed)
    parts = F.split("metric", "\x1f")
    return out.withColumns({"scenario": parts[0], "metric": parts[1]})


def first_documents(docs: DataFrame, n: int, name: str = "source", key: str = "doc_id") -> DataFrame:
    """The n documents that come first by name; the limit is the feature."""
    return docs.join(docs.select(key, name).orderBy(name, key).limit(n).select(key), key, "left_semi")


def naive_context(units: DataFrame, window: int) -> DataFrame:
    """The corpus in name order cut to a token window: context, tokens, coverage, dropped.

    A unit takes two characters at least, the blank line after it, so no unit beyond as many as that
    can lie in the window: the running lengths are of a bounded number of rows, whatever the corpus.
    """
    order = ["document_name", "doc_id", "ordinal"]
    all_ = units.agg((F.sum(F.length("text") + 2) - 2).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"(?U)\S+"))).alias("words"))
    total = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("chars") / T.CHARS_PER_TOKEN, F.col("words") * T.TOKENS_PER_WORD)).cast("int")).alias("corpus_tokens")
    most = int(window * T.CHARS_PER_TOKEN * 2) + 2
    first = units.select(*order, (F.length("text") + 2).alias("chars")).orderBy(*order).limit(most // 2 + 1)
    before = F.coalesce(F.sum("chars").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = first.withColumns({"before": before, "n": F.row_number().over(Window.orderBy(*order))}).where(F.col("before") <= most).select(*order, "n")
    head = units.join(F.broadcast(near), order).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("head")
    )
    cut = F.when(F.col("corpus_tokens") <= window, F.col("head")).otherwise(T.truncate_to_tokens(F.col("head"), window))
    rows = head.crossJoin(all_.select(total)).select(cut.alias("context"), "corpus_tokens").withColumn("context_tokens", T.token_count(F.col("context")))
    return rows.select(
        "context", "corpus_tokens", "context_tokens",
        F.round(F.least(F.lit(1.0), F.col("context_tokens") / F.col("corpus_tokens")), 4).alias("coverage"),
        F.greatest(F.lit(0), F.col("corpus_tokens") - F.col("context_tokens")).alias("dropped_tokens"),
    )


def naive_grounding(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Grounding of answers in the whole context, without asking for citations."""
    from .validate import ValidationPolicy, validate

    evidence = answers.select("question_id").crossJoin(context.select("context")).select("question_id", F.lit(1).alias("pick"), F.lit("S1").alias("label"), F.col("context").alias("text"))
    return validate(answers, evidence, ValidationPolicy(need_citations=False))


SPEED_ROW = r"(?m)^\|\s*([^|\n]+?)\s*\|[^\n]*?\|\s*(pp\d+|tg\d+)\s*\|\s*([\d.]+)\s*±\s*([\d.]+)\s*\|"


def parse_speed(reports: DataFrame, text: str = "text") -> DataFrame:
    """Model, test, speed and deviation from benchmark tables."""
    rows = reports.withColumn("row", F.explode(F.regexp_extract_all(F.col(text), F.lit(SPEED_ROW), 0)))
    get = lambda k: F.regexp_extract("row", SPEED_ROW, k)
    return rows.select(*[c for c in reports.columns if c != text], get(1).alias("model"), get(2).alias("test"), get(3).cast("double").alias("speed"), get(4).cast("double").alias("stdev"))


def synthetic_units(spark, n: int = 400, repeat_every: int = 7) -> DataFrame:
    """Units for micro-benchmarks, every seventh a copy of the first."""
    number = F.when(F.col("id") % repeat_every == 0, 0).otherwise(F.col("id"))
    text = F.concat(F.lit("Clause "), number.cast("string"), F.lit(" covers travel expenses, supplier invoices and approval limits for department "), (number * 13).cast("string"), F.lit("."))
    return spark.range(n).select(
        (F.col("id") / 20).cast("long").alias("doc_id"), F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("unit_id"), (F.col("id") % 20).cast("int").alias("ordinal"),
        F.lit("policy").alias("document_name"), F.lit("paragraph").alias("kind"), text.alias("text"), F.array(F.lit("General")).alias("section_path"),
        T.token_count(text).alias("token_estimate"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"), F.lit(0).alias("heading_level"),
    )
