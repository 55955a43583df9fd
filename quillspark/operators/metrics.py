"""Metrics, statistics, regression and resource warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.keep import keep
from .retrieval import sized


SPLITS = 1024  # parts that a range of values is cut into, round by round


def exact_quantiles(samples: DataFrame, shares: dict[str, float], metric: str = "metric", value: str = "value") -> DataFrame:
    """M5: per metric, a column for each share: its quantile, exact, with linear interpolation.

    A quantile lies on two ranks at most. The value at a rank is found by counting: the range that holds it
    is cut into SPLITS parts, the rows of each part are counted (in the tasks first), and the part that holds
    the rank, from its least to its greatest value, is the next range; a range of one value ends it. No
    task holds more than counts, however many rows a metric has. NaN and null are no values.
    """
    v = F.col(value).cast("double")
    rows = samples.select(F.col(metric).alias("metric"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    ranges = rows.groupBy("metric").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    both = [F.struct(F.lit(name).alias("share"), f((F.col("n") - 1) * F.lit(p)).cast("long").alias("rank")) for name, p in shares.items() for f in (F.floor, F.ceil)]
    found = keep(ranges.select("metric", F.explode(F.array_distinct(F.array(*both))).alias("t"), "low", "high").select("metric", "t.share", "t.rank", "low", "high", F.lit(0).cast("long").alias("below")))
    open_ = F.col("low") < F.col("high")
    while not found.where(open_).isEmpty():
        # ranks in one range share its counts
        wanted = found.where(open_).select("metric", "low", "high", "below").distinct()
        held = rows.join(sized(keep(wanted)), "metric").where(F.col("v").between(F.col("low"), F.col("high")))
        # the least and the greatest value have parts of their own, so that each round gets somewhere, infinities or not
        scale = F.when(F.abs(F.col("high") - F.col("low")) < float("inf"), 1.0).otherwise(0.5)
        along = F.nanvl((F.col("v") * scale - F.col("low") * scale) / (F.col("high") * scale - F.col("low") * scale), F.lit(0.5))
        within = F.least(F.lit(SPLITS - 2), 1 + F.floor(along * (SPLITS - 2)))
        part = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), SPLITS - 1).otherwise(within).alias("part")
        counts = held.groupBy("metric", "low", "high", "below", part).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy("metric", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("c"))
        next_ = found.where(open_).drop("below").join(counts.drop("below"), ["metric", "low", "high"]).where(inside)
        next_ = next_.select("metric", "share", "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("first").alias("below"))
        found = keep(found.where(~open_).unionByName(next_))
    sums = ranges.select("metric", "n").join(found, "metric")
    columns = []
    for name, p in shares.items():
        place = (F.col("n") - 1) * F.lit(p)
        own = F.col("share") == name
        low, high = F.max(F.when(own & (F.col("rank") == F.floor(place)), F.col("low"))), F.max(F.when(own & (F.col("rank") == F.ceil(place)), F.col("low")))
        # as weights of both values, which is how built-in percentiles interpolate
        over = F.first(place - F.floor(place))
        columns.append(F.when(low == high, low).otherwise(low * (1 - over) + high * over).alias(name))
    return sums.groupBy("metric").agg(*columns).withColumnRenamed("metric", metric)


def aggregate(samples: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """M4 to M6: per metric count, mean, min, max, population deviation, median, p95, cv, stable.

    Nulls and NaN are no samples. Percentiles are exact and interpolate linearly.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    r = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    out = samples.groupBy(metric).agg(F.count(v).alias("samples"), r(F.avg(v)).alias("mean"), r(F.min(v)).alias("minimum"), r(F.max(v)).alias("maximum"), r(F.stddev_pop(v)).alias("stdev"))
    ranks = exact_quantiles(samples, {"median": 0.5, "p95": 0.95}, metric, value).withColumnRenamed(metric, "named")
    out = out.join(ranks, F.col(metric).eqNullSafe(F.col("named")), "left").drop("named").withColumns({c: r(F.col(c)) for c in ("median", "p95")})
    cv = F.coalesce(F.round(F.try_divide("stdev", "mean"), 4), F.lit(0.0))
    return out.withColumn("cv", cv).withColumn("stable", (F.col("samples") >= 3) & (F.col("cv") <= 0.15))


def delta_percent(before: Column, after: Column) -> Column:
    """M7: relative change in percent; null where there is no base."""
    return F.round(F.try_divide((after - before) * 100.0, F.abs(before)), 2)


# Tracked metrics: whether more is better, and the regression allowed in percent: fixed values.
TRACKED = {
    "tokens_per_second": (True, 5.0),
    "first_token_latency_ms": (False, 10.0),
    "total_ms": (False, 10.0),
    "peak_rss_mb": (False, 8.0),
    "prompt_tokens": (False, 15.0),
    "response_grounding_rate": (True, 5.0),
    "temperature_c": (False, 5.0),
}
# Families of metrics that one tolerance covers: fixed values.
FAMILIES = {
    "throughput_pct": ("tokens_per_second",),
    "latency_pct": ("first_token_latency_ms", "total_ms"),
    "memory_pct": ("peak_rss_mb", "prompt_tokens"),
    "grounding_pct": ("response_grounding_rate",),
    "thermal_pct": ("temperature_c",),
}
# Metrics of the comparison with the whole-corpus path, and those where zero means missing: fixed values.
NAIVE_METRICS = {
    "prompt_tokens": False, "context_tokens": False, "corpus_coverage": True, "response_grounding_rate": True,
    "tokens_per_second": True, "total_ms": False, "peak_rss_mb": False,
}
ZERO_IS_MISSING = ("prompt_tokens", "context_tokens", "corpus_coverage", "total_ms", "peak_rss_mb")


def compare_regression(current: DataFrame, baseline: DataFrame, tolerances: dict[str, float] | None = None) -> DataFrame:
    """M8: tracked metrics of two campaigns (metric, value), with delta and whether it regressed."""
    allowed = {m: t for m, (_, t) in TRACKED.items()}
    for name, value in (tolerances or {}).items():
        allowed |= dict.fromkeys(FAMILIES.get(name, (name,)), float(value))
    rules = current.sparkSession.createDataFrame([(m, up, float(allowed[m])) for m, (up, _) in TRACKED.items()], "metric string, more_is_better boolean, allowed double")
    both = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric")
    rows = both.join(F.broadcast(rules), "metric").where("baseline <> 0").withColumn("delta_pct", delta_percent(F.col("baseline"), F.col("current")))
    improved = F.when(F.col("more_is_better"), F.col("delta_pct") > 0).otherwise(F.col("delta_pct") < 0)
    rows = rows.withColumn("improved", improved)
    return rows.select("metric", "baseline", "current", "delta_pct", "improved", (~F.col("improved") & (F.abs("delta_pct") > F.col("allowed"))).alias("regression"))


def compare_naive(current: DataFrame, naive: DataFrame) -> DataFrame:
    """M9: metrics with and without the pipeline; rows where a zero means missing are marked unmeasured."""
    rules = current.sparkSession.createDataFrame(list(NAIVE_METRICS.items()), "metric string, more_is_better boolean")
    both = naive.select("metric", F.col("value").alias("without")).join(current.select("metric", F.col("value").alias("with")), "metric").join(F.broadcast(rules), "metric")
    unmeasured = F.col("metric").isin(*ZERO_IS_MISSING) & ((F.col("without") == 0) | (F.col("with") == 0))
    better = F.when(F.col("more_is_better"), F.col("with") > F.col("without")).otherwise(F.col("with") < F.col("without"))
    return both.select("metric", "without", "with", delta_percent(F.col("without"), F.col("with")).alias("delta_pct"), better.alias("favours_pipeline"), (~unmeasured).alias("measured"))


def stage_share(durations: DataFrame, request: str = "request_id", stage: str = "stage", ms: str = "ms") -> DataFrame:
    """Each stage's part of its request's time."""
    total = F.sum(ms).over(Window.partitionBy(request))
    return durations.withColumn("share", F.coalesce(F.round(F.try_divide(F.col(ms), total), 4), F.lit(0.0)))


def peaks(samples: DataFrame, key: str = "session_id") -> DataFrame:
    """M2: peaks of resource samples per session; the least memory left."""
    return samples.groupBy(key).agg(F.max("rss_mb").alias("peak_rss_mb"), F.min("available_ram_mb").alias("least_ram_mb"), F.max("cpu_percent").alias("peak_cpu"), F.max("temperature_c").alias("peak_c"))


def resource_warnings(celsius: Column, ram_percent: Column) -> Column:
    """M3."""
    return F.array_compact(F.array(F.when(celsius >= 92, "critical temperature").when(celsius >= 78, "high temperature"), F.when(ram_percent >= 88, "memory nearly full")))


def assemble(asked: DataFrame, compacted: DataFrame, evidence: DataFrame, answers: DataFrame, reports: DataFrame, precisions: DataFrame) -> DataFrame:
    """M1: one row of metrics per question.

    compacted: compaction_report() rows. A simulated answer has no throughput and no times.
    """
    sums = compacted.agg(F.max(F.when(F.col("stage") == "input", F.col("tokens"))).alias("corpus_tokens"))
    used = evidence.groupBy("question_id").agg(F.sum("token_estimate").alias("context_tokens"), F.count("*").alias("passages"))
    rows = asked.select("question_id").join(used, "question_id", "left").na.fill(0).crossJoin(F.broadcast(sums))
    answered = answers.select("question_id", "prompt_tokens", "generated_tokens", "efficiency", "is_simulated")
    checked = reports.select("question_id", "passed", "confidence", F.col("grounding_rate").alias("response_grounding_rate"), "evidence_coverage")
    rows = rows.join(answered, "question_id", "left").join(checked, "question_id", "left").join(precisions, "question_id", "left")
    saved = F.when(F.col("corpus_tokens") <= 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("context_tokens") / F.col("corpus_tokens")), 4))
    return rows.withColumns({"end_to_end_compression": saved, "tokens_per_second": F.when(~F.col("is_simulated"), F.lit(None).cast("double"))})
