"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are counted into cells of source, language and topic. Raking scales the cells' token
weights to each marginal target in turn until all of them hold. A probability is at most one, so a
cell's weight is capped at its own share of the tokens over the budget: cells at their cap are set
aside and the others are raked to what the targets leave them. A cell's fitted weight over its
tokens is its multiplier, and a document's sampling probability is min(1, scale x multiplier) with
one scale for all, which then only settles what raking left of the token budget. Every document
draws a number from its id alone, so a run repeats itself on any cluster.

A value whose target is more than all its tokens is taken whole, and the other values of its
dimension share the rest in proportion to their targets. Where the targets of several dimensions
contradict each other under the cap, the shares come as near as ROUNDS rounds bring them.

The cell table is raked on the driver where it has at most `driver_cells` rows, a proven bound, and
by the same steps as joins and aggregates where it has more; both give the same weights.

Defined results. A null source, language or topic is a value of its own. A value that no target
names shares what the named ones leave, in proportion to its tokens; targets are scaled to sum to
one over the values that occur. A null text has one token. Repeated rows draw the same number. A
row with a null doc_id draws by its text. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

DIMENSIONS = ("source", "lang", "topic")
NONE = "\x00none"  # stands for null inside cells
ROUNDS, TOLERANCE = 60, 1e-6
MOST = 1e6  # times its cap, a weight grows no further


def topic_of(text: Column) -> Column:
    """A coarse register of a text, for tables that carry no topic."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "tables")
        .when(F.contains(text, F.lit("://")) | F.contains(text, F.lit("@")), "contacts")
        .when(F.lower(text).rlike("licen[cs]e|copyright"), "notices")
        .when(F.octet_length(text) < 500, "short prose")
        .otherwise("prose")
    )


def token_estimate(text: Column) -> Column:
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long") + 1


def marginal(values: list, tokens: np.ndarray, target: dict | float) -> np.ndarray:
    """Target shares of a dimension's values. A number tempers the tokens' own shares by that power."""
    own = tokens / tokens.sum()
    if not isinstance(target, dict):
        share = own ** float(target)
        return share / share.sum()
    named = np.array([target.get(v, np.nan) for v in values], float)
    rest = np.isnan(named)
    spare = max(0.0, 1 - np.nansum(named))
    share = np.where(rest, spare * own / own[rest].sum() if rest.any() else 0, named)
    return share / share.sum() if share.sum() else own


def feasible(share: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Target shares of which none exceeds its room; the others take over what is cut, in proportion."""
    while (share > room * (1 + 1e-12)).any():
        full = share >= room
        free = share[~full].sum()
        share = np.where(full, room, share * ((1 - room[full].sum()) / free if free else 0))
    return share


def rake(codes: np.ndarray, tokens: np.ndarray, shares: list[np.ndarray], cap: np.ndarray | float = np.inf) -> np.ndarray:
    """Weights of the cells (rows of codes), none over its cap, whose marginals are the shares of one.

    The weights are min(cap, a product of one factor per value). A step sets the cells at their cap
    aside and scales the others of a value to what its share leaves them.
    """
    w = tokens / tokens.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for k, share in enumerate(shares):
            full, bounded = w >= cap, np.minimum(w, cap)
            have, held = (np.bincount(codes[:, k], x, len(share)) for x in (bounded, bounded * full))
            free = np.bincount(codes[:, k], bounded * ~full, len(share))
            plain = np.divide(share, have, out=np.ones_like(share), where=have > 0)
            worst = max(worst, float(np.abs(plain - 1)[have > 0].max(initial=0)))
            aside = (free > 0) & (share > held)
            ratio = np.where(aside, np.divide(share - held, free, out=np.ones_like(share), where=free > 0), np.where(share < have, plain, 1.0))
            w = np.minimum(w * ratio[codes[:, k]], cap * MOST)
        if worst < TOLERANCE:
            break
    return np.minimum(w, cap)


def _shares_frame(cells: DataFrame, name: str, target: dict | float) -> DataFrame:
    """marginal() as a table, for dimensions of any size."""
    totals = cells.groupBy(name).agg(F.sum("tokens").alias("t"))
    total = totals.agg(F.sum("t")).first()[0]
    own = F.col("t") / F.lit(float(total))
    if not isinstance(target, dict):
        raw = totals.withColumn("share", F.pow(own, F.lit(float(target))))
    else:
        spark = cells.sparkSession
        named = spark.createDataFrame([(v if v is not None else NONE, float(s)) for v, s in target.items()] or [(NONE, None)], f"{name} string, named double")
        both = totals.join(F.broadcast(named), name, "left")
        sums = both.agg(F.sum("named"), F.sum(F.when(F.col("named").isNull(), own))).first()
        spare = max(0.0, 1 - (sums[0] or 0.0))
        raw = both.withColumn("share", F.coalesce("named", F.lit(spare) * own / F.lit(float(sums[1] or 1.0))))
    scale = raw.agg(F.sum("share")).first()[0]
    return raw.select(name, own.alias("own"), (F.col("share") / F.lit(float(scale))).alias("share"))


def _feasible_frame(shares: DataFrame, budget: float) -> DataFrame:
    """feasible() as a table."""
    room = F.col("own") / F.lit(budget)
    while True:
        over, free, held = shares.agg(F.max(F.col("share") > room * (1 + 1e-12)), F.sum(F.when(F.col("share") < room, F.col("share"))), F.sum(F.when(F.col("share") >= room, room))).first()
        if not over:
            return shares
        shares = store(shares.withColumn("share", F.when(F.col("share") >= room, room).otherwise(F.col("share") * F.lit((1 - held) / free if free else 0.0))), "shares")


def _rake_frames(cells: DataFrame, targets: dict, budget: float) -> tuple[DataFrame, float]:
    """rake() by joins and aggregates: cells with w, and the budget that can be reached."""
    shares = {d: store(_shares_frame(cells, d, targets[d]), "shares") for d in DIMENSIONS}
    budget = min(budget, *[float(s.where("share > 0").agg(F.sum("own")).first()[0] or 0.0) for s in shares.values()])
    shares = {d: _feasible_frame(s, budget) for d, s in shares.items()}
    total = float(cells.agg(F.sum("tokens")).first()[0])
    cells = cells.withColumn("w", F.col("tokens") / F.lit(total))
    cap = F.col("tokens") / F.lit(total) / F.lit(budget)
    full, bounded = F.col("w") >= cap, F.least("w", cap)
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            have = cells.groupBy(d).agg(F.sum(bounded).alias("have"), F.sum(F.when(full, bounded).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(bounded)).alias("free")).join(shares[d], d)
            plain = F.when(F.col("have") > 0, F.col("share") / F.col("have")).otherwise(1.0)
            aside = (F.col("free") > 0) & (F.col("share") > F.col("held"))
            step = F.when(aside, (F.col("share") - F.col("held")) / F.col("free")).when(F.col("share") < F.col("have"), plain).otherwise(1.0)
            ratio = store(have.select(d, plain.alias("plain"), step.alias("ratio")), "ratios")
            worst = max(worst, ratio.agg(F.max(F.abs(F.col("plain") - 1))).first()[0] or 0.0)
            cells = cells.join(ratio.select(d, "ratio"), d).withColumn("w", F.least(F.col("w") * F.col("ratio"), cap * MOST)).drop("ratio")
        cells = store(cells, "raked")
        if worst < TOLERANCE:
            break
    return cells.withColumn("w", bounded), budget


def _calibrate(expected, budget: float, top: float) -> float:
    """The scale at which expected(scale) meets the budget, by bisection."""
    low, high = 0.0, top
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < budget else (low, middle)
    return high


def cell_probabilities(cells: DataFrame, targets: dict, budget_share: float, driver_cells: int) -> DataFrame:
    """cells (source, lang, topic, tokens) with w, the fitted share of all tokens, and probability."""
    spark = cells.sparkSession
    fields = [*DIMENSIONS, "tokens"]
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        rows = cells.select(*fields).toArrow().to_pylist()
        rows.sort(key=lambda r: tuple(r[d] for d in DIMENSIONS))
        if not rows:
            return cells.select(*fields).withColumns({"w": F.lit(0.0), "probability": F.lit(0.0)})
        tokens = np.array([r["tokens"] for r in rows], float)
        own = tokens / tokens.sum()
        codes, shares = [], []
        for d in DIMENSIONS:
            values = sorted({r[d] for r in rows})
            place = {v: i for i, v in enumerate(values)}
            code = np.array([place[r[d]] for r in rows])
            codes.append(code)
            shares.append(marginal([None if v == NONE else v for v in values], np.bincount(code, tokens, len(values)), targets[d]))
        budget_share = min(budget_share, *[float(own[(s > 0)[c]].sum()) for c, s in zip(codes, shares)])
        shares = [feasible(s, np.bincount(c, own, len(s)) / budget_share) for c, s in zip(codes, shares)]
        w = rake(np.column_stack(codes), tokens, shares, own / budget_share)
        multiplier = w / tokens * tokens.sum()
        top = 1 / max(multiplier[multiplier > 0].min(initial=1.0), 1e-12)
        scale = _calibrate(lambda s: float((tokens * np.minimum(1, s * multiplier)).sum()), budget_share * tokens.sum(), top)
        p = np.minimum(1, scale * multiplier)
        data = [(*(r[d] for d in DIMENSIONS), r["tokens"], float(a), float(b)) for r, a, b in zip(rows, w, p)]
        return spark.createDataFrame(data, "source string, lang string, topic string, tokens long, w double, probability double")
    raked, budget_share = _rake_frames(cells.select(*fields), targets, budget_share)
    total = float(raked.agg(F.sum("tokens")).first()[0])
    raked = store(raked.withColumn("m", F.col("w") / F.col("tokens") * F.lit(total)), "multipliers")
    least = raked.where("m > 0").agg(F.min("m")).first()[0] or 1.0

    def expected(scale: float) -> float:
        return raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(scale) * F.col("m")))).first()[0]

    low, high = 0.0, 1 / max(least, 1e-12)
    for _ in range(40):
        middle = math.sqrt(max(low, 1e-6 * high) * high) if high > 4 * max(low, 1e-300) else (low + high) / 2
        low, high = (middle, high) if expected(middle) < budget_share * total else (low, middle)
        if high - low < 1e-6 * high:
            break
    return raked.select(*fields, "w", F.least(F.lit(1.0), F.lit(high) * F.col("m")).alias("probability"))


def draw(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from a row's id (its text where the id is null)."""
    key = F.when(id_col.isNotNull(), F.xxhash64(id_col, F.lit(seed))).otherwise(F.xxhash64(text, F.lit(seed)))
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict, budget_share: float, seed: int = 1, driver_cells: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with topic, n_tokens, probability and sampled added.

    targets: per dimension either {value: share} or a power that tempers the tokens' own shares.
    A topic column of the table is used as it is. budget_share: of all tokens, in expectation.
    """
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col(text_col))
    clash = {"n_tokens", "probability", "sampled", "__source", "__lang", "__topic"}
    rows = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    keys = {"__source": F.col("source").cast("string"), "__lang": F.col("lang").cast("string"), "__topic": topic}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(NONE)) for k, v in keys.items()} | {"n_tokens": token_estimate(F.col(text_col))})
    cells = store(rows.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens")), "cells")
    p = cell_probabilities(cells, targets, budget_share, driver_cells)
    p = p.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "probability")
    out = rows.join(p, [f"__{d}" for d in DIMENSIONS])
    out = out.withColumn("sampled", draw(F.col(id_col), F.col(text_col), seed) < F.col("probability"))
    named = out if "topic" in docs.columns else out.withColumn("topic", F.col("__topic"))
    return named.drop(*[f"__{d}" for d in DIMENSIONS])
