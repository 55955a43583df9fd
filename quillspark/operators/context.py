"""Intent, budget and corpus compaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..functions.runs import cut
from ..plans.keep import keep
from . import neardup
from .retrieval import few, sized

# -- intent -----------------------------------------------------------------------------


def classify_intent(questions: DataFrame, question: str = "question") -> DataFrame:
    """B1, B2: intent, confidence, signals and keywords of each question."""
    padded = F.concat(F.lit(" "), T.strip(F.lower(question)), F.lit(" "))

    def hits(markers) -> Column:
        found = [F.when(F.contains(padded, F.lit(" " + m)) | F.contains(padded, F.lit(m + " ")), F.lit(m)) for m in markers]
        return F.sort_array(F.array_compact(F.array(*found)))

    # names are in alphabetical order, which is the order that breaks ties
    scored = F.array(*[F.struct(F.lit(k).alias("intent"), hits(m).alias("signals")) for k, m in sorted(W.INTENT_MARKERS.items())])
    rows = questions.withColumn("scored", scored)
    best = F.array_max(F.transform("scored", lambda s: F.size(s["signals"])))
    rows = rows.withColumn("best", best)
    rows = rows.withColumn("winners", F.expr("filter(scored, s -> best > 0 AND size(s.signals) = best)"))
    first = F.try_element_at("winners", F.lit(1))
    return rows.select(
        *questions.columns,
        F.coalesce(first["intent"], F.lit("factual")).alias("intent"),
        F.when(F.col("best") == 0, "medium").when((F.col("best") >= 2) | (F.size("winners") == 1), "high").otherwise("low").alias("confidence"),
        F.coalesce(first["signals"], F.array().cast("array<string>")).alias("signals"),
        F.slice(T.content_words(F.col(question)), 1, 24).alias("keywords"),
    )


# -- budget -----------------------------------------------------------------------------


@dataclass(frozen=True)
class BudgetPolicy:
    least_context: int = 256
    overhead: int = 160
    ram_headroom_mb: float = 512.0
    ram_floor_mb: float = 900.0
    warm_c: float = 78.0
    critical_c: float = 92.0
    busy_percent: float = 85.0
    most_passages: int = 12
    factors: dict = field(default_factory=lambda: {"factual": 0.55, "extraction": 0.65, "comparison": 0.90, "explanation": 0.80, "summary": 1.00, "drafting": 0.85})
    passages: dict = field(default_factory=lambda: {"factual": 4, "extraction": 5, "comparison": 8, "explanation": 6, "summary": 10, "drafting": 6})


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def ram_factor(available_mb: Column, footprint_mb: Column, p: BudgetPolicy = BudgetPolicy()) -> Column:
    """Linear from 0.35 to 1 over the memory that is left."""
    left = available_mb - p.ram_headroom_mb - footprint_mb
    linear = F.round(F.greatest(F.lit(0.35), 0.35 + 0.65 * (left / p.ram_floor_mb)), 4)
    return F.when(available_mb.isNull() | (available_mb <= 0), 1.0).when(left <= 0, 0.35).when(left >= p.ram_floor_mb, 1.0).otherwise(linear)


def thermal_factor(celsius: Column, p: BudgetPolicy = BudgetPolicy()) -> Column:
    """Linear from 1 to 0.4 between warm and critical; unknown is cool."""
    linear = F.round(F.greatest(F.lit(0.4), 1.0 - 0.6 * ((celsius - p.warm_c) / (p.critical_c - p.warm_c))), 4)
    return F.when(celsius.isNull() | (celsius < p.warm_c), 1.0).when(celsius >= p.critical_c, 0.4).otherwise(linear)


def cpu_factor(percent: Column, p: BudgetPolicy = BudgetPolicy()) -> Column:
    """Linear from 1 to 0.6 above the busy mark."""
    over = F.least(F.lit(1.0), (percent - p.busy_percent) / (100.0 - p.busy_percent))
    return F.when(percent.isNull() | (percent < p.busy_percent), 1.0).otherwise(F.round(F.greatest(F.lit(0.6), 1.0 - 0.4 * over), 4))


def budget(
    asked: DataFrame, context_tokens: int = 4096, output_tokens: int = 512, footprint_mb: float = 0.0,
    ram_mb: str = "available_ram_mb", celsius: str = "temperature_c", cpu: str = "cpu_percent", question: str = "question", p: BudgetPolicy = BudgetPolicy(),
) -> DataFrame:
    """Evidence token budget and passage limit of questions that carry intent and resources."""
    rows = asked.withColumns(
        {
            "overhead": F.lit(p.overhead) + T.token_count(F.col(question)),
            "ram": ram_factor(F.col(ram_mb), F.lit(footprint_mb), p),
            "thermal": thermal_factor(F.col(celsius), p),
            "cpu": cpu_factor(F.col(cpu), p),
            "intent_factor": _lookup(p.factors, F.col("intent"), 0.8),
        }
    )
    lowest = F.least("ram", "thermal", "cpu")
    rows = rows.withColumns({"base": F.greatest(F.lit(p.least_context), F.lit(context_tokens - output_tokens) - F.col("overhead")), "multiplier": lowest * F.col("intent_factor")})
    target = F.floor(F.col("base") * F.col("multiplier")).cast("int")
    most = F.least(F.lit(p.most_passages), _lookup(p.passages, F.col("intent"), 5))
    return rows.withColumns(
        {
            "evidence_tokens": F.greatest(F.lit(p.least_context), F.least(F.col("base"), target)),
            "max_passages": F.when(F.col("multiplier") < 0.5, F.greatest(F.lit(2), F.floor(most / 2).cast("int"))).otherwise(most),
            "limiting_factor": F.when(lowest >= 1.0, "model_context").when(F.col("ram") == lowest, "ram").when(F.col("thermal") == lowest, "thermal").otherwise("cpu"),
        }
    )


# -- compaction -------------------------------------------------------------------------


@dataclass(frozen=True)
class CompactPolicy:
    alike: float = 0.92
    fragment: int = 70
    least_words: int = 4


ORDER = neardup.ORDER


def marks(units: DataFrame, p: CompactPolicy = CompactPolicy()) -> DataFrame:
    """Units with what compaction asks of their texts: noise, content_key, figures, bucket, grams and chars.

    Content words are found once for all of it. To be written before it is read: a condition on a mark would be
    tried on the text itself. The steps below take marks where units bring them, and texts where not.
    """
    of = lambda w: F.struct(F.size(w).alias("n"), _key(w).alias("content_key"), *neardup.fingerprint(w))
    rows = units.withColumns({"found": T.let(T.content_words(F.col("text")), of), "boiler": _boilerplate(T.strip(F.col("text"))), "figures": T.numeric_signature(F.col("text")), "chars": F.length("text")})
    noise = F.col("boiler") | ((F.col("found.n") < p.least_words) & (F.col("kind") != "table"))
    return rows.select(*units.columns, noise.alias("noise"), "found.content_key", "figures", "found.bucket", "found.grams", "chars")


MARKS = ("noise", "content_key", "figures", "bucket", "grams", "chars")


def _boilerplate(body: Column) -> Column:
    out = F.lit(False)
    for pattern in W.BOILERPLATE:
        out = out | body.rlike("(?iU)" + pattern)
    return out


def drop_noise(units: DataFrame, p: CompactPolicy = CompactPolicy()) -> DataFrame:
    """Boilerplate lines and units of few content words go; tables stay."""
    if "noise" in units.columns:
        return units.where("NOT noise")
    body = T.strip(F.col("text"))
    thin = (F.size(T.content_words(body)) < p.least_words) & (F.col("kind") != "table")
    return units.where(~_boilerplate(body) & ~thin)


def _key(content: Column) -> Column:
    return F.sha2(F.array_join(content, " "), 256)


def content_key(text: Column) -> Column:
    return _key(T.content_words(text))


def drop_exact(units: DataFrame) -> DataFrame:
    """Of units with the same content words the first stays.

    The first of each key is a min aggregate, combined before the shuffle; a window would bring all
    units of a key to one task. The ids of the firsts are written, so that no reader of what is left splits
    texts again for them. Units that bring their keys meet the keys that repeat, where these are few enough to
    be broadcast: then no unit is shuffled.
    """
    if "content_key" in units.columns:
        repeated = units.groupBy("content_key").agg(F.min(F.struct(*ORDER)).alias("first"), F.count("*").alias("n"))
        repeated = keep(repeated.where("n > 1").select("content_key", "first"))
        if few(repeated):
            met = units.join(F.broadcast(repeated), "content_key", "left")
            return met.where(F.col("first").isNull() | (F.col("first") == F.struct(*ORDER))).select(*units.columns)
        keyed = units.select(*ORDER, "content_key")
    else:
        keyed = units.select(*ORDER, content_key(F.col("text")).alias("content_key"))
    first = keep(keyed.groupBy("content_key").agg(F.min(F.struct(*ORDER)).alias("first")).select("first.*"))
    return units.join(sized(first), list(ORDER), "left_semi")


def near_pairs(units: DataFrame, p: CompactPolicy = CompactPolicy()) -> DataFrame:
    """C4, candidates: pairs (a before b) of one bucket and one set of figures that are alike."""
    return neardup.pairs(units, p.alike)


def drop_near(units: DataFrame, p: CompactPolicy = CompactPolicy()) -> DataFrame:
    """C4: each unit in turn meets the first kept one like it; the one with fewer tokens goes."""
    gone, _ = neardup.settle(near_pairs(units, p))
    return units.join(sized(gone), list(ORDER), "left_anti")


def _fragments(units: DataFrame, fields: list[str], p: CompactPolicy) -> DataFrame:
    """doc_id and run: units (fields, chars, words) that become one.

    Units of one path in a row are folded by their lengths: a unit joins the one before where both,
    as far as they have grown, hold fewer tokens than a fragment.
    """
    text = F.col("text") if "text" in units.columns else None
    chars = F.col("chars") if "chars" in units.columns else F.length(text)
    words = F.col("words") if "words" in units.columns else T.word_total(text)
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    fresh = ~F.coalesce(F.lag("section_path").over(w) == F.col("section_path"), F.lit(False))
    rows = units.withColumn("fresh", fresh.cast("int")).withColumn("stretch", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sizes = [chars.alias("chars"), words.alias("words")]
    rows = rows.groupBy("doc_id", "stretch").agg(F.sort_array(F.collect_list(F.struct(*fields, *sizes))).alias("rows"))
    empty = F.struct(*[F.lit(0).alias(c) for c in ("chars", "words", "tokens")])

    def grown(s: Column, x: Column, joined: Column) -> Column:
        chars, words = s["chars"] + 1 + x["chars"], s["words"] + x["words"]
        both = F.struct(chars.alias("chars"), words.alias("words"), T.tokens_of(chars, words).alias("tokens"))
        return F.when(joined, both).otherwise(F.struct(x["chars"].alias("chars"), x["words"].alias("words"), x["token_estimate"].alias("tokens")))

    runs = cut(F.col("rows"), empty, lambda s, x: F.greatest(s["tokens"], x["token_estimate"]) < p.fragment, grown)
    return rows.select("doc_id", F.explode(runs).alias("run"))


def merge_fragments(units: DataFrame, p: CompactPolicy = CompactPolicy()) -> DataFrame:
    """Small units that follow each other in one section of one document are joined."""
    fields = ["ordinal", "unit_id", "kind", "text", "section_path", "token_estimate", "char_start", "char_end", "heading_level", "document_name"]
    out = _fragments(units, fields, p)
    first, last = F.get("run", F.lit(0)), F.get("run", F.size("run") - 1)
    text = F.array_join(F.transform("run", lambda x: x["text"]), "\n")
    out = out.select("doc_id", *[(text if c == "text" else last[c] if c == "char_end" else first[c]).alias(c) for c in fields], (F.size("run") > 1).alias("joined"))
    return out.withColumn("token_estimate", F.when(F.col("joined"), T.token_count(F.col("text"))).otherwise(F.col("token_estimate"))).drop("joined")


def merged_sizes(units: DataFrame, p: CompactPolicy = CompactPolicy()) -> DataFrame:
    """doc_id, unit_id and token_estimate of merge_fragments(), without the texts: units bring chars and words."""
    out = _fragments(units, ["ordinal", "unit_id", "token_estimate"], p)
    first = F.get("run", F.lit(0))
    total = lambda c: F.aggregate("run", F.lit(0), lambda a, x: a + x[c])
    # a line end stands between texts
    return out.select("doc_id", first["unit_id"].alias("unit_id"), F.when(F.size("run") > 1, T.tokens_of(total("chars") + F.size("run") - 1, total("words"))).otherwise(first["token_estimate"]).alias("token_estimate"))


def compression_ratio(tokens_in: Column, tokens_out: Column) -> Column:
    """C7."""
    return F.when(tokens_in <= 0, 0.0).otherwise(F.round(1 - tokens_out / tokens_in, 4))


def compact(units: DataFrame, p: CompactPolicy = CompactPolicy()) -> dict[str, DataFrame]:
    """The stages' results by name; the last is 'merged'."""
    noise = drop_noise(units, p)
    exact = drop_exact(noise)
    near = drop_near(exact, p)
    return {"input": units, "noise": noise, "exact": exact, "near": near, "merged": merge_fragments(near, p)}


def compaction_report(stages: dict[str, DataFrame]) -> DataFrame:
    """Units and tokens after each stage, and the ratio; more tokens than came in is an error."""
    out = None
    for k, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count("*").alias("units"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens")).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "units", "tokens")
        out = row if out is None else out.unionByName(row)
    # a few rows, one for each stage
    first = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.first("tokens").over(first)
    return out.withColumns({"compression_ratio": compression_ratio(before, F.col("tokens")), "grown": F.col("tokens") > before})
