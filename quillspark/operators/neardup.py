"""Near-duplicate units (C4): candidates by rare shared grams, and the sequential rule as a fixpoint.

Two units are alike where bucket (shortest content word) and figures are equal and their sets of
four-word grams have a Jaccard similarity of `alike` or more. Such sets share all but a few grams, so
a unit with few shared grams among its smallest hashes is out at once. Of the rest a unit stays
if enough of its grams occur in other units at all, and meets others over the rarest of them only:
a passage that many units hold makes no pairs unless units consist of it.

The rule is sequential: each unit in turn meets the first kept one before it that is like it, and
the one with fewer tokens goes (the later, where they are equal). `settle` decides all units in rounds
of joins: a unit is decided as soon as the first unit before it that is not known to be gone is known
to be there, that is, has been decided itself and has no undecided rival with more tokens in between.
The first undecided unit always is, so a group takes as many rounds as its longest chain of rivals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.keep import keep
from .retrieval import sized

ORDER = ("doc_id", "ordinal")
FIRST = 16  # common grams, in order of their hashes, that a unit must show before all its grams are looked at


def fingerprint(w: Column) -> tuple[Column, Column]:
    """Bucket and sorted hashed grams of a unit's content words; without words no grams."""
    shortest = F.array_min(F.transform(w, lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))))["t"]
    runs = F.transform(F.slice(w, 1, F.size(w) - 3), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in (1, 2, 3)]))
    grams = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < 4, F.array(F.xxhash64(w))).otherwise(F.sort_array(F.array_distinct(runs)))
    return shortest.alias("bucket"), grams.alias("grams")


def fingerprints(units: DataFrame) -> DataFrame:
    """Bucket, figures and sorted hashed grams of each unit, its words found once, or not again where units bring them."""
    rows = units
    if "grams" not in units.columns:
        of = lambda w: F.struct(*fingerprint(w))
        rows = units.select(*ORDER, "token_estimate", T.numeric_signature(F.col("text")).alias("figures"), T.let(T.content_words(F.col("text")), of).alias("print"))
        rows = rows.select(*ORDER, "token_estimate", "figures", "print.*")
    return rows.select(*ORDER, "token_estimate", "figures", "bucket", "grams", F.size("grams").alias("n"))


def _least_shared(n: Column, alike: float) -> Column:
    """Grams that a set of n shares with any set like it; a tiny slack keeps rounding from raising it."""
    return F.ceil(n * F.lit(alike) - 1e-9).cast("int")


def _cells(rows: DataFrame, grams: Column) -> DataFrame:
    """A row for each of these grams: ids, n and the cell, which units of one bucket and figures share."""
    kin = rows.select(*ORDER, "n", F.xxhash64("bucket", "figures").alias("kin"), F.explode(grams).alias("gram"))
    return kin.select(*ORDER, "n", F.xxhash64("kin", "gram").alias("cell"))


def _shared(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.count("*").alias("df")).where("df > 1")


def pairs(units: DataFrame, alike: float = 0.92) -> DataFrame:
    """a before b, alike: their ids and tokens, bucket, figures and jaccard. Exact."""
    # a condition on what was made of a text would be tried on the text itself, and make it all twice
    rows = fingerprints(units)
    rows = (rows if "grams" in units.columns else keep(rows)).where("n > 0")  # units bring what is written already
    # sets alike differ in n - least at most: their first FIRST common grams are among so many more of each
    least = _least_shared(F.col("n"), alike)
    first = _cells(rows, F.slice("grams", 1, F.col("n") - least + FIRST))
    common = first.join(sized(keep(_shared(first).select("cell"))), "cell", "left_semi").groupBy(*ORDER).agg(F.max("n").alias("n"), F.count("*").alias("common"))
    hopeful = common.where(F.col("common") >= F.least(F.lit(FIRST), least)).select(*ORDER)
    rows = keep(rows.join(sized(keep(hopeful)), list(ORDER), "left_semi"))
    every = _cells(rows, F.col("grams"))
    # a unit's grams that others hold, the rarest first; those of its own come before them and meet nobody
    unit = Window.partitionBy(*ORDER).orderBy("df", "cell")
    held = every.join(sized(keep(_shared(every))), "cell").withColumns({"place": F.row_number().over(unit), "held": F.count("*").over(unit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    placed = held.where((F.col("held") >= least) & (F.col("place") <= F.col("held") - least + 1))
    placed = keep(placed.select(*ORDER, "n", "cell", (F.col("n") - F.col("held") + F.col("place") - 1).alias("at")))
    side = lambda s, *more: [F.col(c).alias(f"{s}_{c}") for c in (*ORDER, *more)]
    a, b = placed.select("cell", *side("a", "n", "at")), placed.select("cell", *side("b", "n", "at"))
    before = F.struct("a_doc_id", "a_ordinal") < F.struct("b_doc_id", "b_ordinal")
    # what is left from the places of the first common gram on bounds what two sets can share
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    enough = most * (1 + alike) >= (F.col("a_n") + F.col("b_n")) * alike - 1e-6
    ids = [f"{s}_{c}" for s in "ab" for c in ORDER]
    met = keep(a.join(b, "cell").where(before & enough).select(*ids).distinct())
    for s in "ab":
        met = met.join(rows.select(*side(s, "token_estimate", "grams", "bucket", "figures")), [f"{s}_{c}" for c in ORDER])
    met = met.where((F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_figures") == F.col("b_figures")))
    met = met.withColumn("common", F.array_size(F.array_intersect("a_grams", "b_grams"))).withColumn("jaccard", F.col("common") / (F.array_size("a_grams") + F.array_size("b_grams") - F.col("common")))
    like = F.explode(F.filter(F.array("jaccard"), lambda j: j >= alike)).alias("jaccard")
    return met.select(F.col("a_bucket").alias("bucket"), F.col("a_figures").alias("figures"), *[f"{s}_{c}" for s in "ab" for c in (*ORDER, "token_estimate")], like)


def settle(alike: DataFrame) -> tuple[DataFrame, int]:
    """The units that go (doc_id, ordinal), by the sequential rule over all pairs, and the rounds it took."""
    unit = lambda s: F.struct(F.col(f"{s}_doc_id").alias("doc_id"), F.col(f"{s}_ordinal").alias("ordinal")).alias(s)
    waiting = keep(alike.select(unit("a"), unit("b"), F.col("a_token_estimate").alias("ta"), F.col("b_token_estimate").alias("tb")))
    gone = keep(waiting.select("a", F.col("b").alias("gone_at")).limit(0))
    rounds = 0
    while not waiting.isEmpty():
        rounds += 1
        rival = waiting.where("tb > ta").groupBy("a").agg(F.min("b").alias("rival"))
        undecided = waiting.select(F.col("b").alias("a"), F.lit(True).alias("undecided")).distinct()
        seen = waiting.join(gone, "a", "left").where("gone_at IS NULL OR gone_at > b").join(rival, "a", "left").join(undecided, "a", "left")
        there = F.col("gone_at").isNotNull() | (F.col("undecided").isNull() & (F.col("rival").isNull() | (F.col("rival") >= F.col("b"))))
        seen = keep(seen.select("a", "b", "ta", "tb", there.alias("there")))
        meets = seen.groupBy("b").agg(F.min(F.struct("a", "there", "ta", "tb")).alias("m"))
        lost = meets.where("m.there").select(F.when(F.col("m.tb") <= F.col("m.ta"), F.col("b")).otherwise(F.col("m.a")).alias("a"), F.col("b").alias("gone_at"))
        gone = keep(gone.unionByName(lost))
        # whoever met one that is there is decided, and so is who has nobody left to meet
        waiting = keep(seen.join(meets.where("NOT m.there").select("b"), "b", "left_semi").select("a", "b", "ta", "tb"))
    return gone.select("a.doc_id", "a.ordinal"), rounds
