"""URL filters: rules first, else empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. At each level a
beta-binomial prior is fitted by moments over the groups below it, and each group's rate is shrunk
towards its parent's: the suffix's prior is the corpus rate, the registered domain's prior centre
is its suffix's posterior mean, the host's is its registered domain's. A page is blocked where the
lower posterior bound (mean less z standard deviations) of its host's bad rate is above a limit,
which is a multiple of the corpus's rate unless it is given:
hosts that are known well enough to be bad, not hosts of which little is known. A host without
labels takes its registered domain's posterior, and so on up.

Hosts and rules are matched by equality on label suffixes, in DataFrame functions; counts are
combined before the shuffle, so a host with a third of all pages is one row per task.

Defined results. A url that is null or has no "://" has an empty host and path, no rule, and takes
the corpus's posterior. Repeated rows are judged each. A host of one label is its own registered
domain and suffix. Without labels nothing is blocked by reputation. An empty table gives an empty
table. Columns named host, path, rule, verdict, bad_rate or bad_bound, in any case, are replaced;
all others are returned untouched. Urls are read whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, store

# Suffixes of two labels under which names are registered: fixed values, a parameter below.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # starts with a slash

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):  # the longest is tested first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def posteriors(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Beta posteriors (a, b) per level from outcomes (host, bad 0/1); 'all' is the corpus's.

    Each level's prior strength is a method-of-moments fit of the beta-binomial, one row of sums.
    """
    counts = outcomes.groupBy("host").agg(F.sum(F.col("bad").cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    # every level reads the counts and the level above it again, so both are written once
    counts = store(counts.select(F.col("host"), domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "k", "n"), "host-counts")
    # one pseudo-outcome of either kind keeps every rate inside (0, 1)
    corpus = counts.agg((F.coalesce(F.sum("k"), F.lit(0.0)) + 0.5).alias("a"), (F.coalesce(F.sum("n") - F.sum("k"), F.lit(0.0)) + 0.5).alias("b"))
    out, parent = {"all": corpus}, None
    for level in LEVELS:
        names = [x for x in ("suffix", "domain", "host") if LEVELS.index(x) <= LEVELS.index(level)]
        own = counts.groupBy(*names).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        if parent is None:  # the corpus's one row, read on the driver: it has two numbers
            row = corpus.first()
            centred = own.withColumn("p0", F.lit(row["a"] / (row["a"] + row["b"])))
        else:
            above = LEVELS[LEVELS.index(level) - 1]
            keys = names[:-1]
            centred = own.join(parent.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("p0")), keys)
        # E[(k - n p)^2] = n p (1 - p) (1 + (n - 1) rho), rho = 1 / (strength + 1)
        spread = centred.agg(
            F.sum((F.col("k") - F.col("n") * F.col("p0")) ** 2 - F.col("n") * F.col("p0") * (1 - F.col("p0"))).alias("over"),
            F.sum(F.col("n") * (F.col("n") - 1) * F.col("p0") * (1 - F.col("p0"))).alias("room"),
        ).first()
        rho = min(0.9, max(1e-3, (spread["over"] or 0.0) / spread["room"])) if spread["room"] else 0.5
        strength = 1 / rho - 1
        parent = centred.select(*names, (F.col("p0") * strength + F.col("k")).alias("a"), ((1 - F.col("p0")) * strength + F.col("n") - F.col("k")).alias("b"))
        parent = out[level] = store(parent, f"{level}-posteriors")
    return out


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float | None = None, z: float = 1.645, url_col: str = "url", times: float = 1.5) -> DataFrame:
    """pages with host, path, rule, verdict, bad_rate and bad_bound.

    outcomes: url and bad (0/1) of labelled pages. limit: `times` the corpus's rate where None.
    """
    known = posteriors(outcomes.where("bad IS NOT NULL").select(host_of(F.col("url")).alias("host"), "bad"))
    clash = {"host", "path", "rule", "verdict", "bad_rate", "bad_bound"}
    kept = pages.drop(*[c for c in pages.columns if c.lower() in clash])
    url = F.col(url_col)
    rows = kept.withColumns({"host": host_of(url), "path": path_of(url)})
    row = known["all"].first()
    limit = times * row["a"] / (row["a"] + row["b"]) if limit is None else limit
    # one row for each host that occurs, so the page rows meet hosts once
    hosts = rows.select("host").distinct().select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    for level in LEVELS:
        hosts = hosts.join(known[level].select(level, F.struct("a", "b").alias(f"by_{level}")), level, "left")
    hosts = hosts.select("host", F.coalesce("by_host", "by_domain", "by_suffix", F.struct(F.lit(row["a"]).alias("a"), F.lit(row["b"]).alias("b"))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    rate = a / (a + b)
    # written, so that the join deals out both sides itself and can split a host with a third of all pages
    hosts = store(hosts.select("host", rate.alias("bad_rate"), (rate - z * F.sqrt(rate * (1 - rate) / (a + b + 1))).alias("bad_bound")), "host-bounds")
    found = matched_rule(F.col("host"), F.col("path"), rules)
    return (
        rows.join(hosts, "host")
        .withColumn("found", found)
        .withColumns({"rule": F.col("found.rule"), "verdict": F.coalesce("found.verdict", F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))})
        .drop("found")
    )
