"""Merkle manifest of a dataset, its trees collapsed by higher-order SQL functions.

A leaf is the SHA-256 of a row's columns. The leaves of each group (a source) ascend by id; every
FAN consecutive nodes become their hash until one, the subroot, is left; the groups' subroots
become the root in the same way. Blocks of FAN ** LEVELS consecutive leaves are arrays: `sequence`
numbers a level's runs, `transform` and `slice` hash them, `aggregate` climbs the levels. A block's
root is a leaf of the next, smaller table of blocks, and so on; on the way back each block hands its
members the siblings that prove them. Positions come from ranges of sorted rows and a running sum
over the ranges' counts, so a group with a third of all rows is many ranges and many blocks, and no
task holds more of it than a range. Texts are hashed where they are read and never shuffled.

Defined results. A null column is `-`, an empty text `0:`; so they differ. Groups may be null, which
comes first. Rows that repeat an id are ordered by their leaf (identical rows get one proof each, and
any order of them gives the same trees). Null ids come first. A text is hashed whole, however long.
An empty table gives an empty table. Other columns are ignored, whatever their names. `tampered`
says which texts a reader would find changed; by default none is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import gathered, sized, store

FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
POWERS = [FAN**k for k in range(40)]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _power(exponent: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in POWERS]), exponent)


def _height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < n))


def _ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `pos`, the place among those of the same key in the given order, and `n`, their number."""
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    # the id holds the range's number and the place in it
    ranged = store(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "manifest-ranges")
    counts = ranged.groupBy(key, "range").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("c").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = store(counts.select(key, "range", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n")), "manifest-counts")
    return ranged.join(sized(counts), [key, "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """key, block, n, members (pos, node and payload in order) and depth, the levels that the block's tree has."""
    held = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
    out = held.agg(F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("members"), F.max("n").alias("n"))
    return out.withColumn("depth", F.least(F.lit(LEVELS), _height(F.col("n"))))


def _steps(depth: Column) -> Column:
    return F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), 1, depth)


def _levels(members: Column, depth: Column) -> Column:
    """The block's levels, its members' nodes first, its root last."""

    def above(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda run: F.sha2(F.array_join(F.slice(nodes, run * FAN + 1, F.lit(FAN)), ""), 256))

    leaves = F.transform(members, lambda m: m["node"])
    return F.aggregate(_steps(depth), F.array(leaves), lambda levels, _: F.concat(levels, F.array(above(F.get(levels, F.size(levels) - 1)))))


def _siblings(levels: Column, place: Column, depth: Column) -> Column:
    """For each level of the block, the joined siblings to the left and to the right of a member's ancestor."""

    def at(level: Column) -> Column:
        nodes, here = F.get(levels, level), F.floor(place / _power(level)).cast("int")
        left = here % FAN
        return F.struct(F.array_join(F.slice(nodes, here - left + 1, left), "").alias("left"), F.array_join(F.slice(nodes, here + 2, F.lit(FAN - 1) - left), "").alias("right"))

    return F.transform(_steps(depth), at)


def _climbed(nodes: DataFrame, payload: list[str], name: str) -> list[DataFrame]:
    """Written tables of blocks, the members first; the last holds one block, and so the root, of each key."""
    out = []
    while True:
        # nodes that are the last of their key stay as they are, until every key has come to its root
        blocks = store(_blocks(nodes, [] if out else payload), name)
        out.append(blocks)
        top = let(_levels(F.col("members"), F.col("depth")), lambda levels: F.get(F.get(levels, F.size(levels) - 1), 0))
        nodes = blocks.select("key", F.col("block").alias("pos"), top.alias("node"), F.ceil(F.col("n") / _power(F.col("depth"))).cast("long").alias("n"))
        most = blocks.agg(F.max("n")).first()[0]
        if most is None or most <= BLOCK:
            return [*out, nodes]


def _proved(blocks: list[DataFrame], above: DataFrame, payload: list[str]) -> DataFrame:
    """Members of the lowest blocks with their payload and all columns of `above`.

    above: one row a key with `path`, the siblings above the key's root; the members' paths start with their own.
    """
    carried = [c for c in above.columns if c not in ("key", "path")]
    for k in range(len(blocks) - 1, -1, -1):
        rows = blocks[k].join(above.withColumnRenamed("path", "upper"), ["key"] if k == len(blocks) - 1 else ["key", "block"])
        own = let(
            _levels(F.col("members"), F.col("depth")),
            lambda levels: F.transform("members", lambda m, i: F.struct(m.alias("m"), _siblings(levels, i, F.col("depth")).alias("path"))),
        )
        rows = rows.select("key", "upper", *carried, F.explode(own).alias("x"))
        names = [F.col(f"x.m.{c}").alias(c) for c in ("node", *(payload if k == 0 else []))]
        rows = rows.select("key", F.col("x.m.pos").alias("block"), *names, *carried, F.concat("x.path", "upper").alias("path"))
        above = rows if k == 0 else rows.select("key", "block", *carried, "path")
    return above


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(_field, values)), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "source", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof (siblings left and right, level by level), proof_sha256,
    folded_root (from the leaf of the text as `tampered` gives it, null for as it was) and verified."""
    changed = leaf(*[tampered if c == text_col and tampered is not None else F.col(c) for c in fields])
    kept = leaf(*[F.col(c) for c in fields])
    found = F.lit(None).cast("string") if tampered is None else F.when(~tampered.eqNullSafe(F.col(text_col)), changed)
    # a null group's key is empty, and so the first
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = _ranked(gathered(docs).select(key.alias("key"), F.col(id_col).alias("doc_id"), kept.alias("node"), found.alias("found")), "key", ["doc_id", "node"])
    *blocks, subroots = _climbed(leaves, ["doc_id", "found"], "manifest-blocks")
    # the groups' tree has one key; its members carry their group's key
    subroots = store(subroots.select(F.lit("").alias("all"), F.col("key").alias("group"), F.col("node")), "manifest-subroots")
    ranked = _ranked(subroots, "all", ["group"]).withColumnRenamed("all", "key")
    *upper, root = _climbed(ranked, ["group"], "manifest-groups")
    start = root.select("key", F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    groups = _proved(upper, start, ["group"]).select(F.col("group").alias("key"), F.col("node").alias("subroot"), "root", "path")
    rows = _proved(blocks, store(groups, "manifest-proofs"), ["doc_id", "found"])
    folded = F.aggregate("path", F.coalesce("found", "node"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
