"""MinHash near-dedup by bottom-k sketches of one hash function.

A document's set is its distinct `width`-word shingles, hashed once; its sketch is the K smallest
hashes. Inverted lists of the retained values bring together documents that share one: only values
of several documents count, and of a sketch only its rarest, as few as the overlap that a link needs
leaves over; so a common line or passage makes a list only of documents that consist of it. Within
a list documents are compared along its order of set sizes: the K smallest values of the union of
two sketches are a sketch of the union, and the share of them that both hold estimates the Jaccard
similarity. What the estimate does not rule out is a candidate: one spanning forest leaves each
list, never its pairs. The forests' components are checked exactly on whole texts, tile by tile.

How few values may be shared follows from K: of K values of a union each is shared with a chance of
`least` at least, and fewer than `fewest(least)` are with a chance of MISSED, as few as none of the
FIRST values with a chance of (1 - least) ** FIRST; so one link in 10 ** 11 would be lost.

The rarest and the most common list of a document come first. What they connect is known in part when
the other lists are read, and only lists that hold several such parts are compared, between those. A list of more
than CELL documents is dealt out by a hash first, and in the end part by part.

Defined results. Words are split and lower-cased as for SimHash. A text of fewer words than a
shingle is one shingle. A text of no words (null, empty, blanks) has an empty set and links with
nothing, not even its like. Equal sets are one node. Rows that share a doc_id are one document, so
whatever links to one of them is linked to all. Rows with a null doc_id have no component and are
kept. Long texts are shingled whole. An empty table gives an empty table. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_ROWS, few, gathered, join_spread, ready, sized, store
from .overlap import MEMBERS, TEXTS, _across, _checked, _edges, _placed, _union, shingles
from .simhash import _utf8, components

K = 64  # values that a sketch retains
FIRST = 16  # of them, among which sets that link share one at least
MISSED = 1e-11
CELL = 8192  # documents that one part of a list holds
PAIRS = 1 << 14  # compared at once


def fewest(least: float, k: int = K) -> int:
    """The number of shared values among the k smallest of a union that a Jaccard of `least` reaches all but surely."""
    below = 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * least**m * (1 - least) ** (k - m)
        if below > MISSED:
            return m
    return k


def needed(size: int, least: float, k: int = K) -> int:
    """Values that a sketch of this size must share with another for a link.

    A set held whole shares `least` of itself; where the union has more than k members, which are at
    most size / least, those beyond the sketch may be the shared ones.
    """
    return fewest(least, k) if size >= k else min(math.ceil(least * size - 1e-9), math.ceil(k * (2 - 1 / least) - 1e-9))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys, sizes, values, prints = [], [], [], []
                for data in _utf8(batch.column(1)):
                    hashes = shingles(data, width)
                    keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    values.append((hashes[:K] >> np.uint64(1)).astype(np.int64))
                    # equal values stay equal and greater ones are not smaller
                    prints.append(hashes[:K].astype(np.float32).tobytes())
                ends = np.cumsum([0, *map(len, values)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))
                columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), held, pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "sketch", "print"])

    return run


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the sketch of the union of two sketches (rows, ascending, filled up with inf) may be of a link."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < np.inf)
    seen = np.cumsum(again, axis=1)
    place = np.arange(1, both.shape[1]) - seen  # among the union's distinct values
    union = (both < np.inf).sum(axis=1) - seen[:, -1]
    shared = (again & (place < K)).sum(axis=1)
    return shared >= np.where(union < K, np.ceil(least * union - 1e-9), fewest(least))


def _linked(least: float):
    """Links within each list's part; rows come sorted by value, part and set size."""

    def links(t: pa.Table) -> pa.RecordBatch:
        value, part, n, node, component = (t.column(k).to_numpy() for k in range(5))
        raw = t.column(5).combine_chunks()
        lengths = np.diff(np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)) // 4
        sketch = np.full((len(node), K), np.inf, np.float32)
        sketch[np.arange(K) < lengths[:, None]] = np.frombuffer(b"".join(raw.to_pylist()), np.float32)
        cuts = np.flatnonzero((value[1:] != value[:-1]) | (part[1:] != part[:-1])) + 1
        bounds = np.concatenate(([0], cuts, [len(node)]))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        stop = bounds[1:][group]
        _, first, inverse = np.unique(np.stack([group, component]), axis=1, return_index=True, return_inverse=True)
        start = first[inverse.ravel()]
        label = start.copy()
        open_, apart = np.arange(len(node)), 1
        while len(open_):
            # sizes ascend within a part, so who is too small for one partner is too small for all after it
            open_ = open_[open_ + apart < stop[open_]]
            open_ = open_[n[open_] >= least * n[open_ + apart] - 1e-9]
            met = open_[label[open_] != label[open_ + apart]]
            for at in range(0, len(met), PAIRS):
                i = met[at : at + PAIRS]
                i = i[alike(sketch[i], sketch[i + apart], least)]
                _union(label, i, i + apart)
            apart += 1
        return _edges(node, label, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [c.to_numpy() for c in batch.columns[:2]]
            before = np.flatnonzero((ends[0] != ends[0][-1]) | (ends[1] != ends[1][-1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut or held and any(held[0].column(k)[0].as_py() != ends[k][0] for k in (0, 1)):
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _compared(rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Links within the parts that rows (value, part, node, component) are dealt to."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.join(nodes.select("node", "n", "print"), "node")
    whole = whole.select(*[F.col(c).cast("long").alias(c) for c in ("value", "part", "n", "node", "component")], "print")
    return store(whole.repartition(n, "value", "part").sortWithinPartitions("value", "part", "n", "node").mapInArrow(_linked(least), "u long, v long").distinct(), "sketch-links")


def _lists(nodes: DataFrame, least: float) -> DataFrame:
    """A written table of the inverted lists: node, value, place (0 for a node's rarest value, -1 for its most common)."""

    def values(rows: DataFrame, kept) -> DataFrame:
        return rows.select("node", "tag", F.explode(kept).alias("value"))

    def common(rows: DataFrame) -> DataFrame:
        return store(rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "sketch-values")

    # sets that share none of their first values are out before the rest is counted
    first = values(nodes, F.slice("sketch", 1, FIRST))
    hopeful = join_spread(first, common(first), ["value"], "df", _total(nodes, F.least(F.size("sketch"), F.lit(FIRST)))).select("node").distinct()
    left = nodes.join(sized(store(hopeful, "sketch-hopeful")), "node", "left_semi")
    every = values(left, F.col("sketch"))
    held = join_spread(every, common(every), ["value"], "df", _total(left, F.size("sketch"))).groupBy("node", "tag").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    # the tag's low byte is the sketch's size
    need = F.get(F.array(*[F.lit(needed(s, least)) for s in range(K + 1)]), F.col("tag").bitwiseAND(255).cast("int"))
    # all but `need` - 1 of a sketch, rarest first; values of one document come before these and make no list
    rare = F.slice("held", 1, F.size("held") - need + 1)
    placed = held.where(F.size("held") >= need).withColumn("rare", rare).select("node", F.size("rare").alias("most"), F.posexplode("rare").alias("place", "x"))
    return store(placed.select("node", F.when(F.col("place") == 0, 0).when(F.col("place") + 1 == F.col("most"), -1).otherwise(F.col("place")).alias("place"), "x.value"), "sketch-lists")


def _total(rows: DataFrame, size) -> int:
    return rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _connected(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of all linked nodes: the smallest node reachable, or with `rounds` one that is reached in so many.

    While the links are few enough for their labels to be broadcast, each round takes the least label around a
    node and that label's own label, with one shuffle; more links go by large-star and small-star steps. Nodes
    of one label are connected whatever the round.
    """
    links = store(links.distinct(), "sketch-edges")
    if rounds is None and not few(links, MOST_ROWS // 4):
        found = store(components(links), "sketch-components")
        roots = found.select(F.col("component").alias("node"), "component").distinct()
        return store(found.unionByName(roots), "sketch-labels")
    ends = [F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), "v")]
    both = links.select(F.explode(F.array(*ends)).alias("e")).select("e.u", "e.v")
    light = few(links, MOST_ROWS // 4)
    held = (lambda x: F.broadcast(x)) if light else (lambda x: x)
    labels, total, done = None, None, 0
    while rounds is None or done < rounds:
        around = both.withColumnRenamed("v", "label") if labels is None else both.join(held(labels.withColumnRenamed("node", "v")), "v")
        least = around.groupBy("u").agg(F.min("label").alias("label"))
        further = least.select(F.col("u").alias("label"), F.col("label").alias("low"))
        labels = store(least.join(held(further), "label").select(F.col("u").alias("node"), F.col("low").alias("component")).withColumnRenamed("component", "label"), "sketch-labels")
        done += 1
        if rounds is None:
            before, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
            if total == before or total is None:
                break
    return labels.withColumnRenamed("label", "component")


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _candidates(nodes: DataFrame, least: float) -> DataFrame:
    """(u, v) links whose components hold every pair of nodes that may be linked."""
    lists = _lists(nodes, least)
    first = lists.where("place <= 0")
    sizes = store(first.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "sketch-sizes")
    part = F.pmod(F.xxhash64("node", "value"), F.ceil(F.col("c") / CELL))
    rows = join_spread(first.select("node", "value"), sizes, ["value"], "c", first.count())
    links = _compared(rows.select("value", part.alias("part"), "node", F.col("node").alias("component")), nodes, least)
    known = store(_named(lists.select("node", "value"), _connected(links, rounds=1)), "sketch-known")
    crowded = _across(known.withColumn("most", F.lit(CELL)), ["value"], ["node", "value"])
    return links.unionByName(_compared(crowded, nodes, least))


def _verified(members: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links of the candidate groups (group, node, n) that hold on whole texts.

    A group of more than one tile is cut into tiles by one hash, then by another, and last, where it
    still holds several components, each tile of the largest meets each tile of the others.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    tiles = F.greatest(F.ceil(F.col("c") / F.lit(TEXTS)), F.ceil(F.col("m") / F.lit(MEMBERS))).cast("long")
    members = store(members.join(sizes.select("group", "c", tiles.alias("tiles")), "group"), "sketch-members")
    texts = store(gathered(texts).join(sized(members.select("node")), "node", "left_semi"), "sketch-texts")

    def compared(rows: DataFrame) -> DataFrame:
        return store(_placed(rows.join(texts, "node"), ["group", "part"], ["group", "part", "node", "component", "text"], _checked(width, least)).distinct(), "sketch-checked")

    cut = lambda *salt: F.pmod(F.xxhash64("node", *salt), F.col("tiles"))
    links = compared(members.withColumn("component", F.col("node")).withColumn("part", cut()))
    large = members.where("tiles > 1")
    if large.isEmpty():
        return links
    links = links.unionByName(compared(_named(large, _connected(links, rounds=1)).withColumn("part", cut(F.lit(1)))))
    share = F.greatest(F.lit(1.0), F.col("c") / F.col("tiles"))  # as the group's tiles hold
    rest = store(_named(large, _connected(links)), "sketch-known").withColumn("most", share)
    return links.unionByName(compared(_across(rest, ["group"], ["node", "group"])))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, least: float = 0.8) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included) and kept."""
    ready(docs.sparkSession)
    if not 0.8 <= least <= 1:
        raise ValueError("FIRST and K are laid out for a bound of 0.8 or more")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, key binary, n long, sketch array<long>, print binary"
    rows = store(gathered(plain).mapInArrow(_sketches(width), schema), "sketches")
    known = rows.where("doc_id IS NOT NULL AND n > 0")
    counted = known.groupBy("key", "doc_id").agg(F.count("*").alias("c")).groupBy("key").agg(F.min(F.struct("doc_id", "c")).alias("first"), F.sum("c").alias("rows"))
    same = store(counted.select("key", F.col("first.doc_id").alias("node"), F.col("first.c").alias("alike"), "rows"), "sketch-nodes")
    total = same.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # one row a set; sketches move only where the row of its smallest doc_id repeats
    repeated = store(same.where("rows > 1").select("key", "node", "alike"), "sketch-repeats")
    marked = known.join(sized(repeated), "key", "left")
    sets = marked.where("node IS NULL OR (doc_id = node AND alike = 1)")
    if not repeated.where("alike > 1").isEmpty():
        sets = sets.unionByName(marked.where("doc_id = node AND alike > 1").dropDuplicates(["key"]))
    tag = F.shiftleft(F.xxhash64("key"), 8).bitwiseOR(F.size("sketch"))
    nodes = sets.select(F.col("doc_id").alias("node"), tag.alias("tag"), "n", "sketch", "print")
    whole = _connected(_candidates(nodes, least)).withColumnRenamed("component", "group")
    members = whole.join(nodes.groupBy("node").agg(F.max("n").alias("n")), "node").select("group", "node", "n")
    texts = plain.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "node")
    links = _verified(members, texts, width, least)
    # rows that share a doc_id link the nodes of their sets
    several = store(known.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key < last").select("doc_id"), "sketch-doubles")
    ids = join_spread(known.select("doc_id", "key").join(sized(several), "doc_id").distinct(), same, ["key"], "rows", total).select("doc_id", "node")
    links = links.unionByName(ids.join(ids.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").select("u", F.col("node").alias("v")))
    named = store(same.join(_connected(links), "node", "left").select("key", "rows", F.coalesce("component", "node").alias("component_id")), "sketch-named")
    joined = join_spread(known.select("doc_id", "key", "n"), named, ["key"], "rows", total)
    # a row of no words takes the component of its doc_id's other rows, where it has any
    lone = rows.where("doc_id IS NULL OR n = 0").select("doc_id", "n")
    others = joined.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    lone = lone.join(others, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = joined.select("doc_id", "n", "component_id").unionByName(lone.select("doc_id", "n", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
