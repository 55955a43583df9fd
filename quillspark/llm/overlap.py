"""SimHash near-dedup at a Jaccard bound: wide fingerprints, tiled comparison, exact check.

Links are pairs whose sets of `width`-word shingles overlap by `least` or more, computed exactly
from both texts; SimHash finds the candidates. A fingerprint of 64 bits cannot stand for a bound of
0.8 (pairs at 0.8 differ in 9.7 +- 2.9 of 64 bits), so a set gets several 64-bit SimHashes under
different seeds. Two sets at 0.8 differ in a bit with a chance of 0.1515 at most. Bits are cut into
`bands`; sets that agree on a whole band meet in that band's cell, and a pair at 0.8 misses all
cells with a chance of MISSED, wider pairs with less. Bands get longer, and more of them are taken,
as the corpus grows, so that a cell keeps about SHARE sets.

Inside a cell, sets sorted by population count are cut into tiles, which are compared with numpy
exclusive-or and bit counts over the first 256 bits; tile pairs whose population counts differ
beyond the radius are skipped. A cell gives a spanning forest of what lies within the radius, never
its pairs; the forests' components are the candidate groups. A cell of more than CELL sets is first
cut by a hash of its own, and then, where it still holds several components, each part of the
largest is compared with each part of the others.

Groups are checked exactly: the texts of a tile of a group meet in one task, the sizes of all
their sets' intersections are one product of 0/1 matrices, and again only a spanning forest leaves
the task. A group of more than one tile is cut by one hash, then by another, and last, where it
still holds several components, each tile of the largest is compared with each tile of the others.

Defined results. Words are split and lower-cased as for SimHash. A text of fewer words than a
shingle is one shingle; texts of no words (null, empty, blanks) are copies of each other. Texts of
one shingle set are one node. Groups are connected components. Rows with a null doc_id stay. Rows
that share a doc_id stay or go together. Long texts are shingled whole. An empty table gives an
empty table. `drop_near_copies` returns all columns untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, join_spread, ready, sized, store, unused
from .simhash import SEED, TILE, _majority, _utf8, components

APART, MISSED = 0.1515, 0.002  # a bit's chance to differ at 0.8; chance that a pair at 0.8 shares no cell
WORDS, RADIUS = 4, 62  # 64-bit words that tiles compare; four standard deviations over the mean at 0.8
LEAST_BITS, SHARE = 12, 512  # of a band; sets in a cell for which a band gets a bit longer
CELL = 8192
TEXTS, MEMBERS = 256, 1 << 20  # texts, and shingles of them, that a tile of a group holds
PRINTS = [f"fp{k}" for k in range(WORDS)]


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of a UTF-8 text's shingles."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def layout(n: int) -> tuple[int, int, int]:
    """Bits of a band, bands, and 64-bit words of a fingerprint, for a corpus of n rows."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n) / SHARE)))
    bands = math.ceil(math.log(MISSED) / math.log1p(-((1 - APART) ** bits)))
    return bits, bands, -(-bits * bands // 64)


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` SimHashes of a set, one for each reseeding of its members' hashes."""
    out = np.empty(words, np.uint64)
    for k in range(words):
        h = hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        out[k] = _majority(h)
    return out


def bands_of(fingerprints: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The bands' values, a row for each fingerprint (a row of 64-bit words)."""
    flat = np.unpackbits(fingerprints.view(np.uint8), axis=1, bitorder="little")[:, : bits * bands]
    return flat.reshape(len(fingerprints), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _sets(width: int, bits: int, bands: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys, sizes, prints = [], [], np.zeros((batch.num_rows, words), np.uint64)
                for row, data in enumerate(_utf8(batch.column(1))):
                    hashes = shingles(data, width)
                    keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    if len(hashes):
                        prints[row] = wide_fingerprint(hashes, words)
                values = bands_of(prints, bits, bands)
                ends = np.cumsum(np.where(np.array(sizes) > 0, bands, 0))
                found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values[np.array(sizes) > 0].ravel()))
                first = [pa.array(prints[:, k].view(np.int64)) for k in range(WORDS)]
                columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *first, found]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", *PRINTS, "bands"])

    return run


CELLS = ("band", "value", "part", "pop", "node", "n", "component", *PRINTS)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree on the first `keys` columns, which they come sorted by; they may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.to_numpy() for c in batch.columns[:keys]], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if held and (key[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-1] if len(cuts) else 0))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the labels of all pairs (i, j)."""
    while len(i):
        a, b = label[i], label[j]
        split = a != b
        i, j, a, b = i[split], j[split], a[split], b[split]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(flat := label[label], label):
            label[:] = flat


def _edges(node: np.ndarray, label: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """(u, v) from one row of each component that a label joins to others, to the label's smallest node.

    Cells that hold the same sets so give the same links, whatever order their rows came in.
    """
    smallest = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, node)
    one = np.flatnonzero(start == np.arange(len(node)))
    joined = np.bincount(label[one], minlength=len(node))[label[one]] > 1
    u, v = node[one[joined]], smallest[label[one[joined]]]
    return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])


def _starts(component: np.ndarray) -> np.ndarray:
    """First place of each row's component."""
    _, first, inverse = np.unique(component, return_index=True, return_inverse=True)
    return first[inverse]


def _forest(least: float):
    """Links between the components of each cell's rows, which come sorted by population count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            if table.num_rows < 2:
                continue
            pop, node, n, component = (table.column(k).to_numpy() for k in range(3, 7))
            fp = np.column_stack([c.to_numpy() for c in table.columns[7:]]).view(np.uint64)
            start = _starts(component)
            label = start.copy()
            for a in range(0, len(node), TILE):
                rows = slice(a, a + TILE)
                for b in range(a, -1, -TILE):
                    cols = slice(b, b + TILE)
                    if pop[rows][0] - pop[cols][-1] > RADIUS:
                        break  # those before are still further away
                    if (label[rows] == label[a]).all() and (label[cols] == label[a]).all():
                        continue
                    apart = np.zeros((len(node[rows]), len(node[cols])), np.int16)
                    for w in range(WORDS):
                        apart += np.bitwise_count(fp[rows, None, w] ^ fp[None, cols, w])
                    i, j = np.nonzero(apart <= RADIUS)
                    i, j = i + a, j + b
                    # a Jaccard bound bounds the ratio of the sizes
                    alike = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
                    _union(label, i[alike], j[alike])
            yield _edges(node, label, start)

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the members that several sets hold."""
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keep = count[code] > 1
    owner, code = owner[keep], (np.cumsum(count > 1) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 8192):
        a, b = np.searchsorted(code, (first, first + 8192))
        block = np.zeros((len(sets), 8192), np.float32)
        block[owner[a:b], code[a:b] - first] = 1
        out += block @ block.T
    return out


def _checked(width: int, least: float):
    """Links between the components of each tile's texts that overlap by `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            node, component = (table.column(k).to_numpy() for k in (2, 3))
            start = _starts(component)
            if (start == 0).all():
                continue
            sets = [shingles(x, width) for x in _utf8(table.column(4).combine_chunks())]
            size = np.array([len(x) for x in sets])
            both = _shared(sets)
            union = size[:, None] + size[None, :] - both
            label = start.copy()
            _union(label, *np.nonzero(np.where(union == 0, True, both >= least * union - 1e-9)))
            yield _edges(node, label, start)

    return run


def _placed(df: DataFrame, keys: list[str], columns: list[str], run) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*columns).repartition(n, *keys).sortWithinPartitions(*columns[: len(keys) + 1]).mapInArrow(run, "u long, v long")


def _tiled(cells: DataFrame, least: float) -> DataFrame:
    cells = cells.select(*[F.col(c).cast("long").alias(c) for c in CELLS])
    return _placed(cells, list(CELLS[:3]), list(CELLS), _forest(least))


def _dealt(nodes: DataFrame) -> DataFrame:
    """A row for each set and band; population counts are of the bits that tiles compare."""
    pop = sum((F.bit_count(c) for c in PRINTS[1:]), F.bit_count(PRINTS[0]))
    return nodes.select("node", "n", "component", *PRINTS, pop.alias("pop"), F.posexplode("bands").alias("band", "value"))


def _across(rows: DataFrame, keys: list[str], salt: list[str]) -> DataFrame:
    """Rows whose components differ so placed that any two of them meet in some part of their group.

    A column `most` of the rows says how many a part holds. Parts are numbered by (part of the largest component, part of the
    others) and, for the others among themselves, below zero by pairs of their parts; the largest
    component's rows do not meet each other. Groups of one component are dropped.
    """
    sizes = rows.groupBy(*keys, "component").agg(F.count("*").alias("c"), F.max("most").alias("most"))
    groups = sizes.groupBy(*keys).agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("k"), F.max("most").alias("most"))
    up = lambda x: F.greatest(F.lit(1), F.ceil(x / F.col("most"))).cast("long")
    groups = groups.where("k > 1").select(*keys, F.col("top.component").alias("largest"), up(F.col("top.c")).alias("mine"), up(F.col("all") - F.col("top.c")).alias("others"))
    rows = rows.join(sized(store(groups, "open-groups")), keys)
    cut = lambda k: F.pmod(F.xxhash64(*salt), k)
    a, b = F.col("mine"), F.col("others")
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    mine = F.transform(upto(b), lambda o: cut(a) * b + o)
    met = F.transform(upto(a), lambda m: m * b + cut(b))
    among = F.transform(upto(b), lambda o: -1 - (F.least(o, cut(b)) * b + F.greatest(o, cut(b))))
    return rows.withColumn("part", F.explode(F.when(F.col("component") == F.col("largest"), mine).otherwise(F.concat(met, among))))


def _candidate_groups(nodes: DataFrame, least: float) -> DataFrame:
    """(node, component): components of what lies within the radius, for nodes that are not alone in theirs."""
    dealt = _dealt(nodes.withColumn("component", F.col("node")))
    hot = store(dealt.groupBy("band", "value").agg(F.count("*").alias("size")).where(F.col("size") > CELL), "hot-cells")
    part = F.coalesce(F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / F.lit(CELL))), F.lit(0))
    links = store(_tiled(dealt.join(sized(hot), ["band", "value"], "left").withColumn("part", part), least).distinct(), "candidate-links")
    found = components(links)
    if hot.isEmpty():
        return found
    met = nodes.join(store(found, "candidates"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    crowded = _dealt(met).join(sized(hot.drop("size")), ["band", "value"], "left_semi")
    more = _tiled(_across(crowded.withColumn("most", F.lit(CELL)), ["band", "value"], ["node", "band"]), least)
    return components(links.unionByName(store(more, "candidate-links")))


def _verified(members: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links of the candidate groups (group, node, n) that hold exactly."""
    sizes = members.groupBy("group").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    tiles = F.greatest(F.ceil(F.col("c") / F.lit(TEXTS)), F.ceil(F.col("m") / F.lit(MEMBERS))).cast("long")
    members = store(members.join(sizes.select("group", "c", tiles.alias("tiles")), "group"), "members")
    texts = store(gathered(texts).join(sized(members.select("node")), "node", "left_semi"), "group-texts")
    columns = ["group", "part", "node", "component", "text"]

    def compared(rows: DataFrame) -> DataFrame:
        # distinct, so that the few links are written by few tasks
        return store(_placed(rows.join(texts, "node"), ["group", "part"], columns, _checked(width, least)).distinct(), "checked-links")

    alone = members.withColumn("component", F.col("node"))
    links = compared(alone.withColumn("part", F.pmod(F.xxhash64("node"), F.col("tiles"))))
    large = members.where("tiles > 1")
    if large.isEmpty():
        return links

    def known() -> DataFrame:
        found = store(components(links), "checked-components")
        return large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    links = links.unionByName(compared(known().withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")))))
    share = F.greatest(F.lit(1.0), F.col("c") / F.col("tiles"))  # as the group's tiles hold
    return links.unionByName(compared(_across(known().withColumn("most", share), ["group"], ["node", "group"])))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable, itself included) of every row with a doc_id."""
    ready(docs.sparkSession)
    if not 0.8 <= least <= 1:
        raise ValueError("bands and radius are laid out for a bound of 0.8 or more")
    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = plain.count()
    schema = f"doc_id long, key binary, n long, {', '.join(f'{c} long' for c in PRINTS)}, bands array<long>"
    rows = store(gathered(plain).mapInArrow(_sets(width, *layout(total)), schema), "shingle-sets")
    same = store(rows.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "shingle-nodes")
    named = join_spread(rows.select("doc_id", "key"), same, ["key"], "rows", total).select("doc_id", "node")
    sets = rows.join(same.select("key", F.col("node").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    nodes = store(sets.select(F.col("doc_id").alias("node"), "n", *PRINTS, "bands"), "shingle-prints")
    found = store(_candidate_groups(nodes, least), "candidate-groups")
    # the smallest node of a group names it, and is not among those found
    whole = found.select("node", F.col("component").alias("group")).unionByName(found.select(F.col("component").alias("node"), F.col("component").alias("group")).distinct())
    members = whole.join(nodes.groupBy("node").agg(F.max("n").alias("n")), "node").select("group", "node", "n")
    links = _verified(members, plain.withColumnRenamed("doc_id", "node"), width, least)
    # rows that share a doc_id link all of its nodes
    ids = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.collect_set("node").alias("vs")).where(F.size("vs") > 1).select("u", F.explode("vs").alias("v"))
    whole = components(links.unionByName(ids))
    return named.join(whole, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The document with the smallest doc_id of each group, with all its columns."""
    (gone,) = unused(docs, "gone")
    groups = near_groups(docs, id_col, text_col, width, least)
    lesser = store(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "near-copies")
    return gathered(docs).join(sized(lesser), F.col(id_col) == F.col(gone), "left_anti")
