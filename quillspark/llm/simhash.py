"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts.
Fingerprints within `radius` bits of each other agree on all but `radius` of any number of bit
blocks, so each fingerprint is dealt to one cell for each choice of the others and their values.
More blocks make longer keys and so smaller cells, but more of them; their number grows with the
corpus so that a cell keeps about SHARE fingerprints. A cell is sorted by population count and
cut into tiles; tile pairs whose population counts differ by more than the radius are skipped.
A cell with too many fingerprints is itself dealt out tile pair by tile pair, again only for
population counts within the radius, so no task holds more than two tiles' rows of a hot cell.
Every cell returns a spanning forest of its links, at most one link per fingerprint, and
connected components are found by alternating large-star and small-star steps over those links.

Defined results. A text of no words (null, empty, blanks) has fingerprint zero and links like any
other. A text of fewer words than a shingle is one shingle. Equal fingerprints are one node, so
copies are never paired. Rows with a null doc_id get a fingerprint and no component. Rows that
share a doc_id are one node in the component graph. An empty table gives an empty table. Texts are
shingled whole, however long. `drop_near_copies` returns all columns untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_ROWS, Scratch, gathered, join_spread, ready, sized, store, unused

TILE = 512
CELL = 8192  # fingerprints that one cell may hold before it is dealt out by tile pairs
SHARE = 1024  # fingerprints in a cell for which another block is added
SEED = 42


def fingerprint(data: bytes, width: int = 4) -> int:
    """SimHash of one UTF-8 text: bits set in over half of its shingles' XXH64 values."""
    words = data.lower().split()  # bytes: lower-cases A-Z only, splits at ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _utf8(column: pa.Array) -> Iterator[bytes]:
    return (b"" if x is None else x for x in column.cast(pa.binary()).to_pylist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fp (the unsigned fingerprint's bits as a signed long) of every row."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, width) for x in _utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return gathered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, pops: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Root position of each fingerprint in one cell; rows come sorted by population count.

    side: 0 compares everything with everything; else 1 with 2 only.
    """
    label = np.arange(len(fps))

    def union(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = label[i], label[j]
            split = a != b
            if not split.any():
                return
            i, j, a, b = i[split], j[split], a[split], b[split]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(flat := label[label], label):
                label[:] = flat

    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    for a in range(0, len(left), TILE):
        rows = left[a : a + TILE]
        low, high = pops[rows[0]] - radius, pops[rows[-1]] + radius
        for b in range(0, len(right), TILE):
            cols = right[b : b + TILE]
            if pops[cols[-1]] < low or pops[cols[0]] > high or (side[rows[0]] == 0 and cols[-1] < rows[0]):
                continue
            i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= radius)
            union(rows[i], cols[j])
    return label


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and population count; a cell may span batches."""
        held: list[np.ndarray] = []

        def links(data: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((data[1:, :3] != data[:-1, :3]).any(axis=1)) + 1
            out_u, out_v = [], []
            for part in np.split(data, cuts):
                if len(part) > 1:
                    root = _forest(part[:, 4].view(np.uint64), part[:, 3], part[:, 6], radius)
                    moved = root != np.arange(len(root))
                    out_u.append(part[moved, 5])
                    out_v.append(part[root[moved], 5])
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_u, out_v))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if held and (data[-1, :3] == held[0][0, :3]).all():
                held.append(data)
                continue
            data = np.concatenate([*held, data])
            last = np.flatnonzero((data[:, :3] != data[-1, :3]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [np.ascontiguousarray(data[cut:])]
            if cut:
                yield links(data[:cut])
        if held:
            yield links(np.concatenate(held))

    return run


def block_count(n: int, radius: int) -> int:
    """The fewest blocks, radius + 1 at least, whose cells hold about SHARE of n fingerprints."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > SHARE:
        blocks += 1
    return blocks


def link_forest(nodes: DataFrame, radius: int = 4, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """(u, v) node links that connect exactly what lies within `radius` bits, directly or in steps.

    nodes: fp, node (distinct fingerprints), a written table. blocks defaults to `block_count`.
    """
    blocks = blocks or block_count(nodes.count(), radius)
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(F.shiftleft("fp", 64 - b), 64 - b + a) for a, b in zip(cuts, cuts[1:])]
    values = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(0).cast("long")
        for c in chosen:
            value = F.shiftleft(value, cuts[c + 1] - cuts[c]).bitwiseOR(part[c])
        values.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
    dealt = nodes.select("fp", "node", F.bit_count("fp").alias("pop"), F.explode(F.array(*values)).alias("k")).select("k.block", "k.value", "pop", "fp", "node")
    # only cells over the limit reach these two small tables
    sizes = dealt.groupBy("block", "value", "pop").agg(F.count("*").alias("n"))
    hot = sizes.groupBy("block", "value").agg(F.sum("n").alias("total")).where(F.col("total") > cell)
    tiles = store(
        sizes.join(hot, ["block", "value"]).select("block", "value", F.col("pop").alias("tile_pop"), F.ceil(F.col("n") / cell).cast("int").alias("parts")),
        "simhash-tiles",
    )
    keys = tiles.select("block", "value").distinct()
    plain = dealt.join(keys, ["block", "value"], "left_anti").select("block", "value", F.lit(0).cast("long").alias("pair"), "pop", "fp", "node", F.lit(0).alias("side"))
    # a hot cell: each row goes to the tile pairs (own tile, other tile) within the radius
    own = tiles.select("block", "value", F.col("tile_pop").alias("pop"), F.col("parts").alias("own_parts"))
    rows = dealt.join(own, ["block", "value", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("own_parts")).cast("int"))
    others = tiles.select("block", "value", "tile_pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("tile_part"))
    mine, other = (F.col(a).cast("long") * 1_000_000 + F.col(b) for a, b in (("pop", "part"), ("tile_pop", "tile_part")))
    first, second = F.least(mine, other), F.greatest(mine, other)
    split = (
        rows.join(others, ["block", "value"])
        .where(F.abs(F.col("pop") - F.col("tile_pop")) <= radius)
        .select("block", "value", (first * 100_000_000 + second).cast("long").alias("pair"), "pop", "fp", "node", F.when(mine == other, 0).when(mine < other, 1).otherwise(2).alias("side"))
    )
    cells = plain.unionByName(split)
    columns = [F.col(c).cast("long") for c in ("block", "value", "pair", "pop", "fp", "node", "side")]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.select(*columns).repartition(n, "block", "value", "pair").sortWithinPartitions("block", "value", "pair", "pop").mapInArrow(_links(radius), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every linked node that is not itself smallest.

    Alternating large-star and small-star steps; each round cuts its lineage in the shared folder
    and stops when the links no longer change.
    """
    rounds = Scratch("links")
    edges = rounds.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def met(e: DataFrame, count: int) -> DataFrame:
        """e with each u's smallest neighbour m; the centre of a large star is broadcast, not shuffled."""
        lows = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        return join_spread(e, store(lows, "lows"), ["u"], "degree", count) if count > MOST_ROWS else e.join(lows, "u")

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = met(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        if before[0] > MOST_ROWS:
            large = store(large, "large-star")
        small = met(large, before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = rounds.keep(small.where("u <> v").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """Per row: doc_id, fp, component_id (smallest doc_id reachable, itself included)."""
    rows = store(fingerprints(docs, id_col, text_col, width), "fingerprints")
    known = rows.where("doc_id IS NOT NULL")
    nodes = store(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "nodes")
    found = components(link_forest(nodes.select("fp", "node"), radius))
    named = store(nodes.join(found, "node", "left").select("fp", "rows", F.coalesce("component", "node").alias("component_id")), "named")
    joined = join_spread(known, named, ["fp"], "rows", rows.count()).select("doc_id", "fp", "component_id")
    return joined.unionByName(rows.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """The document with the smallest doc_id of each group, with all its columns.

    Rows that share a doc_id stay or go together; rows with a null doc_id stay.
    """
    (gone,) = unused(docs, "gone")
    groups = near_groups(docs, id_col, text_col, radius, width)
    lesser = store(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "near-copies")
    return docs.join(sized(lesser), F.col(id_col) == F.col(gone), "left_anti")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
