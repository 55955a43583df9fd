"""Exact dedup through an extendible-hash index on shared files (DataFrame functions only).

The 64-bit hash of each normalised text addresses a directory of bucket pointers by its leading
bits. A bucket that holds more distinct keys than its capacity is split by one more bit; when its
local depth passes the directory's, the directory doubles. Pointers route the keys to owner tasks,
each of which takes a range of buckets, and so of keys, and writes it as one sorted file of the
index. Only where a key occurs more than once are texts read again: they go to the bucket's owner,
which compares them byte for byte and chains distinct texts that share a hash. A key that holds
many rows is combined before the shuffle, so a text that holds a third of all rows reaches its
owner as one row from each map task.

Defined results. A null text counts as empty; empty texts are copies of each other. Of equal texts
the row with the largest doc_id stays (a null doc_id is smaller than any other). Rows that repeat
doc_id and text are equally good: `exact_groups` marks all of them kept, `drop_copies` keeps one.
An empty table gives an empty table. A text is normalised and compared whole, however long. Columns
other than the id and the text are ignored by `exact_groups` and returned untouched by
`drop_copies`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, columns, few, gathered, sized, store, unused

LEAST = 256  # keys that a bucket may hold at least, and the number of buckets that a directory aims at
BUCKETS = 4096
BIG, LEAST_HOT = 10_000, 1000  # groups of a BIGth of all rows count as hot: there are BIG of them at most
MOST_ENTRIES = 250_000  # entries (about 130 bytes each) that may be broadcast


@dataclass(frozen=True)
class Directory:
    """Buckets by (prefix, local depth); global_depth is the largest local depth."""

    global_depth: int
    buckets: tuple[tuple[int, int, int], ...]  # prefix, local depth, distinct keys


def _prefix(depth: int):
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned("h", 64 - depth)


def build_directory(keys: DataFrame, capacity: int, max_depth: int = 16) -> Directory:
    """Double the directory until no bucket holds more than `capacity` distinct hashes.

    keys: distinct column h. One aggregate at max_depth bounds what the driver sees to
    2**max_depth counts; the doublings roll those counts up. A bucket that is still overfull at
    max_depth stays whole, as one owner's longer file.
    """
    counts = {int(r["p"]): int(r["n"]) for r in keys.groupBy(_prefix(max_depth).alias("p")).agg(F.count("*").alias("n")).collect()}
    levels = {max_depth: counts}
    for depth in range(max_depth - 1, -1, -1):
        up: dict[int, int] = {}
        for p, n in levels[depth + 1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        levels[depth] = up
    open_, done, depth = [0], [], 0
    while open_:
        over = []
        for p in open_:
            n = levels[depth].get(p, 0)
            if n > capacity and depth < max_depth:
                over += [2 * p, 2 * p + 1]
            else:
                done.append((p, depth, n))
        open_, depth = over, depth + bool(over)
    return Directory(max((d for _, d, _ in done), default=0), tuple(sorted(done, key=lambda b: b[0] << (max_depth - b[1]))))


def _pointers(spark, directory: Directory) -> DataFrame:
    """The directory's 2**global_depth pointers: p, bucket. Few enough to broadcast, see `_sizes`."""
    g = directory.global_depth
    rows = [(p << (g - d) | i, k) for k, (p, d, _) in enumerate(directory.buckets) for i in range(1 << (g - d))]
    return spark.createDataFrame(rows, "p long, bucket int")


def _sizes(n_keys: int, capacity: int | None) -> tuple[int, int]:
    """Capacity of a bucket, and the depth to which the directory may double.

    About BUCKETS buckets, or as the caller's capacity asks, but no more than 2**16 of them however
    many keys there are; hashes spread evenly, so four more bits than that leave no bucket overfull.
    """
    capacity = max(capacity or max(LEAST, -(-n_keys // BUCKETS)), -(-n_keys >> 16))
    return capacity, min(20, max(1, (-(-n_keys // capacity)).bit_length()) + 4)


def hash_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("h", hash_of(F.col("norm")))


@dataclass(frozen=True)
class Index:
    """Shared files. rows: doc_id, h, text_sha256 of every document. keys: owner, bucket, h, n (rows)
    of every distinct hash, one sorted file for each owner's range of buckets. entries: bucket, h,
    chain, text_sha256, keep_id, group_size of every text whose hash occurs more than once, chain
    counting the texts of one hash from 0. hot: rows from which a group counts as hot."""

    rows: DataFrame
    keys: DataFrame
    entries: DataFrame
    directory: Directory
    hot: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> Index:
    spark = docs.sparkSession
    keyed = _keyed(gathered(docs), id_col, text_col)
    rows = store(keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")), "exact-rows")
    counted = store(rows.groupBy("h").agg(F.count("*").alias("n")), "exact-counts")
    n_keys, n_rows = counted.count(), rows.count()
    capacity, depth = _sizes(n_keys, capacity)
    directory = build_directory(counted, capacity, depth)
    pointers = F.broadcast(_pointers(spark, directory))
    # more owners than tasks, so that hashing owners to tasks evens out
    owners = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = F.floor(F.col("bucket").cast("long") * F.lit(owners) / F.lit(max(1, len(directory.buckets)))).cast("int")
    routed = counted.withColumn("p", _prefix(directory.global_depth)).join(pointers, "p").select(owner.alias("owner"), "bucket", "h", "n")
    keys = store(routed.repartition("owner").sortWithinPartitions("owner", "bucket", "h"), "exact-index")
    hot = max(LEAST_HOT, n_rows // BIG)
    crowded = store(keys.where("n > 1").select("owner", "bucket", "h", (F.col("n") >= hot).alias("hot")), "exact-crowded")
    texts = keyed.join(sized(crowded), "h")
    place = ["owner", "bucket", "h", "norm"]
    parts = texts.where("NOT hot").select(*place, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if not crowded.where("hot").isEmpty():  # at most BIG keys
        few = F.broadcast(crowded.where("hot").drop("hot"))
        parts = parts.unionByName(keyed.join(few, "h").groupBy(*place).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    # the owner compares the bytes of what shares a hash; its place in the chain is by digest
    owned = parts.repartition("owner").groupBy(*place).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    owned = owned.select("owner", "bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy("text_sha256")) - 1
    entries = store(owned.select("bucket", "h", chain.alias("chain"), "text_sha256", "keep_id", "group_size"), "exact-entries")
    return Index(rows, keys, entries, directory, hot)


def _meet(rows: DataFrame, index: Index, on: list[str], names: dict[str, str]) -> DataFrame:
    """rows with their entries' columns (renamed by `names`), null where a row's hash occurs once.

    on: the rows' columns that hold hash and digest. Where the entries are too many to broadcast,
    those of hot groups still are, so that no key of the shuffle holds more rows than a group that
    is not hot.
    """
    named = [F.col(a).alias(b) for a, b in names.items()]

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, on, "left")

    def of(entries: DataFrame) -> DataFrame:
        return entries.select(F.col("h").alias(on[0]), F.col("text_sha256").alias(on[1]), *named)

    if few(index.entries, MOST_ENTRIES):
        return join(rows, F.broadcast(of(index.entries)))
    first = next(iter(names.values()))
    met = join(rows, F.broadcast(of(index.entries.where(F.col("group_size") >= index.hot))))
    rest = met.where(F.col(first).isNull()).select(columns(rows))
    return met.where(F.col(first).isNotNull()).unionByName(join(rest, of(index.entries.where(F.col("group_size") < index.hot))))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and the index bucket and chain place."""
    index = build_index(docs, id_col, text_col, capacity)
    met = _meet(index.rows, index, ["h", "text_sha256"], {"group_size": "size", "keep_id": "keep", "chain": "link"})
    met = met.withColumn("p", _prefix(index.directory.global_depth)).join(F.broadcast(_pointers(docs.sparkSession, index.directory)), "p")
    alone = F.col("size").isNull()
    return met.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"), "text_sha256", "bucket", F.coalesce("link", F.lit(0)).alias("chain"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    index = build_index(docs, id_col, text_col, capacity)
    h, sha, keep, size, again = unused(docs, "h", "sha", "keep", "size", "again")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = gathered(docs).withColumns({h: hash_of(norm), sha: F.sha2(norm, 256)})
    met = _meet(keyed, index, [h, sha], {"group_size": size, "keep_id": keep})
    best = met.where(F.col(size).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    # rows that repeat doc_id and text: several of them carry the id that stays
    marked = _meet(index.rows, index, ["h", "text_sha256"], {"group_size": "size", "keep_id": "keep"})
    repeated = marked.where(F.col("size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("h", "text_sha256").agg(F.count("*").alias("n")).where("n > 1")
    repeated = store(repeated.select(F.col("h").alias(h), F.col("text_sha256").alias(sha), F.lit(True).alias(again)), "exact-repeated")
    if repeated.isEmpty():
        return best.select(columns(docs))
    flagged = best.join(sized(repeated), [h, sha], "left")
    return flagged.where(F.col(again).isNull()).unionByName(flagged.where(again).dropDuplicates([h, sha])).select(columns(docs))
