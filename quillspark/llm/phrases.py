"""Phrase collocations through merged count-min sketches and one exact count of what survives them.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words.
Each task hashes the words and pairs of its texts to the cells of ROWS sketch rows; the tasks' cells
are summed, and a cell's sum is never below the count of a phrase that falls into it. What is left
of a sketch is a bit for each cell: whether its sum reaches the least count. A second sketch counts
the longer phrases all of whose pairs have passed the first. The last pass over the texts counts
exactly, and only phrases whose every cell passed; so nothing frequent is lost, whatever collides,
and what passed wrongly is dropped by its exact count. Tasks combine phrases before the shuffle,
so a phrase that occurs in every document is about one row from each task.

Sketches get wider with the texts, up to 2 ** MOST_BITS cells a row, the bound on what is broadcast
(64 MB); in a corpus of more than about a hundred GB more rare phrases pass than before, and the
exact count, an aggregate like any other, drops them. A key of counts (a first word, say) that a
great part of all phrases ask for is joined by broadcasting.

Defined results. A null or empty text has no words; a null lang is `und`, an empty one a language of
its own. Texts are read whole: a long one is cut between pieces (phrases never cross those), and a
piece is held whole. Repeated rows count again. Phrases of equal score are ordered by count, then by
their bytes. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, gathered, join_spread, ready, sized, store

LONGEST = 5  # words of a phrase
ROWS = 2  # of a sketch
LEAST_BITS, MOST_BITS = 16, 28  # cells of a row, as powers of two
PART = 1 << 16  # cells that are summed together
CHUNK = 8 << 20  # bytes of text that a task looks at together
HELD = 1 << 20  # counted phrases that a task combines before it passes them on
SPLITTERS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
PIECE_END = re.compile(b"[" + SPLITTERS + b"]")
KINDS = np.zeros(256, np.uint8)
KINDS[list(BLANKS)], KINDS[list(SPLITTERS)] = 1, 2
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
SPACED = bytes.maketrans(SPLITTERS + BLANKS, b" " * len(SPLITTERS + BLANKS))
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ROW_FACTORS = [np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by line feeds) of about CHUNK bytes; a longer text is cut at ends of pieces."""
    held: dict[str, list[bytes]] = {}
    total = 0

    def ready_() -> Iterator[tuple[str, bytes]]:
        for lang, texts in held.items():
            yield lang, b"\n".join(texts)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            data, at = text.as_py() or b"", 0
            while at < len(data):
                cut = PIECE_END.search(data, at + CHUNK) if len(data) - at > CHUNK else None
                end = cut.end() if cut else len(data)
                held.setdefault(lang, []).append(data[at:end])
                total, at = total + end - at, end
                if total >= CHUNK:
                    yield from ready_()
                    total = 0
    yield from ready_()


class Words:
    """A chunk's words as numbers into its own list of distinct words, and the number of each word's piece."""

    def __init__(self, lang: str, data: bytes):
        data = data.translate(LOWERED)
        kind = KINDS[np.frombuffer(data, np.uint8)]
        word = kind == 0
        starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        coded = pa.array(data.translate(SPACED).split(), pa.binary()).dictionary_encode()
        self.id = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary.to_pylist()
        seed = xxhash.xxh32_intdigest(lang.encode())
        self.hash = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)

    def prints(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places where a phrase of that size starts as a mask, all places' hashes), by size."""
        n = len(self.id)
        first = self.hash[self.id]
        prints, inside = first, np.ones(n, bool)
        for size in range(1, LONGEST + 1):
            if size > 1:
                following = np.zeros(n, np.uint64)
                following[: max(0, n - size + 1)] = first[size - 1 :]
                mixed = prints * FACTOR + following
                prints = (mixed ^ (mixed >> np.uint64(29))) * MIX
                inside = np.zeros(n, bool)
                inside[: max(0, n - size + 1)] = self.piece[: max(0, n - size + 1)] == self.piece[size - 1 :]
            yield size, inside, prints


def cells(prints: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = prints ^ (prints >> np.uint64(31))
    return (mixed * ROW_FACTORS[row]) >> np.uint64(64 - bits)


class Passed:
    """The bits of a sketch, a packed array for each row."""

    def __init__(self, rows: list[np.ndarray], bits: int):
        self.rows, self.bits = rows, bits

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        ok = np.ones(len(prints), bool)
        for row, packed in enumerate(self.rows):
            at = cells(prints, row, self.bits)
            ok &= (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def _survivors(words: Words, short: Passed, long: Passed | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As `Words.prints`, with places left only whose phrases may be frequent as far as the sketches say.

    A phrase is no more frequent than the phrases in it, so those have to have passed as well.
    """
    before = None
    for size, inside, prints in words.prints():
        passed = short if size <= 2 else long
        if before is not None:
            inside &= before & np.concatenate((before[1:], [False]))
        if passed is not None:
            at = np.flatnonzero(inside)
            inside = np.zeros(len(inside), bool)
            inside[at[passed(prints[at])]] = True
        yield size, inside, prints
        before = inside


def _counter(least: int):
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if least <= np.iinfo(t).max)


def _sketched(bits: int, least: int, short=None):
    """Each chunk's cells by part: key, places in the part, counts (those beyond `least` as `least`, which decides alike).

    Without `short` of words and pairs; with it, of longer phrases all of whose pairs passed it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _chunks(batches):
            words = Words(lang, data)
            if short is None:
                found = [prints[inside] for size, inside, prints in words.prints() if size <= 2]
            else:
                found = [prints[inside] for size, inside, prints in _survivors(words, short.value, None) if size > 2]
            prints, counts = np.unique(np.concatenate(found), return_counts=True)
            keys, places, sums = [], [], []
            for row in range(ROWS):
                at = cells(prints, row, bits)
                order = np.argsort(at, kind="stable")
                at, first = np.unique(at[order], return_index=True)
                if not len(at):
                    continue
                total = np.minimum(np.add.reduceat(counts[order], first), least).astype(_counter(least))
                part = (at // np.uint64(PART)).astype(np.int64)
                cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(at)]))
                place = (at % np.uint64(PART)).astype(np.uint16)
                for a, b in zip(cuts, cuts[1:]):
                    keys.append(row << 32 | int(part[a]))
                    places.append(place[a:b].tobytes())
                    sums.append(total[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.binary()), pa.array(sums, pa.binary())], ["key", "places", "sums"])

    return run


def _summed(least: int):
    """Rows that come sorted by key: the bits of each key's cells whose sums reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros(PART, np.int64)

        def done() -> pa.RecordBatch:
            packed = np.packbits(sums >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([packed], pa.binary())], ["key", "bits"])

        for batch in batches:
            for k, place, more in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        yield done()
                    key, sums = k, np.zeros(PART, np.int64)
                sums[np.frombuffer(place, np.uint16)] += np.frombuffer(more, _counter(least))
        if key is not None:
            yield done()

    return run


def _merged(texts: DataFrame, bits: int, least: int, short=None) -> Passed:
    """The sketch of all texts; the driver gets ROWS * 2 ** bits bits at most."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = texts.mapInArrow(_sketched(bits, least, short), "key long, places binary, sums binary")
    rows = parts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_summed(least), "key long, bits binary")
    packed = [np.zeros(-(-(1 << bits) // 8), np.uint8) for _ in range(ROWS)]
    for key, found in rows.toLocalIterator():
        at = (key & 0xFFFFFFFF) * PART // 8
        out = packed[key >> 32][at : at + PART // 8]
        out[:] = np.frombuffer(found, np.uint8)[: len(out)]
    return Passed(packed, bits)


COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.binary()), ("a", pa.int64())])


def _chunk_counts(lang: str, words: Words, short: Passed, long: Passed) -> pa.Table:
    """A chunk's phrases that passed, with their exact counts; size 0 counts all words."""
    sizes, phrases, counts = [0], [b""], [len(words.id)]
    code = np.zeros(len(words.id), np.int64)  # a phrase's number among those of its size, exact
    for size, inside, _ in _survivors(words, short, long):
        at = np.flatnonzero(inside)
        longer, first, inverse, count = np.unique(code[at] * len(words.words) + words.id[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
        code[at] = inverse
        spelled = np.stack([words.id[at[first] + k] for k in range(size)], axis=1).tolist()
        phrases += [b" ".join([words.words[w] for w in one]) for one in spelled]
        sizes += [size] * len(longer)
        counts += count.tolist()
    return pa.table([pa.array([lang] * len(sizes), pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], COUNTS)


def _counted(short, long):
    """(lang, size, phrase, a) of what passed, combined over the chunks of a task while they are few enough to hold."""

    def combined(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "size", "phrase"]).aggregate([("a", "sum")]).rename_columns(["lang", "size", "phrase", "a"])

    def out(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = combined(held)
        yield from whole.set_column(2, "phrase", whole["phrase"].cast(pa.string())).to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for lang, data in _chunks(batches):
            held.append(_chunk_counts(lang, Words(lang, data), short.value, long.value))
            if sum(t.num_rows for t in held) > HELD:
                held = [combined(held)]
                if held[0].num_rows > HELD // 2:
                    yield from out(held)
                    held = []
        if held:
            yield from out(held)

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> DataFrame:
    """lang, size, phrase, a: a written table of the phrases of 1 to LONGEST words that occur `least` times or
    more; a row of size 0 for each language counts its words. bits: of a sketch row's width, else by the texts' size."""
    spark = ready(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if bits is None:
        size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # words and pairs are a third of the bytes; cells that hold an eighth of the least count each
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / 3 * 8 / max(8, least))))))
    texts = gathered(plain)
    short = spark.sparkContext.broadcast(_merged(texts, bits, least))
    long = spark.sparkContext.broadcast(_merged(texts, bits, least, short))
    counts = texts.mapInArrow(_counted(short, long), "lang string, size int, phrase string, a long")
    return store(counts.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).where((F.col("size") == 0) | (F.col("a") >= least)), "phrase-counts")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in whole decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, covered: int = 100, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> DataFrame:
    """Each language's `most` best phrases of 2 to LONGEST words: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its lowest-scoring cut into a first part (l) and a rest (r). Phrases
    that lie inside a longer one which occurs in `covered` per cent of their places or more are dropped.
    """
    counts = frequent_phrases(docs, least, text_col, lang_col, bits)
    totals = store(counts.where("size = 0").select("lang", F.col("a").alias("n")), "phrase-totals")
    spelled = counts.where("size >= 2").withColumn("words", F.split("phrase", " "))
    upto = lambda last: F.sequence(F.lit(1), last)
    part = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    # a cut's first part is asked for under its length, the rest under the length negated
    asked = F.flatten(F.transform(upto(F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("cut"), part(F.lit(1), k).alias("part")), F.struct((-k).alias("cut"), part(k + 1, F.col("size") - k).alias("part")))))
    parts = spelled.select("lang", "phrase", "size", "a", F.explode(asked).alias("x")).select("lang", "phrase", "size", "a", "x.cut", "x.part")
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    known = store(uses.join(counts.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"]), "phrase-parts")
    total = known.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    met = join_spread(parts, known, ["lang", "part"], "uses", total).select("lang", "phrase", "size", "a", F.struct("cut", "f").alias("part"), F.lit(None).cast("long").alias("longer"))
    # what a longer phrase holds, down to pairs
    held = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(upto(F.col("size") - k + 1), lambda i: part(i, k))))
    none = lambda c: F.lit(None).cast(met.schema[c].dataType).alias(c)
    within = spelled.where("size > 2").select("lang", F.explode(held).alias("phrase"), none("size"), none("a"), none("part"), F.col("a").alias("longer"))
    one = met.unionByName(within).groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.max("a").alias("a"), F.max("longer").alias("longer"), F.map_from_entries(F.collect_list("part")).alias("f"))
    kept = one.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)).join(sized(totals), "lang")
    cut = F.array_min(F.transform(upto(F.col("size") - 1), lambda k: F.struct(
        _score(F.col("a"), F.col("n"), F.col("f")[k], F.col("f")[-k]).alias("score"), k.alias("k"), F.col("f")[k].alias("l"), F.col("f")[-k].alias("r"))))
    scored = kept.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # the best of each of many parts first, so that a language with most phrases is not sorted in one task
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(n)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
