"""Best-fit packing of token sequences with exact-complement hashing.

Only a histogram of piece lengths (at most `size` counters, whatever the corpus) reaches the
driver. There the longest piece left opens a sequence, and its gap is looked up in an index of the
lengths' single, pair and triple sums: a combination that fills the gap exactly is consumed as
often as its availability counts allow. Where no combination fills it, the longest piece that fits
(best fit) is added and the smaller gap is looked up again. The plan, a few thousand rules of the
form "so many pieces of this length in each of so many sequences", is applied to the pieces by
their rank within their length, so the packing of any corpus is one pass over its pieces.

Documents are encoded in Arrow batches. A document longer than a sequence is cut into pieces of
`size` tokens, the first of which may be shorter; nothing else is cut.

Defined results. A null text counts as empty and is one token, the end id. An empty table gives an
empty table. Rows with a null or repeated doc_id are packed like any other row. A text with
characters outside the common scripts, or one that spells a special token, is encoded by the
slower of the two libraries, which defines the ids. A text is encoded whole, however long: one task
holds it and its ids. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, ready, store

ROWS = 1024  # documents encoded between two batches of pieces
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
UNUSUAL = re.compile("[^\x00-ɏ‐-‧€]|<\\|")


@lru_cache(maxsize=4)
def _whole(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=4)
def _encoder(json_path: str, ranks_path: str | None):
    """Text to uint32 ids. ranks_path: the same vocabulary for the faster library, if there is one;
    the other is then loaded by the first text that needs it."""
    exact = lambda text: np.array(_whole(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    if not ranks_path:
        return exact
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: exact(text) if UNUSUAL.search(text) else fast.encode_to_numpy(text, disallowed_special=())


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than size."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: its document's place and a checksum of its ids, and part and place: its rank
    among the pieces of its length in its task."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, ranks_path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, sums = np.empty(batch.num_rows, np.int64), []  # of ids; of pieces
                for row, text in enumerate(batch.column(1)):
                    ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                    counts[row] = len(ids)
                    sums += [zlib.crc32(ids[start : start + length]) for start, length in cut(len(ids), size)]
                n = -(-counts // size)
                first = counts - (n - 1) * size
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(piece == 0, first[row], size)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                # rank among the task's pieces of the same length
                order = np.argsort(length, kind="stable")
                sorted_, place = length[order], np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=size + 1)
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return gathered(plain).mapInArrow(run, SCHEMA)


class Complements:
    """Available piece lengths and the sums of one, two or three of them.

    even: prefer combinations of like lengths to those with the longest piece.
    """

    def __init__(self, counts: np.ndarray, even: bool = False):
        self.even = even
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0

    def take(self, parts: list[int], times: int) -> None:
        for x in parts:
            self.left[x] -= times

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths of sum gap, long ones first."""
        left = self.left
        if gap < len(left) and left[gap]:
            return [gap]
        have = np.flatnonzero(left[:gap])[::-1]
        if not len(have):
            return None
        if (pair := self._pair(have, gap)) is not None:
            return pair
        tops = have[have * 3 >= gap]
        for a in tops[::-1] if self.even else tops:
            left[a] -= 1
            rest = self._pair(have[(have <= a) & (left[have] > 0)], gap - a)
            left[a] += 1
            if rest is not None:
                return [int(a), *rest]
        return None

    def fourth(self, gap: int) -> list[int] | None:
        """A piece that leaves a gap which one, two or three others fill exactly."""
        for x in np.flatnonzero(self.left[: gap + 1])[::-1]:
            self.left[x] -= 1
            rest = self.exact(gap - int(x))
            self.left[x] += 1
            if rest is not None:
                return [int(x), *rest]
        return None

    def _pair(self, have: np.ndarray, gap: int) -> list[int] | None:
        if gap < 2 or not len(have):
            return None
        big = have[(2 * have >= gap) & (have < gap)]
        small = gap - big
        fits = (self.left[small] > (small == big)) & (self.left[big] > 0) & (small <= have[0])
        at = np.flatnonzero(fits)
        k = -1 if self.even else 0
        return [int(big[at[k]]), int(small[at[k]])] if len(at) else None


Rule = tuple[int, int, int, int, int]


def plan(counts: np.ndarray, size: int) -> tuple[list[Rule], int]:
    """Rules (length, pieces a sequence, first sequence, sequences, offset), and how many sequences.

    counts[l] pieces of length l. Every rule's pieces lie side by side in its sequences. The better
    of the plans that prefer long or like pieces in combinations; each takes well under a second.
    """
    return min((_plan(counts, size, even) for even in (False, True)), key=lambda p: p[1])


def _plan(counts: np.ndarray, size: int, even: bool) -> tuple[list[Rule], int]:
    index, rules, used = Complements(counts, even), [], 0
    for longest in range(size, 0, -1):
        while index.left[longest]:
            parts, gap = [longest], size - longest
            index.left[longest] -= 1
            while gap:
                more = index.exact(gap)
                if more is None:
                    fit = np.flatnonzero(index.left[: gap + 1])
                    if not len(fit):
                        break
                    best = int(fit[-1])
                    # as many of the best fit as leave a gap that small pieces may still fill
                    more = index.fourth(gap) or [best] * int(max(1, min(index.left[best], gap // best - 1)))
                index.take(more, 1)
                parts += more
                gap -= sum(more)
            need: dict[int, int] = {}
            for x in parts:
                need[x] = need.get(x, 0) + 1
            times = 1 + min(int(index.left[x]) // n for x, n in need.items())
            offset = 0
            for x, n in need.items():
                index.left[x] -= n * (times - 1)
                rules.append((x, n, used, times, offset))
                offset += n * x
            used += times
    return rules, used


def pack(placed: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset to pieces that carry length, part and place."""
    counted = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[row["length"]] = row["n"]
    rules, _ = plan(counts, size)
    by_length: dict[int, np.ndarray] = {}
    for length in {r[0] for r in rules}:
        own = np.array([r[1:] for r in rules if r[0] == length], np.int64)
        by_length[length] = np.column_stack([np.cumsum(own[:, 0] * own[:, 2]), own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rule = by_length[int(length[at[0]])]
                k = np.searchsorted(rule[:, 0], rank[at], side="right")
                ends, each, first, times, base = rule[k].T
                nth = rank[at] - (ends - each * times)
                sequence[at] = first + nth // each
                offset[at] = base + nth % each * length[at]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    from pyspark.sql import Window

    # one row for each length and task, so a window by length holds as many rows as there are tasks
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    ranked = placed.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Encode, cut and pack all documents: one row per piece."""
    return pack(store(pieces(docs, json_path, ranks_path, size, end_id), "pieces"), size)
