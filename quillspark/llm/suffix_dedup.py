"""Suffix-array dedup: removal of every byte covered by a `span`-byte string that starts earlier.

The suffix array is sparse: it holds the suffixes that start at anchors, the positions that hold
the least hashed `SEED`-byte token of some span-byte window. A window's anchor depends on the
window's bytes alone, so equal windows have equal anchors and nothing is lost by the sampling.

1. Each task reads whole texts, finds the anchors and their windows, and keeps the first of those
   whose whole surroundings are equal (later ones are repeats at once). Surroundings are the bytes
   of all windows of an anchor and its place in them; they are held to be equal where their 128-bit
   BLAKE2b digests are, which no two differing ones are known to be.
2. Splitters sampled from the leading tokens range-partition the suffixes. Each bucket sorts its
   suffixes and finds, across all tasks' runs, repeats with equal surroundings, and suffixes that
   share their token but not their surroundings, where a match begins or ends.
3. The windows of the latter are range-partitioned by their anchor's leading tokens, cut from the
   texts, sorted by multikey quicksort over eight-byte keys, and neighbours compared. A token too
   common for one bucket has its windows dealt out one by one instead, by all of their bytes.
   Buckets are cut between different leading tokens, so a run of equal windows never crosses a
   boundary; runs that different tasks began are compared in the bucket that owns them.
4. The repeats' byte ranges are merged per document and cut from its text.

Defined results. A null text counts as empty. Texts shorter than a span lose nothing. Positions of
rows that share a doc_id are ordered by the row's place in its task and by task; a null doc_id is
ordered before any other. An empty table gives an empty table. A text is read whole; one longer
than LIMIT is hashed in stretches that share no window. Columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, store

U = np.uint64
M1, M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
TOKEN = 32  # bytes of the leading token that anchors are chosen by
BLOCK = 1 << 19  # bytes hashed at once
LIMIT = 1 << 23  # window starts of one stretch of a text; positions fit the 24 bits that `anchors` packs
FLUSH = 1 << 21  # anchors that a task gathers before it combines and ships them
HOT = 4096  # suffixes of one token from which its windows are dealt out one by one
NULL_ID = -(1 << 63)

# around, about: a BLAKE2b digest of the bytes of all windows; sides: bit 0 where left holds, 1 where right does
ANCHOR = np.dtype([("token", "<u8"), ("around", "<u8"), ("about", "<u8"), ("left", "<u4"), ("right", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<i8"), ("back", "u1"), ("more", "u1"), ("sides", "u1")])
OUT = "kind int, bucket int, doc_id long, row long, data binary"


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> U(29))
    a *= M2
    a ^= a >> U(32)
    return a


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix((a * M1) ^ b)


def hash_grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and 64 bytes from every position that has them."""
    eight = np.ndarray((len(x) - 7,), dtype="<u8", buffer=x, strides=(1,)).copy()
    eight = _mix(eight * M1)
    sixteen = _pair(eight[:-8], eight[8:])
    grams = _pair(sixteen[:-16], sixteen[16:])
    return grams, _pair(grams[:-32], grams[32:])


def anchors(x: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """For the joined texts x, which end at `ends`: per anchor its document's place in `ends`, its
    position, the first and last window start, and the hashes that ANCHOR holds."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U, U, np.uint8))
    if len(x) < span:
        return none
    grams, wide = hash_grams(x)
    least = (grams & ~U(0xFFFFFF)) | np.arange(len(grams), dtype=U)  # leftmost of equal hashes
    width, have = span - TOKEN + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), np.maximum(ends - starts - span + 1, 0))
    at = np.arange(len(doc)) - np.searchsorted(doc, doc) + starts[doc] if len(doc) else np.empty(0, np.int64)
    if not len(at):
        return none
    own = (least[at] & U(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(doc) != 0))))
    low, high, p, d = at[first], at[np.append(first[1:], len(at)) - 1], own[first], doc[first]
    # a window holds the token and either `half` bytes before it or `half` bytes after it
    half, top = (span - TOKEN) // 2, len(wide) - 1
    before = _pair(wide[np.clip(p - half, 0, top)], wide[np.clip(p + TOKEN - 64, 0, top)])
    after = _pair(wide[np.clip(p, 0, top)], wide[np.clip(p + TOKEN + half - 64, 0, top)])
    sides = (p - low >= half).astype(np.uint8) | (p - high <= span - TOKEN - half).astype(np.uint8) << 1
    return d, p - starts[d], low - starts[d], high - starts[d], grams[p], before, after, sides


def digests(x: np.ndarray, starts: np.ndarray, stops: np.ndarray, back: np.ndarray) -> np.ndarray:
    """128-bit digests of x[start:stop] and the place of the anchor in it, two numbers a row."""
    data, digest = x.tobytes(), hashlib.blake2b
    found = [digest(data[a:b], digest_size=16, salt=k.to_bytes(2, "little")).digest() for a, b, k in zip(starts.tolist(), stops.tolist(), back.tolist())]
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, ...) of consecutive rows of about BLOCK bytes: their bytes and ends."""
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        yield first, stop, data[offsets[first] : offsets[stop]], offsets[first + 1 : stop + 1] - offsets[first]
        first = stop


def _anchor_rows(x: np.ndarray, ends: np.ndarray, docs: np.ndarray, rows: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """ANCHOR records; a text too long for one block is read in stretches that share no window."""
    if len(x) <= LIMIT or len(ends) > 1:
        stretches = [(0, x, ends)]
    else:
        parts = ((a, x[a : a + LIMIT + span - 1]) for a in range(0, len(x) - span + 1, LIMIT))
        stretches = [(a, part, np.array([len(part)])) for a, part in parts]
    for base, part, stops in stretches:
        d, p, low, high, token, before, after, sides = anchors(part, stops, span)
        out = np.empty(len(d), ANCHOR)
        own = np.concatenate(([0], stops[:-1]))[d]
        whole = digests(part, own + low, own + high + span, p - low)
        out["token"], out["around"], out["about"], out["doc"], out["row"], out["pos"] = token, whole[:, 0], whole[:, 1], docs[d], rows[d], low + base
        out["left"], out["right"], out["sides"] = before >> U(32), after >> U(32), sides
        out["back"], out["more"] = p - low, high - low
        yield out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _ranges(docs: np.ndarray, rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge overlapping and touching byte ranges per document."""
    order = np.lexsort((starts, rows, docs))
    docs, rows, starts, stops = docs[order], rows[order], starts[order], stops[order]
    if not len(docs):
        return docs, rows, starts, stops
    own = np.cumsum(_runs(docs, rows))
    reach = np.maximum.accumulate(stops + own * (1 << 40)) - own * (1 << 40)
    new = _runs(docs, rows)
    new[1:] |= starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return docs[first], rows[first], starts[first], reach[np.append(first[1:], len(docs)) - 1]


def _emit_ranges(docs, rows, starts, stops, buckets: int = 1) -> pa.RecordBatch:
    """Byte ranges, one row per document, dealt over the buckets by document."""
    docs, rows, starts, stops = _ranges(docs, rows, starts, stops)
    first = np.flatnonzero(_runs(docs, rows)) if len(docs) else np.empty(0, np.int64)
    both = np.column_stack((starts, stops)).astype("<i8")
    data = [x.tobytes() for x in np.split(both, first[1:])] if len(first) else []
    return _batch(np.full(len(first), 0), docs[first] % buckets, docs[first], rows[first], data)


def _batch(kind, bucket, docs, rows, data) -> pa.RecordBatch:
    columns = [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "doc_id", "row", "data"])


def _by_bucket(records: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(_runs(bucket[order])) if len(order) else np.empty(0, np.int64)
    data = [x.tobytes() for x in np.split(records[order], cuts[1:])] if len(cuts) else []
    return _batch(np.full(len(cuts), 1), bucket[order][cuts], np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64), data)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (tells rows of one doc_id apart) and text."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    return docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _scan(splitters: np.ndarray, span: int):
    """Step 1: anchors to their buckets (kind 1), repeats within the task as byte ranges (kind 0)."""

    def ship(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(parts)
        a = a[np.lexsort((a["pos"], a["row"], a["doc"], a["about"], a["around"], a["token"]))]
        first = _runs(a["token"], a["around"], a["about"]) if len(a) else np.empty(0, bool)
        again = a[~first]
        yield _emit_ranges(again["doc"], again["row"], again["pos"], again["pos"] + again["more"] + span, len(splitters) + 1)
        a = a[first]
        yield _by_bucket(a, np.searchsorted(splitters, a["token"], side="right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, stop, x, ends in _texts(batch, 2):
                for a in _anchor_rows(x, ends, docs[first:stop], rows[first:stop], span):
                    held.append(a)
                    n += len(a)
                if n >= FLUSH:
                    yield from ship(held)
                    held, n = [], 0
        if held:
            yield from ship(held)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows sorted by bucket: each bucket's pieces of data."""
    bucket, held = None, []
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(data.as_py())
    if held:
        yield bucket, held


REQUEST = np.dtype([("pos", "<i8"), ("token", "<u8"), ("back", "u1"), ("more", "u1"), ("hot", "u1")])


def _resolve(span: int):
    """Step 2, per bucket: repeats with equal surroundings (kind 0); windows to compare (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []  # ranges that step 1 found pass through

        def suffixes() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = pc.equal(batch.column(0), 0)
                known.append(batch.filter(done))
                yield batch.filter(pc.invert(done)).select(["bucket", "data"])

        for _, parts in _groups(suffixes()):
            while known:
                yield known.pop()
            a = np.concatenate([np.frombuffer(x, ANCHOR) for x in parts])
            a = a[np.lexsort((a["pos"], a["row"], a["doc"], a["about"], a["around"], a["token"]))]
            first = _runs(a["token"], a["around"], a["about"])
            again = a[~first]
            yield _emit_ranges(again["doc"], again["row"], again["pos"], again["pos"] + again["more"] + span)
            a = a[first]
            group = np.cumsum(_runs(a["token"])) - 1
            size = np.bincount(group)[group] if len(a) else group
            a, group, size = a[size > 1], group[size > 1], size[size > 1]
            keep = np.zeros(len(a), bool)
            for bit, side in enumerate(("left", "right")):
                has = np.flatnonzero(a["sides"] >> bit & 1)
                key = group[has].astype(U) << U(32) | a[side][has].astype(U)
                _, where, times = np.unique(key, return_inverse=True, return_counts=True)
                keep[has] |= times[where] > 1
            a, size = a[keep], size[keep]
            order = np.lexsort((a["pos"], a["row"], a["doc"]))
            a, size = a[order], size[order]
            wanted = np.empty(len(a), REQUEST)
            for name in ("pos", "token", "back", "more"):
                wanted[name] = a[name]
            wanted["hot"] = size > HOT
            first = np.flatnonzero(_runs(a["doc"], a["row"])) if len(a) else np.empty(0, np.int64)
            data = [x.tobytes() for x in np.split(wanted, first[1:])] if len(first) else []
            yield _batch(np.full(len(first), 2), np.full(len(first), -1), a["doc"][first], a["row"][first], data)
        yield from known

    return run


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of keys by multikey quicksort, and the number of each ordered row's run of
    equal rows. Each key column is sorted only within the runs that the columns before it left."""
    order = np.arange(len(keys))
    run = np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))  # places whose run has more than one row
    for column in range(keys.shape[1]):
        if not len(open_):
            break
        rows = order[open_]
        inner = np.lexsort((keys[rows, column], run[open_]))
        rows = rows[inner]
        order[open_] = rows
        new = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else run.astype(bool)
        values = keys[rows, column]
        split = np.zeros(len(run), bool)
        split[open_[1:]] = (values[1:] != values[:-1]) & (run[open_[1:]] == run[open_[:-1]])
        run = np.cumsum(new | split) - 1
        sizes = np.bincount(run)
        open_ = np.flatnonzero(sizes[run] > 1)
    return order, run


WINDOW = np.dtype([("doc", "<i8"), ("row", "<i8"), ("pos", "<i8"), ("token", "<u8"), ("back", "u1"), ("more", "u1"), ("n", "<u2")])


def _cut_windows(splitters: np.ndarray, span: int, spread: int):
    """Step 3a: the bytes around each wanted suffix go to its bucket (kind 1)."""

    def ship(heads: list, bodies: list) -> pa.RecordBatch:
        h = np.array(heads, WINDOW)
        bucket = np.searchsorted(splitters, h["token"], side="right")
        single = h["more"] == 0
        # windows of a hot token, and only those, come one by one: deal them by all of their bytes
        key = np.fromiter((hash_bytes(b) for b in bodies), U, len(bodies))
        hot = single & (h["row"] < 0)
        bucket = np.where(hot, len(splitters) + 1 + (key % U(spread)).astype(np.int64), bucket)
        h["row"] = np.where(hot, -1 - h["row"], h["row"])
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(_runs(bucket[order]))
        groups = np.split(order, cuts[1:])
        data = [len(g).to_bytes(8, "little") + h[g].tobytes() + b"".join(bodies[i] for i in g) for g in groups]
        zero = np.zeros(len(groups), np.int64)
        return _batch(zero + 1, bucket[order][cuts], zero, zero, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies = [], []
        for batch in batches:
            for doc, row, text, wanted in zip(*(batch.column(k) for k in range(4))):
                doc, row, text = doc.as_py(), row.as_py(), text.as_py().encode()
                for data in wanted.as_py():
                    for pos, token, back, more, hot in np.frombuffer(data, REQUEST).tolist():
                        if hot:
                            for k in range(more + 1):
                                heads.append((doc, -1 - row, pos + k, token, back - k, 0, span))
                                bodies.append(text[pos + k : pos + k + span])
                        else:
                            heads.append((doc, row, pos, token, back, more, more + span))
                            bodies.append(text[pos : pos + more + span])
                    if len(heads) > 1 << 16:
                        yield ship(heads, bodies)
                        heads, bodies = [], []
        if heads:
            yield ship(heads, bodies)

    return run


def hash_bytes(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _compare(span: int):
    """Step 3b, per bucket: sort the windows, compare neighbours, give the repeats' byte ranges."""
    words = -(-span // 8)

    def tokens(parts: list[bytes]) -> Iterator[np.ndarray]:
        """Windows as (doc, row, pos, eight-byte keys), a run of leading tokens at a time."""
        heads, texts = [], []
        for part in parts:
            n = int.from_bytes(part[:8], "little")
            heads.append(np.frombuffer(part, WINDOW, n, 8))
            texts.append(np.frombuffer(part, np.uint8, offset=8 + n * WINDOW.itemsize))
        head, text = np.concatenate(heads), np.concatenate([*texts, np.zeros(8, np.uint8)])
        at = np.cumsum(head["n"].astype(np.int64)) - head["n"]
        order = np.argsort(head["token"], kind="stable")
        token, many = head["token"][order], np.cumsum(head["more"][order].astype(np.int64) + 1)
        new = _runs(token)
        firsts = np.append(np.flatnonzero(new), len(order))
        begin = 0
        while begin < len(order):
            stop = int(np.searchsorted(many, (many[begin - 1] if begin else 0) + (1 << 17))) + 1
            stop = int(firsts[min(np.searchsorted(firsts, stop), len(firsts) - 1)])
            own = order[begin:stop]
            times = head["more"][own].astype(np.int64) + 1
            rows = np.repeat(own, times)
            k = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            where = at[rows] + k
            eight = np.ndarray((len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))
            starts = [min(8 * w, span - 8) for w in range(words)]
            # the anchor's place in the window is a key as well: only windows of one anchor are equal
            keys = np.column_stack([head["token"][rows], *(eight[where + s].astype(U) for s in starts)])
            yield head["doc"][rows], head["row"][rows], head["pos"][rows] + k, keys
            begin = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches):
            for doc, row, pos, keys in tokens(parts):
                order, number = multikey_order(keys)
                doc, row, pos = doc[order], row[order], pos[order]
                inner = np.lexsort((pos, row, doc, number))
                again = inner[~_runs(number[inner])]
                yield _emit_ranges(doc[again], row[again], pos[again], pos[again] + span)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: cut the merged ranges from each text."""
    for batch in batches:
        out = []
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            text = text.as_py().encode()
            both = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in found.as_py() or []] or [np.empty((0, 2), np.int64)])
            zero = np.zeros(len(both), np.int64)
            _, _, starts, stops = _ranges(zero, zero, both[:, 0], both[:, 1])
            edges = [0, *np.column_stack((starts, stops)).ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((None if doc == NULL_ID else doc, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _sample_splitters(numbered: DataFrame, span: int, buckets: int, sample: int = 2000) -> np.ndarray:
    """Splitters of the leading tokens from at most `sample` documents' anchors.

    Tokens are compared by hash, so that common openings do not gather in one range; the sample
    bounds what the driver sees and moves boundaries only, never results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, x, ends in _texts(batch, 2):
                for a in _anchor_rows(x, ends, np.zeros(stop - first, np.int64), np.zeros(stop - first, np.int64), span):
                    yield pa.RecordBatch.from_arrays([pa.array(a["token"][::16].view(np.int64))], ["token"])

    some = numbered.limit(sample).select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    tokens = np.sort(np.array([r["token"] for r in some.mapInArrow(run, "token long").collect()], np.int64).view(U))
    even = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U)
    if len(tokens) < 8 * buckets:
        return even
    return np.unique(tokens[np.arange(1, buckets) * len(tokens) // buckets])


def remove_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) per document.

    span must lie between TOKEN + 32 and 150. bucket_bytes: text whose suffixes make up a bucket.
    """
    spark = ready(docs.sparkSession)
    numbered = _numbered(docs, id_col, text_col)
    # a row number is needed only where doc_ids repeat
    repeated = numbered.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty() is False
    if repeated:
        numbered = store(numbered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    else:
        numbered = numbered.withColumn("row", F.lit(0).cast("long"))
    numbered = numbered.select("doc_id", "row", "text")
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    splitters = _sample_splitters(numbered, span, buckets)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    resolved = store(dealt(numbered.mapInArrow(_scan(splitters, span), OUT)).mapInArrow(_resolve(span), OUT), "resolved")
    wanted = resolved.where("kind = 2").groupBy("doc_id", "row").agg(F.collect_list("data").alias("wanted"))
    # a document's requests are at most its own anchors, so the list is bounded by its text
    texts = numbered.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "wanted")
    windows = texts.mapInArrow(_cut_windows(splitters, span, buckets), OUT)
    compared = dealt(windows.select("bucket", "data")).mapInArrow(_compare(span), OUT)
    ranges = resolved.where("kind = 0").unionByName(compared).select("doc_id", "row", "data")
    merged = store(ranges.groupBy("doc_id", "row").agg(F.collect_list("data").alias("found")), "repeats")
    return (
        numbered.join(merged, ["doc_id", "row"], "left").select("doc_id", "text", "found")
        .mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
