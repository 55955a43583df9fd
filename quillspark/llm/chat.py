"""Chat formatting by columnar byte assembly.

Every turn is a header, its escaped text and a footer. For a batch of turns the segments' lengths
are known at once, their cumulative sums are the output offsets, and one scatter per kind of
segment copies all headers, contents and footers into a single preallocated buffer, which becomes
an Arrow string column without another copy. Turns are formatted where they are read; only the
finished bytes are shuffled to their conversation, sorted by turn and joined.

Template: <|turn|>ROLE<|says|>TEXT<|end|> per turn. Inside roles and texts a backslash is written
\\\\ and a control string is broken after its first character by \\: (so "</s>" reads "<\\:/s>"):
no control string survives inside a turn, and undoing the two rules gives back every text.

Defined results. A null role or text counts as empty. Rows of one conversation are ordered by turn,
then role, then text, null turns first; repeated rows are kept. Rows with a null conv_id are one
conversation. An empty text is an empty segment. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

OPEN, SAYS, END = b"<|turn|>", b"<|says|>", b"<|end|>"
# Control strings of this and of other common templates: fixed values.
CONTROLS = ("<|turn|>", "<|says|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_BREAK = "(" + "|".join(sorted({re.escape(c[0]) for c in CONTROLS})) + ")(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
_TURN = re.compile(re.escape(OPEN) + b"(.*?)" + re.escape(SAYS) + b"(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(rb"\\(\\|:)")


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    # twice: a control string may begin inside the one just broken
    for _ in range(2):
        texts = pc.replace_substring_regex(texts, _BREAK, r"\1\\:\2")
    return texts


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: b"\\" if m[1] == b"\\" else b"", data) if b"\\" in data else data


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copy data[begin : begin + length] to out[to : to + length] for all segments at once."""
    total = int(length.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + within] = data[np.repeat(begin, length) + within]


def assemble(segments: list[bytes | pa.Array], n: int) -> pa.Array:
    """One string per row: the constants and columns in `segments`, side by side."""
    parts = []
    for s in segments:
        if isinstance(s, bytes):
            parts.append((np.frombuffer(s, np.uint8), np.zeros(n, np.int64), np.full(n, len(s), np.int64)))
        else:
            data, offsets = _bytes_of(s)
            parts.append((data, offsets[:-1], np.diff(offsets)))
    lengths = np.column_stack([p[2] for p in parts])
    places = (np.cumsum(lengths.ravel()) - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(lengths.sum()), np.uint8)
    for k, (data, begin, length) in enumerate(parts):
        _scatter(out, places[:, k], data, begin, length)
    offsets = np.append(places[:, 0], len(out)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = (escape(pc.fill_null(batch.column(k), "")) for k in (2, 3))
        turns = assemble([OPEN, roles, SAYS, texts, END], batch.num_rows)
        trained = pc.fill_null(pc.equal(batch.column(2), "assistant"), False)
        # code points of the text inside its turn, for the loss mask
        head = pc.add(pc.utf8_length(roles), len(OPEN) + len(SAYS))
        columns = [batch.column(0), batch.column(1), turns.cast(pa.string()), trained, head.cast(pa.int64()), pc.utf8_length(texts).cast(pa.int64()), batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "formatted", "trained", "head", "size", "role"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation; a conversation may span batches."""

    def done(key, turns: list[str], spans: list[tuple[int, int]]) -> tuple:
        return key, "".join(turns), len(turns), [x for s in spans for x in s]

    def ship(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "formatted", "n_turns", "loss_spans"])

    key, turns, spans, at, started = None, [], [], 0, False
    for batch in batches:
        rows = []
        for conv, turn, trained, head, size in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if started and conv != key:
                rows.append(done(key, turns, spans))
                turns, spans, at = [], [], 0
            key, started = conv, True
            turns.append(turn)
            if trained:
                spans.append((at + head, at + head + size))
            at += len(turn)
        if rows:
            yield ship(rows)
    if started:
        yield ship([done(key, turns, spans)])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans (code point starts and stops, flat) per conversation.

    turns: conv_id, turn, role, text.
    """
    ready(turns.sparkSession)
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    done = plain.mapInArrow(_format, "conv_id long, turn long, formatted string, trained boolean, head long, size long, role string")
    # rows of the same turn are ordered by role and whole text, which is read back from the formatted turn
    text = F.regexp_replace(F.substring(F.col("formatted"), F.col("head").cast("int") + 1, F.col("size").cast("int")), r"\\(?:(\\)|:)", "$1")
    keyed = done.select("conv_id", "formatted", "trained", "head", "size", "turn", F.coalesce("role", F.lit("")).alias("tie"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "tie", text)
    return dealt.select("conv_id", "formatted", "trained", "head", "size").mapInArrow(_join, "conv_id long, formatted string, n_turns long, loss_spans array<long>")


def parse(formatted: str) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a formatted conversation."""
    data = formatted.encode()
    found = [m.span(k) for m in _TURN.finditer(data) for k in (0, 1, 2)]
    if "".join(formatted) and sum(b - a for a, b in found[::3]) != len(data):
        raise ValueError("text outside turns")
    return [(unescape(data[r[0] : r[1]]), unescape(data[t[0] : t[1]])) for r, t in zip(found[1::3], found[2::3])]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            turns = parse(formatted)
            whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, text in turns:
                whole.update(role + b"\n" + text + b"\n")
            for a, b in zip(spans[::2], spans[1::2]):
                text = unescape(formatted[a:b].encode())
                loss.update(text)
                chars += len(text.decode())
            rows.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations, as digests."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest, schema)
