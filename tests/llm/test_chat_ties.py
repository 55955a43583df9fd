"""Tied chat turns are ordered by their whole texts."""

import hashlib

from quillspark.llm import chat


def test_chat_ties_are_ordered_by_whole_text(spark):
    texts = ["x" * 64 + tail for tail in ("b", "a", "\\", "<s>", "<", "é", "d", "c", "\\:", "")]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_conversations(turns)).first()
    expected = "".join(f"user\n{t}\n" for t in sorted(texts, key=str.encode))
    assert got.turns_sha256 == hashlib.sha256(expected.encode()).hexdigest()
