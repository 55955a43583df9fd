"""Truncation splits a text's head only, where that settles it, and gives what the whole text gives."""

from pyspark.sql import functions as F

from quillspark.functions import text as T


def plain(spark, text, limit):
    d = spark.createDataFrame([(text,)], "text string")
    s = d.select(T.sentences(F.col("text")).alias("s"), T.token_count(F.col("text")).alias("n")).select("n", "s", F.transform("s", T.token_count).alias("c")).first()
    kept, used = [], 0
    for x, c in zip(s.s, s.c):
        if used + c + 1 > limit:
            break
        kept, used = [*kept, x], used + c + 1
    if s.n <= limit or not text:
        return text
    if kept:
        return " ".join(kept)
    head = text[: max(1, int(len(text) * (limit / s.n)))]
    return head[: head.rindex(" ")] if " " in head else head


def test_heads_give_what_whole_texts_give(spark):
    limit = 12
    width = limit * T.HEAD
    texts = ["One. Two! Three? " * 200, "word " * 300, "x" * 2000, "Short. " + "y " * 900, "", "A b.\n\n \n\nC d; " + " " * (2 * width) + "e f. " * 50]
    texts += ["A b c. " + "d" * (width - 7 - k) + ". e f. " + "g " * 300 for k in range(4)] + ["A b." + " " * (width - 4 + k) + "C d. e " * 30 for k in (-1, 0, 1)]
    texts += ["A b." + "\n" * (width - 5 + k) + "C d.\n\ne " * 30 for k in (-1, 0, 1)] + ["é.\r\n" * 300, "3.5 is no end. " * 90]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", T.truncate_to_tokens(F.col("text"), limit).alias("head")).collect()
    assert {r.i: r.head for r in rows} == {i: plain(spark, t, limit) for i, t in enumerate(texts)}


def test_a_limit_may_be_a_column(spark):
    d = spark.createDataFrame([("One two three. Four five. " * 20, n) for n in (0, 1, 5, 10, 500)], "text string, n int")
    assert [len(r.h) for r in d.select(T.truncate_to_tokens(F.col("text"), F.col("n")).alias("h")).collect()][0] == 0


def test_the_whole_text_is_not_split_where_its_head_settles_it(spark):
    """Nine megabytes a row, whose sentences would each be priced."""
    import time

    d = spark.range(2).select(F.repeat(F.lit("One two three. Four five. "), 350_000).alias("text"))
    d.select(F.length(T.truncate_to_tokens(F.lit("a. b. " * 99), 12))).collect()
    began = time.time()
    assert {r.h for r in d.select(T.truncate_to_tokens(F.col("text"), 12).alias("h")).collect()} == {"One two three. Four five."}
    assert time.time() - began < 30
