"""The text kernel against hand-made expectations."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import cleaning
from quillspark.functions import text as T


@pytest.fixture(scope="module")
def of(spark):
    def apply(function, *texts):
        df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
        return [r.v for r in df.select("n", function(F.col("t")).alias("v")).orderBy("n").collect()]

    return apply


def test_normalize(of):
    raw = ["a\r\nb\rc", "x  \t y ", "﻿a b", "a\n\n\n\nb", "\x01a\x7f", "  \n a \n ", "Délai", ""]
    assert of(T.normalize, *raw) == ["a\nb\nc", "x y", "a b", "a\n\nb", "a", "a", "Délai", ""]
    once = of(T.normalize, *raw)
    assert of(T.normalize, *once) == once


def test_fold_and_words(of):
    assert of(T.fold, "Délai ß ø Ñ", "é") == ["Delai ß ø N", "e"]
    assert of(T.words, "L'indemnité d’un Délai", "company's 3 days", "jusqu'au 5", "") == [["indemnite", "un", "delai"], ["company's", "3", "days"], ["au", "5"], []]


def test_content_words(of):
    assert of(T.content_words, "Faut-il un délai de 3 jours ?", "What is the a I", "peut-on payer", "il-y") == [["faut", "delai", "jours"], [], ["peut", "payer"], ["il-y"]]


def test_sentences_and_grams(of):
    assert of(T.sentences, "One. Two; three: four!  Five\n\nSix", " ", "a.b") == [["One.", "Two;", "three:", "four!", "Five", "Six"], [], ["a.b"]]
    assert of(lambda c: T.shingles(c, 2), "alpha beta gamma", "alpha", "") == [["alpha\x1fbeta", "beta\x1fgamma"], ["alpha"], []]


def test_jaccard(spark):
    rows = [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, v double")
    assert all(r.v == pytest.approx(r.got) for r in df.select("v", T.jaccard(F.col("a"), F.col("b")).alias("got")).collect())


def test_token_count_equals_python(of):
    texts = ["", "a", "hello world", "x" * 37, "one two three four five six seven", "é é"]
    plain = lambda t: max(1, math.ceil(max(len(t) / 3.6, len(t.split()) * 1.32))) if t else 0
    assert of(T.token_count, *texts) == [plain(t) for t in texts]
    assert of(T.token_count, "x" * 36) == [10]


def test_truncate(of):
    text = "First one. Second sentence here. Third sentence is longer than others."
    assert of(lambda c: T.truncate_to_tokens(c, 10), text) == ["First one."]
    assert of(lambda c: T.truncate_to_tokens(c, 0), text) == [""]
    assert of(lambda c: T.truncate_to_tokens(c, 500), text) == [text]
    assert of(lambda c: T.truncate_to_tokens(c, 3), "abcdefgh ijklmnop qrstuvwxyz") == ["abcdefgh"]


def test_numbers_protect(of):
    a, b, c = of(T.numeric_signature, "within 30 days, 1 200,5 EUR.", "within 45 days", "none")
    assert a == ["1200.5", "30"] and b == ["45"] and c == []


def test_language_and_marks(of):
    assert of(T.detect_language, "les frais des agents", "the cost of and", "xyz", "") == ["fr", "en", "und", "und"]
    assert of(T.citations, "a [S2] b [S1] [S2] [X1]") == [["S1", "S2"]]
    assert of(T.looks_french, "Quel est le délai", "what is it") == [True, False]
    assert of(T.phrases, "How long is it", "two words") == [["how long is", "long is it"], []]


@pytest.mark.parametrize(
    "raw, prompt, answer, notes",
    [
        ("Plain answer.", "", "Plain answer.", []),
        ("<think>hmm</think>The limit is 25 EUR.", "", "The limit is 25 EUR.", ["reasoning"]),
        ("<think>never ends", "", "", ["reasoning", "only reasoning"]),
        ("Loading model...\n/exit\n> The limit is 25 EUR.\nExiting...", "", "The limit is 25 EUR.", ["scaffolding"]),
        ("Use the rules.\nBe brief please\nThe limit is 25.", "Use the rules.\nBe brief please", "The limit is 25.", ["scaffolding"]),
        ("Reasoning first. Final answer: 25 EUR per day.", "", "25 EUR per day.", ["final answer"]),
        ("It stops in the mid", "", "It stops in the mid", ["truncated"]),
        ("<thi<think>a</think>nk>b</think>The end.", "", "The end.", ["reasoning"]),
        ("Thinking process: a\nAnswer: Thinking process: b\nresponse: It is 5 EUR.", "", "It is 5 EUR.", ["reasoning"]),
        ("x\nAvailable commands:\n/help\n\n/exit or Ctrl+C to stop\n> Say it.\nKeep it short.\n\nIt is so. [ Prompt: 3 t/s ]", "Say it.\nKeep it short.", "It is so.", ["scaffolding"]),
        ("/help\n/exit", "", "/help\n/exit", ["scaffolding", "truncated"]),
        ("> ", "", ">", ["scaffolding", "truncated"]),
        ("Say it now please: ok\nrest of it", "Say it now please: ok", "rest of it", ["scaffolding", "truncated"]),
        ("The answer: no", "", "The answer: no", ["truncated"]),
        ("Draft answer: it is 1. **Final answer:** it is 2.\r\nYes.", "", "it is 2.\nYes.", ["final answer"]),
        (None, "", "", []),
    ],
)
def test_cleaning(spark, raw, prompt, answer, notes):
    row = spark.createDataFrame([(raw, prompt)], "raw string, prompt string")
    got = row.select(cleaning.clean_generation(F.col("raw"), F.col("prompt")).alias("c")).first().c
    assert (got.text, got.notes) == (answer, notes)


def test_parameters(spark):
    df = spark.createDataFrame([(1160000000, "Q4_0", 3.8), (1160000000, "q4", 1.88), (5, "??", 1.0)], "size long, q string, declared double")
    implied = cleaning.estimated_parameters(F.col("size"), F.col("q"))
    got = df.select(implied.alias("i"), cleaning.parameters_plausible(F.col("declared"), implied).alias("ok")).collect()
    assert [(r.i, r.ok) for r in got] == [(2.0, False), (2.0, True), (None, True)]
