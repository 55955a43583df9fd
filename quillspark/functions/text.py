"""The text kernel as Spark columns: normalisation, words, sentences, shingles, token counts.

All functions take and return columns and stay in the JVM. (?U) makes Java's classes follow
Unicode. A null text gives a null column unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

UNIT = "\x1f"  # joins parts of keys
# what (?U)[\s\x1c-\x1f] matches: Unicode's blanks and the separators below the blank
BLANKS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _accents() -> tuple[str, str]:
    """Precomposed letters and what is left of them without their marks, from Unicode's own rule."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        whole = chr(code)
        bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", whole) if not unicodedata.combining(c)))
        if bare != whole and len(bare) == 1:
            pairs.append((whole, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _accents()


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda's variable holds it.

    An expression named inside a lambda's body is evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_any(text: Column, markers) -> Column:
    """True where the text contains one of the markers."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


# -- T1 to T5 ---------------------------------------------------------------------------


def compose(text: Column) -> Column:
    """Compose the letters of Latin scripts that come as base and combining mark (NFC).

    Rows without combining marks, nearly all, are passed through; the others are composed pair by
    pair over the marks of Latin scripts.
    """
    out = text
    for mark in "̧̀́̂̃̈̊̌":
        whole = [(base, unicodedata.normalize("NFC", base + mark)) for base in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        for base, one in whole:
            if len(one) == 1:
                out = F.replace(out, F.lit(base + mark), F.lit(one))
    return F.when(text.rlike("\\p{Mn}"), out).otherwise(text)


def normalize(text: Column) -> Column:
    """Line ends unified, controls and no-break blanks mended, blank runs and lines collapsed."""
    c = compose(text)
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(F.translate(c, " ﻿", " "), r"[\x00-\x08\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"[ \t\x0b\f]+", " ")
    # Unicode blanks at line ends go too
    c = F.regexp_replace(c, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(c)


def strip(text: Column) -> Column:
    """Blanks of any kind off both ends."""
    return F.btrim(text, F.lit(BLANKS))


def fold(text: Column) -> Column:
    """Letters without their marks, for matching only."""
    return F.regexp_replace(F.translate(text, MARKED, BARE), r"\p{Mn}", "")


# an apostrophe within reach is looked for before the dearer test for the word's beginning
ELISION = r"(?U)(?=[cdijlmnopqrstu]{1,6}['’])\b([cdjlmnstqu]|qu|jusqu|lorsqu|puisqu)['’]"
WORD = r"(?U)[0-9\w][0-9\w'’-]*"
PLAIN_WORD = r"[0-9a-z_][0-9a-z_'-]*"  # the same for lower-cased ASCII


def _plain(text: Column) -> Column:
    """Whether a text is ASCII, by its lengths."""
    return F.octet_length(text) == F.length(text)


def words(text: Column) -> Column:
    """Lower-case words with elided articles split off and accents folded.

    A text pays for what it holds: ASCII needs neither folding nor Unicode's classes, and precomposed letters
    are folded in the words that have them, as they are letters before and after. Texts with combining
    marks are folded before they are split.
    """

    def of(t: Column) -> Column:
        bare = F.when(F.contains(t, F.lit("'")) | F.contains(t, F.lit("’")), F.regexp_replace(t, ELISION, " ")).otherwise(t)
        found = F.regexp_extract_all(bare, F.lit(WORD), 0)
        folded = F.transform(found, lambda w: F.when(_plain(w), w).otherwise(F.translate(w, MARKED, BARE)))
        return F.when(_plain(t), F.regexp_extract_all(bare, F.lit(PLAIN_WORD), 0)).when(t.rlike(r"\p{Mn}"), F.regexp_extract_all(fold(bare), F.lit(WORD), 0)).otherwise(folded)

    return let(F.lower(text), of)


def _without_enclitic(word: Column) -> Column:
    out = word
    for e in reversed(W.ENCLITICS):
        out = F.when(F.endswith(word, F.lit(e)) & (F.length(word) > len(e) + 2), F.substring(word, F.lit(1), F.length(word) - len(e))).otherwise(out)
    return F.when(F.contains(word, F.lit("-")), out).otherwise(word)


def content_words(text: Column) -> Column:
    """T4: words less enclitics, stop words and single characters."""
    bare = F.transform(words(text), _without_enclitic)
    return F.filter(bare, lambda w: (F.length(w) > 1) & ~w.isin(*W.STOP_WORDS))


def sentences(text: Column) -> Column:
    """T5: pieces after . ! ? ; : and blank lines, stripped, without empty ones."""
    return F.filter(sentence_parts(text), lambda s: s != "")


def sentence_parts(text: Column) -> Column:
    """The pieces that sentences() takes, empty ones too."""
    return F.transform(F.split(text, r"(?U)(?<=[.!?;:])\s+|\n{2,}"), strip)


# -- T6 to T11 --------------------------------------------------------------------------


def grams(tokens: Column, n: int = 4) -> Column:
    """Distinct n-grams of a word array; one gram of all where there are fewer words."""

    def of(w: Column) -> Column:
        size = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), UNIT))
        empty = F.array().cast("array<string>")
        return F.when(size == 0, empty).when(size < n, F.array(F.array_join(w, UNIT))).otherwise(F.array_distinct(runs))

    return let(tokens, of)


def shingles(text: Column, n: int = 4) -> Column:
    return grams(content_words(text), n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike, an empty and another are not."""

    def of(x: Column, y: Column) -> Column:
        both_empty = (F.size(x) == 0) & (F.size(y) == 0)
        one_empty = (F.size(x) == 0) | (F.size(y) == 0)
        return F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: of(p["a"], p["b"]))


CHARS_PER_TOKEN, TOKENS_PER_WORD = 3.6, 1.32


def tokens_of(chars: Column, words: Column) -> Column:
    """The count for a text of so many characters, one at least, and words."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(chars / F.lit(CHARS_PER_TOKEN), words * F.lit(TOKENS_PER_WORD))).cast("int"))


def word_total(text: Column) -> Column:
    """Runs of characters that are not blank."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def token_count(text: Column) -> Column:
    """Heuristic token count, the larger of a count by characters and one by words."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(tokens_of(F.length(text), word_total(text)))


HEAD = 40  # characters for each token of a limit; sentences that are longer are looked for in the whole text


def truncate_to_tokens(text: Column, limit: Column | int) -> Column:
    """Leading whole sentences within the limit, else a proportional cut at a blank.

    Sentences that end within a text's head are the text's own. Where they pass the limit the rest is not split.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    state = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.lit(0).alias("kept"))

    def add(a: Column, s: Column) -> Column:
        def costing(cost: Column) -> Column:
            fits = ~a["full"] & (a["used"] + cost <= limit)
            return let(fits, lambda f: F.struct((a["used"] + F.when(f, cost).otherwise(0)).alias("used"), (~f).alias("full"), (a["kept"] + f.cast("int")).alias("kept")))

        return F.when(a["full"], a).otherwise(let(token_count(s) + 1, costing))

    def fitted(s: Column) -> Column:
        return F.aggregate(s, state, add, lambda a: F.struct(a["full"].alias("full"), F.slice(s, 1, a["kept"]).alias("kept")))

    # the head's last sentence may go on behind it
    parts = sentence_parts(F.substring(text, F.lit(1), limit * HEAD))
    whole = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s != "")
    kept = let(let(whole, fitted), lambda a: F.when(a["full"], a["kept"]).otherwise(let(sentences(text), fitted)["kept"]))

    def head() -> Column:
        cut = F.greatest(F.lit(1), F.floor(F.length(text) * (limit / F.greatest(F.lit(1), token_count(text)))).cast("int"))
        start = F.substring(text, F.lit(1), cut)
        # up to the last blank, all of it where there is none
        return let(start, lambda h: F.when(F.contains(h, F.lit(" ")), F.regexp_replace(h, r"(?s) [^ ]*\z", "")).otherwise(h))

    # a text of too many characters is too long whatever its words
    short = (F.length(text) / F.lit(CHARS_PER_TOKEN) <= limit) & (token_count(text) <= limit)
    return F.when(limit <= 0, "").when(short, text).otherwise(let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(head())))


def numeric_signature(text: Column) -> Column:
    """Sorted distinct figures of a text, normalised."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\d[\d\s.,%]*"), 0), lambda x: F.regexp_replace(x, r"^[ .,]+|[ .,]+\z", "") != "")
    clean = F.transform(found, lambda x: F.replace(F.regexp_replace(F.replace(x, F.lit(" "), F.lit("")), r"[.,]+\z", ""), F.lit(","), F.lit(".")))
    return F.sort_array(F.array_distinct(clean))


# -- T12 to T18 -------------------------------------------------------------------------


def detect_language(text: Column, sample_chars: int | None = 4000) -> Column:
    """Fr, en or und by marker words of a text's first `sample_chars` characters; None reads it whole."""

    def of(sample: Column) -> Column:
        count = lambda markers: F.size(F.filter(sample, lambda w: w.isin(*markers)))
        return F.sign(count(W.FRENCH_MARKERS) - count(W.ENGLISH_MARKERS))

    lead = let(words(text if sample_chars is None else F.substring(text, 1, sample_chars)), of)
    return F.when(lead == 0, "und").when(lead > 0, "fr").otherwise("en")


def sha(text: Column, length: int = 64) -> Column:
    """SHA-256 in hexadecimal, or its beginning."""
    full = F.sha2(text, 256)
    return full if length >= 64 else F.substring(full, 1, length)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and no blanks; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def phrases(question: Column, n: int = 3) -> Column:
    """All runs of n words of a lower-cased question, stop words and accents kept."""


    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(runs)

    return let(F.filter(F.split(F.lower(question), r"(?U)\W+"), lambda t: t != ""), of)


CITATION = r"\[(S\d+)\]"


def citations(answer: Column) -> Column:
    """Sorted distinct labels cited."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), 1)))


def strip_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, CITATION, "")


def declares_insufficient(answer: Column) -> Column:
    """T17."""
    return contains_any(F.lower(answer), W.INSUFFICIENT_MARKERS)


def hedges(answer: Column) -> Column:
    return contains_any(F.lower(answer), W.HEDGE_MARKERS)


def looks_french(question: Column) -> Column:
    """T18."""
    return contains_any(F.concat(F.lit(" "), F.lower(question), F.lit(" ")), W.FRENCH_QUESTION)


# -- identities -------------------------------------------------------------------------


def artifact_id(prefix: str, kind: str, *parts: Column) -> Column:
    """Deterministic id of an artifact: prefix and the head of a hash of its parts."""
    return F.concat(F.lit(prefix + "_"), sha(F.concat_ws(UNIT, F.lit(kind), *parts), 16))


def document_id(descriptor_id: Column, filename: Column) -> Column:
    return sha(F.concat_ws(":", descriptor_id, filename), 24)


def unit_id(document: Column, order: Column) -> Column:
    return F.concat(F.substring(document, 1, 12), F.lit("#"), F.when(order < 10000, F.lpad(order.cast("string"), 4, "0")).otherwise(order.cast("string")))
