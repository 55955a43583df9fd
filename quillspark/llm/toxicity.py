"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, hashed into a table; a window of words
is the mean of its words, and a linear softmax over that mean gives the window's toxic logit.
Embeddings and softmax are trained together on a bounded sample of labelled rows, with step sizes
that shrink per table row as its gradients add up, and without the rows that fewer than MIN_DOCS
documents touch, which could only be learnt by heart. A label says that a document is toxic, not
where, so each pass trains on the window that the current model finds worst (and on a random window
of each document). Because the softmax is linear in the mean, a trained word is one number: its
share of a window's logit. A document is scored whole: all of its words in one pass, the windows'
means by running sums, and a logistic calibration of its worst windows and of how many and how bad
its worst words are, fitted on rows that training left out. A misspelled word that training never
saw shares most n-grams, and so most of its number, with the word it distorts.

Words of a batch are dictionary-encoded in Arrow, and n-grams are hashed and looked up for the
batch's distinct words at once.

Defined results. A null or wordless text has no window and gets the score of the calibration's
floor (clean). Rows with a null doc_id are scored like any other, and count as not held out. Score
depends on the text alone, so equal texts have equal scores. A doc_id that several rows or labels
carry is learnt from once (its least text, toxic if any label says so). An empty table gives an
empty table. Without labelled rows of both classes there is nothing to learn: `fit` raises
ValueError, and `train` gives a model that scores every text 0. Columns named score or predicted,
in any case, are replaced by `score`; all others are returned untouched.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, ready, store

STRIP = string.punctuation + "«»“”„‘’…–—¿¡"
BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
WINDOW, STEP = 16, 8
RATE, DECAY, WARM, GAIN = 0.05, 0.95, 10, 4.0  # step size, shrinkage a pass, passes over random windows, softmax's first scale
MIN_DOCS = 3  # training documents that must share an n-gram
TOP, OUTLIER = 8, 3.0  # words that count as a document's worst, and the logit of a bad word
ROWS, WORDS = 256, 20_000  # documents scored, and words hashed, at once
CACHE = 500_000  # words a worker remembers before it starts anew
PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text, without the punctuation around them."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    bare = pc.utf8_trim(words.values, characters=STRIP)
    whole = pc.greater(pc.binary_length(bare), 0)
    before = np.concatenate(([0], np.cumsum(whole.to_numpy(zero_copy_only=False))))
    return pa.LargeListArray.from_arrays(pa.array(before[words.offsets.to_numpy()], pa.int64()), bare.filter(whole))


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word, side by side, and how many each has: the word itself and its n-grams."""
    parts = [_subwords(words.slice(k, WORDS)) for k in range(0, len(words), WORDS)]
    return tuple(np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]) for k in (0, 1))


def word_means(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of the table rows' values for each word, some words at a time."""
    ends, out = np.concatenate(([0], np.cumsum(sizes))), np.empty(len(sizes))
    for k in range(0, len(sizes), WORDS):
        stop = min(k + WORDS, len(sizes))
        out[k:stop] = np.add.reduceat(values[rows[ends[k] : ends[stop]]], ends[k:stop] - ends[k]) / sizes[k:stop]
    return out


def _subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    marked = "".join(f"<{w}>" for w in words.to_pylist())
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
    first = np.cumsum(length) - length
    power = np.cumprod(np.full(int(length.max()), PRIME, np.uint64))
    inside = np.arange(len(codes)) - np.repeat(first, length)
    keys, owners = [np.add.reduceat(codes * power[inside], first)], [np.arange(len(length))]
    for n in GRAMS:
        count = np.maximum(length - n + 1, 0)
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        h = np.full(len(at), np.uint64(n), np.uint64)
        for k in range(n):
            h = h * PRIME + codes[at + k]
        keys.append(h)
        owners.append(np.repeat(np.arange(len(length)), count))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    key ^= key >> np.uint64(32)
    key *= PRIME
    rows = (key >> np.uint64(48)).astype(np.uint16)  # the table has 2**16 rows
    return rows[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(length))


@dataclass
class Model:
    """grams: each table row's share of the toxic logit; bias: of a window; scale: the calibration."""

    grams: np.ndarray
    bias: float
    scale: np.ndarray

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's share of the logit."""
        return word_means(self.grams, *subwords(words))

    def word(self, token: str) -> float:
        return float(self.numbers(pa.array([token.lower().strip(STRIP)], pa.large_string()))[0])


def windows(n: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents of n words that lie side by side: first word, length, and how many a document has."""
    spare = np.maximum(n - width, 0)
    count = np.where(n > 0, -(-spare // step) + 1, 0)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(n) - n, count) + np.minimum(j * step, np.repeat(spare, count))
    return start, np.repeat(np.minimum(n, width), count), count


def features(numbers: np.ndarray, n: np.ndarray, bias: float) -> np.ndarray:
    """Per document of n words: the logits of its worst window, quarter-window and TOP words, the
    share of words over zero, how many are bad, and a constant."""
    out = np.tile([bias, bias, 0.0, bias, 0.0, 1.0], (len(n), 1))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    total = np.concatenate(([0.0], np.cumsum(numbers)))
    ends = np.cumsum(n)
    for k, (width, step) in enumerate(((WINDOW, STEP), (WINDOW // 4, 1))):
        start, length, count = windows(n, width, step)
        means = (total[start + length] - total[start]) / length
        out[some, k] = np.maximum.reduceat(means, (np.cumsum(count) - count)[some]) + bias
    first = (ends - n)[some]
    out[some, 2] = (np.add.reduceat((numbers + bias > 0).astype(float), first) / n[some]) ** 0.5
    for i in some:
        own = numbers[ends[i] - n[i] : ends[i]]
        out[i, 3] += (np.partition(own, n[i] - TOP)[n[i] - TOP :] if n[i] > TOP else own).mean()
    out[some, 4] = np.log1p(np.add.reduceat((numbers + bias > OUTLIER).astype(float), first))
    return out


class Scorer:
    """Features of whole texts under a model; words seen before are looked up."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words = tokens(texts)
        n = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = [w for w in names if w not in self.known]
        self.known.update(zip(fresh, self.model.numbers(pa.array(fresh, pa.large_string())).tolist()))
        number = np.fromiter(map(self.known.__getitem__, names), np.float64, len(names))
        return features(number[coded.indices.to_numpy()], n, self.model.bias)


def _sigmoid(x):
    return np.where(x == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(texts: list[str], labels: list[int], prior: float | None = None, epochs: int = 30, seed: int = 7) -> Model:
    """Train on the given documents; every fourth calibrates and is not trained on.

    prior: share of toxic rows among all labelled rows, where the sample's share differs from it.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        raise ValueError("labelled rows of both classes are needed")
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::4]] = True
    texts = pa.array(texts, pa.large_string())
    parts = [tokens(texts.slice(k, ROWS)) for k in range(0, len(texts), ROWS)]
    ends = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts]))))
    coded = pa.chunked_array([p.flatten() for p in parts], pa.large_string()).dictionary_encode().unify_dictionaries()
    del parts
    code, vocabulary = np.concatenate([c.indices.to_numpy() for c in coded.chunks]), coded.chunk(0).dictionary
    docs = [code[a:b] for a, b in zip(ends, ends[1:])]
    flat, sizes = subwords(vocabulary)
    del coded, vocabulary
    pa.default_memory_pool().release_unused()
    begin = np.cumsum(sizes) - sizes
    # n-grams that few documents share could only be learnt by heart
    shared = np.zeros(BUCKETS, np.int32)
    for d in docs:
        own = np.unique(d)
        shared[np.unique(flat[np.repeat(begin[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())])] += 1
    shared = (shared >= MIN_DOCS)[:, None]

    table = rng.normal(0, 0.01, (BUCKETS, DIM)) * shared
    past = np.full(BUCKETS, 1e-4)  # squared gradients so far
    out = rng.normal(0, GAIN, (2, DIM))
    bias = np.zeros(2)
    train = [i for i in np.flatnonzero(~held) if len(docs[i])]
    use = np.concatenate([docs[i] for i in train])
    target = y[train]
    # every window of every training document: first word, length, and the document
    wstart, wlen, count = windows(np.array([len(docs[i]) for i in train]), WINDOW, STEP)
    wdoc, wfirst = np.repeat(np.arange(len(train)), count), np.cumsum(count) - count
    share = np.array([max(1.0, np.sqrt((1 - target).sum() / target.sum())), 1.0])  # the rare class weighs more
    for epoch in range(epochs):
        number = word_means(table @ (out[1] - out[0]), flat, sizes)
        total = np.concatenate(([0.0], np.cumsum(number[use])))
        means = (total[wstart + wlen] - total[wstart]) / wlen
        best = np.maximum.reduceat(means, wfirst)
        worst = np.zeros(len(train), np.int64)
        hit = np.flatnonzero(means == best[wdoc])[::-1]
        worst[wdoc[hit]] = hit
        some = wfirst + (rng.random(len(train)) * np.diff(np.append(wfirst, len(wdoc)))).astype(np.int64)
        # no model yet to say where: random windows first, of both classes alike
        chosen = np.concatenate([some, some if epoch < WARM else worst])
        for batch in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 64)):
            length = wlen[batch]
            inside = np.repeat(wstart[batch], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            word, owner = use[inside], np.repeat(np.arange(len(batch)), length)
            count = sizes[word]
            gram = flat[np.repeat(begin[word], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            weight = np.repeat(1 / (count * length[owner]), count)
            gram_owner = np.repeat(owner, count)
            mean = np.stack([np.bincount(gram_owner, weight * table[gram, k], len(batch)) for k in range(DIM)], 1)
            label = target[wdoc[batch]]
            wrong = _sigmoid((mean @ out.T + bias) @ [-1, 1]) - label
            wrong *= np.where(label == 1, share[0], share[1])
            used, where = np.unique(gram, return_inverse=True)
            push = np.bincount(where, weight * wrong[gram_owner])
            past[used] += push**2
            push /= np.sqrt(past[used])
            grads = (np.outer(push, out[1] - out[0]), np.outer([-1, 1], wrong @ mean), np.array([-1, 1]) * wrong.sum())
            for x, g, at, rate in zip((table, out, bias), grads, (used, slice(None), slice(None)), (RATE, RATE, RATE)):
                x[at] -= rate * g
        table *= DECAY * shared
    model = Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]), np.zeros(6))
    scorer, rest = Scorer(model), np.flatnonzero(held)
    x = np.concatenate([scorer(texts.take(pa.array(rest[k : k + ROWS]))) for k in range(0, len(rest), ROWS)])
    model.scale = _logistic(x, y[held])
    if prior is not None and 0 < prior < 1:
        sampled = y[held].mean()
        model.scale[-1] += np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the last column is the constant."""
    spread = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    middle = np.where(x.std(0) > 1e-9, x.mean(0), 0.0)
    z = (x - middle) / spread
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])

    def loss(b):
        m = np.clip(z @ b, -500, 500)
        return np.logaddexp(0, m).sum() - y @ m + b @ penalty @ b / 2

    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = _sigmoid(z @ b)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ b)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    out = b / spread
    out[-1] -= (b * middle / spread)[:-1].sum()
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int = 64 << 20) -> tuple[list[str], list[int], float | None]:
    """At most `rows` labelled texts of together at most `most_bytes`, none of them held out, half of
    them toxic where there are as many, and the toxic share of all such labels.

    Chosen by a hash of doc_id, so the sample is the same at every run. Texts are taken whole; one
    that no longer fits is passed over.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for c in (0, 1)]
    both = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most `rows` ids
    text = F.min(F.coalesce("text", F.lit(""))).alias("text")
    got = store(docs.select("doc_id", "text").join(both, "doc_id").groupBy("doc_id", "toxic").agg(text), "labelled")
    sizes = got.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).collect()  # at most `rows`
    ids, used = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if used + r.n <= most_bytes:
            used += r.n
            ids.append((r.doc_id,))
    fitting = F.broadcast(docs.sparkSession.createDataFrame(ids, got.select("doc_id").schema))
    table = got.join(fitting, "doc_id").select("doc_id", "toxic", "text").toArrow()
    table = table.sort_by([(c, "ascending") for c in table.column_names])
    return table["text"].to_pylist(), table["toxic"].to_pylist(), known.agg(F.avg("toxic")).first()[0]


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted added; the model (half a megabyte) goes with the task."""
    ready(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    fields = docs.columns
    at = [c.lower() for c in fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                p = _sigmoid(scorer(batch.column(at)) @ model.scale)
                columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*fields, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(list(docs.schema.fields)).add("score", DoubleType()).add("predicted", IntegerType())
    return gathered(docs).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> Model:
    """A model of at most `rows` labelled rows; one that scores 0 where they are not of both classes."""
    texts, toxic, prior = labelled_sample(docs, labels, rows)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, np.array([0.0, 0.0, 0.0, 0.0, 0.0, -np.inf]))
    return fit(texts, toxic, prior)
