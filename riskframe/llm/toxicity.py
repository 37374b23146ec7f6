"""Toxicity by a classifier that is indifferent to who is named.

A linear model over hashed words and word beginnings scores segments (sentences, in runs of at most 32 words); a text is
as toxic as its most toxic segment. Labels are of whole texts, so training alternates between picking the segment that
speaks most for a toxic text and fitting the weights. Wherever a training segment holds an identity term, the term is
swapped for the others of its group, and the squared change of the score is part of the loss (counterfactual pairs), so
a neutral mention of a group does not raise the score.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c

SLOTS = 1 << 18
BEGINNINGS = (4, 5, 6)
SEGMENT = 32
SAMPLE_CHARS = 24_000_000

# Terms that name groups, neutral in themselves; a term is swapped within its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "foreigner", "refugee"),
    ("immigrants", "natives", "foreigners", "refugees"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("étrangers", "immigrés"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("extranjeros", "inmigrantes"),
)
_SWAPS = {t: [o for o in row if o != t] for row in IDENTITY_TERMS for t in row}


def _bare(word: str) -> str:
    return word.lower().strip(string.punctuation)


def word_slots(words: list[str]) -> np.ndarray:
    """Slots of each word: the bare word and its beginnings; unused places hold ``SLOTS``."""
    found = np.full((len(words), 1 + len(BEGINNINGS)), SLOTS, dtype=np.int64)
    h = xxhash.xxh3_64_intdigest
    for i, word in enumerate(words):
        bare = _bare(word)
        if bare:
            found[i, 0] = h("w" + bare) % SLOTS
            for k, n in enumerate(BEGINNINGS):
                if len(bare) > n:
                    found[i, 1 + k] = h("b" + bare[:n]) % SLOTS
    return found


def segments(flat: pa.Array, rows: np.ndarray) -> np.ndarray:
    """First token of each segment: a new text, after an end of sentence, or after ``SEGMENT`` words."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    ends = np.asarray(pc.match_substring_regex(flat, r"[.!?]$"))
    start = np.ones(len(rows), dtype=bool)
    start[1:] = ends[:-1] | (rows[1:] != rows[:-1])
    first = np.flatnonzero(start)
    since = np.arange(len(rows)) - first[np.cumsum(start) - 1]
    return np.flatnonzero(start | (since % SEGMENT == 0))


def distinct(codes: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's distinct words, and where they begin: a word said often in a segment speaks once."""
    sizes = np.diff(np.append(first, len(codes)))
    pairs = np.unique(np.repeat(np.arange(len(first)), sizes) * words + codes)
    of = pairs // max(words, 1)
    return pairs % max(words, 1), np.searchsorted(of, np.arange(len(first)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # SLOTS + 1, the last one 0
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text; one without words has that of an empty segment."""
        flat, rows = c.tokens(texts, lower=False)
        codes, words = c.coded(flat)
        best = np.full(len(texts), self.bias)
        if len(codes):
            value = self.weights[word_slots(words.to_pylist())].sum(axis=1)
            first = segments(flat, rows)
            own, begin = distinct(codes, first, len(words))
            np.maximum.at(best, rows[first], np.add.reduceat(value[own], begin) + self.bias)
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def train(texts: list[str], labels: list[int], penalty: float = 1.0, turns: int = 3, steps: int = 80) -> Model:
    """Fit on whole labelled texts."""
    y = np.array(labels, dtype=np.float64)
    weights = np.zeros(SLOTS + 1)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Model(weights.astype(np.float32), float(np.log(share / (1 - share))))
    flat, rows = c.tokens(pa.array(texts, pa.string()), lower=False)
    codes, words = c.coded(flat)
    words = words.to_pylist()
    slots = word_slots(words)
    first = segments(flat, rows)
    of_text = rows[first]
    spoken, first = distinct(codes, first, len(words))
    last = np.append(first[1:], len(spoken))

    # Start: how much more often a slot stands in toxic texts, for slots of three texts or more.
    pairs = np.unique(rows * len(words) + codes)
    counts = []
    for side in (1, 0):
        seen = np.bincount(pairs[y[pairs // len(words)] == side] % len(words), minlength=len(words))
        counts.append(np.bincount(slots.reshape(-1), weights=np.repeat(seen, slots.shape[1]), minlength=SLOTS + 1))
    rate = [(n + 0.5) / (m + 1.0) for n, m in zip(counts, (y.sum(), (1 - y).sum()), strict=True)]
    weights = np.where(counts[0] + counts[1] >= 3, np.log(rate[0]) - np.log(rate[1]), 0.0)
    weights[SLOTS] = 0.0
    bias = -2.0
    for _ in range(turns):
        value = weights[slots].sum(axis=1)
        score = np.add.reduceat(value[spoken], first)
        order = np.lexsort((-score, of_text))
        rank = np.empty(len(order), dtype=np.int64)
        starts = np.searchsorted(of_text, of_text, side="left")
        rank[order] = np.arange(len(order))
        rank -= starts
        chosen = np.flatnonzero(np.where(y[of_text] == 1, rank < 1, rank < 4))  # a toxic text's worst segment; a clean text's four
        sizes = last[chosen] - first[chosen]
        begin = np.cumsum(sizes) - sizes
        own = spoken[np.repeat(first[chosen] - begin, sizes) + np.arange(sizes.sum())]
        target = y[of_text[chosen]]
        weight = np.where(target == 1, np.sqrt(max((1 - target).sum(), 1) / max(target.sum(), 1)), 1.0)
        weights, bias = _fit(weights, bias, own, begin, target, weight / weight.sum(), slots, words, penalty, steps)
    return Model(weights.astype(np.float32), bias)


def _swapped(words: list[str], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of identity terms among the chosen tokens: slots of the term, slots of each other term, and how often."""
    seen = np.bincount(own, minlength=len(words))
    here, there, n = [], [], []
    for i in np.flatnonzero(seen):
        for other in _SWAPS.get(_bare(words[i]), ()):
            here.append(words[i])
            there.append(other)
            n.append(float(seen[i]))
    return word_slots(here), word_slots(there), np.array(n)


def _fit(weights, bias, own, begin, target, weight, slots, words, penalty, steps, rate=0.3, decay=1e-5):
    """Gradient steps with per-slot rates on logistic loss + weight decay + squared score change under swaps."""
    here, there, times = _swapped(words, own)
    share = times / max(len(begin), 1)
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(own))))
    past, past_bias = np.full(SLOTS + 1, 1e-8), 1e-8
    used = np.unique(own)
    used_slots = slots[used].reshape(-1)
    for _ in range(steps):
        value = weights[slots[used]].sum(axis=1)
        full = np.zeros(len(words))
        full[used] = value
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(full[own], begin) + bias, -30, 30)))
        error = (p - target) * weight
        by_word = np.bincount(own, weights=error[of], minlength=len(words))[used]
        gradient = np.bincount(used_slots, weights=np.repeat(by_word, slots.shape[1]), minlength=SLOTS + 1) + decay * weights
        if len(times):
            change = weights[here].sum(axis=1) - weights[there].sum(axis=1)
            pull = np.repeat(2 * penalty * share * change, here.shape[1])
            gradient += np.bincount(here.reshape(-1), weights=pull, minlength=SLOTS + 1)
            gradient -= np.bincount(there.reshape(-1), weights=pull, minlength=SLOTS + 1)
        gradient[SLOTS] = 0.0
        past += gradient ** 2
        weights = weights - rate * gradient / np.sqrt(past)
        past_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(past_bias)
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, sample_chars: int = SAMPLE_CHARS, penalty: float = 1.0) -> Model:
    """Train on labelled rows whose crc32(doc_id) mod ``modulus`` is not 0, of at most ``sample_chars`` characters."""
    return c.train_on(c.labelled_sample(docs, labels, label, modulus, sample_chars), lambda texts, marks: train(texts, marks, penalty))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with score and predicted (in place of columns so named)."""
    from pyspark.sql import types as T

    own = docs.drop("score", "predicted")
    names = own.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte: the slots are fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, most=4 << 20):
            p = shared.value.scores(batch.column("text"))
            yield pa.record_batch({**{n: batch.column(n) for n in names}, "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    docs: doc_id long, text string; labels: doc_id, toxic 0/1; further columns are not read. A null or blank text has
    the score of an empty segment, far below the threshold. A null id counts as held out. Repeated rows are scored
    each; of labels repeated for an id one is used. Labels other than 0 and 1 are not used; without labels of both
    kinds every text has the same score, the share of toxic ones (0.01 at least). An empty table gives an empty result.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, modulus=modulus, **options), threshold)
    return scored.select("doc_id", (c.crc32_of_id(F.col("doc_id")) % modulus == 0).alias("held_out"), "score", "predicted")
