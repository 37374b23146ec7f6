"""Quality by random-indexing word vectors and a two-layer network.

Every word has a sparse index vector, drawn from its hash. A word's vector is its index vector plus, for words of the
training sample, the sum of the index vectors around it there (random indexing). A raw token speaks as up to four
words: its letters, its shape, the run of signs at its end, and a mark if it repeats the token before. The vectors of
all tokens of a text are averaged; a network with one hidden layer reads the average. A temperature, fitted on training
texts kept back from the weights, calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c

WIDTH, NONZERO, WINDOW, LEAST_COUNT = 96, 6, 2, 5
HIDDEN, EPOCHS, RATE = 32, 40, 3e-3
SAMPLE_CHARS = 24_000_000
MOST_TOKENS = 400_000  # tokens whose vectors a worker remembers
_TOKEN = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def index_vectors(names: list[str], width: int = WIDTH) -> np.ndarray:
    """Sparse vectors of +1 and -1, drawn from each name's hash."""
    out = np.zeros((len(names), width), dtype=np.float32)
    h = np.fromiter((xxhash.xxh3_64_intdigest(n) for n in names), dtype=np.uint64, count=len(names))
    for k in range(NONZERO):
        x = c.mix(h + np.uint64(k + 1))
        np.add.at(out, (np.arange(len(names)), (x % np.uint64(width)).astype(np.int64)), np.where(x >> np.uint64(63), 1.0, -1.0))
    return out


def spoken(token: str) -> tuple[str, ...]:
    """The words of a raw token: its core, its shape, the signs after it."""
    before, core, after = _TOKEN.match(token).groups()
    shape = "<none>" if not core else "<upper>" if core.isupper() and len(core) > 1 else "<title>" if core[:1].isupper() else "<digit>" if core.isdigit() else "<lower>"
    signs = before + after
    return tuple(x for x in (core.lower(), shape, f"<{signs[:3]}>" if signs else "") if x)


@dataclass
class WordVectors:
    """Context vectors of the sample's frequent words; index vectors of all words."""

    context: dict[str, np.ndarray]

    def of_tokens(self, tokens: list[str]) -> np.ndarray:
        parts = [spoken(t) for t in tokens]
        names = list(dict.fromkeys(n for p in parts for n in p))
        own = index_vectors(names)
        for i, n in enumerate(names):
            if n in self.context:
                own[i] += self.context[n]
        at = {n: i for i, n in enumerate(names)}
        flat = np.fromiter((at[n] for p in parts for n in p), dtype=np.int64)
        begin = np.cumsum([0] + [len(p) for p in parts[:-1]])
        return np.add.reduceat(own[flat], begin, axis=0) if len(flat) else np.zeros((len(tokens), own.shape[1]), dtype=np.float32)


_REPEAT = index_vectors(["<repeat>"])[0]


def pooled(texts: pa.Array, vectors: WordVectors) -> np.ndarray:
    """Mean vector of all tokens of each text, with the logarithm of their number."""
    flat, rows = c.tokens(texts, lower=False)
    codes, words = c.coded(flat)
    n = np.bincount(rows, minlength=len(texts))
    total = np.zeros((len(texts), WIDTH))
    if len(codes):
        own = vectors.of_tokens(words.to_pylist())
        pairs, times = np.unique(rows * len(words) + codes, return_counts=True)
        for k in range(0, len(pairs), 65536):  # blocks bound the memory, however long a text is
            doc, code = np.divmod(pairs[k:k + 65536], len(words))
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            total[doc[begin]] += np.add.reduceat(own[code] * times[k:k + 65536, None].astype(np.float32), begin, axis=0)
        repeats = np.bincount(rows[1:][(codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])], minlength=len(texts))
        total += repeats[:, None] * _REPEAT[None, :]
    return np.concatenate([total / np.maximum(n, 1)[:, None], np.log1p(n)[:, None]], axis=1)


def learn_vectors(texts: list[str]) -> WordVectors:
    """Context vectors of cores that stand at least ``LEAST_COUNT`` times in the sample."""
    flat, rows = c.tokens(pa.array(texts, pa.string()), lower=True)
    codes, words = c.coded(flat)
    if not len(codes):
        return WordVectors({})
    cores = [spoken(w)[0] for w in words.to_pylist()]
    names, to_core = np.unique(np.array(cores, dtype=object), return_inverse=True)
    codes = to_core[codes]
    counts = np.bincount(codes, minlength=len(names))
    frequent = np.flatnonzero(counts >= LEAST_COUNT)
    place = np.full(len(names), -1, dtype=np.int64)
    place[frequent] = np.arange(len(frequent))
    own = index_vectors(list(names))
    context = np.zeros((len(frequent), WIDTH), dtype=np.float64)
    for step in range(1, WINDOW + 1):
        for a, b in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
            near = (rows[a] == rows[b]) & (place[codes[a]] >= 0)
            here, there = place[codes[a]][near], codes[b][near]
            order = np.argsort(here, kind="stable")
            here, there = here[order], there[order]
            for k in range(0, len(here), 262144):
                h, t = here[k:k + 262144], there[k:k + 262144]
                begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else []
                if len(h):
                    context[h[begin]] += np.add.reduceat(own[t], begin, axis=0)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    context = (context / np.maximum(norm, 1e-9) * 0.5).astype(np.float32)
    return WordVectors({str(names[f]): context[i] for i, f in enumerate(frequent)})


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Two layers by Adam on nine tenths of the rows; the temperature on the last tenth."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)
    order = rng.permutation(len(x))
    kept, held = order[len(x) // 10:], order[:len(x) // 10]
    z = (x - mean) / scale
    parameters = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(EPOCHS):
        rng.shuffle(kept)
        for k in range(0, len(kept), 128):
            part = kept[k:k + 128]
            hidden = np.tanh(z[part] @ parameters[0] + parameters[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ parameters[2] + parameters[3], -30, 30)))
            error = (p - y[part]) / len(part)
            back = np.outer(error, parameters[2]) * (1 - hidden ** 2)
            gradients = [z[part].T @ back + 1e-4 * parameters[0], back.sum(axis=0), hidden.T @ error + 1e-4 * parameters[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(gradients):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                parameters[i] -= RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parameters[0], parameters[1], parameters[2], float(parameters[3][0])
    if len(held):
        logits = net.logits(x[held])
        loss = lambda t: np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logits / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


class TokenTable:
    """What each token adds to the hidden layer. Pooling is linear, so standardisation and the first layer are applied to tokens.

    Known tokens stand before a batch's own when those are numbered. Beyond ``MOST_TOKENS`` only the last batch's stay.
    """

    def __init__(self, vectors: WordVectors, network: Network):
        self.vectors, self.network = vectors, network
        self.first = (network.w1 / network.scale[:, None]).astype(np.float64)
        self.base = network.b1 - (network.mean / network.scale) @ network.w1
        self.known, self.rows = pa.array([], pa.string()), np.zeros((0, self.first.shape[1]), dtype=np.float32)

    def numbers(self, flat: pa.Array) -> np.ndarray:
        coded = pa.concat_arrays([self.known, flat]).dictionary_encode()
        old = len(self.known)
        fresh = coded.dictionary[old:].to_pylist()
        if fresh:
            new = [self.vectors.of_tokens(fresh[k:k + 16384]) @ self.first[:WIDTH] for k in range(0, len(fresh), 16384)]
            self.known, self.rows = coded.dictionary, np.concatenate([self.rows, *(x.astype(np.float32) for x in new)])
        return np.asarray(coded.indices)[old:].astype(np.int64)

    def logits(self, texts: pa.Array) -> np.ndarray:
        flat, rows = c.tokens(texts, lower=False)
        codes = self.numbers(flat)
        n = np.bincount(rows, minlength=len(texts))
        total = np.zeros((len(texts), self.rows.shape[1]))
        for k in range(0, len(codes), 65536):
            doc = rows[k:k + 65536]
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            total[doc[begin]] += np.add.reduceat(self.rows[codes[k:k + 65536]], begin, axis=0)
        repeats = np.bincount(rows[1:][(codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])], minlength=len(texts))
        total += repeats[:, None] * (_REPEAT @ self.first[:WIDTH])[None, :]
        if len(self.known) > MOST_TOKENS:
            used = np.unique(codes)
            self.known, self.rows = self.known.take(pa.array(used)), self.rows[used]
        hidden = np.tanh(total / np.maximum(n, 1)[:, None] + np.log1p(n)[:, None] * self.first[WIDTH:] + self.base)
        return hidden @ self.network.w2 + self.network.b2


@dataclass
class Model:
    vectors: WordVectors
    network: Network | None
    share: float
    table: TokenTable | None = None  # grows in each worker

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        self.table = self.table or TokenTable(self.vectors, self.network)
        return self.network.calibrated(self.table.logits(texts))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on labelled rows whose crc32(doc_id) mod ``modulus`` is not 0, of at most ``sample_chars`` characters."""
    return c.train_on(c.labelled_sample(docs, labels, label, modulus, sample_chars), train)


def train(texts: list[str], marks: list[int]) -> Model:
    """Fit on whole labelled texts."""
    y = np.array(marks, dtype=np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    if not len(y) or y.min() == y.max():
        return Model(WordVectors({}), None, share)
    vectors = learn_vectors(texts)
    x = np.concatenate([pooled(pa.array(texts[k:k + 500], pa.string()), vectors) for k in range(0, len(texts), 500)])
    return Model(vectors, train_network(x, y), share)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    docs: doc_id long, text string; labels: doc_id, quality 0/1; further columns are not read. A null or blank text is
    scored by the network on the zero vector. A null id counts as held out. Repeated rows are scored each; of different
    labels of an id the smaller counts. Labels other than 0 and 1 are not used; without labels of both kinds every score
    is the share of label 1 (0.5 without labels). An empty table gives an empty result.
    """
    # At most one context vector for each LEAST_COUNT words of the sample: bounded by ``sample_chars``.
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus=modulus, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, most=2 << 20):
            p = shared.value.scores(batch.column("text"))
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (c.crc32_of_id(F.col("doc_id")) % modulus == 0).alias("held_out"), "score", "predicted")
