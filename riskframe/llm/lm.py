"""Deleted-interpolation language model.

The probability of a word mixes its maximum-likelihood bigram estimate with a unigram estimate and a uniform one. The
weight of the bigram depends on how often its context was seen (buckets by powers of two); all weights are learned by
expectation-maximisation on a held-out part of the training documents, whose counts are deleted from the estimates
meanwhile. Afterwards the model counts every training document.

How it runs: documents are read in groups of about a million tokens. Each group asks for the counts of its distinct
words and bigrams, once, as sorted 64-bit keys; keys are dealt out by range, added up there, and the totals go back to
the group. A word or pair that stands in every text costs one key a group, so no key is hot. Nothing of the corpus
comes to the driver but fixed-size histograms. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c

END, START = np.uint64(0x1E), np.uint64(0x1C)  # keys of the end of a text and of its start; words' keys are scrambled hashes
GROUP_TOKENS = 800_000
CONTEXT_BUCKETS, RATIO_BINS, RATIO_PER_E = 48, 1200, 20
EXACT_COUNTS, COUNT_BINS = 1024, 1024 + 64 * 32
_GROUP = "group long, em boolean, kind int, bucket int, docs binary, words binary, codes binary, train binary, fold binary"
_REQUEST = "group long, em boolean, bucket int, keys binary, train binary, fold binary"


@dataclass(frozen=True)
class Weights:
    """What the driver holds of the model: totals and mixture weights, of fixed size."""

    train_tokens: int
    types: int
    unigram: float
    bigram: tuple[float, ...]  # by context bucket


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2)."""
    return np.where(count > 0, np.frexp(count.astype(np.float64))[1], 0).clip(0, CONTEXT_BUCKETS - 1)


def _count_bin(count: np.ndarray) -> np.ndarray:
    """Counts below 1024 exactly, larger ones to 1/32 of a doubling."""
    big = EXACT_COUNTS + (32 * (np.log2(np.maximum(count, EXACT_COUNTS)) - 10)).astype(np.int64)
    return np.where(count < EXACT_COUNTS, count, big).clip(0, COUNT_BINS - 1)


def _bin_count(b: np.ndarray) -> np.ndarray:
    return np.where(b < EXACT_COUNTS, b, 2.0 ** (10 + (b - EXACT_COUNTS + 0.5) / 32))


# --- reading documents into groups ---------------------------------------------

def _tokenise(remainder: int, modulus: int, em_modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def group(em: bool) -> pa.RecordBatch:
            nonlocal number
            parts, held[em], size[em] = held[em], [], 0
            ids = [i for p in parts for i in p[0]]
            lengths = np.concatenate([p[1] for p in parts])
            train = np.concatenate([p[2] for p in parts])
            found = pa.chunked_array([p[3] for p in parts], pa.string()).combine_chunks()
            codes, words = c.coded(found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks))
            keys = c.mix(c.hashes(words)) & ~np.uint64(1)
            order = np.argsort(keys)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            docs = pa.record_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(lengths), "train": pa.array(train)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(docs)
            number += 1
            return pa.record_batch({
                "group": pa.array([(task << 24) + number], pa.int64()), "em": pa.array([em]), "kind": pa.array([0], pa.int32()),
                "bucket": pa.array([-1], pa.int32()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                "words": pa.array([c.pack(keys[order], delta=True)], pa.binary()),
                "codes": pa.array([c.pack(place[codes].astype(np.int32))], pa.binary()),
                "train": pa.array([None], pa.binary()), "fold": pa.array([None], pa.binary())})

        for batch in c.pieces(batches, most=4 << 20):
            ids = batch.column("doc_id").to_pylist()
            train = c.id_remainder(ids, modulus) != remainder
            fold = train & (np.array([c.xxhash.xxh3_64_intdigest(str(i).encode(), 7) % em_modulus for i in ids]) == 0)
            flat, rows = c.tokens(batch.column("text"), lower=True)
            lengths = np.bincount(rows, minlength=len(ids))
            for em in (False, True):
                mine = fold == em
                if mine.any():
                    words = flat if mine.all() else flat.filter(pa.array(mine[rows]))
                    held[em].append(([i for i, m in zip(ids, mine, strict=True) if m], lengths[mine], train[mine], words))
                    size[em] += len(words) + int(mine.sum())
                    if size[em] >= GROUP_TOKENS:
                        yield group(em)
        for em in (False, True):
            if held[em]:
                yield group(em)
    return run


class _Group:
    """A group's tokens as keys: every word, the end of each text, and each pair of neighbours."""

    def __init__(self, row: dict):
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        self.ids = docs["id"].to_pylist()
        self.train = np.asarray(docs["train"].combine_chunks().cast(pa.int8())).astype(bool)
        self.lengths = np.asarray(docs["n"].combine_chunks()).astype(np.int64) + 1
        words = c.unpack(row["words"], np.uint64, delta=True)
        codes = c.unpack(row["codes"], np.int32).astype(np.int64)
        self.ends = np.cumsum(self.lengths) - 1
        total = int(self.lengths.sum())
        keys = np.empty(total, dtype=np.uint64)
        inner = np.ones(total, dtype=bool)
        inner[self.ends] = False
        keys[inner] = words[codes]
        keys[self.ends] = END
        before = np.empty(total, dtype=np.uint64)
        before[1:] = keys[:-1]
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)
        before[self.starts] = START
        pairs = c.mix(before * np.uint64(0x9E3779B97F4A7C15) + (keys ^ (keys >> np.uint64(29)))) | np.uint64(1)
        self.of_doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        every = np.concatenate([keys, np.full(len(self.ids), START), pairs])
        self.unique, place = np.unique(every, return_inverse=True)
        n, d = total, len(self.ids)
        self.word, self.pair = place[:n], place[n + d:]
        start = place[n:n + d]
        self.context = np.empty(n, dtype=np.int64)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = start
        counted = np.concatenate([self.train[self.of_doc], self.train, self.train[self.of_doc]])
        self.counts = np.bincount(place, weights=counted, minlength=len(self.unique)).astype(np.int64)


def _edges(buckets: int) -> np.ndarray:
    """First key of each bucket."""
    return np.array([-(-i * (1 << 64) // buckets) for i in range(buckets)], dtype=np.uint64)


def _ask(buckets: int):
    """For each group, its distinct keys with their counts in training texts, cut by key range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                g = _Group(row)
                cut = np.append(np.searchsorted(g.unique, edges), len(g.unique))
                out = []
                for b in range(buckets):
                    lo, hi = int(cut[b]), int(cut[b + 1])
                    if hi > lo:
                        counts = g.counts[lo:hi].astype(np.uint32)
                        out.append((row["group"], row["em"], b, c.pack(g.unique[lo:hi], delta=True), c.pack(counts)))
                yield pa.record_batch({
                    "group": pa.array([o[0] for o in out], pa.int64()), "em": pa.array([o[1] for o in out], pa.bool_()),
                    "bucket": pa.array([o[2] for o in out], pa.int32()), "keys": pa.array([o[3] for o in out], pa.binary()),
                    "train": pa.array([o[4] for o in out], pa.binary()),
                    "fold": pa.array([None] * len(out), pa.binary())})
    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows with equal ``key``, which stand together."""
    now: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):  # one row at a time: they are large
            row = batch.slice(i, 1).to_pylist()[0]
            if now and now[0][key] != row[key]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now
    c.release_memory()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a bucket's keys, sent back to every group that asked; and the bucket's share of the statistics."""
    for rows in _runs(batches, "bucket"):
        keys = [c.unpack(r["keys"], np.uint64, delta=True) for r in rows]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        mine = np.concatenate([c.unpack(r["train"], np.uint32) for r in rows])
        em = np.repeat(np.array([bool(r["em"]) for r in rows]), [len(k) for k in keys])
        train = np.bincount(place, weights=mine, minlength=len(unique)).astype(np.int64)
        fold = np.bincount(place, weights=mine * em, minlength=len(unique)).astype(np.int64)
        words = ((unique & np.uint64(1)) == 0) & (unique != START)
        seen = np.bincount(_count_bin((train - fold)[words]), weights=fold[words], minlength=COUNT_BINS).astype(np.int64)
        stats = np.concatenate([[train[words].sum(), (train[words] > 0).sum(), fold[words].sum()], seen])
        at = 0
        for r, k in zip(rows, keys, strict=True):
            where = place[at:at + len(k)]
            at += len(k)
            yield _answer(r["group"], r["em"], r["bucket"], c.pack(train[where]), c.pack(fold[where]) if r["em"] else None)
        yield _answer(-1, False, rows[0]["bucket"], c.pack(stats), None)


def _answer(group, em, bucket, train, fold) -> pa.RecordBatch:
    none = pa.array([None], pa.binary())
    return pa.record_batch({
        "group": pa.array([group], pa.int64()), "em": pa.array([em], pa.bool_()), "kind": pa.array([1], pa.int32()),
        "bucket": pa.array([bucket], pa.int32()), "docs": none, "words": none, "codes": none,
        "train": pa.array([train], pa.binary()), "fold": pa.array([fold], pa.binary())})


# --- learning the weights --------------------------------------------------------

def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Group, np.ndarray, np.ndarray | None]]:
    """Groups with the totals of their keys: in all training texts and, for held-out groups, in the held-out ones."""
    for rows in _runs(batches, "group"):
        g = _Group(rows[0])
        answers = sorted(rows[1:], key=lambda r: r["bucket"])
        totals = (np.concatenate([c.unpack(r[x], np.int64) for r in answers]) if answers[0][x] is not None else None for x in ("train", "fold"))
        yield g, *totals


def _below(words: np.ndarray, tokens: int, types: int, unigram: float) -> np.ndarray:
    """The lower-order probability: unigram estimate mixed with the uniform one."""
    return unigram * words / max(tokens, 1) + (1 - unigram) / (types + 1)


def _ratios(tokens: int, types: int, unigram: float):
    """Held-out tokens by context bucket and by how much likelier the bigram estimate makes them than the lower order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, train, fold in _answered(batches):
            kept = train - fold
            context, pair = kept[g.context], kept[g.pair]
            ratio = pair / np.maximum(context, 1) / _below(kept[g.word], tokens, types, unigram)
            slot = np.where(pair > 0, (np.log(np.maximum(ratio, 1e-30)) * RATIO_PER_E + RATIO_BINS / 3).clip(1, RATIO_BINS - 1), 0)
            cell, n = np.unique(_bucket(context) * RATIO_BINS + slot.astype(np.int64), return_inverse=True)
            yield pa.record_batch({"cell": pa.array(cell), "n": pa.array(np.bincount(n).astype(np.int64)),
                                   "r": pa.array(np.bincount(n, weights=ratio))})
    return run


def em_weight(n: np.ndarray, ratio: np.ndarray, steps: int = 200) -> float:
    """Weight of a component that is ``ratio`` times as likely as the other, by expectation-maximisation."""
    if n.sum() == 0:
        return 0.0
    n, ratio, weight = n[n > 0], ratio[n > 0], 0.5
    for _ in range(steps):  # never quite 1: the lower order must keep some probability
        weight = min(float((n * (weight * ratio / (weight * ratio + 1 - weight))).sum() / n.sum()), 0.9999)
    return weight


def _learn(groups: DataFrame, answers: DataFrame, parts: int) -> Weights:
    stats = [c.unpack(r["train"], np.int64) for r in answers.filter("group < 0").select("train").collect()]  # one row a bucket
    total = sum(stats, np.zeros(3 + COUNT_BINS, dtype=np.int64))
    tokens, types, held = int(total[0]), int(total[1]), int(total[2])
    kept = max(tokens - held, 1)
    words = _bin_count(np.arange(COUNT_BINS))
    unigram = em_weight(total[3:], words / kept * (types + 1))
    cells = (
        _joined(groups.filter("em"), answers.filter("em and group >= 0"), parts)
        .mapInArrow(_ratios(kept, types, unigram), "cell long, n long, r double")
        .groupBy("cell").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).collect()  # at most buckets x bins rows
    )
    count, ratio = np.zeros((CONTEXT_BUCKETS, RATIO_BINS)), np.zeros((CONTEXT_BUCKETS, RATIO_BINS))
    for cell in cells:
        b, s = divmod(cell["cell"], RATIO_BINS)
        count[b, s], ratio[b, s] = cell["n"], cell["r"] / cell["n"]
    bigram = [0.0]
    for b in range(1, CONTEXT_BUCKETS):
        bigram.append(em_weight(count[b], ratio[b]) if count[b].sum() else bigram[-1])
    return Weights(tokens, types, unigram, tuple(bigram))


def _joined(groups: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    return groups.unionByName(answers).repartition(parts, "group").sortWithinPartitions("group", "kind", "bucket")


def _score(weights: Weights):
    n, v = weights.train_tokens, weights.types
    by_bucket = np.array(weights.bigram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, train, _ in _answered(batches):
            word, context = train[g.word], train[g.context]
            weight = by_bucket[_bucket(context)]
            p = weight * train[g.pair] / np.maximum(context, 1) + (1 - weight) * _below(word, n, v, weights.unigram)
            add = lambda x, g=g: np.add.reduceat(x, g.starts)
            yield pa.record_batch({
                "doc_id": pa.array(g.ids, pa.int64()), "held_out": pa.array(~g.train), "n_tokens": pa.array(g.lengths),
                "n_known": pa.array(add((word > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(g.ids), n, dtype=np.int64)),
                "base_score": pa.array(add(np.log10((word + 0.1) / (n + 0.1 * (v + 1))))),
                "score": pa.array(add(np.log10(p)))})
    return run


def score_documents(docs: DataFrame, remainder: int = 0, modulus: int = 10, em_modulus: int = 10) -> DataFrame:
    """Scores of all texts under a model learned from the rows whose crc32(doc_id) mod ``modulus`` is not ``remainder``.

    docs: doc_id long, text string; further columns are not read. Returns doc_id, held_out, n_tokens (words and the
    end), n_known, train_tokens, base_score (add-0.1 unigrams) and score (both log10 of the whole text).

    A null text is an empty one: its end alone is scored. A null id counts as held out. Repeated rows are each counted
    and scored. Without training rows every probability is uniform. An empty table gives an empty result.
    ``em_modulus``: one in so many training texts is held out for the weights.
    """
    spark = docs.sparkSession
    parts = c.shuffle_partitions(spark)
    groups = c.checkpointed(docs.select("doc_id", "text").mapInArrow(_tokenise(remainder, modulus, em_modulus), _GROUP))
    asked = groups.select("group", "em", "docs", "words", "codes").mapInArrow(_ask(4 * parts), _REQUEST)
    dealt = asked.repartition(parts, "bucket").sortWithinPartitions("bucket")
    answers = c.checkpointed(dealt.mapInArrow(_add_up, _GROUP))
    weights = _learn(groups, answers, parts)
    result = _joined(groups, answers.filter("group >= 0"), parts)
    return result.mapInArrow(_score(weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
