"""Packing as a cutting-stock problem, by column generation.

Sequences come in sizes: the capacity, and every smaller power of two, which needs no padding either. Documents longer
than the capacity give whole sequences first. What remains are items of at most ``capacity`` tokens, and the plan depends
only on how many items there are of each length:

1. Lengths are put in classes (exact up to 64, then 32 classes an octave; an item counts as the longest of its class).
2. A linear program asks how often to use each pattern (a multiset of classes that fits a sequence) so that all items are
   placed in the fewest tokens of sequence (and a little for each sequence). Its columns are generated: a knapsack by dynamic programming over the dual
   prices gives the most valuable pattern of every sequence size at once, and enters it while it improves the program.
3. Pattern counts are rounded down; then single patterns whose items are still there are added, by their lost fraction;
   then patterns that the same knapsack makes of the items left, with tokens as value.
4. Items are ranked within their class, longest first, and each rank has a slot: a sequence and an offset.

Items that no pattern took, all in all a few sequences' worth, and the tokens that classes and patterns leave free, are
matched: these items are laid end to end and cut where the gaps end, so no sequence is padded. What is then left of them
fills whole sequences, and the rest powers of two. Only these items and documents above the capacity are ever cut.

All of this is arithmetic on a table of at most ``capacity`` lengths; Spark numbers the items of each length and looks the
numbers up. Items never come to the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import common as c
from riskframe.llm.seekable import shared_folder
from riskframe.llm.tokens import encoder

EXACT, STEPS = 64, 32
START = 1 / 256  # what a sequence costs beside its tokens, in capacities: full ones come first
GAP, ROUNDS, POOLED, SPREAD = 5e-4, 6000, 5e-3, 16


def class_tops(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The longest length of each item's class."""
    octave = np.maximum(np.floor(np.log2(np.maximum(lengths, 1))).astype(np.int64), 0)
    width = np.maximum((np.int64(1) << octave) // STEPS, 1)
    return np.where(lengths <= EXACT, lengths, np.minimum(-(-lengths // width) * width, capacity))


class Knapsack:
    """Most valuable multisets of items for every weight up to ``capacity``."""

    def __init__(self, weights: np.ndarray, capacity: int):
        self.weights, self.capacity = weights, capacity

    def solve(self, values: np.ndarray, most: np.ndarray | None = None) -> None:
        """``most``: how many of each item there are (as many as fit if None). Copies are tried in powers of two."""
        self.best, self.moves = np.zeros(self.capacity + 1), []
        for i, (w, v) in enumerate(zip(self.weights.tolist(), values.tolist(), strict=True)):
            left, times = self.capacity // w if most is None else min(int(most[i]), self.capacity // w), 1
            while left > 0 and v > 0:
                times = min(times, left)
                with_ = self.best[:-times * w] + times * v
                better = with_ > self.best[times * w:] + 1e-12
                if better.any():
                    np.copyto(self.best[times * w:], with_, where=better)
                    self.moves.append((i, times, better))
                left, times = left - times, times * 2

    def pattern(self, weight: int) -> np.ndarray:
        """The multiset of the best value within ``weight``."""
        counts = np.zeros(len(self.weights), dtype=np.int64)
        for i, times, better in reversed(self.moves):
            shift = times * int(self.weights[i])
            if weight >= shift and better[weight - shift]:
                counts[i] += times
                weight -= shift
        return counts


def sequence_sizes(capacity: int) -> list[int]:
    return sorted({capacity, *(1 << b for b in range(capacity.bit_length()) if 1 << b <= capacity)})


def fractional(weights: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, np.ndarray, float]], float]:
    """The linear program by column generation: (sequence size, pattern, times) of the last basis, and a lower bound.

    Revised simplex on the demand rows. It stops when no column improves the program, or the bound is within ``GAP``; any
    state is a feasible plan, so ``ROUNDS`` limits time and not correctness.
    """
    m, sizes = len(weights), sequence_sizes(capacity)
    cost = {s: s + START * capacity for s in sizes}
    bins, columns = [], []
    for i, w in enumerate(weights.tolist()):  # to begin with, one class a sequence, in the size that wastes least
        size = min((s for s in sizes if s >= w), key=lambda s: s / (s // w))
        bins.append(size)
        columns.append(np.eye(1, m, i, dtype=np.int64)[0] * (size // w))
    inverse = np.diag([1.0 / columns[i][i] for i in range(m)])
    times = inverse @ demand
    # No plan takes fewer tokens than the items have.
    bound, sack = float(weights @ demand) * cost[capacity] / capacity, Knapsack(weights, capacity)
    pool, pool_size, pool_cost = np.zeros((0, m)), np.zeros(0, dtype=np.int64), np.zeros(0)  # patterns generated so far, so one knapsack serves several pivots
    for turn in range(ROUNDS):
        paid = np.array([cost[s] for s in bins])
        prices = paid @ inverse
        if float(paid @ times) <= bound * (1 + GAP):
            break
        excess = pool @ prices - pool_cost
        if not len(pool) or excess.max() <= POOLED * pool_cost[np.argmax(excess)]:
            sack.solve(np.maximum(prices, 0))
            best = max(sizes, key=lambda s: sack.best[s] / cost[s])
            bound = max(bound, float(prices @ demand) / max(1.0, float(sack.best[best]) / cost[best]))
            if sack.best[best] <= (1 + 1e-9) * cost[best]:
                break
            fresh = [(s, sack.pattern(s)) for s in sizes if sack.best[s] > cost[s]]
            # Beside the best pattern, the best ones that hold a certain class.
            for i in range(turn % SPREAD, m, SPREAD):
                rest = capacity - int(weights[i])
                if sack.best[rest] + prices[i] > cost[capacity]:
                    fresh.append((capacity, sack.pattern(rest) + np.eye(1, m, i, dtype=np.int64)[0]))
            pool = np.concatenate([pool, np.array([p for _, p in fresh], dtype=float)])
            pool_size = np.concatenate([pool_size, np.array([s for s, _ in fresh], dtype=np.int64)])
            pool_cost = pool_size + START * capacity
            excess = pool @ prices - pool_cost
        chosen = int(np.argmax(excess / pool_cost))
        step = inverse @ pool[chosen]
        able = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[able] = times[able] / step[able]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        t = max(float(ratio[out]), 0.0)
        times -= t * step
        times[out] = t
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        bins[out], columns[out] = int(pool_size[chosen]), pool[chosen].astype(np.int64)
        if len(pool) > 16 * m:
            worth = pool @ prices / pool_cost
            stay = np.argsort(-worth, kind="stable")[:4 * m]
            pool, pool_size, pool_cost = pool[stay], pool_size[stay], pool_cost[stay]
    return [(b, p, max(float(t), 0.0)) for b, p, t in zip(bins, columns, times, strict=True)], bound


def whole_patterns(weights: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray, int]]:
    """Patterns with whole numbers: the program's, rounded, and knapsacks of what that leaves."""
    columns, _ = fractional(weights, demand, capacity)
    left, plan = demand.copy(), []
    rounded = []
    for size, pattern, times in columns:
        n = int(times + 1e-7)
        used = np.flatnonzero(pattern)
        if n and len(used):
            n = min(n, int((left[used] // pattern[used]).min()))
        left -= n * pattern
        rounded.append([size, pattern, n, times - n])
    for own in sorted(rounded, key=lambda r: -r[3]):
        if own[3] > 1e-7 and (own[1] <= left).all():
            left -= own[1]
            own[2] += 1
    plan = [(s, p, n) for s, p, n, _ in rounded if n]
    sack = Knapsack(weights, capacity)
    while left.any():
        sack.solve(weights.astype(float), left)
        size = max((s for s in sequence_sizes(capacity) if sack.best[s] > 0), key=lambda s: (sack.best[s] * 50 // s, s))
        pattern = sack.pattern(size)
        if sack.best[size] < 0.9 * size:
            break
        used = np.flatnonzero(pattern)
        n = int((left[used] // pattern[used]).min())
        left -= n * pattern
        plan.append((size, pattern, n))
    return plan


@dataclass
class Layout:
    """Where the items of each length go, as tables of bounded size.

    ``slots[length]``: rows of (first number, first sequence, offset): items with consecutive numbers have consecutive
    sequences. Items from ``cut_from[length]`` on are laid on a stream that begins for them at ``stream_from[length]``.
    ``gaps``: rows of (first place on the stream, free tokens of each sequence, first sequence, offset of the gap).
    """

    slots: dict[int, np.ndarray]
    cut_from: dict[int, int]
    stream_from: dict[int, int]
    gaps: np.ndarray
    sequences: int

    def find(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.slots[length]
        k = np.searchsorted(rows[:, 0], number, side="right") - 1
        return rows[k, 1] + number - rows[k, 0], rows[k, 2]

    def cut(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """Pieces of an item on the stream: (start in the item, length, sequence, offset)."""
        at = self.stream_from[length] + (number - self.cut_from[length]) * length
        end, begin, out = at + length, at, []
        while at < end:
            first, room, sequence, offset = self.gaps[np.searchsorted(self.gaps[:, 0], at, side="right") - 1].tolist()
            i, within = divmod(at - first, room)
            take = min(end - at, room - within)
            out.append((at - begin, take, sequence + i, offset + within))
            at += take
        return out


def _segments(pattern_slots: list[tuple[np.ndarray, np.ndarray]], times: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the lengths in a pattern's slots change over its sequences, and the lengths there (segments x slots).

    Each slot is given as the ranks (from 0) at which its length changes, and the lengths from there.
    """
    cuts = np.unique(np.concatenate([at for at, _ in pattern_slots]))
    cuts = cuts[cuts < times]
    return cuts, np.stack([lengths[np.searchsorted(at, cuts, side="right") - 1] for at, lengths in pattern_slots], axis=1)


def lay_out(counts: dict[int, int], capacity: int) -> Layout:
    """The plan for a table of item lengths (1 to ``capacity``)."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    number = np.array([counts[x] for x in lengths.tolist()], dtype=np.int64)
    if not len(lengths):
        return Layout({}, {}, {}, np.zeros((0, 4), dtype=np.int64), 0)
    tops = class_tops(lengths, capacity)
    weights, own = np.unique(tops, return_inverse=True)
    demand = np.bincount(own, weights=number).astype(np.int64)
    plan = whole_patterns(weights, demand, capacity)
    total = int(lengths @ number)
    while True:
        slots, patterns, used, placed, size = _place(plan, weights, own, lengths, number)
        free = size - placed
        if free <= total - placed:  # the items that are cut fill every gap
            break
        # Undo some sequences of the emptiest pattern: each brings its items, and needs no filling itself.
        fill = [(p @ weights) / s for s, p, _ in plan]
        k = int(np.argmin(fill))
        s, p, n = plan[k]
        undone = min(n, max(1, (free - (total - placed)) // s))
        plan = [(a, b, t) for a, b, t in [*plan[:k], (s, p, n - undone), *plan[k + 1:]] if t]
    cut_from, stream_from, at = {}, {}, 0
    for j in range(len(lengths) - 1, -1, -1):
        x = int(lengths[j])
        cut_from[x], stream_from[x] = int(used[j]), at
        at += int(number[j] - used[j]) * x
    gaps, stream, sequences = [], 0, 0
    for size_, first, cuts, sums, times in patterns:
        for begin, end, filled in zip(cuts.tolist(), [*cuts[1:].tolist(), times], sums.tolist(), strict=True):
            if size_ > filled:
                gaps.append((stream, size_ - filled, first + begin, filled))
                stream += (size_ - filled) * (end - begin)
        sequences = max(sequences, first + times)
    whole, rest = divmod(at - stream, capacity)
    for room, times in [(capacity, whole), *((1 << b, 1) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)]:
        if times:
            gaps.append((stream, room, sequences, 0))
            stream += room * times
            sequences += times
    return Layout(slots, cut_from, stream_from, np.array(gaps, dtype=np.int64).reshape(-1, 4), sequences)


def _place(plan, weights, own, lengths, number):
    """Slots of each length, patterns with the sums of their segments, items used of each length, tokens placed, tokens of sequences.

    In a class the longest items have the first ranks; a slot of a pattern takes as many ranks as the pattern has sequences.
    """
    members = [np.flatnonzero(own == k)[::-1] for k in range(len(weights))]  # lengths of a class, longest first
    ends = [np.cumsum(number[j]) for j in members]
    taken = np.zeros(len(weights), dtype=np.int64)
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    patterns, sequence, placed, size = [], 0, 0, 0
    for s, pattern, times in plan:
        shown, ranks = [], []
        for k in np.flatnonzero(pattern).tolist():
            for _ in range(int(pattern[k])):
                begin = int(taken[k])
                j = np.searchsorted(ends[k], begin, side="right")
                stop = np.searchsorted(ends[k], begin + times - 1, side="right") + 1
                at = np.maximum(np.append(0, ends[k])[j:stop] - begin, 0)
                shown.append((at, lengths[members[k][j:stop]]))
                ranks.append((k, begin))
                taken[k] += times
        cuts, seen = _segments(shown, times)
        offsets = np.cumsum(seen, axis=1) - seen
        for t, (k, begin) in enumerate(ranks):
            for g, cut in enumerate(cuts.tolist()):
                x = int(seen[g, t])
                before = int(np.append(0, ends[k])[np.flatnonzero(lengths[members[k]] == x)[0]])
                table[x].append((begin + cut - before, sequence + cut, int(offsets[g, t])))
        sums = seen.sum(axis=1)
        patterns.append((s, sequence, cuts, sums, times))
        placed += int(sums @ np.diff(np.append(cuts, times)))
        sequence, size = sequence + times, size + s * times
    used = np.zeros(len(lengths), dtype=np.int64)
    for k, j in enumerate(members):
        used[j] = np.clip(taken[k] - np.append(0, ends[k][:-1]), 0, number[j])
    return {x: np.array(sorted(rows), dtype=np.int64) for x, rows in table.items()}, patterns, used, placed, size


_ITEMS = "row long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary"


def _cut(vocabulary: str, capacity: int, end: int):
    """Items: whole sequences of long documents first, then what is left of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(vocabulary).encode, TaskContext.get().partitionId() << 40
        for batch in c.pieces(batches, most=4 << 20):
            ids, lengths = encode(batch.column("text"), end)
            begins = np.cumsum(lengths) - lengths
            n = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(lengths[doc] - start, capacity)
            raw, at = memoryview(ids.tobytes()), (begins[doc] + start).tolist()
            spans = [raw[4 * b:4 * (b + k)] for b, k in zip(at, length.tolist(), strict=True)]
            yield pa.record_batch({
                "row": pa.array(row + doc), "doc_id": batch.column("doc_id").take(pa.array(doc)).cast(pa.int64()), "start": pa.array(start),
                "length": pa.array(length.astype(np.int32)), "doc_tokens": pa.array(lengths[doc]),
                "ids_crc32": pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                "ids": pa.array([c.pack(np.frombuffer(x, np.uint32)) if len(x) < 4 * capacity else None for x in spans], pa.binary())})
            row += len(lengths)
    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """Place all documents in sequences of at most ``capacity`` tokens, none of which needs padding.

    docs: doc_id long, text string; further columns are not read. Returns one row a piece: row (a number of the input row,
    so that repeated rows are told apart), doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every
    sequence is as long as the capacity, or a power of two.

    A null text is an empty one (its end id alone); a null id stays null. Repeated rows are packed each. Ties between items
    of one length are settled by their row. An empty table gives an empty result. Token ids of items shorter than the
    capacity are kept in the shared folder until the plan says which of them are cut.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark, 'items')}/items"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own.mapInArrow(_cut(vocabulary, capacity, end), _ITEMS).write.parquet(path)
    items = spark.read.schema(_ITEMS).parquet(path)
    buckets = max(64, 4 * c.shuffle_partitions(spark))
    named = items.drop("ids").withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)).cast("int"))
    counts = named.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = c.checkpointed(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    available = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    layout = lay_out(available, capacity)
    within = Window.partitionBy("bucket", "length").orderBy("row", "start")
    numbered = named.withColumn("number", F.row_number().over(within) - 1).join(offsets.drop("n"), ["bucket", "length"])
    numbered = c.checkpointed(numbered.withColumn("number", F.col("number") + F.col("before")).drop("bucket", "before"))
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = np.asarray(batch.column("length")).astype(np.int64), np.asarray(batch.column("number")).astype(np.int64)
            sequence, offset = np.full(len(length), -1, dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero((length == x) & (number < layout.cut_from[x]))
                if len(rows):
                    sequence[rows], offset[rows] = layout.find(x, number[rows])
            yield pa.record_batch({
                **{k: batch.column(k) for k in ("row", "doc_id", "start")}, "length": pa.array(length), "ids_crc32": batch.column("ids_crc32"),
                "doc_tokens": batch.column("doc_tokens"), "sequence_id": pa.array(sequence), "offset": pa.array(offset), "number": pa.array(number)})

    columns = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = numbered.mapInArrow(place, f"{columns}, number long")
    kept = placed.filter("sequence_id >= 0").drop("number")
    cut = placed.filter("sequence_id < 0").select("row", "start", "number").join(items, ["row", "start"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw = memoryview(c.unpack(r["ids"], np.uint32).tobytes())
                out += [(r["row"], r["doc_id"], r["start"] + a, k, zlib.crc32(raw[4 * a:4 * (a + k)]), r["doc_tokens"], q, o)
                        for a, k, q, o in layout.cut(r["length"], r["number"])]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 8,
                                  names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return kept.unionByName(cut.mapInArrow(split, columns))
