"""Best-fit packing by exact complements.

Documents become token pieces of at most ``capacity`` ids. How the pieces fill sequences depends only on how many
pieces there are of each length, a table of at most ``capacity`` rows, so the plan is made on that table:

1. singles: a piece as long as the sequence fills it;
2. pairs: lengths a + b = capacity are looked up by complement and consumed while both last;
3. triples: a + b + c = capacity, found in the index of pair sums, consumed while all three last;
4. what remains goes best-fit, longest first, into the open sequence with the smallest gap that holds it.

The plan lists fillings with the number of sequences filled alike. Spark then numbers the pieces of each length (within
hash buckets, with offsets, so a length that a third of all pieces have is no single task) and looks each number up in
the plan. At no point do pieces come to the driver.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import common as c
from riskframe.llm.tokens import encoder

Filling = tuple[int, ...]
_PIECES = "row long, doc_id long, piece int, start long, length int, ids_crc32 long"


#: What is consumed before best-fit. Greedy triples can spoil what is left on small tables.
ORDERS = (("pairs", "triples"), ("pairs",))


def plan(available: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences get each, using every piece of ``available`` (length -> pieces) once.

    Every order of ``ORDERS`` is planned (on counts, so this costs little); the one with the fewest sequences is taken.
    """
    return min((consume(available, capacity, order) for order in ORDERS), key=lambda p: sum(n for _, n in p))


def consume(available: dict[int, int], capacity: int, order: tuple[str, ...]) -> list[tuple[Filling, int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in available.items():
        left[length] = n
    done: list[tuple[Filling, int]] = []

    def take(filling: Filling) -> None:
        need: dict[int, int] = defaultdict(int)
        for x in filling:
            need[x] += 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times > 0:
            for x, k in need.items():
                left[x] -= k * times
            done.append((filling, times))

    def pairs() -> None:
        for a in range(capacity - 1, (capacity - 1) // 2, -1):
            take((a, capacity - a))

    def triples() -> None:
        for a in range(capacity - 2, 0, -1):  # the longest first: they are the hardest to place
            gap = capacity - a
            # b from half the gap up: the pair (b, gap - b) stands in the index of pair sums at `gap`
            for b in range(min(a, gap - 1), (gap - 1) // 2, -1):
                if left[a] == 0:
                    break
                if left[b] and left[gap - b]:
                    take((a, b, gap - b))

    take((capacity,))
    for step in order:
        {"pairs": pairs, "triples": triples}[step]()
    return done + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: sequences filled alike are handled together."""
    open_: dict[int, dict[Filling, int]] = defaultdict(dict)  # gap -> filling -> sequences
    gaps: list[int] = []

    def put(filling: Filling, gap: int, n: int) -> None:
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap][filling] = open_[gap].get(filling, 0) + n

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                fits = capacity // length
                if n >= fits:
                    put((length,) * fits, capacity - fits * length, n // fits)
                    n -= fits * (n // fits)
                else:
                    put((length,) * n, capacity - n * length, 1)
                    n = 0
                continue
            gap = gaps[at]
            filling, there = next(iter(open_[gap].items()))
            fits = min(gap // length, n)
            used = min(there, n // fits)
            if used == there:
                del open_[gap][filling]
                if not open_[gap]:
                    gaps.pop(at)
            else:
                open_[gap][filling] = there - used
            put(filling + (length,) * fits, gap - fits * length, used)
            n -= fits * used
    return [(filling, n) for same in open_.values() for filling, n in same.items()]


class Places:
    """From (length, number among the pieces of that length) to (sequence, offset)."""

    def __init__(self, fillings: list[tuple[Filling, int]]):
        slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length: first number, first sequence, offset, stride
        used: dict[int, int] = defaultdict(int)
        sequence = 0
        for filling, n in fillings:
            offset = 0
            for x in filling:
                slots[x].append((used[x], sequence, offset))
                used[x] += n
                offset += x
            sequence += n
        self.sequences = sequence
        self.by_length = {x: np.array(v, dtype=np.int64) for x, v in slots.items()}

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for x in np.unique(length):
            rows, table = np.flatnonzero(length == x), self.by_length[int(x)]
            k = np.searchsorted(table[:, 0], number[rows], side="right") - 1
            sequence[rows] = table[k, 1] + number[rows] - table[k, 0]
            offset[rows] = table[k, 2]
        return sequence, offset


def _cut(vocabulary: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(vocabulary).encode, TaskContext.get().partitionId() << 40
        for batch in c.pieces(batches, most=4 << 20):
            ids, lengths = encode(batch.column("text"), end)
            raw = ids.tobytes()
            begins = np.cumsum(lengths) - lengths
            n = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = (lengths - 1) % capacity + 1  # the first piece takes what whole pieces leave
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = begins[doc] + start
            yield pa.record_batch({
                "row": pa.array(row + doc), "doc_id": batch.column("doc_id").take(pa.array(doc)).cast(pa.int64()),
                "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length.astype(np.int32)),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * b:4 * (b + k)]) for b, k in zip(at, length, strict=True)], pa.int64())})
            row += len(lengths)
    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Place all documents in sequences of at most ``capacity`` tokens.

    docs: doc_id long, text string; further columns are not read. Returns one row a piece: row (a number of the input
    row, so that repeated rows are told apart), doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one (its end id alone); a null id stays null. Repeated rows are packed each. Ties between
    pieces of one length are settled by their row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = c.checkpointed(docs.select("doc_id", "text").mapInArrow(_cut(vocabulary, capacity, end), _PIECES))
    buckets = max(64, 4 * c.shuffle_partitions(spark))
    bucket = F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int")
    placed = pieces.withColumn("bucket", bucket)
    counts = placed.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = c.checkpointed(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    available = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = Places(plan(available, capacity))
    within = Window.partitionBy("bucket", "length").orderBy("row", "piece")
    numbered = placed.withColumn("number", F.row_number().over(within) - 1).join(offsets.drop("n"), ["bucket", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.asarray(batch.column("number")).astype(np.int64) + np.asarray(batch.column("before"))
            sequence, offset = places.find(np.asarray(batch.column("length")), number)
            own = {f: batch.column(f) for f in ("row", "doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch({**own, "length": own["length"].cast(pa.int64()), "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    columns = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(place, columns)
