"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of words with a smallest period q that is at least two periods, and ``least`` words, long. A
run of length L holds, within its first L - q words, an aligned block of 2^k words once 2^(k+1) - 1 <= L - q, and that
block stands again exactly q words later. So every period is found by asking, for each aligned block of each size 2^k,
where the block occurs in the windows behind it:

1. Prefix doubling sorts the suffixes. On the way it names every stretch of 2^k words, so the suffixes that start with
   a block are one interval of the suffix array. Only stretches that occur twice are sorted on.
2. A wavelet tree over the suffix array answers range successor: the first occurrence of a block after a place, and the
   number of occurrences up to one.
3. Windows are as long as the block, so the occurrences in one are an arithmetic progression: first, step, number. Its
   members are candidate periods. Those that lie within the run of the block's own period are multiples of it and skipped.
4. Each candidate is extended to both sides by the names of stretches (longest common extension), and kept if it is long
   enough. Of candidates with the same place the smallest period stays.

Words are numbered within their text, so a batch of texts is sorted together and no stretch is shared by two texts.
Work is near-linear in the number of words, also in texts that are one long repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c

_AT_ONCE = 1 << 20  # candidates that are extended together


class WaveletTree:
    """Values below 2^bits; counts and order statistics of any stretch, many questions at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []  # for each bit, from the highest: number of zero bits before each place
        now = values
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1
            before = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(1 - one, out=before[1:], dtype=np.int32)
            self.zeros.append(before)
            now = np.concatenate([now[one == 0], now[one == 1]])

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values in [left, right) are smaller than ``value``."""
        count, big = np.zeros(len(left), dtype=np.int64), value >= (1 << self.bits)
        count[big] = (right - left)[big]
        left, right, value = left.copy(), right.copy(), np.where(big, 0, np.maximum(value, 0))
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, r0, one = zeros[left], zeros[right], (value >> b) & 1 == 1
            count[one] += (r0 - l0)[one]
            left, right = np.where(one, left - l0 + zeros[-1], l0), np.where(one, right - r0 + zeros[-1], r0)
        return count

    def ranked(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value with ``rank`` smaller ones in [left, right)."""
        left, right, rank, value = left.copy(), right.copy(), rank.copy(), np.zeros(len(left), dtype=np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            one = rank >= r0 - l0
            rank = np.where(one, rank - (r0 - l0), rank)
            value |= one.astype(np.int64) << b
            left, right = np.where(one, left - l0 + zeros[-1], l0), np.where(one, right - r0 + zeros[-1], r0)
        return value


class Suffixes:
    """The suffix array of a sequence, and the names of its stretches of 2^k words.

    ``names[k][i]``: the first place in the suffix array of the suffixes that begin like i for 2^k words; ``sizes[k][i]``:
    how many those are. The last level is the first on which no stretch occurs twice.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable").astype(np.int32)
        self.names, self.sizes = [], []
        name = np.empty(n, dtype=np.int32)
        size = np.empty(n, dtype=np.int32)
        self._group(order, words[order], np.zeros(n, dtype=np.int32), name, size)
        self.names.append(name)
        self.sizes.append(size)
        step = 1
        while len(open_ := np.flatnonzero(size[order] > 1)):  # places of the suffix array that are not settled
            own = order[open_]
            after = own.astype(np.int64) + step
            follower = np.where(after < n, name[np.minimum(after, n - 1)], -1)
            key = (name[own].astype(np.int64) << 32) + (follower + 1)
            by = np.argsort(key, kind="stable")
            own, key = own[by], key[by]
            order[open_] = own
            name, size = name.copy(), np.ones(n, dtype=np.int32)
            self._group(own, key, name, name, size)
            self.names.append(name)
            self.sizes.append(size)
            step *= 2
        self.order = order

    @staticmethod
    def _group(own: np.ndarray, key: np.ndarray, base: np.ndarray, name: np.ndarray, size: np.ndarray) -> None:
        """Number groups of equal keys by their first place; ``base``: where the suffixes of a larger group begin."""
        if not len(own):
            return
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(own)))
        parent = base[own[first]]
        same = np.append(False, parent[1:] == parent[:-1])
        start = np.flatnonzero(~same)
        place = parent + (first - np.repeat(first[start], np.diff(np.append(start, len(first)))))
        size[own] = np.repeat(count, count)
        name[own] = np.repeat(place, count)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequences from a and b (a < b) agree."""
        n, x, y = len(self.order), a.astype(np.int64), b.astype(np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            inside = y < n
            same = inside & (self.names[k][np.minimum(x, n - 1)] == self.names[k][np.minimum(y, n - 1)])
            x, y = x + (same << k), y + (same << k)
        return x - a

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequences that end before a and b (a < b) agree."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            u, v = x - (1 << k), y - (1 << k)
            same = (u >= 0) & (self.names[k][np.maximum(u, 0)] == self.names[k][np.maximum(v, 0)])
            x, y = x - (same << k), y - (same << k)
        return a - x


def _progressions(tree: WaveletTree, left: np.ndarray, right: np.ndarray, after: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences in (after, last]: number, first, and step to the second (0 where there is none)."""
    skip = tree.below(left, right, after + 1)
    number = tree.below(left, right, last + 1) - skip
    some, more = number > 0, number > 1
    first, step = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
    first[some] = tree.ranked(left[some], right[some], skip[some])
    step[more] = tree.ranked(left[more], right[more], skip[more] + 1) - first[more]
    return number, first, step


def find_runs(words: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start and period. ``words``: numbers; texts are told apart by them."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < least:
        return none, none, none
    s = Suffixes(words)
    starts, ends, periods = [none], [none], [none]

    def extend(block: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Keep the runs of these candidates; returns where each stretch of that period ends."""
        end = np.zeros(len(block), dtype=np.int64)
        for k in range(0, len(block), _AT_ONCE):
            a, q = block[k:k + _AT_ONCE], period[k:k + _AT_ONCE]
            begin = a - s.left(a, a + q)
            end[k:k + _AT_ONCE] = stop = a + q + s.right(a, a + q)
            long = stop - begin >= np.maximum(least, 2 * q)
            kept = np.unique(np.stack([begin[long], stop[long], q[long]], axis=1), axis=0)
            for column, values in zip((starts, ends, periods), kept.T, strict=True):
                column.append(values)
        return end

    lowest = 0 if least < 5 else 1  # a run of five words or more holds an aligned block of two
    repeated = s.sizes[lowest][s.order] > 1 if len(s.sizes) > lowest else np.zeros(len(words), dtype=bool)
    if repeated.any():
        among = np.append(0, np.cumsum(repeated))  # the tree holds only suffixes whose first words occur again
        tree = WaveletTree(s.order[repeated].astype(np.int64))
        for k in range(lowest, len(s.names)):
            size = 1 << k
            block = np.arange(0, len(words), size)
            block = block[s.sizes[k][block] > 1]
            if not len(block):
                continue
            name = s.names[k][block].astype(np.int64)
            left, right = among[name], among[name + s.sizes[k][block]]
            # A block of 4 serves periods up to 14 but for 6, one of 2^k those from 2^(k+1) - 1 to 2^(k+2) - 2.
            reach = 4 * size - 2
            own_end, own_period = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64)
            for begin in range(0, reach, size):
                last = block + min(begin + size, reach)
                number, first, step = _progressions(tree, left, right, block + begin, last)
                if begin == 0:  # the block overlaps its next occurrence: it has a period of its own
                    own = np.flatnonzero(number > 0)
                    own_period[own] = first[own] - block[own]
                    own_end[own] = extend(block[own], own_period[own])
                hit = np.flatnonzero(number > 0)
                member = np.arange(int(number[hit].sum())) - np.repeat(np.cumsum(number[hit]) - number[hit], number[hit])
                hit = np.repeat(hit, number[hit])
                q = first[hit] + member * step[hit] - block[hit]
                fresh = block[hit] + q + size > own_end[hit]
                extend(block[hit][fresh], q[fresh])
    start, end, period = (np.concatenate(x).astype(np.int64) for x in (starts, ends, periods))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    single = np.ones(len(start), dtype=bool)
    single[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[single], end[single], period[single]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


_COLUMNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _runs(least: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, most=2 << 20):
            flat, rows = c.tokens(batch.column("text"), lower=False)
            number, _ = c.coded(flat)
            n = batch.num_rows
            ends = np.searchsorted(rows, np.arange(n), side="right")
            begins = np.append(0, ends[:-1]) if n else ends
            # Words of different texts are different; so no stretch crosses a text's end.
            words = np.unique(rows * np.int64(max(1, int(number.max(initial=0)) + 1)) + number, return_inverse=True)[1]
            start, length, period = find_runs(words, least)
            text = rows[start]
            dropped = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            kept = np.cumsum(dropped)[:-1] == 0
            offsets = np.append(0, np.cumsum(np.bincount(rows[kept], minlength=n))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat if kept.all() else flat.filter(pa.array(kept)))
            run_ends = np.append(0, np.cumsum(np.bincount(text, minlength=n))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(start - begins[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.record_batch({
                **{x: batch.column(x) for x in extra}, "n_words": pa.array((ends - begins).astype(np.int64)),
                "runs": pa.ListArray.from_arrays(pa.array(run_ends), spans), "collapsed": pc.binary_join(lists, " ")})
    return run


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Periodic runs of each text and the text without their repetitions.

    docs: doc_id long, text string; further columns are not read. Returns one row for each input row: doc_id, n_words,
    runs (start, length, period in words, by start and period), collapsed (the words that no run holds after its first
    period, joined by one space).

    Words lie between ASCII white space and are compared as written. A null or empty text has no words, no runs and an
    empty ``collapsed``; a null id stays null; repeated rows are treated each for itself. Two runs of one place with
    different periods are one, with the smaller. Texts are read whole; a text is the unit of memory, about 200 bytes a
    word beside 4 bytes a word for each doubling of its longest repetition. An empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _runs(least, ["doc_id"]), f"doc_id long, {_COLUMNS}")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each tenth text (by crc32 of the id) repeats a stretch of itself from some word on.

    The words from ``a`` on become the first of ``p`` words from there, over and over; joined by one space.
    """
    h = c.crc32_of_id(F.col("doc_id"))
    words = F.regexp_extract_all("text", F.lit(f"({c.WORD})"), F.lit(1))
    g = F.floor(h / 10)
    own = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g"))
    own = own.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    kept = F.slice("w", F.lit(1), F.col("a").cast("int"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(kept, tail), " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    shown = found.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.p")
    return shown.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
