"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label. Every positive sets a window of scores for its negatives; the
windows of an anchor overlap. Their upper limits split the scores into disjoint slots:

1. Positives: anchors meet the rows of their label; each task keeps the best ``positives`` rows of an anchor.
2. Slots: anchors meet all rows. A row of another label falls into one slot of the anchor (between two upper limits), and
   each task keeps the best ``negatives`` rows of every slot; so do the merges of the tasks' results.
3. From the lowest slot upwards, the best of a slot and of all below it are merged (descending suffix merges): the result
   at a slot answers the window with that upper limit, which only has to be cut at its lower limit.

Anchors are dealt into blocks and rows into lanes. A group is a block of anchors with a lane of rows; a task streams the
rows past the anchors and holds only the anchors' best rows. All scores are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c

ANCHORS, ROWS = 512, 2048  # anchors of a block, rows that are scored together
#: Components beyond this give scores that 64 bits may not hold.
MOST = 1 << 26

_ROW = "row long, vec_id long, label int, width int, vector binary"


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; through floating point where all sums stay below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The best ``most`` rows of each of many lists, under batches of rows."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.score = np.zeros((lists, 0), dtype=np.int64)
        self.vec = np.zeros((lists, 0), dtype=np.int64)
        self.row = np.zeros((lists, 0), dtype=np.int64)
        self.real = np.zeros((lists, 0), dtype=bool)

    def add(self, own: np.ndarray, score: np.ndarray, allowed: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        """Rows (in the order of vec_id, row) with their scores for the lists ``own``, where ``allowed``."""
        if not allowed.any():
            return
        shown = np.where(allowed, score, np.iinfo(np.int64).min)
        k = min(self.most, shown.shape[1])
        # The k-th best score of a list; of rows that equal it the first are taken.
        limit = -np.partition(-shown.astype(np.float64), k - 1, axis=1)[:, k - 1] if np.abs(score).max() < 1 << 53 else np.sort(shown, axis=1)[:, -k]
        i, j = np.nonzero(allowed & (shown >= limit[:, None]))
        order = np.lexsort((j, -shown[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, place = i[place < k], j[place < k], place[place < k]
        new = [np.zeros((len(own), k), dtype=t) for t in (np.int64, np.int64, np.int64, bool)]
        for x, values in zip(new, (shown[i, j], vec[j], row[j], True), strict=True):
            x[i, place] = values
        merged = [np.concatenate([x[own], y], axis=1) for x, y in zip((self.score, self.vec, self.row, self.real), new, strict=True)]
        by = np.lexsort((merged[2], merged[1], -merged[0], ~merged[3]), axis=1)[:, :self.most]
        width = by.shape[1]
        if width > self.score.shape[1]:
            grown = ((0, 0), (0, width - self.score.shape[1]))
            self.score, self.vec, self.row, self.real = (np.pad(x, grown) for x in (self.score, self.vec, self.row, self.real))
        for x, values in zip((self.score, self.vec, self.row, self.real), merged, strict=True):
            x[own, :width] = np.take_along_axis(values, by, axis=1)


def prepared(vectors: DataFrame, relabel: bool) -> DataFrame:
    """Rows that take part: row, vec_id, label, width, and the whole-number components as bytes."""
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("int").alias("label"))
    fits = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST / 256))
    own = own.filter(F.col("label").isNotNull() & F.col("e").isNotNull() & fits)
    if relabel:
        own = own.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            x = np.floor(256 * np.asarray(lists.flatten())).astype(np.int32)
            size = np.asarray(lists.value_lengths()).astype(np.int32)
            ends = np.cumsum(size.astype(np.int64))
            yield pa.record_batch({
                **{k: batch.column(k) for k in ("row", "vec_id", "label")}, "width": pa.array(size),
                "vector": pa.array([x[b:e].tobytes() for b, e in zip(ends - size, ends, strict=True)], pa.binary())})

    spread = own.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "e")
    return c.checkpointed(spread.mapInArrow(run, _ROW))


def _meet(anchors: DataFrame, rows: DataFrame, key: list[str], work: Callable, schema: str) -> DataFrame:
    """Stream rows past blocks of anchors. ``anchors``: the columns of rows, block, and what ``work`` needs more.

    ``rows`` have an array of the blocks they go to, and are copied once for each; ``key``: columns that both sides share
    beside the block. Within a group anchors come first.
    """
    parts = c.shuffle_partitions(rows.sparkSession)
    dealt = rows.withColumn("block", F.explode("blocks")).drop("blocks")
    dealt = dealt.withColumns({"lane": F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"), "anchor": F.lit(False)})
    first = anchors.withColumns({"lane": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "anchor": F.lit(True)})
    group = [*key, "block", "lane"]
    both = first.unionByName(dealt, allowMissingColumns=True)
    both = both.repartition(parts, *group).sortWithinPartitions(*group, F.desc("anchor"), "vec_id", "row")
    return both.mapInArrow(lambda batches: work(batches, group), schema)


def _streams(batches: Iterator[pa.RecordBatch], group: list[str], most: int) -> Iterator[tuple[pa.Table, Iterator[pa.RecordBatch]]]:
    """Of each group its anchors, then its rows in small batches. Groups without anchors or rows are passed over."""
    def slices() -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(k)) for k in [*group, "anchor"]]
            change = np.zeros(batch.num_rows, dtype=bool)
            for x in columns:
                change[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                name = tuple(x[begin] for x in columns[:-1])
                for k in range(begin, end, most):
                    yield name, bool(columns[-1][begin]), batch.slice(k, min(most, end - k))

    source, head = slices(), None
    head = next(source, None)
    while head is not None:
        name, held = head[0], []
        while head is not None and head[0] == name and head[1]:
            held.append(head[2])
            head = next(source, None)

        def rows(name: tuple = name) -> Iterator[pa.RecordBatch]:
            nonlocal head
            while head is not None and head[0] == name:
                now = head[2]
                head = next(source, None)
                yield now

        if held:
            yield pa.Table.from_batches(held), rows()
        for _ in rows():
            pass
    c.release_memory()


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), dtype=np.int32).reshape(len(vectors), width).astype(np.int64)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as numbers; a null id is the largest, so it comes last among ties."""
    return np.array([np.iinfo(np.int64).max if x is None else x for x in column.to_pylist()], dtype=np.int64)


def _best_positives(most: int):
    def work(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
        for anchors, rows in _streams(batches, group, ROWS):
            best, own_row = Best(anchors.num_rows, most), np.asarray(anchors.column("row"))
            widths = np.asarray(anchors.column("width"))
            for batch in rows:
                row, vec, width = np.asarray(batch.column("row")), _ids(batch.column("vec_id")), np.asarray(batch.column("width"))
                for w in np.unique(width):
                    own, other = np.flatnonzero(widths == w), np.flatnonzero(width == w)
                    if len(own):
                        score = _scores(_matrix(anchors.column("vector").take(pa.array(own)), int(w)), _matrix(batch.column("vector").take(pa.array(other)), int(w)))
                        best.add(own, score, own_row[own][:, None] != row[other][None, :], vec[other], row[other])
            i, k = np.nonzero(best.real)
            yield pa.record_batch({"anchor_row": pa.array(own_row[i]), "score": pa.array(best.score[i, k]), "vec_id": pa.array(best.vec[i, k]), "row": pa.array(best.row[i, k])})
    return work


def _best_in_slots(most: int):
    """``upper``: the distinct upper limits of an anchor, descending. Slot s holds scores in (upper[s + 1], upper[s]]."""
    def work(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
        for anchors, rows in _streams(batches, group, ROWS):
            own_row, label = np.asarray(anchors.column("row")), np.asarray(anchors.column("label"))
            uppers, widths, lowest = anchors.column("upper").to_pylist(), np.asarray(anchors.column("width")), np.asarray(anchors.column("lowest"))
            slots = max(len(u) for u in uppers)
            limit = np.full((len(uppers), slots + 1), np.iinfo(np.int64).min)
            for i, u in enumerate(uppers):
                limit[i, :len(u)] = u
            best = [Best(len(uppers), most) for _ in range(slots)]
            for batch in rows:
                row, vec, width = np.asarray(batch.column("row")), _ids(batch.column("vec_id")), np.asarray(batch.column("width"))
                for w in np.unique(width):
                    own, other = np.flatnonzero(widths == w), np.flatnonzero(width == w)
                    if not len(own):
                        continue
                    score = _scores(_matrix(anchors.column("vector").take(pa.array(own)), int(w)), _matrix(batch.column("vector").take(pa.array(other)), int(w)))
                    fine = (label[own][:, None] != np.asarray(batch.column("label"))[other][None, :]) & (score >= lowest[own][:, None])
                    for s in range(slots):
                        best[s].add(own, score, fine & (score <= limit[own, s][:, None]) & (score > limit[own, s + 1][:, None]), vec[other], row[other])
            for s, b in enumerate(best):
                i, k = np.nonzero(b.real)
                yield pa.record_batch({"anchor_row": pa.array(own_row[i]), "slot": pa.array(np.full(len(i), s, dtype=np.int32)), "score": pa.array(b.score[i, k]), "vec_id": pa.array(b.vec[i, k]), "row": pa.array(b.row[i, k])})
    return work


def _combined(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best ``most`` rows of each key, merged from the tasks' results: sorted lists of (-score, vec_id, row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of neighbours in a sorted partition the first ``most`` of each key."""
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, name in enumerate(names):
                seen = seen + 1 if name == last else 1
                last = name
                keep[i] = seen <= most
            yield batch.filter(pa.array(keep))

    parts = c.shuffle_partitions(found.sparkSession)
    order = [*keys, F.desc("score"), "vec_id", "row"]
    return found.repartition(parts, *keys).sortWithinPartitions(*order).mapInArrow(run, found.schema)


def _windows(most: int, low: int, high: int):
    """Suffix merges of an anchor's slots, from the lowest up, cut at each positive's lower limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                suffix: list[tuple[int, int, int]] = []
                at: dict[int, list[tuple[int, int, int]]] = {}
                by_slot: dict[int, list[tuple[int, int, int]]] = {}
                for x in r["slots"] or []:
                    by_slot.setdefault(x["slot"], []).append((-x["score"], x["vec_id"], x["row"]))
                for s in range(len(r["upper"]) - 1, -1, -1):
                    suffix = at[s] = list(heapq.merge(suffix, sorted(by_slot.get(s, []))))[:most]
                for p in r["positives"]:
                    best = at[r["upper"].index(p["score"] * high // 100)]
                    fit = [x for x in best if -x[0] * 100 >= low * p["score"]]
                    out += [(r["vec_id"], _real(p["vec_id"]), k, _real(v), p["score"], -n) for k, (n, v, _) in enumerate(fit, 1)]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)],
                                  names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return run


def _real(vec_id: int) -> int | None:
    return None if vec_id == np.iinfo(np.int64).max else vec_id


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, relabel: bool = True) -> DataFrame:
    """Hard negatives of each anchor and positive.

    vectors: vec_id long, embedding array<float or double>, label int; further columns are not read. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by ``every``) and
    each of its ``positives`` best other rows of the same label, the ``negatives`` best rows of another label whose score
    lies between ``low`` and ``high`` percent of the positive's. ``relabel``: ids divisible by 7 move to the next label.

    A score is the inner product of the components, each first turned to floor(256 x). Ties go to the smaller vec_id, then
    to the earlier row; a null vec_id comes last. Rows without a label or vector, or with null, non-finite or very large
    components (256 x of 2^26 and more, whose scores a long might not hold) take no part. Rows that share an id are rows of
    their own: each is an anchor if its id is one, and each may be the positive or negative of another. Vectors of
    different widths do not meet. A positive with a negative score has an empty window. Empty tables give empty results.
    """
    rows = prepared(vectors, relabel)
    chosen = rows.filter(F.col("vec_id") % every == 0)
    counts = chosen.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(ANCHORS)).cast("int").alias("_blocks"))
    block = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    in_label = chosen.join(counts, "label").withColumn("block", block(F.col("_blocks"))).drop("_blocks")
    near = rows.join(counts, "label").withColumn("blocks", F.sequence(F.lit(0), F.col("_blocks") - 1)).drop("_blocks")
    found = _meet(in_label, near, ["label"], _best_positives(positives), "anchor_row long, score long, vec_id long, row long")
    pairs = _combined(found, ["anchor_row"], positives)
    limits = pairs.groupBy("anchor_row").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "row"))).alias("_p"))  # at most ``positives``
    limits = limits.withColumn("positives", F.transform("_p", lambda p: F.struct((-p["s"]).alias("score"), p["vec_id"].alias("vec_id"), p["row"].alias("row"))))
    whole = F.transform("positives", lambda p: F.floor((p["score"] * high).cast("decimal(38,0)") / 100).cast("long"))
    limits = limits.withColumn("upper", F.sort_array(F.array_distinct(whole), asc=False))
    lowest = F.array_min(F.transform("positives", lambda p: F.ceil((p["score"] * low).cast("decimal(38,0)") / 100).cast("long")))
    limits = c.checkpointed(limits.select(F.col("anchor_row").alias("row"), "positives", "upper", lowest.alias("lowest")))
    blocks = max(1, -(-chosen.count() // ANCHORS))
    ready = chosen.join(limits.drop("positives"), "row").withColumn("block", block(F.lit(blocks)))
    everyone = rows.withColumn("blocks", F.sequence(F.lit(0), F.lit(blocks - 1)))
    slots = _meet(ready, everyone, [], _best_in_slots(negatives), "anchor_row long, slot int, score long, vec_id long, row long")
    slots = _combined(slots, ["anchor_row", "slot"], negatives)
    lists = slots.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("slot", "score", "vec_id", "row")).alias("slots"))
    answered = limits.join(chosen.select("row", "vec_id"), "row").join(lists, "row", "left")
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return answered.select("vec_id", "positives", "upper", "slots").mapInArrow(_windows(negatives, low, high), columns)


#: DuckDB SQL of the query over ``embeddings``.
SQL = """
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding::double[], lambda x: floor(256 * x)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.rid as arid, a.vec_id as anchor_id, b.rid as brid, b.vec_id, a.label = b.label as same,
    coalesce(list_dot_product(a.e, b.e), 0)::bigint as score
  from v a join v b on len(a.e) = len(b.e) where a.vec_id % 100 = 0 and a.rid <> b.rid
), p as (
  select * from (select *, row_number() over (partition by arid order by score desc, vec_id nulls last, brid) as k from s where same) where k <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.arid, p.brid order by s.score desc, s.vec_id nulls last, s.brid)::integer as rank
  from p join s on p.arid = s.arid and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
