"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has a fixed number of coordinates. Round by round every shingle is thrown into one coordinate; the first round
that reaches a coordinate, and the smallest value in it, fill it. After as many rounds as there are coordinates, a round
sends all shingles to one coordinate in turn, so every coordinate fills. Large sets fill in one or two rounds.

Equal sets are one node. Nodes that agree in a whole band of coordinates meet in a bucket. Candidates come in turns,
each followed by exact verification on the full sets and by components:

1. each node with the first and the last node of its buckets (two pairs a node and bucket, never all pairs);
2. where a bucket still holds nodes of different components: of each node's most similar node of another one, the pairs
   of a forest (fewer pairs than nodes);
3. every pair of a bucket that is still in different components, on the full sets, in blocks.

Links inside a component need no further test, so a group of thousands of near copies costs a few pairs a node, and no
pair that could still join two components is left out. The first two turns propose pairs whose sketches agree well; the
last one does not ask the sketches, so a link is missed only if its nodes meet in no bucket: by the binomial law, with
21 bands of 6 coordinates, 0.005 % of links exactly at a similarity of 0.85 and 0.17 % at 0.80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c
from riskframe.llm.graph import components, groups, in_blocks

COORDINATES, BANDS, ROWS, BLOCK = 126, 21, 6, 1024
LAST = 4  # blocks of the last turn against those before it
SHINGLES = 1024  # a node of the last turn; a block holds as many nodes as have ``block`` times that
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the ascending hashes of its distinct word shingles; a shorter text is one shingle, no word none."""
    flat, rows = c.tokens(texts, lower=True)
    codes, words = c.coded(flat)
    h = c.mix(c.hashes(words))[codes]
    counts = np.bincount(rows, minlength=len(texts))
    begins = np.cumsum(counts) - counts
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(size):  # at i the hash of the words i .. i + size - 1; those over a text's end are not used
        rolled[:len(h) - k] = c.mix(rolled[:len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    found = []
    for n, at in zip(counts, begins, strict=True):
        if n >= size:
            found.append(np.unique(rolled[at:at + n - size + 1]))
        elif n:
            one = np.uint64(n)
            for x in h[at:at + n]:
                one = c.mix(np.array([(int(one) * 0x9E3779B97F4A7C15 + int(x)) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]
            found.append(np.array([one], dtype=np.uint64))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of ``coordinates`` 16-bit values for each non-empty set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    best = np.full((len(sets), coordinates), _EMPTY)
    flat = best.reshape(-1)
    low = np.uint64((1 << 48) - 1)
    for turn in range(2 * coordinates):
        if not len(x):
            break
        h = c.mix(x ^ c.mix(np.array([turn + 1], dtype=np.uint64)))
        if turn < coordinates:
            coordinate = (((h >> np.uint64(48)) * np.uint64(coordinates)) >> np.uint64(16)).astype(np.int64)
        else:
            coordinate = turn - coordinates
        np.minimum.at(flat, owner * coordinates + coordinate, (np.uint64(turn) << np.uint64(48)) | (h & low))
        open_ = (best == _EMPTY).any(axis=1)
        more = open_[owner]
        x, owner = x[more], owner[more]
    return (c.mix(best) & np.uint64(0xFFFF)).astype(np.uint16)


def _sketched(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in c.pieces(batches, most=4 << 20):
            sets = shingle_sets(batch.column("text"), size)
            prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            values = sketches(sets, coordinates)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            half = lambda shift, p=prints: pa.array(np.array([(x >> shift) & 0xFFFFFFFFFFFFFFFF for x in p], dtype=np.uint64).view(np.int64))
            yield pa.record_batch({
                "row": pa.array(row + np.arange(len(n))), "doc_id": batch.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(n),
                "h1": half(64), "h2": half(0), "sketch": pa.array([v.tobytes() if k else None for v, k in zip(values, n, strict=True)], pa.binary())})
            row += len(n)
    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
            keys = []
            for b in range(bands):
                key = np.full(len(v), b + 1, dtype=np.uint64)
                for x in range(b * rows, (b + 1) * rows):
                    key = c.mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, x])
                keys.append(key)
            yield pa.record_batch({"node": batch.column("node"), "keys": pa.array(list(np.stack(keys, axis=1).view(np.int64)), pa.list_(pa.int64()))})
    return run


def _agreement(least: float):
    """Pairs whose sketches agree in at least a share ``least`` of the coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for x in ("sa", "sb"))
            fine = pa.array((a == b).mean(axis=1) >= least)
            yield pa.record_batch({"a": batch.column("a").filter(fine), "b": batch.column("b").filter(fine)})
    return run


def _across(least: float):
    """Candidate pairs between components of a group: a forest of the most similar ones, so fewer than it has nodes.

    Each node names its most similar node of another component; of these pairs, the most similar first, those are proposed
    that join components not yet joined by a pair of the group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "lo", "hi"]):
            node, part, block = (np.asarray(t[x].combine_chunks()) for x in ("node", "component", "block"))
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            if not len(a) or not len(b) or (part[a].min() == part[a].max() == part[b].min() == part[b].max()):
                continue
            v = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint16).reshape(len(node), -1)
            found = []
            for own, side in [(a, b)] if lo == hi else [(a, b), (b, a)]:
                for i in own:
                    others = side[part[side] != part[i]]
                    if len(others):
                        alike = (v[others] == v[i]).mean(axis=1)
                        k = int(np.argmax(alike))
                        if alike[k] >= least:
                            found.append((-alike[k], int(i), int(others[k])))
            root = {int(p): int(p) for p in np.unique(part)}

            def find(p: int, root: dict[int, int] = root) -> int:
                while root[p] != p:
                    root[p] = p = root[root[p]]
                return p

            kept = []
            for _, i, j in sorted(found):
                p, q = find(int(part[i])), find(int(part[j]))
                if p != q:
                    root[p] = q
                    kept.append((node[i], node[j]))
            if kept:
                x, y = np.array(kept, dtype=np.int64).T
                yield pa.record_batch({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})
    return run


def _linked_across(least_percent: int, rows: int):
    """Links on the full sets between different components of a group; components that a link joins count as one after it.

    A pair is tested in the first band where it meets. Of two components one is not the largest of the group, so only the
    others' nodes go through their partners; the intersections of a node with all of them are counted in one pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "lo", "hi"]):
            node, part, block = (np.array(t[x].combine_chunks()) for x in ("node", "component", "block"))
            lo, hi, band = t["lo"][0].as_py(), t["hi"][0].as_py(), t["band"][0].as_py()
            a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            if not len(a) or not len(b) or (part[a].min() == part[a].max() == part[b].min() == part[b].max()):
                continue
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint16).reshape(len(node), -1)[:, :band * rows].reshape(len(node), band, rows)
            sets = [c.unpack(x, np.uint64, delta=True) for x in t["set"].to_pylist()]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            known, codes = np.unique(np.concatenate(sets), return_inverse=True)
            del sets
            begin = np.cumsum(n) - n
            here = np.zeros(len(known), dtype=bool)
            labels, times = np.unique(part, return_counts=True)
            largest = labels[np.argmax(times)]
            for i in np.flatnonzero(part != largest):
                side = b if block[i] == lo else a
                others = side[(part[side] != part[i]) & (100 * np.minimum(n[side], n[i]) >= least_percent * np.maximum(n[side], n[i]))]
                if band and len(others):
                    others = others[~(sketch[others] == sketch[i]).all(axis=2).any(axis=1)]
                own = codes[begin[i]:begin[i] + n[i]]
                here[own] = True
                for k in range(0, len(others), 4096):
                    some = others[k:k + 4096]
                    ends = np.cumsum(n[some])
                    flat = np.arange(int(ends[-1])) + np.repeat(begin[some] - (ends - n[some]), n[some])
                    both = np.add.reduceat(here[codes[flat]].astype(np.int64), ends - n[some])
                    for j in some[100 * both >= least_percent * (n[some] + n[i] - both)]:
                        if part[j] != part[i]:
                            part[part == part[j]] = part[i]
                            yield pa.record_batch({"a": pa.array([min(node[i], node[j])]), "b": pa.array([max(node[i], node[j])])})
                here[own] = False
    return run


def _verified(least_percent: int):
    """Pairs with 100 * intersection >= least * union on the full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.zeros(batch.num_rows, dtype=bool)
            held, own = None, None
            for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                blob = x.as_buffer()
                if held is None or not blob.equals(held):
                    held, own = blob, c.unpack(blob.to_pybytes(), np.uint64, delta=True)
                other = c.unpack(y.as_buffer().to_pybytes(), np.uint64, delta=True)
                both = len(np.intersect1d(own, other, assume_unique=True))
                fine[k] = 100 * both >= least_percent * (len(own) + len(other) - both)
            keep = pa.array(fine)
            yield pa.record_batch({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)})
    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, most=4 << 20):
            sets = shingle_sets(batch.column("text"), size)
            prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = lambda shift, p=prints: pa.array(np.array([(x >> shift) & 0xFFFFFFFFFFFFFFFF for x in p], dtype=np.uint64).view(np.int64))
            yield pa.record_batch({"h1": half(64), "h2": half(0), "set": pa.array([c.pack(s, delta=True) for s in sets], pa.binary())})
    return run


def near_duplicates(docs: DataFrame, size: int = 3, least_percent: int = 85, coordinates: int = COORDINATES, bands: int = BANDS,
                    rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Link documents whose sets of ``size``-word shingles have a Jaccard similarity of ``least_percent`` % or more.

    docs: doc_id long, text string; further columns are not read. Returns row (a number of the input row), doc_id,
    n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Words are lower-cased in A-Z. A text of fewer words is one shingle; a null or blank text has no shingle and links
    with nothing. A row with a null doc_id links with nothing and is kept. Rows that share a doc_id are rows of their
    own; equal rows link and are all kept by this column. An empty table gives an empty result.
    """
    columns = "row long, doc_id long, n_shingles long, h1 long, h2 long, sketch binary"
    sketched = c.checkpointed(docs.select("doc_id", "text").mapInArrow(_sketched(size, coordinates), columns))
    full = sketched.filter("n_shingles > 0 and doc_id is not null")
    same = full.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"))
    same = c.checkpointed(same)
    nodes = full.join(same.select("node"), full["row"] == same["node"], "left_semi").select(F.col("row").alias("node"), "doc_id", "h1", "h2", "sketch")
    likely = least_percent / 100
    near = max(0.0, likely - 3 * np.sqrt(likely * (1 - likely) / coordinates))  # for the first turns only; the last one asks no sketch

    met = nodes.select("node", "sketch").mapInArrow(_bands(bands, rows), "node long, keys array<long>").select("node", F.posexplode("keys").alias("band", "bucket"))
    crowded = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).filter("size > 1")
    members = c.checkpointed(met.join(crowded, "bucket"))

    sketch_of = nodes.select("node", "sketch")

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketch_of.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(
            sketch_of.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_agreement(near), "a long, b long")

    ends = members.select(F.explode(F.array("low", "high")).alias("x"), "node").filter("x != node")
    first = ends.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    first = c.checkpointed(similar(first))

    # Full sets of the nodes that can need them, read once.
    wanted = members.select("node").distinct().join(nodes.drop("sketch"), "node")
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_full_sets(size), "h1 long, h2 long, set binary")
    sets = c.checkpointed(sets.join(wanted.select("node", "h1", "h2"), ["h1", "h2"]).groupBy("node").agg(F.first("set").alias("set")))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        return c.checkpointed(both.select("a", "b", "sa", "sb").mapInArrow(_verified(least_percent), "a long, b long"))

    def apart(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        parts = components(links)
        labelled = members.select("bucket", "band", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = labelled.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("size"), F.min("component").alias("p"), F.max("component").alias("q")).filter("p != q").select("bucket", "size")
        return labelled, c.checkpointed(mixed)

    tested, links = first, verify(first)
    labelled, mixed = apart(links)
    if not mixed.isEmpty():
        dealt = in_blocks(labelled.join(mixed, "bucket").join(sketch_of, "node"), ["bucket"], "node", "size", block)
        new = dealt.mapInArrow(_across(near), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        links = links.unionByName(verify(c.checkpointed(new)))
        labelled, mixed = apart(links)
    if not mixed.isEmpty():
        left = labelled.join(mixed.select("bucket"), "bucket")
        load = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n_shingles") / SHINGLES))
        loads = left.join(full.select(F.col("row").alias("node"), "n_shingles"), "node").groupBy("bucket").agg(load.alias("size"))
        # Sets are copied once a block, so blocks are as large as a task can well hold.
        dealt = in_blocks(left.join(loads, "bucket").join(sets, "node").join(sketch_of, "node"), ["bucket"], "node", "size", LAST * block)
        links = links.unionByName(c.checkpointed(dealt.mapInArrow(_linked_across(least_percent, rows), "a long, b long").distinct()))
    parts = components(links)
    placed = same.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(least_id, "component").select("h1", "h2", "component_id")
    joined = sketched.drop("sketch").join(placed, ["h1", "h2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("row", "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


#: DuckDB SQL of the query over ``documents``.
SQL = r"""
with recursive d as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct rid, array_to_string(w[i:i + 2], ' ') as shingle
  from (select rid, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from d where len(w) > 0)
), n as (select rid, count(*) as n from s group by rid), u as (select s.* from s join d on s.rid = d.rid where d.doc_id is not null),
p as (select a.rid as x, b.rid as y, count(*) as c from u a join u b on a.shingle = b.shingle and a.rid <> b.rid group by a.rid, b.rid),
l as (select x, y from p join n a on p.x = a.rid join n b on p.y = b.rid where 100 * c >= 85 * (a.n + b.n - c)),
reach as (select rid, rid as other from d union select r.rid, l.y from reach r join l on r.other = l.x),
part as (select r.rid, min(d.doc_id) as component_id from reach r join d on r.other = d.rid group by r.rid)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, part.component_id, coalesce(d.doc_id = part.component_id, true) as kept
from d join part on d.rid = part.rid left join n on d.rid = n.rid
"""
