"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors are turned onto their principal axes, and a rotation is learned that brings them close to the corners of a cube
(iterative quantisation); the signs are balanced binary codes. Each code is cut into substrings and every substring is
a hash table: vectors that agree in one substring meet. Several rotations, learned from different starts, give further
tables. Whoever meets is compared by cosine of the original vectors in double precision.

Equal vectors of a label are one node with a weight. A crowded bucket is cut into blocks, and every pair of blocks is
one task, so no bucket must fit into a task and none is cut short. Pairs are counted where they first meet and never
written out: a group returns link counts of its vectors and their local components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c
from riskframe.llm.graph import components, groups, in_blocks, roots

BITS, TABLES, SAMPLE, BLOCK = 16, 20, 4096, 2048


@dataclass(frozen=True)
class Quantiser:
    """Mean and one projection (axes times learned rotation) for each set of tables, of vectors of one width."""

    mean: np.ndarray
    projections: tuple[np.ndarray, ...]
    bits: int

    def codes(self, x: np.ndarray, tables: int) -> np.ndarray:
        found = []
        for p in self.projections:
            signs = (x - self.mean) @ p >= 0
            for k in range(0, signs.shape[1] - self.bits + 1, self.bits):
                found.append(signs[:, k:k + self.bits] @ (1 << np.arange(self.bits)))
        return np.stack(found[:tables], axis=1).astype(np.uint32)


def learn(sample: np.ndarray, width: int, tables: int = TABLES, bits: int = BITS, rounds: int = 40, seed: int = 11) -> Quantiser:
    """Iterative quantisation of unit vectors (rows); without a sample the rotations are random."""
    rng = np.random.default_rng([seed, width])
    mean = sample.mean(axis=0) if len(sample) else np.zeros(width)
    k = min(width, 64)
    if len(sample) > 1:
        axes = np.linalg.svd((sample - mean).T @ (sample - mean))[0][:, :k]
    else:
        axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :k]
    own = (sample - mean) @ axes
    bits = min(bits, k)
    projections = []
    while len(projections) * (k // bits) < tables:
        rotation = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(rounds if len(sample) > 1 else 0):
            u, _, vt = np.linalg.svd(np.where(own @ rotation >= 0, 1.0, -1.0).T @ own)
            rotation = (u @ vt).T
        projections.append(axes @ rotation)
    return Quantiser(mean, tuple(projections), bits)


def unit(rows: list) -> np.ndarray:
    """Unit vectors; first scaled by a power of two, so no component is too large or too small to be squared."""
    x = np.array(rows, dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(quantisers: dict[int, Quantiser], tables: int):
    """Of each node: its vector as bytes, its codes, and a bucket for each table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for width in sorted({len(r["embedding"]) for r in rows}):
                own = [r for r in rows if len(r["embedding"]) == width]
                x = unit([r["embedding"] for r in own])
                if width not in quantisers:
                    quantisers[width] = learn(np.zeros((0, width)), width, tables)
                codes = quantisers[width].codes(x, tables)
                label = np.array([r["label"] for r in own], dtype=np.int64).astype(np.uint64)
                base = c.mix(label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width))
                keys = c.mix(base[:, None] ^ c.mix((np.arange(codes.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)) | codes.astype(np.uint64)))
                yield pa.record_batch({
                    "node": pa.array([r["node"] for r in own], pa.int64()), "weight": pa.array([r["weight"] for r in own], pa.int64()),
                    "label": pa.array([r["label"] for r in own], pa.int32()), "width": pa.array(np.full(len(own), width, dtype=np.int32)),
                    "vector": pa.array([v.tobytes() for v in x], pa.binary()), "codes": pa.array([v.tobytes() for v in codes], pa.binary()),
                    "keys": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))})
    return run


def _links(least: float):
    """Link counts and local components of a group (a block of a bucket, or a pair of blocks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "lo", "hi"]):
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            block = np.asarray(t["block"].combine_chunks())
            node, weight, table = (np.asarray(t[x].combine_chunks()) for x in ("node", "weight", "table"))
            label, width = (np.asarray(t[x].combine_chunks()) for x in ("label", "width"))
            codes = np.frombuffer(b"".join(t["codes"].to_pylist()), dtype=np.uint32).reshape(len(node), -1)
            vectors = t["vector"].to_pylist()
            a_rows, b_rows = (np.flatnonzero(block == lo), np.flatnonzero(block == hi))
            counts, left, right = np.zeros(len(node), dtype=np.int64), [], []
            for w in np.unique(width[a_rows]):  # keys of different widths or labels meet by a hash collision alone
                a, b = a_rows[width[a_rows] == w], b_rows[width[b_rows] == w]
                if not len(b):
                    continue
                xb = np.frombuffer(b"".join(vectors[i] for i in b), dtype=np.float64).reshape(len(b), -1)
                for k in range(0, len(a), 256):
                    part = a[k:k + 256]
                    xa = np.frombuffer(b"".join(vectors[i] for i in part), dtype=np.float64).reshape(len(part), -1)
                    i, j = np.nonzero(xa @ xb.T >= least)
                    i, j = part[i], b[j]
                    fine = (label[i] == label[j]) & ((i < j) if lo == hi else (i != j))
                    i, j = i[fine], j[fine]
                    # Count a pair in the first table where it meets.
                    early = np.zeros(len(i), dtype=bool)
                    for s in range(codes.shape[1]):
                        early |= (s < table[i]) & (codes[i, s] == codes[j, s])
                    same = table[i] == table[j]
                    i, j = i[~early & same], j[~early & same]
                    np.add.at(counts, i, weight[j])
                    np.add.at(counts, j, weight[i])
                    left.append(i)
                    right.append(j)
            i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
            if len(i):
                order = np.argsort(node, kind="stable")
                place = np.empty(len(node), dtype=np.int64)
                place[order] = np.arange(len(node))
                root = node[order[roots(len(node), place[i], place[j])[place]]]
                some = counts > 0
                yield pa.record_batch({"node": pa.array(node[some]), "n": pa.array(counts[some]), "root": pa.array(root[some])})
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Links between vectors of one label with a cosine of ``least`` or more.

    vectors: vec_id long, embedding array<float or double>, label int; further columns are not read. Returns vec_id,
    n_links, component_id, kept (vec_id = component_id), one row for each input row.

    A vector that is null, zero, empty or holds null or non-finite components, or has no label, links with nothing and
    is its own component. Vectors of different widths do not link. Repeated rows are vectors like others and link. The
    rotations are learned on the ``sample`` vectors with the smallest hashes; every vector is indexed. Pairs at the
    very limit meet in one of ``tables`` tables with a probability above 0.99; pairs found are never below the limit.
    """
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))
    own = own.select("vec_id", "embedding", "label", valid.alias("valid"))
    keyed = own.withColumns({"h1": F.when(F.col("valid"), F.xxhash64("embedding")), "h2": F.when(F.col("valid"), F.xxhash64("embedding", F.lit(1)))})
    same = ["label", "h1", "h2"]
    nodes = keyed.filter("valid").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    nodes = c.checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    picked = nodes.select("h1", "embedding").orderBy("h1").limit(sample).collect()  # ``sample`` vectors
    by_width: dict[int, list] = {}
    for r in picked:
        by_width.setdefault(len(r["embedding"]), []).append(r["embedding"])
    quantisers = {w: learn(unit(rows), w, tables) for w, rows in by_width.items()}
    columns = "node long, weight long, label int, width int, vector binary, codes binary, keys array<long>"
    coded = c.checkpointed(nodes.select("node", "weight", "label", "embedding").mapInArrow(_coded(quantisers, tables), columns))
    met = coded.select("node", F.posexplode("keys").alias("table", "bucket"))
    crowded = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = met.join(crowded, "bucket").join(coded.drop("keys"), "node")
    found = in_blocks(members, ["bucket"], "node", "size", block).mapInArrow(_links(least), "node long, n long, root long")
    found = c.checkpointed(found)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select(*same, "node", "first", "weight").join(links, "node", "left").join(parts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least_id = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(least_id, "component").select(*same, (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = keyed.select("vec_id", *same).join(placed, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL of the query over ``embeddings``.
SQL = """
with recursive v as (select row_number() over () as rid, vec_id, label, embedding::double[] as e from embeddings),
sound as (
  select rid, vec_id, label, e, list_max(list_transform(e, lambda x: abs(x))) as m from v
  where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), scaled as (select rid, vec_id, label, list_transform(e, lambda x: x / m) as e from sound where m > 0),
ok as (select *, list_dot_product(e, e) as n2 from scaled), l as (
  select a.rid as x, b.rid as y from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.rid <> b.rid
  where list_dot_product(a.e, b.e) / sqrt(a.n2 * b.n2) >= 0.98
), reach as (
  select rid, rid as other from v union select r.rid, l.y from reach r join l on r.other = l.x
), part as (
  select r.rid, min(v.vec_id) as component_id from reach r join v on r.other = v.rid group by r.rid
), n as (select x as rid, count(*) as n from l group by x)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, part.component_id, coalesce(v.vec_id = part.component_id, true) as kept
from v join part on v.rid = part.rid left join n on v.rid = n.rid
"""
