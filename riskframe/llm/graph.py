"""Blocks of large buckets, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c


def in_blocks(members: DataFrame, key: list[str], node: str, size: str, most: int) -> DataFrame:
    """Deal the members of each bucket out so that every pair of a bucket meets in exactly one group.

    A bucket of ``size`` members is cut into blocks of about ``most``; a group is a pair of blocks (lo, hi), or one
    block with itself. Adds lo, hi and block, and brings groups together in partitions, sorted.
    """
    blocks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "_with"), "hi": F.greatest("block", "_with")}).drop("_blocks", "_with")
    group = [*key, "lo", "hi"]
    return dealt.repartition(c.shuffle_partitions(members.sparkSession), *group).sortWithinPartitions(*group)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows with equal ``key``, which stand together, over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [np.asarray(batch.column(k)) for k in key]
        change = np.zeros(batch.num_rows, dtype=bool)
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
        cuts = np.append(np.flatnonzero(change), batch.num_rows)
        begin = 0
        for end in cuts:
            now = tuple(x[begin] for x in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield pa.Table.from_batches(held)
    c.release_memory()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each of ``n`` places, by the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _contracted(most: int):
    """Of each ``most`` edges of a partition a star forest with the same components: at most one edge a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def forest() -> pa.RecordBatch:
            nodes, places = np.unique(np.concatenate(held), return_inverse=True)
            a, b = places.reshape(-1, 2).T
            root = roots(len(nodes), a, b)
            inner = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.record_batch({"u": pa.array(nodes[inner]), "v": pa.array(nodes[root[inner]])})

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column("a")), np.asarray(batch.column("b"))], axis=1).reshape(-1))
            n += batch.num_rows
            if n >= most:
                yield forest()
                held, n = [], 0
        if n:
            yield forest()
        c.release_memory()
    return run


def components(edges: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a long, b long; cheap to read twice).

    Partitions of about ``chunk`` edges are first contracted to star forests where they lie. Large-star and small-star
    rounds follow until the whole is a star forest: no node has two edges to smaller ones, and none that has one is the
    end of another. Each round's edges are checkpointed. Nodes with many edges are only ever grouped by a minimum or a
    sum (partly added up before the shuffle) or joined (skewed partitions are split).
    """
    edges = edges.filter("a != b")
    parts = max(1, -(-edges.count() // chunk))
    now = c.checkpointed(edges.select("a", "b").coalesce(parts).mapInArrow(_contracted(chunk), "u long, v long"))
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")),
                                            F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up = 1 and root = 1)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = c.checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = c.checkpointed(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
