"""Incremental line de-duplication that can be taken back.

The index keeps, exactly, which document holds which line (the reference table) and, by shard of the line's key, cuckoo
filters over the lines present. Inserting documents first asks the filters: a line that no filter knows is new and
needs no look-up. Only the suspects (known fingerprints, or met twice in the batch) are counted in the exact table. A
deletion takes the document's references away, and the fingerprints of lines that nobody holds any more; a line that is
left with one document stops being a repeat, so its dropped copies come back on the next ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common as c
from riskframe.llm.seekable import shared_folder

STRIPPED = " \t\n\x0b\x0c\r"
_KEY = ["hi", "lo"]
_REFS = "hi long, lo long, doc_id long"
_SHARDED = "shard int, hi long, lo long, n long, blob binary"


def line_key(line: str) -> bytes:
    """The line without outer white space, A-Z in lower case."""
    return line.strip(STRIPPED).encode().lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """Two signed halves of a 128-bit hash."""
    h = xxhash.xxh3_128_intdigest(key)
    hi, lo = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return hi - (1 << 64) if hi >> 63 else hi, lo - (1 << 64) if lo >> 63 else lo


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; batches are placed together, losers are kicked on to their other bucket."""

    SLOTS, ROUNDS = 4, 200

    def __init__(self, keys: int, table: np.ndarray | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (0.8 * self.SLOTS) + 1))))
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16) if table is None else table
        self.used = int((self.table != 0).sum())

    def _at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (h >> np.uint64(48)).astype(np.uint16)
        return np.where(mark == 0, 1, mark).astype(np.uint16), (h & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (c.mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, a = self._at(h)
        b = self._other(mark, a)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Place distinct keys; returns, as (mark, bucket) in one integer each, fingerprints that found no place."""
        mark, bucket = self._at(h)
        self.used += len(h)
        slot = 0
        for turn in range(self.ROUNDS):
            if len(mark) == 0:
                break
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket, side="left")
            empty = self.table[bucket] == 0
            free = np.argsort(~empty, axis=1, kind="stable")
            fits = rank < empty.sum(axis=1)
            self.table[bucket[fits], free[fits, rank[fits]]] = mark[fits]
            waits, first = ~fits, ~fits & (rank == empty.sum(axis=1))
            if turn:  # the first loser of each bucket takes a place there, whose holder moves on
                slot = (slot + 1) % self.SLOTS
                out = self.table[bucket[first], slot].copy()
                self.table[bucket[first], slot] = mark[first]
                mark[first] = out
            mark, bucket, moves = mark[waits], bucket[waits], first[waits] | (turn == 0)
            bucket = np.where(moves, self._other(mark, bucket), bucket)
        self.used -= len(mark)
        return (bucket.astype(np.uint64) << np.uint64(16)) | mark

    def delete(self, h: np.ndarray) -> np.ndarray:
        """Take one fingerprint of each key away; returns which keys had one."""
        found = np.zeros(len(h), dtype=bool)
        marks, buckets = self._at(h)
        others = self._other(marks, buckets)
        for k in range(len(h)):
            for bucket in (int(buckets[k]), int(others[k])):
                at = np.flatnonzero(self.table[bucket] == marks[k])
                if len(at):
                    self.table[bucket, at[0]] = 0
                    found[k] = True
                    break
        self.used -= int(found.sum())
        return found


class KeySet:
    """Distinct keys in sorted runs, at least doubling in length from the last to the first: few runs, few merges."""

    def __init__(self):
        self.runs: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.runs.append(np.unique(keys))
        while len(self.runs) > 1 and 2 * len(self.runs[-1]) > len(self.runs[-2]):
            self.runs[-2:] = [np.union1d(self.runs[-2], self.runs[-1])]

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
            found |= run[at] == keys
        return found


class Shard:
    """Cuckoo filters of one shard: a further one, as large as all before it together, is opened when the last is full."""

    def __init__(self, blob: bytes | None = None):
        self.filters: list[CuckooFilter] = []
        self.loose = np.zeros(0, dtype=np.uint64)  # keys whose insertion failed, kept whole
        self.fresh = KeySet()  # keys inserted since the blob was read; not part of it
        if blob:
            reader = pa.ipc.open_stream(blob)
            for batch in reader:
                values = batch.column("v").to_numpy(zero_copy_only=False)
                if batch.column("kind")[0].as_py() == 0:
                    self.filters.append(CuckooFilter(0, values.astype(np.uint16).reshape(-1, CuckooFilter.SLOTS).copy()))
                else:
                    self.loose = values.astype(np.uint64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        known = np.isin(h, self.loose)
        for f in self.filters:
            known |= f.contains(h)
        return known

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Insert those of distinct keys that are certainly new; returns which seemed to be there."""
        known = self.contains(h)
        self.force(h[~known])
        return known

    def force(self, new: np.ndarray) -> None:
        """Insert distinct keys whatever the filters say: for keys that only seemed to be there."""
        self.fresh.add(new)
        if len(new):
            if not self.filters or self.filters[-1].used + len(new) > 0.9 * self.filters[-1].table.size:
                held = sum(f.table.size for f in self.filters)
                self.filters.append(CuckooFilter(max(2 * len(new), held * 3 // 4, 1024)))
            last = self.filters[-1]
            before, used = last.table.copy(), last.used
            if len(last.insert(new)):  # very rare: keep these keys whole instead
                last.table[:], last.used = before, used
                self.loose = np.union1d(self.loose, new)

    def delete(self, h: np.ndarray) -> None:
        whole = np.isin(h, self.loose)
        self.loose = np.setdiff1d(self.loose, h)
        h = h[~whole]
        for f in self.filters:
            h = h[~f.delete(h)] if len(h) else h

    def blob(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema({"kind": pa.int8(), "v": pa.uint64()}), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for kind, values in [(0, f.table.reshape(-1)) for f in self.filters] + [(1, self.loose)] * bool(len(self.loose)):
                out.write_batch(pa.record_batch({"kind": pa.array(np.full(len(values), kind, dtype=np.int8)), "v": pa.array(values.astype(np.uint64))}))
        return sink.getvalue().to_pybytes()


def references(docs: DataFrame, least: int) -> DataFrame:
    """One row for each document and distinct key of at least ``least`` code points in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches):
            hi, lo, ids = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if doc_id is None or not text:
                    continue
                for key in {line_key(x) for x in text.split("\n") if len(x.strip(STRIPPED)) >= least}:
                    a, b = key_hash(key)
                    hi.append(a)
                    lo.append(b)
                    ids.append(doc_id)
            yield pa.record_batch({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "doc_id": pa.array(ids, pa.int64())})
    return docs.select("doc_id", "text").mapInArrow(run, _REFS)


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    """Distinct keys of each batch with their number of references, by shard: a line of every text is one row a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.stack([np.asarray(batch.column("hi")), np.asarray(batch.column("lo"))], axis=1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            first = np.ones(len(pairs), dtype=bool)
            first[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(pairs)))
            hi, lo = pairs[at, 0], pairs[at, 1]
            yield pa.record_batch({
                "shard": pa.array(((hi.astype(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)), "hi": pa.array(hi), "lo": pa.array(lo),
                "n": pa.array(n.astype(np.int64)), "blob": pa.array([None] * len(hi), pa.binary())})
    return keys.select(*_KEY).mapInArrow(run, _SHARDED)


def _per_shard(work):
    """Rows of a shard stand together, its filters (the row with a blob) first; ``work(shard, filters, hi, lo, n)`` yields batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filters = None, Shard()
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(shard)), strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    if now is not None:
                        yield _row(now, filters)
                    now, filters = int(shard[a]), Shard()
                part = batch.slice(a, b - a)
                blobs = [x for x in part.column("blob").to_pylist() if x is not None]
                if blobs:
                    filters = Shard(blobs[0])
                    part = part.filter(part.column("blob").is_null())
                if part.num_rows:
                    yield from work(now, filters, *(np.asarray(part.column(x)) for x in ("hi", "lo", "n")))
        if now is not None:
            yield _row(now, filters)
    return run


def _row(shard: int, filters: Shard) -> pa.RecordBatch:
    return pa.record_batch({"shard": pa.array([shard], pa.int32()), "hi": pa.array([None], pa.int64()), "lo": pa.array([None], pa.int64()),
                            "n": pa.array([None], pa.int64()), "blob": pa.array([filters.blob()], pa.binary())})


def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return c.mix(hi.astype(np.uint64) ^ c.mix(lo.astype(np.uint64)))


def _insert(shard, filters, hi, lo, n):
    """Suspects: keys met again (n as it is), or that a filter took for known before they were inserted here (n = 0)."""
    unique, place = np.unique(_mixed(hi, lo), return_inverse=True)
    here = filters.fresh.has(unique)
    known = filters.insert(unique)
    suspect = (known | (np.bincount(place, weights=n) > 1))[place]
    k = int(suspect.sum())
    yield pa.record_batch({"shard": pa.array(np.full(k, shard, dtype=np.int32)), "hi": pa.array(hi[suspect]), "lo": pa.array(lo[suspect]),
                           "n": pa.array(np.where((known & ~here)[place], 0, n)[suspect]), "blob": pa.array([None] * k, pa.binary())})


def _force(shard, filters, hi, lo, n):
    new = np.unique(_mixed(hi, lo))
    filters.force(new[~filters.fresh.has(new)])
    return
    yield


def _delete(shard, filters, hi, lo, n):
    filters.delete(np.unique(_mixed(hi, lo)))
    return
    yield


class LineIndex:
    """The index: tables in a shared folder, one version for each insertion or deletion."""

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = 10, shards: int = 256):
        self.spark, self.least, self.shards, self.version = spark, least, shards, 0
        self.folder = folder or shared_folder(spark, "lines")

    def _read(self, name: str, schema: str, versions: range) -> DataFrame:
        paths = [f"{self.folder}/{name}/{v}" for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _every(self) -> range:
        return range(1, self.version + 1)

    def _filters(self) -> DataFrame:
        return self._read("filters", _SHARDED, range(self.version, self.version + 1) if self.version else range(0)).filter(F.col("blob").isNotNull())

    def _pass(self, keys: DataFrame, work) -> None:
        """Run keys through the shards' filters; the next version's filters and suspects are written in one go."""
        rows = keys if self.version == 0 else keys.unionByName(self._filters())
        dealt = rows.repartition(c.shuffle_partitions(self.spark), "shard").sortWithinPartitions("shard", F.col("blob").isNull())
        dealt.mapInArrow(_per_shard(work), _SHARDED).write.mode("overwrite").parquet(f"{self.folder}/filters/{self.version + 1}")

    def references(self) -> DataFrame:
        """The exact table: who holds which line now. A document deleted and inserted again counts from its last insertion."""
        if self.version == 1:
            return self._read("references", _REFS + ", sign int", self._every()).drop("sign")
        signed = self._read("references", _REFS + ", sign int", self._every())
        return signed.groupBy("doc_id", *_KEY).agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")

    def insert(self, docs: DataFrame, last: bool = False) -> None:
        """Add documents (doc_id long, text string) that are not in the index.

        Keys that only seemed to be known (their fingerprint was another key's) get a fingerprint of their own, so that
        a later deletion of the other one does not hide them. ``last``: no change follows, so that step is left out.
        """
        signed = references(docs, self.least).distinct() if self.version else references(docs, self.least)
        self._next(signed.withColumn("sign", F.lit(1)))
        new = self._read("references", _REFS, range(self.version + 1, self.version + 2))
        held = self.references().select(*_KEY) if self.version else None
        self._pass(_sharded(new, self.shards), _insert)
        self.version += 1
        if not last:
            seeming = self._read("filters", _SHARDED, range(self.version, self.version + 1)).filter("blob is null and n = 0").select(*_KEY).distinct()
            strangers = seeming.join(held, _KEY, "left_anti") if held is not None else seeming
            self._next(None)
            self._pass(_sharded(strangers, self.shards), _force)
            self.version += 1

    def _next(self, references: DataFrame | None) -> None:
        """The reference rows of the next version; none if only its filters change."""
        rows = self.spark.createDataFrame([], _REFS + ", sign int") if references is None else references
        rows.write.mode("overwrite").parquet(f"{self.folder}/references/{self.version + 1}")

    def delete(self, ids: DataFrame) -> None:
        """Take documents (doc_id) out again."""
        gone = self.references().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("sign", F.lit(-1))
        self._next(gone.select("doc_id", *_KEY, "sign"))
        taken = self._read("references", _REFS, range(self.version + 1, self.version + 2)).distinct()
        counted = self.references().distinct().groupBy(*_KEY).agg(F.count("*").alias("n"))
        orphans = taken.groupBy(*_KEY).agg(F.count("*").alias("g")).join(counted, _KEY).filter("n = g")
        self._pass(_sharded(orphans, self.shards), _delete)
        self.version += 1

    def _with_keys(self, keys: DataFrame, weight: str, how: str) -> DataFrame:
        """References joined with distinct ``keys``; those of keys that hold over a thousandth of all ``weight`` move no reference.

        There are fewer than a thousand of these, whatever the input, so they are broadcast; the rest are joined by key.
        """
        keys = c.checkpointed(keys)
        most = (keys.agg(F.sum(weight)).first()[0] or 0) / 1000
        hot, rest = keys.filter(F.col(weight) > most), keys.filter(F.col(weight) <= most)
        held = self.references()
        cold = held.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti").join(rest, _KEY, how)
        return held.join(F.broadcast(hot), _KEY, how).unionByName(cold)

    def repeats(self) -> DataFrame:
        """Lines that at least two documents hold: hi, lo, n_docs, first (the smallest doc_id)."""
        suspects = self._read("filters", _SHARDED, self._every()).filter(F.col("blob").isNull()).groupBy(*_KEY).agg(F.sum("n").alias("n"))
        counted = self._with_keys(suspects, "n", "left_semi").groupBy(*_KEY)
        return counted.agg(F.count_distinct("doc_id").alias("n_docs") if self.version == 1 else F.count("*").alias("n_docs"),
                           F.min("doc_id").alias("first")).filter("n_docs >= 2")

    def drops(self) -> DataFrame:
        """For each document, the keys of the lines it loses."""
        pairs = self._with_keys(self.repeats(), "n_docs", "inner").filter("doc_id > first").select("doc_id", *_KEY).distinct()
        return pairs.groupBy("doc_id").agg(F.collect_list(F.struct(*_KEY)).alias("keys"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` with the text cleaned, n_lines (before) and n_dropped (in place of columns so named)."""
        docs = docs.drop("n_lines", "n_dropped", "_hi", "_lo", "_id")
        marks = self.drops().select(F.col("doc_id").alias("_id"), F.transform("keys", lambda k: k["lo"]).alias("_lo"), F.transform("keys", lambda k: k["hi"]).alias("_hi"))
        joined = docs.join(marks, docs["doc_id"] == marks["_id"], "left").drop("_id")
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, lines, dropped = [], [], []
                for text, hi, lo in zip(*(batch.column(x).to_pylist() for x in ("text", "_hi", "_lo")), strict=True):
                    own = (text or "").split("\n")
                    if lo:
                        bad = set(zip(hi, lo, strict=True))
                        kept = [x for x in own if len(x.strip(STRIPPED)) < self_least or key_hash(line_key(x)) not in bad]
                        text = "\n".join(kept)
                    else:
                        kept = own
                    texts.append(text)
                    lines.append(len(own))
                    dropped.append(len(own) - len(kept))
                columns = {f: batch.column(f) for f in docs_columns}
                columns["text"] = pa.array(texts, pa.string())
                yield pa.record_batch({**columns, "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

        self_least, docs_columns = self.least, list(docs.columns)
        return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = 10, shards: int = 256) -> DataFrame:
    """All columns of ``docs`` with repeated lines dropped, and n_lines, n_dropped.

    A line's key is the line without outer ASCII white space, A-Z in lower case. Keys of at least ``least`` code points
    that two or more documents hold lose their lines everywhere but in the smallest doc_id that holds them.

    A null text counts as one empty line and stays null; a null doc_id holds no line and loses none. Rows that share a
    doc_id are one document. Extra columns pass through. An empty table gives an empty result. A shard's filters are held
    by one task: take a shard for every few million distinct lines.
    """
    index = LineIndex(docs.sparkSession, least=least, shards=shards)
    index.insert(docs, last=True)
    return index.clean(docs)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of cleaned documents."""
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL of the query over ``documents``.
SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (
  select rid, doc_id, i, line, case when length(k) >= 10 then translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as k
  from (select rid, doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k
        from (select rid, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d))
), r as (
  select k, min(doc_id) as first from l where k is not null and doc_id is not null group by k having count(distinct doc_id) >= 2
), m as (
  select l.*, coalesce(r.first < l.doc_id, false) as gone from l left join r on l.k = r.k
)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by rid
"""
