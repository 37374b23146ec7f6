"""Shared helpers: tables, tokens in Arrow batches, hashes, packed integer columns, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import checkpointed  # noqa: F401  (re-used by the operators)

#: A word, as a SQL pattern: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def id_remainder(ids: list, modulus: int) -> np.ndarray:
    """The same in Python, modulo ``modulus``, for a list of ids."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], dtype=np.int64)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, beside an executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


# --- texts in Arrow batches -------------------------------------------------

def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def tokens(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, and each word's row. Only A-Z are lower-cased; null is an empty text."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    return (flat, rows) if real.all() else (flat.filter(pa.array(real)), rows[real])


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the list of the distinct words, and that list."""
    if len(flat) == 0:
        return np.zeros(0, dtype=np.int64), pa.array([], pa.string())
    d = flat.dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w.encode(), seed) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- packed integer columns --------------------------------------------------

def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Integers as byte planes under zstandard; ``delta`` for ascending ones."""
    v = np.ascontiguousarray(values)
    if delta and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    planes = v.view(np.uint8).reshape(len(v), -1).T.tobytes() if len(v) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, dtype, delta: bool = False) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    width = np.dtype(dtype).itemsize
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)
    return np.cumsum(v, dtype=dtype) if delta else v


# --- bounded samples ----------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, most_chars: int, seed: int = 17) -> DataFrame:
    """doc_id, text, _label (0 or 1): whole labelled texts for training, of at most ``most_chars`` characters.

    Only rows whose crc32(doc_id) mod ``modulus`` is not 0 are used, and none that alone exceeds the bound. Rows are
    ordered by a hash of id and text (of different labels of an id the smaller counts), in 65,536 x 65,536 slices; the sample takes slices from the first on. The slice in
    which the bound falls is cut again by its second level, so rows that share an id, and large tables, are cut where
    the bound falls too. Slices are measured on ids, hashes and lengths alone, and labels meet texts only within them.
    An error is raised if there are labelled training texts but none fits.
    """
    hashed = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(seed))
    upper, lower = F.pmod(F.shiftrightunsigned(hashed, 16), F.lit(1 << 16)).cast("int"), F.pmod(hashed, F.lit(1 << 16)).cast("int")
    size = F.length("text") + 64
    marked = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter("_label in (0, 1) and doc_id is not null")
    marked = marked.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    train = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc32_of_id(F.col("doc_id")) % modulus != 0))
    sized = train.select("doc_id", size.alias("_n"), upper.alias("_s"), lower.alias("_t"))

    def prefix(rows: DataFrame, slices: str, room: int) -> tuple[int, int, int]:
        """The last slice within ``room``, what it leaves of it, and the slice after it (-1: there is none)."""
        last = -1
        for s, n in sorted((r["s"], r["n"]) for r in rows.groupBy(F.col(slices).alias("s")).agg(F.sum("_n").alias("n")).collect()):  # at most 65,536 rows
            if n > room:
                return last, room, s
            last, room = s, room - n
        return last, room, -1

    fits = sized.filter(F.col("_n") <= most_chars).join(marked.select("doc_id"), "doc_id")
    last, room, crossing = prefix(fits, "_s", most_chars)
    inner = prefix(fits.filter(F.col("_s") == crossing), "_t", room)[0] if crossing >= 0 else -1
    if last < 0 and inner < 0 and not sized.join(marked.select("doc_id"), "doc_id").isEmpty():
        raise ValueError(f"no labelled training text within a sample of {most_chars} characters")
    taken = (size <= most_chars) & ((upper <= last) | ((upper == crossing) & (lower <= inner)))
    chosen = train.filter(taken).select("doc_id", "text")
    return chosen.join(marked, "doc_id")


def train_on(sample: DataFrame, train: Callable[[list[str], list[int]], object]) -> object:
    """The model that ``train`` makes of a bounded sample, made in one task; only the model comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("_label").to_pylist()
        yield pa.record_batch({"model": pa.array([pickle.dumps(train(texts, labels))], pa.binary())})
        del texts, labels
        release_memory()

    row = sample.select("doc_id", "text", "_label").repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(run, "model binary").first()
    return train([], []) if row is None else pickle.loads(row["model"])


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set, by the rule of ``checkpointed``."""
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(1))
