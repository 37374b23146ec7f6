"""Token files made of independent zstandard frames with a trailing seek table.

A file holds frames of about one megabyte of ids. After them come two skippable frames, which plain zstandard readers
pass over: an index (first document, number of documents and of ids of each frame) and the seek table of the public
"seekable format" (sizes and the low 32 bits of xxh64 of each frame, then the frame count, a descriptor and its magic
number). A reader fetches the two tables from the end of the file, and decompresses only the frames it needs.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm import common as c
from riskframe.llm.tokens import encoder

# Fixed values of the zstandard seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
INDEX_MAGIC = 0x184D2A50  # a skippable frame of one's own

FRAME_IDS = 1 << 18
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
_INDEX = np.dtype([("first", "<i8"), ("docs", "<u4"), ("ids", "<u8")])


class ChecksumError(ValueError):
    """A frame's content does not match its checksum."""


def pack_frame(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([i is None for i in doc_ids], dtype=np.uint8)
    own = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    return b"".join([struct.pack("<I", len(doc_ids)), null.tobytes(), own.tobytes(), lengths.astype("<u4").tobytes(), ids.astype("<u4").tobytes()])


def unpack_frame(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", raw)[0]
    null = np.frombuffer(raw, np.uint8, n, 4)
    own = np.frombuffer(raw, "<i8", n, 4 + n)
    lengths = np.frombuffer(raw, "<u4", n, 4 + 9 * n)
    ids = np.frombuffer(raw, "<u4", offset=4 + 13 * n)
    return [None if z else int(i) for z, i in zip(null, own, strict=True)], lengths, ids


class Writer:
    """Writes one file; it appears under its name only when it is whole."""

    def __init__(self, path: str, level: int = 3):
        self.fs, self.path = filesystem(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        raw = pack_frame(doc_ids, lengths, ids)
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((next((i for i in doc_ids if i is not None), -(1 << 63)), len(doc_ids), len(ids)))

    def close(self) -> None:
        index = np.array(self.index, dtype=_INDEX).tobytes()
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Frames of one file, by number or by document."""

    def __init__(self, path: str):
        fs, own = filesystem(path)
        self.file = fs.open_input_file(own)
        size = self.file.size()
        count, flag, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table")
        table = size - _FOOTER.size - count * _ENTRY.size
        self.entries = list(_ENTRY.iter_unpack(self._at(table, count * _ENTRY.size)))
        index = table - 8 - count * _INDEX.itemsize
        self.index = np.frombuffer(self._at(index, count * _INDEX.itemsize), _INDEX)
        self.begins = np.cumsum([0] + [e[0] for e in self.entries])

    def _at(self, place: int, size: int) -> bytes:
        return self.file.read_at(size, place)

    def __len__(self) -> int:
        return len(self.entries)

    def frame(self, k: int) -> tuple[list, np.ndarray, np.ndarray]:
        size, raw_size, checksum = self.entries[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begins[k]), size), max_output_size=raw_size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ChecksumError(f"frame {k}")
        return unpack_frame(raw)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every copy of a document; only the frames that can hold it are decompressed."""
        firsts = self.index["first"]
        k = max(int(np.searchsorted(firsts, doc_id, side="left")) - 1, 0)
        found = []
        while k < len(self) and firsts[k] <= doc_id:
            ids, lengths, tokens = self.frame(k)
            ends = np.cumsum(lengths.astype(np.int64))
            found += [tokens[e - n:e] for i, e, n in zip(ids, ends, lengths, strict=True) if i == doc_id]
            k += 1
        return found


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor sees; made through Spark's own file system."""
    context = spark.sparkContext
    c.checkpoint_folder(spark)
    root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(place)
    return folder.replace("file:///", "file:/").replace("file:/", "file:///") if folder.startswith("file:") else folder


def _write(folder: str, vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary).encode
        path = f"{folder}/part-{part:06d}.tok"
        out, docs, tokens = None, 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            out.add([i for h in held for i in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            held.clear()

        for batch in c.pieces(batches, most=4 << 20):
            out = out or Writer(path)
            ids, lengths = encode(batch.column("text"), end)
            doc_ids, ends, begin = batch.column("doc_id").to_pylist(), np.cumsum(lengths), 0
            while begin < len(doc_ids):  # frames of about FRAME_IDS ids, one document at least
                base = int(ends[begin - 1]) if begin else 0
                room = FRAME_IDS - sum(len(h[2]) for h in held)
                stop = max(begin + 1, int(np.searchsorted(ends, base + room, side="right")))
                held.append((doc_ids[begin:stop], lengths[begin:stop], ids[base:int(ends[stop - 1])]))
                begin = stop
                if sum(len(h[2]) for h in held) >= FRAME_IDS:
                    flush()
            docs, tokens = docs + len(doc_ids), tokens + len(ids)
        if out:
            if held:
                flush()
            out.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": [path], "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})
    return run


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = 2) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order, one file a range of ids.

    docs: doc_id long, text string. Returns one row a file: part, path, docs, tokens, start (ids in the files before).
    A null text is an empty one (its end id alone); null ids come first; repeated rows are written each, rows of one id in the order of
    their texts. An empty
    table gives no file. A task that is repeated writes its file anew and renames it into place.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    ordered = docs.select("doc_id", "text").repartitionByRange(c.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = c.checkpointed(ordered.mapInArrow(_write(folder, vocabulary, end), "part int, path string, docs long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file: at most the number of partitions
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, start = Reader(row["path"]), row["start"]
                for k in range(len(reader)):
                    ids, lengths, tokens = reader.frame(k)
                    ends = np.cumsum(lengths.astype(np.int64))
                    begins = ends - lengths
                    raw = tokens.tobytes()
                    yield pa.record_batch({
                        "doc_id": pa.array(ids, pa.int64()), "start": pa.array(start + begins), "n_tokens": pa.array(lengths.astype(np.int64)),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * b:4 * e]) for b, e in zip(begins, ends, strict=True)], pa.int64())})
                    start += len(tokens)

    spread = files.select("part", "path", "start").repartition(c.shuffle_partitions(files.sparkSession), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
