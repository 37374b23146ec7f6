"""File sources: bytes with digests, archive parts, inflated streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import lexicons as lx


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a path with name, extension, size and SHA-256.

    Spark's file scan leaves zero-byte files out; rows for them can be added
    from a landing manifest and are then scanned as inconclusive.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return raw.select(
        "path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"), F.sha2("content", 256).alias("file_id"), "content")


def archive_parts(files: DataFrame, max_bytes: int = lx.MAX_INFLATED_BYTES) -> DataFrame:
    """Parts of ZIP containers: ``file_id, part_name, part_text, bomb``.

    Every part is listed; the text is read for relationship files. A container
    whose parts would inflate past the limit is flagged; its relationship files
    are still read, but for single ones past the limit.
    """
    zipped = files.filter(F.substring("content", 1, 2) == F.lit(b"PK")).select("file_id", "content")

    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            rows = []
            for file_id, data in zip(pdf["file_id"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        bomb = sum(i.file_size for i in z.infolist()) > max_bytes
                        for info in z.infolist():
                            name = info.filename.lower()
                            read = name.endswith(".rels") and info.file_size <= max_bytes
                            body = z.read(info).decode("utf-8", errors="ignore").lower() if read else None
                            rows.append((file_id, name, body, bomb))
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError):
                    rows.append((file_id, None, None, False))
            yield pd.DataFrame(rows, columns=["file_id", "part_name", "part_text", "bomb"])

    return zipped.mapInPandas(unpack, "file_id string, part_name string, part_text string, bomb boolean")


def inflated_streams(files: DataFrame, max_total: int = lx.MAX_INFLATED_BYTES, max_stream: int = lx.MAX_STREAM_BYTES) -> DataFrame:
    """Text of the compressed streams of PDF files: ``file_id, inflated, bomb``.

    A stream above ``max_stream`` compressed bytes, or one that would inflate
    past what is left of ``max_total``, is left out and the file is flagged; the
    text of all other streams is kept, so a bomb hides nothing and one hostile
    file cannot exhaust a task.
    """
    pdfs = files.filter(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("file_id", "content")

    def inflate(batches):
        import re
        import zlib

        import pandas as pd

        opener = re.compile(rb"stream(\r\n|\r|\n)")

        def one(data: bytes):
            texts, total, at, bomb, before = [], 0, 0, False, 0
            while found := opener.search(data, at):
                end = data.find(b"endstream", found.end())
                if end < 0:
                    break
                packed = data[found.end():end]
                at = end + len(b"endstream")
                context, before = data[before:found.start()], at
                if b"/FlateDecode" not in context or not packed:
                    continue
                if len(packed) > max_stream:
                    bomb = True
                    continue
                try:
                    out = zlib.decompressobj().decompress(packed, max_total - total + 1)
                except zlib.error:
                    continue
                if total + len(out) > max_total:
                    bomb = True
                    continue
                total += len(out)
                texts.append(out.decode("latin-1"))
            return "\n".join(texts), bomb

        for pdf in batches:
            done = [one(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "inflated": [d[0] for d in done], "bomb": [d[1] for d in done]})

    return pdfs.mapInPandas(inflate, "file_id string, inflated string, bomb boolean")
