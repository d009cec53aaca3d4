"""Content manifests of source files and their comparison with pinned snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20  # bytes of a file that travel together
MARK = b"\xef\xbb\xbf"  # which a text reader leaves out at the start of a file
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"  # names that a text reader unpacks


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that follow each other in one split of a file, as pieces of bytes."""
    seq = 0
    for batch in batches:
        ids, starts, sizes = (batch.column(c).to_numpy() for c in ("id", "start", "size"))
        raw = batch.column("raw").cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = memoryview(raw.buffers()[2] or b"")
        runs = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1]), True]) if len(ids) else []
        for a, b in zip(runs[:-1], runs[1:]):
            for at in range(ends[a], ends[b], PIECE):
                piece = pa.array([bytes(data[at:min(at + PIECE, ends[b])])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([int(v)], pa.int64()) for v in (ids[a], starts[a], sizes[a], seq)), piece], ["id", "start", "size", "seq", "piece"])
                seq += 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of every file from its pieces in their order; a file is held as a state, never as a whole."""
    states: dict = {}
    for batch in batches:
        for i, size, piece in zip(batch.column("id").to_pylist(), batch.column("size").to_pylist(), batch.column("piece")):
            s = states.setdefault(i, [hashlib.sha256(), hashlib.sha256(MARK), 0, b"", size])
            view = memoryview(piece.as_buffer())
            for h in s[:2]:
                h.update(s[3])
                h.update(view[:-1])
            s[2] += len(view)
            s[3] = bytes(view[-1:])  # the last line of a file may lack its end
    out = []
    for i, (plain, marked, total, last, size) in states.items():
        h, total = (plain, total) if total >= size else (marked, total + len(MARK))
        if total not in (size, size + 1):
            raise RuntimeError(f"{total} bytes were read of a file of {size}")
        if total == size:
            h.update(last)
        out.append((i, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["id", "sha256"])


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(id, sha256) of each file, id a hash of its path.

    Splits of a file are read side by side as lines of raw bytes and travel in pieces to the task that adds them up in their
    order, so that memory does not grow with a file. Only files whose name promises packed content are read whole (below 2 GB).
    """
    def read(kind: str, **options) -> DataFrame:
        f = spark.read.format(kind).options(pathGlobFilter=pattern, recursiveFileLookup="true", **options).load(path)
        packed = F.col("_metadata.file_name").rlike(PACKED)
        return f.where(packed if kind == "binaryFile" else ~packed).withColumn("id", F.xxhash64("_metadata.file_path"))

    raw = F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("raw")
    lines = read("text", lineSep="\n").select("id", F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), raw)
    pieces = lines.mapInArrow(_pieces, "id long, start long, size long, seq long, piece binary")
    whole = pieces.repartition("id").sortWithinPartitions("start", "seq").mapInArrow(_digests, "id long, sha256 string")
    return whole.unionByName(read("binaryFile").select("id", F.sha2("content", 256).alias("sha256")))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, bytes, time and SHA-256 of each entry of a folder; empty files are none, as Spark's readers leave them out.

    A table kept as a folder of part files is one entry, the digest of which is that of the sorted names and digests of its files.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_extract("path", rf"\Q{urlparse(path).path.rstrip('/')}/\E(.*)", 1)
    f = f.select(F.xxhash64("_metadata.file_path").alias("id"), inside.alias("inside"), "length", "modificationTime")
    found = F.coalesce("sha256", F.raise_error(F.concat(F.lit("no digest of "), "inside")))
    f = f.join(file_digests(spark, path, pattern), "id", "left").select("inside", "length", "modificationTime", found.alias("sha256"))
    parts = F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(" ", "inside", "sha256"))))
    plain = F.max("inside") == F.substring_index(F.max("inside"), "/", 1)
    return f.groupBy(F.substring_index("inside", "/", 1).alias("file")).agg(
        F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"),
        F.when(plain, F.max("sha256")).otherwise(F.sha2(parts, 256)).alias("sha256"))


def compare_manifests(actual: DataFrame, pinned: DataFrame) -> DataFrame:
    """State of every file against a pinned or earlier manifest."""
    a = actual.select("file", F.col("sha256").alias("a"), F.col("bytes").alias("an"))
    p = pinned.select("file", F.col("sha256").alias("p"), F.col("bytes").alias("pn"))
    same = (F.col("a") == F.col("p")) & (F.col("an") == F.col("pn"))
    state = F.when(F.col("p").isNull(), "not pinned").when(F.col("a").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    return a.join(p, "file", "full").select("file", state.alias("state"))


def with_replaced(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Append manifest rows; a file that is listed again replaces its earlier row."""
    return manifest.join(rows.select("file"), "file", "left_anti").unionByName(rows)
