"""Token-id output: documents in ascending order as token files with Elias-Fano boundaries, and their reader.

One range exchange of the texts brings them into order; each task encodes its range and writes files of bounded
size, under a name of its own that becomes the final one when whole, so that a repeated or doubled attempt leaves
the same files. Only a row for each file (its number of documents and ids) reaches the driver, which gives each
file the number of ids before it.

Files go where ``pyarrow.fs`` writes; the default is the folder in ``spark.checkpoint.dir``.

Defined results: a null text counts as empty and has the end id alone; rows without a number come first, and are
read back without one; equal numbers keep all rows, ordered by text; an empty table writes no file and reads as an
empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano, tokens
from .common import bounded_batches, partitions, shared_path, staged

FILE_IDS = 16 << 20
#: Documents whose boundaries are read at once.
STRETCH = 4_096
MANIFEST = "part long, seq long, name string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def _write_files(batches: Iterator[pa.RecordBatch], path: str, vocabulary: str, style: str, end_id: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(path)
    part, end, encoder = TaskContext.get().partitionId(), np.array([end_id], "<u2").tobytes(), tokens.encoder(vocabulary, style)
    numbers: list[int | None] = []
    parts: list[bytes] = []
    rows: list[tuple] = []
    size = 0

    def flush() -> None:
        name = f"part-{part:08d}-{len(rows):05d}.ids"
        n_null = sum(x is None for x in numbers)
        raw = elias_fano.file_bytes(np.array(numbers[n_null:], np.int64), n_null, parts)
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(raw)
        store.move(own, f"{root}/{name}")
        rows.append((part, len(rows), name, len(parts), size))
        numbers.clear()
        parts.clear()

    for batch in batches:
        own = batch.column(0).to_pylist()
        for low, high, ids, bounds in encoder.encode(batch.column(1)):
            raw, cut = ids.tobytes(), (2 * bounds).tolist()
            for k in range(high - low):
                numbers.append(own[low + k])
                parts.append(raw[cut[k] : cut[k + 1]] + end)
                size += len(parts[-1]) // 2
                if size >= file_ids:
                    flush()
                    size = 0
    if parts:
        flush()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])


def write(docs: DataFrame, path: str, vocabulary: str, style: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write ``docs`` as token files under ``path`` (a URI); returns the manifest: a row for each file, in no order."""
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    two = bounded_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # The second key parts a number that many rows bear.
    ordered = two.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return staged(ordered.mapInArrow(functools.partial(_write_files, path=path, vocabulary=vocabulary, style=style, end_id=end_id, file_ids=file_ids), MANIFEST), "token-manifest")


def _read_files(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(path)
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_file(f"{root}/{name}") as source:
                f = elias_fano.TokenFile(source)
                for first in range(0, f.n_docs, STRETCH):
                    last = min(first + STRETCH, f.n_docs)
                    bounds, numbers = f.bounds.select_range(first, last + 1), f.doc_ids(first, last)
                    low = 0
                    while low < last - first:
                        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + (1 << 21), "right")) - 1)
                        wide = f.ids(int(bounds[low]), int(bounds[high])).astype("<u4")
                        own = bounds[low : high + 1] - bounds[low]
                        crc = [zlib.crc32(wide[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[low:high], pa.int64()), pa.array(bounds[low:high] + start), pa.array(np.diff(own)), pa.array(crc, pa.int64()), pa.array([name] * (high - low))], names=[x.split()[0] for x in READ.split(", ")])
                        low = high


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """A row for each document of the files: its number, the ids before it in all files, its length and its ids' CRC-32."""
    start, rows = 0, []
    for x in sorted(manifest.collect(), key=lambda x: (x.part, x.seq)):  # a row for each file
        rows.append((x.name, start))
        start += x.n_ids
    files = spark.createDataFrame(rows, "name string, start long").repartition(max(1, min(len(rows), 2 * partitions(spark))))
    return files.mapInArrow(functools.partial(_read_files, path=path), READ)


def written_and_read(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", style: str = tokens.END_OF_WORD, end_id: int = 2) -> DataFrame:
    """Token files of ``docs`` in a fresh shared folder, as read back."""
    path = shared_path(docs.sparkSession, "token-files")
    return read(docs.sparkSession, path, write(docs, path, vocabulary, style, end_id))
