"""What the training-data operators share: the shared folder, staged tables, Arrow helpers."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, at most.
BATCH_ROWS = 500
#: Bits of the membership bitmap, 2 MB in a task's closure whatever the members' number.
MEMBER_BITS = 1 << 24


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where it is unset and all tasks run on this machine, as in tests, a local one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _own_folders:
            _own_folders[application] = f"file://{tempfile.mkdtemp(prefix='sparrowgrid-')}"
        folder = _own_folders[application]
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def released(spark: SparkSession) -> None:
    """Let the driver drop what it no longer needs. Spark removes shuffle files, map outputs and broadcasts when the driver's garbage is collected, which
    it does by itself only when its heap is full; until then the heap grows, and executors keep files of steps that are done."""
    gc.collect()  # frames of Python hold plans of the driver's JVM
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the operators' own exchanges follow."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Shuffle partitions for ``size`` bytes of which a task gathers ``each`` or less: the session's number, or more."""
    return max(partitions(spark), -(-int(size) // each))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(rows: DataFrame) -> DataFrame:
    """``rows``, in a session whose Arrow batches hold BATCH_ROWS rows at most: texts are long, and a batch is copied on both sides."""
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return rows


def on_batches(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that maps a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return run


def one_after_another(*functions: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``mapInArrow`` function that is one after the other. Two such steps in one stage would take two workers for each task, and an executor
    keeps its idle workers and takes them by turns, so that all of them grow to the size of the largest step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for function in functions:
            batches = function(batches)
        return iter(batches)

    return run


def in_portions(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` over batches put together to about ``size`` bytes."""

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= size:
                whole, held = pa.concat_batches(held), []
                yield whole
        if held:
            whole, held = pa.concat_batches(held), []
            yield whole

    return lambda batches: function(portions(batches))


def _bits_of(numbers: np.ndarray) -> np.ndarray:
    from .wordkernel import mix

    return (mix(numbers.view(np.uint64)) >> np.uint64(40)).astype(np.int64)


def _positions(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_bits_of(batch.column(0).to_numpy(zero_copy_only=False)))], names=["bit"])


def _member_bits(members: DataFrame) -> np.ndarray:
    """A bitmap of hashes of ``members``' first column, packed; it is gathered natively in pieces of 32,768 bits."""
    at = members.mapInArrow(on_batches(_positions), "bit long")
    pieces = at.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(MEMBER_BITS + 65_536, bool)
    for row in pieces.collect():  # MEMBER_BITS / 32,768 rows at most
        own = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        # Piece 0 holds bit 0 alone, piece k the 32,768 bits from 32,768 (k - 1) + 1 on.
        start = (row.piece - 1) * 32_768 + 1 if row.piece else 0
        bits[start : start + len(own)] |= own.astype(bool)
    return np.packbits(bits, bitorder="little")


def _sifted(batch: pa.RecordBatch, packed: np.ndarray, members: bool) -> pa.RecordBatch:
    numbers = batch.column(0)
    at = _bits_of(numbers.fill_null(0).to_numpy(zero_copy_only=False))
    found = (packed[at >> 3] >> (at & 7) & 1).astype(bool) & ~numbers.is_null().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(found == members))


def members_apart(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: none of the first has its first column (a long) among ``members`` (one column of longs), all that have are in the second.

    With far more members than MEMBER_BITS the second holds all rows, and the join that follows is what it would be without it.
    """
    packed = _member_bits(members)
    return tuple(rows.mapInArrow(on_batches(functools.partial(_sifted, packed=packed, members=m)), rows.schema) for m in (False, True))


def only_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The second part of :func:`members_apart`."""
    return members_apart(rows, members)[1]


#: A class is large with more than LARGE_ROWS copies and more than 1 / LARGE_CLASSES of all rows.
LARGE_ROWS, LARGE_CLASSES = 1_000, 10_000


def by_class(rows: DataFrame, classes: DataFrame, key: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``classes`` (with a column ``times``, their rows) by ``key``, "inner" or "left". Classes with a share of the rows of
    more than 1 / LARGE_CLASSES, which are fewer than that, are broadcast, so that a group of very many copies stays where its rows are read."""
    least = max(LARGE_ROWS, rows.count() // LARGE_CLASSES)
    large = F.broadcast(classes.filter(F.col("times") > least).drop("times"))
    usual = rows.join(large.select(*key), key, "left_anti").join(classes.filter(F.col("times") <= least).drop("times"), key, how)
    return usual.unionByName(rows.join(large, key))
