"""Helpers shared by the operators: lineage cuts, Arrow iteration and shipping of kernels."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

def ship_by_value(module_name: str) -> None:
    """Let executors run this module's functions without having the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Only a session on one machine may name none; then a folder of its own is set. Elsewhere that is an error, since rows written
    to a machine's own disk are lost to the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"/tmp/checkpoints-{os.getpid()}"
        os.makedirs(named, exist_ok=True)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one computation in the shared folder, deleted at the end of the ``with`` block, also when it fails."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.written = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.drop()

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """``df`` as read back from a written table, and the table's place."""
        place = f"{self.folder}/{self.written}"
        self.written += 1
        df.write.parquet(place)
        # What the driver holds of it and its shuffle files go now, not when the driver happens to be short of heap.
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(place), place

    def drop(self, place: str | None = None) -> None:
        """Deletes one table, or all."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(place or self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows handed to a kernel at once; Spark bounds the bytes of what it sends by spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_ROWS = 1000


def release_memory() -> None:
    """Give what the allocators hold in reserve back to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has this call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in pieces of ``BATCH_ROWS``, whatever the session's settings are; a task's memory is given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))
        release_memory()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(column: pa.Array | pa.ChunkedArray, max_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts as ``(first row, bytes, offsets)`` with about ``max_bytes`` in each.

    A text longer than that comes alone and whole; a null comes as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


ship_by_value(__name__)
