"""Helpers that the training-data operators share: shared storage, text buffers, 64-bit hashing."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators.records import placed
from ..work import _LOCAL_DEFAULT, clean, drop_written, new_path, remove, small, work_dir, written

__all__ = ["_LOCAL_DEFAULT", "clean", "drop_written", "free_shuffles", "frame_bytes", "fresh", "held", "lean", "mix64", "new_path", "odd_inverse", "placed", "powers", "remove", "ship", "slices", "small", "utf8", "work_dir", "written"]

def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to drop shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: What a worker keeps from task to task, by the kind of stage that uses it.
HELD: dict[str, dict] = {}


def held(kind: str) -> dict:
    """A worker's own store for one kind of stage; it goes when a task of another kind begins there."""
    return HELD.setdefault(kind, {})


def lean(stage, keep: str | None = None):
    """`stage` for mapInArrow. Workers live on from stage to stage: what others than `keep` held is dropped
    before a task, and unused memory goes back to the system after it."""
    home = __name__

    def run(batches):
        import ctypes
        import importlib

        store = importlib.import_module(home).HELD  # the worker's own, not a copy that came with this function
        for kind in [k for k in store if k != keep]:
            del store[kind]
        try:
            yield from stage(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column without decoding; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Cut a batch into runs of whole rows of at most `most_bytes` of text each (one row may be longer)."""
    _, offs = utf8(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + most_bytes, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def odd_inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base & (2**64 - 1)), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it until no column of `df` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def frame_bytes(df: DataFrame, column: str) -> int:
    """Exact UTF-8 size of a column; nulls count nothing."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


#: Rows that hold whole texts go to Python in batches of so many bytes, where the session says nothing else.
_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Give executors this package; and bound Arrow batches by bytes (a session setting), so that long texts don't add up to large batches."""
    if spark.conf.get(_BATCH_BYTES[0], None) is None:
        spark.conf.set(*_BATCH_BYTES)
    session.ship(spark)
