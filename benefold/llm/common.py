"""Shared pieces: reading tables, cutting lineage in the shared folder, byte-level numpy helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a fresh one for a session on one machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow. When its task ends, the Python worker, which lives on, gives back the memory that it no longer uses."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- bytes of an Arrow column ------------------------------------------------------------------------------

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(a: np.ndarray, b) -> np.ndarray:
    """64-bit name of a pair of 64-bit names (wraps around)."""
    z = a * _C1
    z += np.atleast_1d(b) * _C2
    z ^= z >> _S29
    z *= _C3
    z ^= z >> _S32
    return z


def byte_column(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty."""
    import pyarrow as pa

    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset:]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int):
    """Ranges of rows of about ``size`` bytes (one row at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


#: Powers that a worker keeps; those of longer data are made anew.
_POW_N = 1 << 20
_BASE = 0x5851F42D4C957F2D
_TABLE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


@functools.cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, _POW_N), _powers(pow(_BASE, -1, 2**64), _POW_N)


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of byte spans, from running sums of a polynomial modulo 2**64, then mixed with the length."""
    n = len(data)
    up, down = _kept_powers() if n < _POW_N else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts], (ends - starts).astype(np.uint64))


# --- joining on counted keys --------------------------------------------------------------------------------


def count_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, _n): how often each key occurs, counted map-side first."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"))


def join_keys(df: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a table that was grouped by the same keys.

    A further key, derived from the others, keeps Spark from reusing the grouping's partitions for the join: both sides
    are exchanged for the join itself, and adaptive execution can then split a key that holds very many rows.
    """
    mark = F.pmod(F.hash(*keys), F.lit(1009)).alias("_mark")
    return df.select("*", mark).join(keyed.select("*", mark), [*keys, "_mark"], how).drop("_mark")
