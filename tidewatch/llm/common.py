"""Helpers shared by the operators: tables, staging, word hashes over whole texts."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import shared_folder, stage

#: ASCII white space; a word is a run of other characters.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts are worked on in runs of about this many bytes (one longer text stays whole).
CHUNK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that Spark hands to a Python task at once, where the session has no choice of its own.
ARROW_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: fewer of them at once keep the Python workers small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def staged(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the files survive lost executors.

    After a ``large`` step the driver also collects its garbage, upon which Spark
    deletes the step's shuffle files: a long job needs the disk of one step at a time.
    """
    out = stage(df, name)
    del df
    if large:
        gc.collect()
        out.sparkSession._jvm.System.gc()
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged frames that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).toUri().getPath()
        for file in df.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            if path.toUri().getPath().startswith(root):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: A random number for each byte; white space has 0.
BYTE_CODE = odd(256, 11)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[65:91] = BYTE_CODE[97:123]
#: Base of the rolling sums and its inverse, modulo 2**64.
BASE = int(odd(1, 77)[0]) | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size:size + step] = out[:step] * np.uint64(pow(base, size, 1 << 64))
        size += step
    return out


_powers: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        _powers[base] = powers(base, max(n, CHUNK + (CHUNK >> 2)))
    return _powers[base][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``CHUNK`` bytes: (first row, end row, bytes, offsets from 0)."""
    data, offsets = text_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word of a run of texts; A-Z count as a-z if ``lower``.

    A word's hash is the sum of its bytes' codes times powers of a base, scrambled.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((BYTE_CODE_LOWER if lower else BYTE_CODE)[data] * cached_powers(BASE, n), out=sums[1:])
    code = (sums[end] - sums[start]) * cached_powers(BASE_INVERSE, n)[start]
    row = np.searchsorted(offsets, start, side="right") - 1
    return mix(code + (end - start).astype(np.uint64)), row, start, end


def parts(spark: SparkSession) -> int:
    """As many partitions as the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
