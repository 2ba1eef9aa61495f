"""What several operators share: written intermediate tables, and words as arrays of numbers.

Words are runs of bytes other than ASCII white space. The functions here look at the
UTF-8 bytes of a whole Arrow column at once, so that no Python loop sees a word.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on together inside a task.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scopes: list[list[tuple[str, str]]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the session's JVM ends, if no scope does before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, store = _hadoop(spark, path)
    store.deleteOnExit(place)
    if _scopes:
        _scopes[-1].append((name, path))
    return path


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Deletes at its end what was written inside, but for tables of the names in ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for name, path in _scopes.pop():
            if name in keep:
                if _scopes:
                    _scopes[-1].append((name, path))
                continue
            place, store = _hadoop(spark, path)
            store.delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Inside, so many bytes of rows at most go to a Python worker at a time: JVM and worker each hold a whole batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def splits(df: DataFrame) -> int:
    """Number of tasks that read df: grows with the table."""
    return max(1, df.rdd.getNumPartitions())


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number with its bits spread over all 64 (a fixed bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, list[np.ndarray]] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the power 0, 1, ... n - 1, modulo 2 to the power 64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        seq = np.full(max(n, 1 << 16), base, np.uint64)
        seq[0] = 1
        have = _powers[base] = np.cumprod(seq)
    return have[:n]


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` values, as if each stood alone, bits spread."""
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return mixed((total[size:] - total[:-size]) * powers(inverse, n - size + 1))


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8, at[-1]) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes, one row at least."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """The words of some rows: where each starts and ends in ``data``, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray | None = None):
        """``inside``: for each byte value, whether it is part of a word; all but ASCII white space if None."""
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = ~_SPACE[data] if inside is None else inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge))
        self.ends = np.flatnonzero(before & (~word | edge))
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(int(_BASE), n), out=total[1:])
        raw = (total[self.ends] - total[self.starts]) * powers(int(_UNBASE), n + 1)[self.starts]
        return mixed(raw + (self.ends - self.starts).astype(np.uint64))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys starts, in arrays sorted by them; the end is not added."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids with 0 for null, which are null) of an integer column."""
    gone = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), gone


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name) if not os.path.isabs(name) else name
