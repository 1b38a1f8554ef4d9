"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_session_defaults, ensure_checkpoint_dir

#: Rows and bytes per Arrow batch sent to Python: texts may be long, so batches are short.
#: The row that exceeds the bytes ends its batch.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20

#: The setting that fixes how scans are split, whatever the number of cores.
MIN_SPLITS = "spark.sql.files.minPartitionNum"

#: The contracts' word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that every operator here relies on (shared checkpoint
    folder, package shipped to the workers, short Arrow batches).

    Splits of a scan depend on the number of cores unless their least number is
    set.  It is fixed here, so that a table that is scanned again after executors
    came or went has the same splits, and its rows the same numbers."""
    apply_session_defaults(spark)
    if not spark.conf.get(MIN_SPLITS, None):
        spark.conf.set(MIN_SPLITS, str(spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def release_memory() -> None:
    """Gives memory that Arrow and the C library hold free back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, a function for ``mapInArrow``, with ``release_memory`` at its end.  A Python worker
    outlives its tasks, and what its allocators hold counts to the executor in the steps that follow."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()
    return whole


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    n = F.size(parts)
    return (n - (F.element_at(parts, 1) == "").cast("int")
            - ((n > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(modulus))


# ------------------------------------------------------------ word hashing --
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INV)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes hashed at a time; the cut is moved to the next white space.
_CHUNK = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the white-space separated words, in order.  A word's
    hash is a polynomial over random codes of its bytes, taken from running
    sums, so no Python code runs per word."""
    out, at = [], 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        out.append(_word_hashes(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _word_hashes(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[a], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers_to(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_CODES[a] * power[: len(a)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(text: str | bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of ``text``
    after lower-casing A-Z; with fewer words the whole sequence is one."""
    if not text:
        return np.empty(0, np.uint64)
    w = word_hashes((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower())
    if not len(w):
        return w
    k, m = (n, len(w) - n + 1) if len(w) >= n else (len(w), 1)
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = mix64(h * _U(0x2545F4914F6CDD1D) + w[i: i + m])
    return np.unique(h)
