"""Shared plumbing of the ``llm`` operators: scratch tables, range layout, Arrow helpers, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_SCRATCH: list[tuple[SparkSession, str, str]] = []
_OWNER = [""]

#: Bytes that a shuffle partition should hold when the session's own number would make larger ones.
TARGET_PARTITION_BYTES = 256 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a ``local`` master may go without: a temporary folder is then made once per application. A
    cluster without the setting is an error, since a machine-local folder would lose data there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN_DIR:
        _OWN_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="semclean-")
        atexit.register(shutil.rmtree, _OWN_DIR[sc.applicationId], ignore_errors=True)
    return _OWN_DIR[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/semclean-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path, _OWNER[-1]))
    return path


@contextmanager
def arrow_records(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at a time to Python; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch_owner(name: str) -> Iterator[None]:
    """Scratch tables made inside belong to ``name``."""
    _OWNER.append(name)
    try:
        yield
    finally:
        _OWNER.pop()


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch(owner: str) -> None:
    """Delete an owner's scratch tables; for callers whose earlier results are all written."""
    mine = [x for x in _SCRATCH if x[2] == owner]
    _SCRATCH[:] = [x for x in _SCRATCH if x[2] != owner]
    for spark, path, _ in mine:
        _delete(spark, path)


#: Bytes of a table that may be sent to every task.
SENT_BYTES = 8 << 20


def sent(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """``df`` with the hint to broadcast it if its counted rows, of ``row_bytes`` each, fit in ``SENT_BYTES``; else as it is, and joined by shuffle."""
    most = SENT_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving freed memory back at the end of a task: a worker idles between tasks, and later stages need the room."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def shuffle_partitions(df: DataFrame) -> int:
    """The session's ``spark.sql.shuffle.partitions``, raised when the input's estimated size asks for more."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, own, min(200_000, size // TARGET_PARTITION_BYTES) if size < 1 << 60 else own)


def bucket_of(key: str, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are <= ``key`` (null: 0), as a balanced CASE tree."""
    col = F.col(key)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(bounds) <= 1024:
        inner = tree(0, len(bounds))
    else:
        held = np.asarray(bounds)

        @F.pandas_udf("int")
        def find(keys):
            import pandas as pd

            return pd.Series(np.searchsorted(held, keys.fillna(held[0] - 1).to_numpy(), side="right").astype("int32"))

        inner = find(col)
    return F.when(col.isNull(), F.lit(0)).otherwise(inner).cast("int")


def range_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` ascending split values of ``key``, taken from its values above the least; one narrow column scan."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found, least = df.select(F.percentile_approx(key, shares, F.lit(max(10_000, 20 * parts))), F.min(key)).first()
    return sorted(set(found or []) - {least})


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts, null as empty."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string array as one UTF-8 byte array, with n + 1 offsets; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each holds about ``most`` bytes of text (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(name)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


# word hashes

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POW = _powers(_BASE, _CHUNK)
_INV = _powers(pow(_BASE, -1, 1 << 64), _CHUNK)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lowered; word ranges by text.

    ``data`` and ``offsets`` as from :func:`text_bytes`. Returns the hashes of all words in order and
    n + 1 positions where each text's words begin. A word never spans two texts. Words are hashed by a
    polynomial over random byte values from prefix sums, so no Python loop runs over words.
    """
    n = len(data)
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    begin[cut] = ~space[cut]
    starts = np.flatnonzero(begin)
    stop = np.empty(n, bool)
    stop[:-1] = space[1:]
    if n:
        stop[-1] = True
    ends_at = cut[cut > 0] - 1
    stop[ends_at] = True
    ends = np.flatnonzero(stop & ~space) + 1
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        origin = int(starts[lo])
        hi = int(np.searchsorted(ends, origin + _CHUNK, side="right"))
        if hi <= lo:  # one word longer than a chunk
            out[lo] = _long_word(data[origin : int(ends[lo])])
            lo += 1
            continue
        upto = int(ends[hi - 1])
        value = _BYTE[_LOWER[data[origin:upto]]]
        value *= _POW[: upto - origin]
        total = np.zeros(upto - origin + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        s = starts[lo:hi] - origin
        out[lo:hi] = (total[ends[lo:hi] - origin] - total[s]) * _INV[s]
        lo = hi
    out = mix64(out + (ends - starts).astype(np.uint64))
    return out, np.searchsorted(starts, offsets)


def _long_word(word: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(word), _CHUNK):
        part = _BYTE[_LOWER[word[at : at + _CHUNK]]] * _POW[: len(word[at : at + _CHUNK])]
        total += int(part.sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return np.uint64(total & (2**64 - 1))

