"""Helpers that several corpus operators use: staged tables, bounded broadcasts and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of packing, mixing and near-duplicates define it.
WORD = r"[^\x20\x09-\x0D]+"


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder, removed at exit, and a cluster the warehouse, which is
    shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="veriplumb-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root or spark.conf.get('spark.sql.warehouse.dir')}/veriplumb/{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    path = f"{work_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_staged(spark: SparkSession) -> None:
    """Deletes all tables that this application has staged. Results that still read them must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A staged ``df``, marked for broadcast if it has at most ``rows`` rows; a larger one is left to a shuffled join."""
    table = staged(df)
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``limit`` bytes of ``column`` each, at least one row; no row is split or left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size.astype(np.int64)) // limit
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers are used again; they should not keep what a task needed


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
RATIO = np.uint64(0xD1342543DE82EF95)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and where each row starts (one more entry than rows); null is empty."""
    filled = pc.fill_null(column, "")
    filled = pa.array(filled.combine_chunks() if isinstance(filled, pa.ChunkedArray) else filled)
    width = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, width)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the number of words of each row."""
    rows = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][np.diff(at) > 0]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    span = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, span)
    power = np.cumprod(np.full(int(place.max()) + 1, RATIO))
    value = BYTE_VALUE[LOWER[raw[starts[0] :]]] * power[place]
    value[~inside[starts[0] :]] = 0
    return scramble(np.add.reduceat(value, starts - starts[0])), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse of a small matrix. Threads of BLAS can stall in a process that also hosts a JVM's threads."""
    n = len(matrix)
    a = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(a[i:, i]).argmax())
        if not a[p, i]:
            raise ValueError("matrix is singular")
        a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        column = a[:, i].copy()
        column[i] = 0
        a -= column[:, None] * a[i]
    return a[:, n:]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of ``schema`` from plain sequences or arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lowers the session's limit of rows in an Arrow batch, so that workers hold few whole texts at a time; never raises
    it. Bytes of a batch have a limit of their own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
