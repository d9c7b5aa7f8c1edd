"""Shared pieces of the training-data operators: work folder, code shipping, vectorised words and hashes.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; they are found on the UTF-8 bytes of a whole
Arrow batch at once, so no Python loop runs per word.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 4 << 20

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def work_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of our own only where it is unset, and all runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "vellum-work")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{work_root(spark)}/vellum-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Spark's own estimate; of a table just staged, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_split(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", least: int = 10_000) -> DataFrame:
    """left join right, where one key may hold most of left's rows. right has a row a key.

    weight: the column of right that says how many rows of left its key has (it is dropped); total: rows of left. Keys with more than
    least rows and more than a partition's share (there are no more of them than partitions) are broadcast, so their rows stay
    where they are; all others are joined by a shuffle.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(least, total // parts)
    heavy = F.broadcast(right.where(F.col(weight) > limit).drop(weight))
    if total <= limit:
        return left.join(right.drop(weight), keys, how)
    marks = F.broadcast(right.where(F.col(weight) > limit).select(*keys))
    light = left.join(marks, keys, "left_anti").join(right.where(F.col(weight) <= limit).drop(weight), keys, how)
    return left.join(heavy, keys).unionByName(light)


def clean_work(spark: SparkSession) -> None:
    """Removes the tables that stage has left in the shared folder; DataFrames that read them end with this."""
    jvm, root = spark.sparkContext._jvm, work_root(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/vellum-*")) or []:
        fs.delete(found.getPath(), True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers of any cluster: adds it once as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="vellum-ship-"), "vellum.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(path)
    sc._vellum_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that the bytes of a string column stay near a bound; a longer single row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if big else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (rows + 1 values)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def _zobrist(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 64 * 256, dtype=np.uint64)


_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word: tabulation by position and byte, finished with the length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    table = _TABLES.setdefault(seed, _zobrist(seed)) if seed not in _TABLES else _TABLES[seed]
    lengths = ends - starts
    total = int(lengths.sum())
    base = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(base, lengths)
    src = within + np.repeat(starts, lengths)
    value = table[((within & 63) << 8) | data[src]]
    if int(lengths.max()) > 64:
        value *= (within >> 6).astype(np.uint64) * np.uint64(2 * 0x9E3779B97F4A7C15 & (2**64 - 1)) + np.uint64(1)
    return mix(np.add.reduceat(value, base) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes (len(words) - n + 1 values), by doubling."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1) | 1
    total, length = None, 0
    power, span = words, 1
    rest = n
    while rest:
        if rest & 1:
            if total is None:
                total, length = power, span
            else:
                keep = len(words) - (length + span) + 1
                total = total[:keep] * np.uint64(pow(base, span, 1 << 64)) + power[length : length + keep]
                length += span
        rest >>= 1
        if rest:
            keep = len(words) - 2 * span + 1
            power = mix(power[:keep] * np.uint64(pow(base, span, 1 << 64)) + power[span : span + keep])
            span *= 2
    return mix(total.copy())


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def fixed_binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are runs of an array; offsets are in elements."""
    size = values.dtype.itemsize
    at = (offsets * size).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
