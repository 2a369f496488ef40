"""Shared pieces: shared scratch tables, whole-text word splitting in Arrow, 64-bit word and shingle hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds as arrays.
STEP_BYTES = 3 << 20
BATCH_ROWS = 2000
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def bound_batches(spark: SparkSession) -> None:
    """Texts may be long: where the session has Spark's default of rows in an Arrow batch, BATCH_ROWS are set, which
    bounds what executors hold outside of their heaps."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, n: int):
    """Fold of a row: crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


class Scratch:
    """Tables written to the folder that driver and executors share, so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.gettempdir() + "/tessera-scratch"
        self.spark, self.base = spark, f"{base}/tessera-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle() -> None:
    """Give freed memory back, so that a worker holds no more than its largest step while it waits."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text; a single longer text is a slice of its own."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end
    settle()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text after lower-casing A-Z, and where each text's words begin (one more at the end). Null: no words."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    parts = pa.concat_arrays([parts]) if parts.offset else parts
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():  # only a text without any word gives an empty one
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    return flat, offsets


def hash64(flat: pa.Array) -> np.ndarray:
    """64-bit hash of every word."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    d = flat.dictionary_encode()
    unique = np.array([xxhash.xxh3_64_intdigest(w) for w in d.dictionary.to_pylist()], dtype=np.uint64)
    return unique[np.asarray(d.indices)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; fewer words: the whole sequence as one; no words: empty."""
    flat, at = words(texts)
    h = mix(hash64(flat))
    s = h.copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            s[: len(s) - i] = mix(s[: len(s) - i] * np.uint64(0x9E3779B97F4A7C15) + h[i:])
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for y in h[a:b]:
                    x = mix(np.array([x * np.uint64(0x9E3779B97F4A7C15) + y]))[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))
