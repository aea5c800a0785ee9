"""What the operators share: reading, sizes, shared-folder tables, Arrow batches and word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one Arrow batch and rows of it: bounds what a Python worker holds besides one longest row.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 256
#: Text that one block of a blocked operator stands for.
BLOCK_TEXT = 4 << 20
MIN_BLOCKS, MAX_BLOCKS = 64, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that other columns of the input, whatever their names, play no part."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def block_count(docs: DataFrame) -> int:
    """Blocks in proportion to the text of all rows."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return int(min(MAX_BLOCKS, max(MIN_BLOCKS, size // BLOCK_TEXT)))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset and the session is local (tests), under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or f"file://{tempfile.gettempdir()}/lodestar-checkpoints"
    return f"{root.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    atexit.register(drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, column: str, parts: int) -> DataFrame:
    """As cut, of rows that were repartitioned into parts by column: the table knows that, so joins on it leave them where they are."""
    spark = df.sparkSession
    path = shared_dir(spark)
    name = f"cut_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(parts, column).sortBy(column).option("path", path).saveAsTable(name)
    atexit.register(drop, spark, path)
    return spark.table(name)


def join_spread(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join on key, where right has one row a key with the number of left's rows that have it.

    Keys that more than a 1,024th of left's rows have are at most 1,024: those rows of right are broadcast, so that no task gathers
    the rows of a hot key; the others are joined by key.
    """
    hot = cut(right.where(F.col(rows) > left.count() // 1024))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder at the end of the application, if the session still lives."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder goes with the job
        return


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps that nothing refers to any more.

    The first collection frees what Python held, the second what that held in the JVM; the cleaner works beside them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


# Arrow's buffers from the same allocator as all else, so that trim() reaches them.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and an executor's count together."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20250101)
#: A random value for every byte value, and an odd multiplier for each place in a word.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1024, _PLACE, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _PLACE, np.uint64))
    return _POWERS


def word_hashes(data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without space and \\t to \\r, A-Z lower-cased) of a UTF-8 buffer, and their start offsets."""
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    body = raw[inside]
    sizes = ends - starts
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(body)) - np.repeat(begin, sizes)
    values = BYTE_VALUES[_LOWER[body]] * _powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(values, begin)), starts


#: Texts are taken together up to so many bytes for the vector operations.
GROUP_BYTES = 1 << 19


def grouped(ids: list, values: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Consecutive rows in groups of about limit bytes; a longer text is a group of its own."""
    a, b, size = [], [], 0
    for i, v in zip(ids, values, strict=True):
        if a and size + len(v) > limit:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(v)
        size += len(v) + 1
    if a:
        yield a, b


def doc_words(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the offsets at which each text's words begin (one more at the end)."""
    lengths = np.fromiter((len(v) + 1 for v in values), np.int64, len(values))
    hashes, starts = word_hashes(b" ".join(values))
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null: empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def doc_hash(column: str = "doc_id"):
    """CRC-32 of the id as decimal text (null: of the empty text): the key of the folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))
