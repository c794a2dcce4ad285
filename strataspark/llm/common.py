"""What the operators share: shared-folder tables, packed blobs, fixed-size counts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Arrow batch and one vectorised slice hold at most (a single longer text stands alone).
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 19
_LOCAL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, so Python memory doesn't follow row counts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset (tests, local masters)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="strataspark-"))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` (in folders ``by`` a column) to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_path"] = path
    return out


def drop(*frames: DataFrame | None, part: str = "") -> None:
    """Delete what ``written`` wrote for these frames (a ``part``: one folder of it); nothing lazy may depend on them any more."""
    for df in frames:
        path = df.__dict__.get("written_path") if df is not None else None
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see shuffles of finished jobs that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give freed memory of this Python worker back: workers live on and are reused."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- blobs


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of one length -> compressed byte planes. Planes of high bytes, mostly alike, cost little."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(n, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(planes))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(d).itemsize for d in dtypes]
    n, at, out = len(raw) // sum(sizes), 0, []
    for d, k in zip(dtypes, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).view(d).reshape(n))
        at += n * k
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, joined."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def buckets_of(batches: Iterator[pa.RecordBatch], column: str = "b") -> Iterator[tuple[int, list[dict]]]:
    """Rows that are sorted by ``column``, a bucket at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[column] != now:
                if held:
                    yield now, held
                now, held = row[column], []
            held.append(row)
    if held:
        yield now, held
    held = None
    trim()


def dealt(df: DataFrame, n: int, column: str = "b") -> DataFrame:
    """Blobs to ``n`` partitions by bucket, sorted, so that one bucket is in memory at a time."""
    return df.repartition(n, column).sortWithinPartitions(column)


# ---------------------------------------------------------------- counts of fixed size

BLOCK = 1 << 15


def count_blocks(docs: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum of one fixed-length vector of counts per task.

    The vector's length is a parameter, so what reaches the driver is bounded
    whatever the input; tasks send compressed blocks, summed by block.
    """

    def each(batches):
        total = count(batches)
        rows = [(k, pack(total[k * BLOCK : (k + 1) * BLOCK])) for k in range(math.ceil(len(total) / BLOCK))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["b", "blob"])

    def add(batches):
        for b, rows in buckets_of(batches):
            total = None
            for r in rows:
                x = unpack(r["blob"], np.int64)[0]
                total = x if total is None else total + x
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack(total)], pa.binary())], ["b", "blob"])

    blocks = docs.mapInArrow(each, "b int, blob binary")
    summed = dealt(blocks, min(partitions(docs.sparkSession), 64)).mapInArrow(add, "b int, blob binary")
    rows = sorted(summed.collect())
    return np.concatenate([unpack(r["blob"], np.int64)[0] for r in rows]) if rows else np.zeros(0, np.int64)


def text_column(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long, text as string, by the exact names; further columns are left out unless named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


# ---------------------------------------------------------------- a bounded filter on ids

#: Sizes of the field, by the number of ids: 8 to 16 bits each up to the largest (16 MB), fewer beyond.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 27


def id_filter(ids: DataFrame, column: str = "id", n: int = 0) -> np.ndarray:
    """A bit field with two bits set for each of about ``n`` ids. It only thins out rows before an exact join, so beyond its largest size it thins less, and results are the same."""
    size = FILTER_BITS
    while size < min(8 * n, MOST_FILTER_BITS):
        size *= 2

    def bits(batches):
        field = np.zeros(size, bool)
        for batch in batches:
            for h in filter_slots(batch.column(0).to_numpy(zero_copy_only=False), size):
                field[h] = True
        packed = np.packbits(field)
        for k in range(8):
            part = packed[k * len(packed) // 8 : (k + 1) * len(packed) // 8]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(part)], pa.binary())], ["b", "blob"])

    def union(batches):
        for b, rows in buckets_of(batches):
            total = None
            for r in rows:
                x = unpack(r["blob"], np.uint8)[0]
                total = x if total is None else total | x
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack(total)], pa.binary())], ["b", "blob"])

    found = ids.select(F.col(column).cast("long")).mapInArrow(bits, "b int, blob binary")
    out = np.zeros(size // 8, np.uint8)
    for r in dealt(found, 8).mapInArrow(union, "b int, blob binary").collect():
        out[r["b"] * len(out) // 8 : (r["b"] + 1) * len(out) // 8] = unpack(r["blob"], np.uint8)[0]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def filter_slots(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    m = np.uint64(size - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)


def may_hold(field: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = filter_slots(ids, 8 * len(field))
    return ((field[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (field[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)
