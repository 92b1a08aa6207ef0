"""Shared helpers: scratch tables in the cluster's shared folder, bounded Arrow slices, size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None

#: A join key list of at most this many 8-byte ids may be broadcast; a longer one is shuffled.
BROADCAST_IDS = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, a folder of our own in a local session, and
    an error on a cluster, whose executors would write where nobody else reads."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="murmura-")
            atexit.register(shutil.rmtree, _own_dir, True)
        named = f"file://{_own_dir}"
    return f"{named.rstrip('/')}/murmura-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing already done."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._murmura_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``save``; no later action may read them."""
    for df in tables:
        delete(df.sparkSession, df._murmura_path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared(spark: SparkSession, key: str, value):
    """A broadcast variable for a driver-side model whose size is bounded by a parameter."""
    return spark.sparkContext.broadcast(value)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches hold at most ``size`` bytes in this session: a worker's memory then doesn't depend on how long
    the texts are that happen to share a batch (a single row may be longer)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_caches: dict[str, Callable[[], None]] = {}
_running = ""
#: glibc's mallopt: from what size on memory goes back to the system when it is freed, and how much of less is held.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Say how to clear what the operators of one ``name`` keep in a worker process between tasks."""
    _caches[name] = clear


def make_room(name: str) -> None:
    """At the start of a task. A worker process serves many operators and waits between tasks: when another operator starts,
    what the others keep is cleared; freed memory goes back to the system, and from then on large arrays at once."""
    global _running
    try:
        c = ctypes.CDLL(None)
        if not _running:
            c.mallopt(_MMAP_THRESHOLD, 1 << 20)
            c.mallopt(_TRIM_THRESHOLD, 4 << 20)
        if name != _running:
            for other, clear in _caches.items():
                if other != name:
                    clear()
        pa.default_memory_pool().release_unused()
        c.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    _running = name


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Row ranges of ``batch`` whose ``column`` holds about ``limit`` bytes; a longer single value is a range of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(col).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def near_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with a saved one-column table ``ids``; it is broadcast only if counted within the bound."""
    small = ids.count() <= BROADCAST_IDS
    key = ids.select(F.col(ids.columns[0]).alias("__near_id"))
    return df.join(F.broadcast(key) if small else key, F.col(on) == F.col("__near_id"), how)
