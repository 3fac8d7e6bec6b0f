"""Intermediate tables in the shared folder that the session names.

Lineage is cut by written tables, never by ``localCheckpoint``: a lost executor costs a re-read, not a rerun.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its counted rows times their width stay under this many bytes.
BROADCAST_LIMIT = 32 << 20
#: Bytes of one Arrow batch sent to a Python worker, where the session sets no other bound: rows may hold long texts.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
ROW_GROUP_BYTES = 16 << 20
_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a temporary one, and that in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(size))


def lean(run):
    """The same function of batches; when a task ends, its worker gives freed memory back before the next one uses it."""

    @wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Deletes the intermediate tables that operators make inside, whose results must have been written by the end."""
    before = set(_ROOTS)
    yield
    for root in _ROOTS - before:
        _delete(spark, root)
        _ROOTS.discard(root)


def sweep(spark: SparkSession) -> None:
    """Delete the intermediate tables of all operators of this process, once their results are written."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


class Scratch:
    """Tables of one run of an operator, each written once and read back; ``drop`` deletes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        _ROOTS.add(self.root)
        small_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """Write and read back; ``parts``, from a count of rows, keeps small tables from becoming many files."""
        # small row groups: a task that writes long texts holds one of them
        (df if parts is None else df.coalesce(parts)).write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted size is under the limit; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
