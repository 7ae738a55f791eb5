"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; bounds a worker's memory when texts are long.
ARROW_ROWS = 500

#: Smallest long: stands in for a null doc_id in keys, so that nulls join and sort first.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session to ARROW_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system when it ends: workers wait for later tasks,
    beside those that are at work, and share an executor's memory with them."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return leaner


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("cuelake.checkpoint.dir", None)
    if not found:
        own = tempfile.mkdtemp(prefix="cuelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("cuelake.checkpoint.dir", found)
    return found.rstrip("/")


#: Names of the folders that `staged` has made: nothing else is deleted.
_staged: set[str] = set()

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def staged(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors. Inside of
    `scratch`, the table goes with its block, or with the block around that if it outlives its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.add(path.rsplit("/", 1)[1])
    if scopes := _scopes.get()[: -1 if outlives else None]:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged in this block are deleted at its end."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            _delete(spark, path)


def discard(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more. Other tables are left alone, which is an error."""
    for file in table.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[1] not in _staged:
            raise ValueError(f"{folder} was not staged here")
        _delete(table.sparkSession, folder)


#: Rows that are broadcast, at most; they are counted first.
BROADCAST_ROWS = 100_000


def small(counted: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, broadcast if it has few rows, as counted; otherwise left to the planner."""
    return F.broadcast(counted) if counted.count() <= rows else counted


def row_key() -> list[Column]:
    """Identity of a row of documents: its doc_id (null: NULL_ID) and the hash of its whole text.

    Rows that repeat both are one document with several output rows.
    """
    return [
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_tx"),
    ]


def crc_mod(n: int) -> Column:
    """crc32 of doc_id as text, modulo n (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def most_frequent(counted: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of a written table with the largest counts: as many as fit into `limit`, counts being told apart by
    sixteenths of a power of two. Only the sizes of the levels, under 1024 rows, come to the driver."""
    levelled = counted.withColumn("_level", F.floor(16 * F.log2(count)).cast("int"))
    least, room = 1024, limit
    for r in sorted(levelled.groupBy("_level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["_level"]):
        if (room := room - r.n) < 0:
            break
        least = r["_level"]
    return levelled.where(F.col("_level") >= least).drop("_level")
