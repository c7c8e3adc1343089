"""Helpers that the operators of this subpackage share: input columns, shared storage, Arrow rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that become Python objects at once; bounds a worker's memory on long texts.
SLICE = 128
#: Rows of an Arrow batch between the JVM and Python, at most: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000
#: Bytes of text that become Python objects at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riskweave-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that no plan still to be run reads."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under internal names, so that extra or clashing columns don't matter."""
    return docs.select(*[docs[source].alias(name) for name, source in columns.items()])


def slices(batch: pa.RecordBatch, text: str | None = None, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and, with a text column, about SLICE_BYTES of text."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        if text is not None and part.num_rows > 1 and part.column(text).nbytes > SLICE_BYTES:
            total, n = 0, 0
            for x in part.column(text):
                total += len(x.as_py() or "")
                if n and total > SLICE_BYTES:
                    break
                n += 1
            part = part.slice(0, n)
        yield part
        at += part.num_rows


def trim() -> None:
    """Gives freed memory back to the system: a worker lives on through many tasks and stages beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, nothing is lost
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in small batches, with memory given back after each."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(trimmed(batches))
        trim()

    return df.mapInArrow(run, schema)


def serial_tokenizers() -> None:
    """One thread a worker: the cores are Spark's to give."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    rare_gc()


def rare_gc() -> None:
    """Large caches of strings make full collections slow, and these workers make no cycles to speak of."""
    gc.set_threshold(200_000, 50, 1000)


def crc_fold(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))
