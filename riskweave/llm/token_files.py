"""Token-ID output: Parquet list columns in ascending id order, read back by id ranges and columns.

Texts are range-partitioned and sorted before they are tokenized, so that the sampling for the ranges never runs the
tokenizer and the shuffle carries texts once. Each task writes one file; the shard column and the ids' running count
within the shard give every document's place in the whole stream without another pass over the ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, picked, shared_dir, slices, table
from .words import word_encoder

#: Bytes of a row group and of a page: a reader of a few documents opens few pages of one group.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

FILE_COLUMNS = "shard int, doc_id long, shard_start long, n_tokens long, tokens array<int>"
_FILE = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])


def _encoded(tokenizer: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_encoder(tokenizer), end.to_bytes(4, "little")
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", 1024):
                coded = [b + tail for b in encoder.encode(part.column("text").to_pylist())]
                sizes = np.array([len(b) // 4 for b in coded], dtype=np.int64)
                ends = np.cumsum(sizes)
                tokens = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), np.frombuffer(b"".join(coded), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), shard, np.int32)), part.column("doc_id"), pa.array(at + ends - sizes), pa.array(sizes), tokens], schema=_FILE)
                at += int(ends[-1])

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1, doc_id: str = "doc_id", text: str = "text", encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Writes one row a document in ascending id order (null ids first; equal ids by their text's hash).

    encoding: "dictionary" or "delta" (DELTA_BINARY_PACKED). Page indexes are written, so a reader that filters on
    doc_id decodes only the pages that hold it. A null or empty text is the end id alone.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    df = picked(docs, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64("text"))
    ordered = df.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    mapped(ordered, _encoded(tokenizer, end), FILE_COLUMNS).write.options(
        **{
            "compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "v2", "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of a range of ids with the chosen columns; both reach the scan."""
    df = spark.read.schema(FILE_COLUMNS).parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df.select(columns) if columns else df


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: the ids in all shards before it. One row a written file, from two metadata columns."""
    ends = read_tokens(spark, path, ["shard", "shard_start", "n_tokens"]).groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("own"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("shard", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))


_DIGEST = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        ends = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        view = memoryview(np.ascontiguousarray(ids)).cast("B")
        crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), b.column("shard_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], schema=_DIGEST)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, counts and checksums taken from the lists in the files."""
    digests = mapped(read_tokens(spark, path), _digests, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    # One row a written file, and files are at most spark.sql.shuffle.partitions many: small enough to broadcast.
    return digests.join(F.broadcast(shard_bases(spark, path)), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, path)
