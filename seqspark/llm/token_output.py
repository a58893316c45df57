"""Token ids as Parquet list columns in document order, with metadata that can be read without the ids.

Layout: one row per document (doc_id, part, start_in_part, n_tokens, ids), ascending doc_id within and across
files. Ids are delta-encoded (Parquet format 2, no dictionary for them), `part` is dictionary-encoded; row
groups and pages have a set size and each page has its entry in the column index, so a range of documents or
the metadata alone is read without touching other pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.llm.shared import shared_path, slices
from seqspark.llm.tokens import encode_texts

#: Schema of the files, fixed.
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encoder(tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in slices(batches, "text"):
            ids, bounds = encode_texts(tokenizer, batch.column("text"))
            lengths = np.diff(bounds) + 1
            ends = np.cumsum(lengths)
            out = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids.astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("part"), pa.array(before + ends - lengths, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out, pa.int32())),
            ], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            before += int(ends[-1])
    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encodes `docs` (doc_id, text; null text is empty) and writes the files to `path`.

    A null doc_id sorts first; rows with equal doc_id are ordered by text. Further columns are ignored.
    One shuffle, by ranges of doc_id; a partition streams through the tokenizer.
    """
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (
        few.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_encoder(tokenizer, end_id), SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#part", "true").option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes).option("compression", "zstd").parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The files' rows with `start`, the ids of all documents before; with ids=False only metadata is read.

    Offsets of parts come from one row per part.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = rows.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("start_in_part"))
    return out.select("doc_id", "start", "n_tokens", *(["ids"] if ids else []))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        bounds = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files to the shared folder, reads them back and returns doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return read_tokens(docs.sparkSession, path).mapInArrow(_digest, schema)
