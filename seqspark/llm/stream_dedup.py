"""Exact copies by a stream that keeps one entry for each distinct text, on disk and for ever.

1. A Structured Streaming query reads the table's files. Its keyed state (RocksDB, no watermark, so nothing expires)
   has for each digest of a normalised text the row that stays, by its stable identifier and the place of its
   content (file and row), and how many rows had the digest. Rows are aggregated before the shuffle, so a text that
   a third of the table repeats is one row for each task. Run again with the same checkpoint, the query reads only
   files that are new and compares them with all that came before.
2. Digests that more than one row has are hits. The whole texts of all rows of a hit are compared with the kept one;
   texts that only share a digest are told apart by their bytes.
3. Every row of the table gets its group from the state.

DataFrame functions only. One pass over the text for the stream, one for the bytes of hits and one for the answers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.shared import shared_path, stored

#: White space that does not count in a comparison.
BLANKS = " \t\n\v\f\r"
#: Digests of hits that are broadcast at most (32 bytes each); beyond it they are joined.
MOST_BROADCAST = 1_000_000

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store is closed when its task ends, so the open ones are those of running tasks; each reserves some MB of disk.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(plain: Column) -> Column:
    return F.unhex(F.sha2(plain, 256))


def _plain() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, text)


def _columns(spark: SparkSession, path: str) -> str:
    """The types of the two columns that are read; others, whatever their names, are left in the files."""
    kinds = dict(spark.read.parquet(path).dtypes)
    return f"doc_id {kinds['doc_id']}, text {kinds['text']}"


def _rows(files: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, plain text and `row`: least is the one that stays (most code points, then smallest doc_id, then place)."""
    row = F.struct(
        (-F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("shortness"), F.isnull("doc_id").alias("no_id"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return files.select(_plain().alias("plain"), row.alias("row")).select(digest(F.col("plain")).alias("digest"), "plain", "row")


class _settings:
    """The session's settings of the state store, as they were before at the end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def take_in(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = 1 << 40) -> None:
    """Reads the Parquet files at `path` that the state in `checkpoint` has not seen, `batch_bytes` of them at a time."""
    # A pattern, as a stream takes no path of a single file otherwise.
    pattern = f"{path[:-1]}[{path[-1]}]"
    files = spark.readStream.schema(_columns(spark, path)).option("maxBytesPerTrigger", str(batch_bytes)).parquet(pattern)
    state = _rows(files, digest).groupBy("digest").agg(F.min("row").alias("kept"), F.count("*").alias("n"))
    with _settings(spark):
        query = state.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option(
            "checkpointLocation", checkpoint).start()
        query.awaitTermination()


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, kept (shortness, no_id, doc_id, file, place), n."""
    with _settings(spark):
        state = spark.read.format("statestore").load(checkpoint)
        return stored(state.select("key.digest", F.col("value.min").alias("kept"), F.col("value.count").alias("n")), "digests")


def exact_copies(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of the Parquet table at `path` (doc_id, text).

    Texts are equal if they are after white space is deleted; null is empty. Of equal ones the row with the most code
    points stays, then that of the smallest doc_id (null last), then the first in its file, so rows that repeat a
    doc_id are told apart and one of each group is kept. An empty table gives no row; other columns are not read.
    With a `checkpoint` of an earlier run its files count as well, and rows may name a row of those as kept.
    """
    checkpoint = checkpoint or shared_path(spark, "digest-state")
    take_in(spark, path, checkpoint, digest)
    state = state_of(spark, checkpoint)
    rows = _rows(spark.read.schema(_columns(spark, path)).parquet(path), digest)
    hits = state.where("n > 1").select("digest")
    seen = rows.select("digest", "plain")
    if hits.count() <= MOST_BROADCAST:
        seen = seen.join(F.broadcast(hits), "digest", "left_semi")
    # Equal texts fold into one row before the shuffle; the least and the greatest are the same if all are.
    differ = stored(seen.groupBy("digest").agg(F.min("plain").alias("least"), F.max("plain").alias("greatest")).where(
        "least <> greatest").select("digest"), "differing")
    answer = [F.col("row.doc_id").alias("doc_id"), F.col("kept.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
              F.expr("kept.file = row.file AND kept.place = row.place").alias("kept"),
              F.col("text_sha256")]
    whole = digest is sha256
    narrow = rows.select("digest", "row", (F.lower(F.hex("digest")) if whole else F.sha2("plain", 256)).alias("text_sha256"))
    if differ.isEmpty():
        return narrow.join(state, "digest").select(answer)
    told = narrow.join(differ, "digest", "left_anti").join(state, "digest").select(answer)
    apart = rows.join(differ, "digest", "left_semi")
    groups = apart.groupBy("plain").agg(F.min("row").alias("kept"), F.count("*").alias("n"))
    return told.unionByName(apart.withColumn("text_sha256", F.sha2("plain", 256)).join(groups, "plain").select(answer))
