"""Writers for motif and summary tables, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = [
    "seq_name", "class", "subtype", "start_pos", "end_pos", "length", "score", "detail", "spacer",
    "conservation_score", "conservation_p", "conservation_significance",
]


BUCKETS = 64


def _write_split(rows: DataFrame, by_name: bool, buckets: int, kind: str, path: str) -> None:
    """Folders of names by hash, so their number does not grow with the sequences; ``by_name``: one for each name.

    A folder has few files, and a name with very many rows still goes to several tasks.
    """
    key = "seq_name"
    if not by_name:
        key = "bucket"
        rows = rows.withColumn(key, F.pmod(F.xxhash64("seq_name"), F.lit(buckets)).cast("int"))
    rows = rows.repartition(key, F.pmod(F.hash("start_pos", "class"), F.lit(8)))
    rows.write.mode("overwrite").partitionBy(key).format(kind).save(path)


def write_motif_csv(motifs: DataFrame, path: str, max_records: int = 0) -> None:
    """The display columns as CSV parts with headers, written by all tasks."""
    columns = [c for c in TABLE if c in motifs.columns]
    writer = motifs.select(*columns).write.mode("overwrite").option("header", True)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.csv(path)


def write_sequence_json(motifs: DataFrame, path: str, by_name: bool = False, buckets: int = BUCKETS) -> None:
    """JSON lines of the sequences' motifs; nested values as strings."""
    rows = motifs.withColumn("attrs", F.to_json("attrs")).withColumn("written_at", F.current_timestamp())
    _write_split(rows, by_name, buckets, "json", path)


def read_sequence_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The motifs written as JSON, with the columns of ``schema``."""
    return spark.read.schema(schema).json(path)


def class_summary(motifs: DataFrame) -> DataFrame:
    """Per sequence its motifs by class and their mean score, as taken again from stored motifs."""
    return motifs.groupBy("seq_name", "class").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def write_results(
    motifs: DataFrame, summary: DataFrame, path: str, by_name: bool = False, buckets: int = BUCKETS,
) -> None:
    """Summary and details as two Parquet tables."""
    summary.write.mode("overwrite").parquet(path + "/summary")
    _write_split(motifs, by_name, buckets, "parquet", path + "/details")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(path + "/summary"), spark.read.parquet(path + "/details").drop("bucket")
