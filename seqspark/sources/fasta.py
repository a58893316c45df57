"""Sequence sources: FASTA files, pasted text and header fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.functions import sequence as S

MAX_NAME = 100
RAW_NAME = "User_Input"


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """FASTA files as file, record_no, seq_id, name, sequence, length.

    Each record is one row from the start: records are split at a line break followed by ``>``,
    so a ``>`` inside a header does no harm and one large file is read by several tasks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"),
    )
    return parse_records(raw)


def parse_fasta_text(df: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """The same for FASTA texts held in a column, one row per file."""
    body = F.ltrim(F.regexp_replace(F.col(text), r"\r", ""))
    rows = df.select(F.col(file).alias("file"), F.posexplode(F.split(body, "\n>")).alias("place", "text"))
    return parse_records(rows.withColumn("block", F.floor(F.col("place") / 4096)))


def parse_records(rows: DataFrame) -> DataFrame:
    """Records (file, block, place, text) to named clean sequences; empty ones are dropped.

    Records are numbered per block; the few block totals give the numbers per file and the dense
    seq_id, so no file is ever sorted in one task.  A file that does not start with ``>`` opens
    with one unnamed raw record.
    """
    text = F.regexp_replace(F.col("text"), r"\r", "")
    order = Window.partitionBy("file", "block").orderBy("place")
    rows = rows.withColumn("_text", text).withColumn("_n", F.row_number().over(order))
    opens = (F.col("block") == 0) & (F.col("_n") == 1)
    raw = opens & ~F.ltrim("_text").startswith(">")
    record = F.when(opens, F.regexp_replace("_text", r"^\s*>", "")).otherwise(F.col("_text"))
    rows = rows.withColumn("_raw", raw).withColumn("_record", record)
    header = F.when(~F.col("_raw"), F.trim(F.substring_index("_record", "\n", 1))).otherwise("")
    body = F.when(F.col("_raw"), F.col("_record")).when(
        F.col("_record").contains("\n"), F.expr("substring(_record, instr(_record, '\n') + 1)")
    ).otherwise("")
    rows = rows.withColumn("_header", header).withColumn("sequence", S.clean(body)).where(F.length("sequence") > 0)
    rows = rows.withColumn("_n", F.row_number().over(order))
    totals = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_t"))
    before = lambda w: F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(
        "file", "block", before(Window.partitionBy("file").orderBy("block")).alias("_in_file"),
        before(Window.orderBy("file", "block")).alias("_in_all"),
    )
    rows = rows.join(totals, ["file", "block"])
    number = F.col("_in_file") + F.col("_n")
    cut = F.when(
        F.length("_header") > MAX_NAME, F.concat(F.substring("_header", 1, MAX_NAME), F.lit("..."))
    ).otherwise(F.col("_header"))
    name = (
        F.when(F.col("_raw"), RAW_NAME).when(F.col("_header") == "", F.concat(F.lit("Sequence_"), number)).otherwise(cut)
    )
    return rows.select(
        "file", number.alias("record_no"), (F.col("_in_all") + F.col("_n")).alias("seq_id"), name.alias("name"),
        "sequence", F.length("sequence").alias("length"),
    )


def parse_fasta(text) -> Column:
    """One sequence from a FASTA text: header lines dropped, the rest joined and cleaned."""
    lines = F.filter(F.split(S.col(text), "\n"), lambda l: ~l.startswith(">"))
    return S.clean(F.array_join(lines, ""))


def longer_than(seqs: DataFrame, least: int = 10) -> DataFrame:
    """Fetched or pasted records are only used when longer than ten bases."""
    return seqs.where(F.length("sequence") > least)


def valid_sequences(seqs: DataFrame) -> DataFrame:
    """Sequences of A, C, G, T only (any case), upper-cased."""
    return seqs.where(F.upper("sequence").rlike("^[ACGT]+$")).withColumn("sequence", F.upper("sequence"))


def rejected_sequences(seqs: DataFrame) -> DataFrame:
    """What ``valid_sequences`` leaves out."""
    return seqs.where(~F.coalesce(F.upper("sequence").rlike("^[ACGT]+$"), F.lit(False)))


def with_header_fields(seqs: DataFrame, name: str = "name") -> DataFrame:
    """Adds gene_symbol and disease_info from a |-separated header."""
    field = lambda i: F.coalesce(F.nullif(F.try_element_at(F.split(name, r"\|"), F.lit(i)), F.lit("")), F.lit("Unknown"))
    return seqs.withColumn("gene_symbol", field(2)).withColumn("disease_info", field(3))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over the cluster when the source gives fewer partitions than there are cores.

    Detection is row-local and has no shuffle of its own, so a small file in one split would
    leave all other cores idle.  Sources with enough splits are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df
