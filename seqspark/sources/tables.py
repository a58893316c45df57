"""Sequences derived from a text table, for testing on tables that hold no DNA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators.scan import computed
from seqspark.sources.fasta import spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
BASES = "".join("ACGT"[i % 4] for i in range(26)) * 2
FILLER = "ACTACGATCATCAGTCA"

# One planted cassette per remainder of the row number, written as (text, times) parts.
CASSETTES = [
    [("GGGTTA", 6), ("ACTCATCAGTCATCATCAATCATC", 1), ("GGGTTGGGTTGGG", 1), ("A", 24), ("GGGTTGGGTTGGG", 1)],
    [("CCCTAA", 6), ("GATTGATG", 1), ("CCCTTTTTTTTCCCTTTTTTTCCCTTTTTTCCCT", 1)],
    [("GAA", 70)],
    [("CGG", 60), ("ATA", 1), ("CGG", 4)],
    [("CAG", 45)],
    [("CG", 20), ("ATGATTGA", 1), ("CTG", 55)],
    [("AAAAACCGTC", 6), ("CGCGCGAAAAAAAAAAAACGCGCG", 1)],
    [("ACGTTGCAATCGGATTCCAG", 1), ("CTGGAATCCGATTGCAACGT", 1), ("GAC", 1), ("AGGAAGAGGAAAGGTCGGAAAGGAGAAGGA", 1)],
    [("GGGCTAGGGAAAGGG", 1), ("CCGTCAGCGC", 20)],
    [("CCCACACACACACACACACACACACACCCC", 1), ("GATG", 1), ("AT", 12)],
    [("GGGTTTTTTTTGGGTTTTTTTTGGGTTTTTTTTGGG", 1), ("ACTCATCAGTCA", 2), ("GGGAGGGTTGGGTTGGG", 1)],
    [("ACGATTGACCATGCAGTTACAGGCATTACG", 2), ("TGTCA", 1), ("ATCG", 12), ("GGGCTGGGGGCTGGGGG", 1), ("CTGGG", 30)],
]
GENES = [None, "HTT", "FMR1", "fxn", "AR"]

#: Rows of text that a Parquet reader unpacks at a time, and bytes of a batch that goes to Python.
READ_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches to a size that fits long texts.

    By default each task unpacks 4096 texts at a time and hands 10,000 (up to 64 MB) to Python: tens of MB of buffers
    on the heap, as many again for Arrow and in the worker.
    """
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, name, gene, sequence, length from the documents table."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cassette, gene = F.lit(""), F.lit(None).cast("string")
    for i, parts in enumerate(CASSETTES):
        text = "".join(t * n for t, n in parts)
        cassette = F.when(F.col("doc_id") % len(CASSETTES) == i, text).otherwise(cassette)
    for i, g in enumerate(GENES):
        gene = F.when(F.col("doc_id") % len(GENES) == i, F.lit(g)).otherwise(gene)
    body = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES)
    rows = computed(spread(docs), sequence=F.concat(body, F.lit(FILLER), cassette, F.lit(FILLER)))
    return rows.select(
        F.col("doc_id").alias("seq_id"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"), gene.alias("gene"),
        "sequence", F.length("sequence").alias("length"),
    )


def sequences_sql() -> str:
    """The same as a SQL query."""
    cassette = " ".join(
        "WHEN {} THEN '{}'".format(i, "".join(t * n for t, n in parts)) for i, parts in enumerate(CASSETTES)
    )
    genes = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GENES) if g)
    return f"""
      SELECT *, length(sequence) AS length FROM (
        SELECT doc_id AS seq_id, 'doc_' || doc_id AS name,
               CASE doc_id % {len(GENES)} {genes} END AS gene,
               translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}')
               || '{FILLER}' || CASE doc_id % {len(CASSETTES)} {cassette} END || '{FILLER}' AS sequence
        FROM documents)
    """
