"""Motif detection on a stream of sequences.

A motif never reaches over the end of its sequence, so a stream needs no state between batches.
Detectors without windows or joins run on the streaming DataFrame itself; those that choose among
overlapping hits need Spark's sort and run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqspark.operators import triplex, zdna
from seqspark.operators.motifs import union
from seqspark.plans.all_motifs import detectors
from seqspark.sources.fasta import valid_sequences


def row_local(seqs: DataFrame) -> DataFrame:
    """Sticky DNA, Z-DNA and eGZ: a plan without shuffle that is the same on a batch and on a stream."""
    seqs = valid_sequences(seqs)
    return union([triplex.sticky_dna(seqs), zdna.zdna(seqs), zdna.egz(seqs)])


def detect_to_parquet(
    seqs: DataFrame, path: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame] | None = None, **trigger
) -> StreamingQuery:
    """Start a query that writes the motifs of every micro-batch of ``seqs`` below ``path``.

    ``detect`` makes motifs of sequences (default: all detectors on valid sequences).  Each batch
    overwrites its own partition ``batch=<number>``, so a batch that is run again after a failure
    leaves its rows once.  ``trigger`` goes to ``DataStreamWriter.trigger``.
    """
    detect = detect or (lambda rows: detectors(valid_sequences(rows)))

    def write(rows: DataFrame, number: int) -> None:
        detect(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = seqs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def detected(spark, path: str) -> DataFrame:
    """The motifs written so far, with the number of their batch."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
