"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents. A stage begins by deleting what the stages before it stored on their way, so a result must be
written before the next stage is called, and read back for it.

Null texts count as empty, extra columns are handed on, an empty table stays empty and rows that repeat a doc_id are
judged alike; what each stage does with ties is said there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from seqspark.llm.importance import keep_resampled
from seqspark.llm.near_texts import keep_one
from seqspark.llm.packing import pack
from seqspark.llm.quality_rules import keep_by_rules
from seqspark.llm.repeated_text import without_repeats
from seqspark.llm.shared import drop, making, shared_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of a batch that goes to Python. Ten thousand texts, as by default, would take tens of MB in the JVM and again
#: in the worker, for each task.
BATCH_BYTES = 4 << 20
_left: list[str] = []


def _stage(work: Stage) -> Stage:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        _left[:] = drop(docs, _left)
        out, made = making(lambda: work(spark, docs, sf_dir))
        _left.extend(made)
        return out
    return stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither base conditions nor learned rules reject; equal statistics have equal verdicts."""
    return keep_by_rules(docs, _labels(spark, sf_dir))


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good ones draws; equal scores at the limit all stay."""
    return keep_resampled(docs, _labels(spark, sf_dir))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates, with all rows of that doc_id, and rows without one.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return keep_one(docs)


@_stage
def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur earlier, a null doc_id first, equal ones by text; none goes."""
    return without_repeats(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 4096 ids that hold the sources' proportions."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_chunks=False)


STAGES = [
    ("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text), ("packing", packing),
]

#: Learned verdicts, components and token ids have no SQL; tests hold the run against the stages done plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; between stages a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        _left.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
