"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which is set to a temporary folder only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-stored-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
    """``df`` written and read back: a cut of the plan that survives lost executors.

    ``dealt`` deals its rows out evenly, for steps on single rows that follow: files of unequal tasks leave most cores idle.
    """
    path = shared_path(df.sparkSession, name)
    if dealt:
        df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
