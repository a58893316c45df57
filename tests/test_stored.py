"""Stored rows are dealt out evenly."""

from pyspark.sql import functions as F

from seqspark.sources.stored import stored


def test_rows_of_one_task_are_read_by_all(spark):
    df = spark.range(4000).coalesce(1)
    rows = stored(df, "dealt", dealt=True)
    assert sorted(r[0] for r in rows.collect()) == list(range(4000))
    sizes = [r[0] for r in rows.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
    assert stored(df, "plain").groupBy(F.input_file_name()).count().count() == 1
