"""A file stream gives the rows of a batch run."""

import pytest

from seqspark.operators.motifs import MOTIF_COLUMNS
from seqspark.plans.all_motifs import detectors
from seqspark.sources.fasta import valid_sequences
from seqspark.streaming import detect

TEXTS = [
    "CG" * 20, "GAA" * 70, "CGG" * 12, "ACGTN" * 9, "gggttgggttgggttggg", "A" * 30, "CAG" * 30, "ATCG" * 12, "CG" * 20,
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream"))
    rows = [(i, f"s{i}", t, len(t)) for i, t in enumerate(TEXTS)]
    for part in (rows[:4], rows[4:6], rows[6:]):
        spark.createDataFrame(part, "seq_id long, name string, sequence string, length int").coalesce(1).write.mode("append").parquet(path)
    return path


def plain(df):
    return sorted(str(sorted(r.asDict(True).items(), key=str)) for r in df.select(*MOTIF_COLUMNS).collect())


def source(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_row_local_detectors_run_on_the_stream(spark, stored, tmp_path):
    query = detect.row_local(source(spark, stored)).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    assert query.awaitTermination(120)
    want = plain(detect.row_local(spark.read.parquet(stored)))
    assert plain(spark.read.parquet(str(tmp_path / "o"))) == want and len(want) >= 4


def test_all_detectors_run_on_each_batch(spark, stored, tmp_path):
    out, kept = str(tmp_path / "o"), str(tmp_path / "c")
    for _ in range(2):  # a second start finds nothing new
        assert detect.detect_to_parquet(source(spark, stored), out, kept, availableNow=True).awaitTermination(300)
    rows = detect.detected(spark, out)
    assert plain(rows) == plain(detectors(valid_sequences(spark.read.parquet(stored))))
    assert {r[0] for r in rows.select("batch").distinct().collect()} == {0, 1, 2}
