"""Batches of sequences are bounded by bytes, not by rows."""

import pyarrow as pa
import pytest

from seqspark.sources.tables import sequences


@pytest.fixture
def session(spark):
    return spark.newSession()


def test_a_python_step_gets_a_few_megabytes_at_a_time(session, tmp_path):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = session.range(3000).selectExpr("id AS doc_id", "repeat('ACGTTGCA', 1250) AS text").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sequences(session, str(tmp_path)).coalesce(1).select("sequence")
    found = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 3000 and len(found) > 5
    assert max(r["size"] for r in found) < 6 << 20  # 30 MB came at once
    assert int(session.conf.get("spark.sql.parquet.columnarReaderBatchSize")) * 10_000 < 4 << 20
