"""Queries that ask for lengths make no sequence; texts are not joined."""

import os

import pytest

from seqspark.plans import catalog, reports

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_lengths_are_stored(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_kept", {})
    named = catalog.queries()
    for name in ("cluster_windows", "hotspot_windows", "sequence_summary", "filtered_motifs"):
        plan = named[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan, name  # what sequences are made with
    rows = named["sequence_summary"](spark, SF)
    assert rows.count() == catalog.sequences(spark, SF).count()


def test_texts_are_not_joined(spark, make):
    motifs = spark.createDataFrame([(0, "Z-DNA"), (0, "Z-DNA"), (2, "R-loop")], "seq_id long, class string")
    seqs = make(["GGCC", "ATAT", "ACGT"]).selectExpr("*", "'HTT' AS gene")
    genes = reports.gene_summary(motifs, motifs.where("class = 'R-loop'"), seqs)
    plan = genes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("translate(") > plan.index("Join")
    found = sorted((r["seq_id"], r["gc"], r["n_motifs"], r["n_disease"]) for r in genes.collect())
    assert found == [(0, 100.0, 2, 0), (1, 0.0, 0, 0), (2, 50.0, 1, 1)]
    assert reports.top_sequences(genes, 1).first()["seq_id"] == 0


def test_kinds_of_a_window_are_counted_from_its_entries(make, spark):
    """Each distinct count used to send a copy of all rows."""
    from seqspark.operators import hotspots

    rows = [(0, c, s, 10, 20, 1.0) for c, s in (("A", "x"), ("A", "y"), ("B", "x"), ("B", "x"), (None, "z"), ("C", None))]
    motifs = spark.createDataFrame(rows, "seq_id long, class string, subtype string, start_pos int, end_pos int, score double")
    found = hotspots.hotspot_windows(motifs, make(["ACGT" * 30]))
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert (row["motif_count"], row["class_diversity"], row["subclass_diversity"], row["subtype_diversity"]) == (6, 3, 5, 3)
