import pytest
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.plans import reports
from seqspark.plans.all_motifs import all_motifs
from seqspark.sources import fasta, sinks

TEXT = ">one|HTT|Huntington\nACGU acgt\nAC\n>\nGGGG\n>empty\n\n>a > b" + "x" * 120 + "\nTTTT\n"


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(TEXT)
    (tmp_path / "b.fa").write_text("acgtacgtaa\nccc\n")
    rows = {(r.file[-4:], r.record_no): r for r in fasta.with_header_fields(fasta.read_fasta(spark, str(tmp_path))).collect()}
    assert [rows["a.fa", i].sequence for i in (1, 2, 3)] == ["ACGTACGTAC", "GGGG", "TTTT"]
    assert rows["a.fa", 1].gene_symbol == "HTT" and rows["a.fa", 2].gene_symbol == "Unknown"
    assert rows["a.fa", 2].name == "Sequence_2"
    assert rows["a.fa", 3].name.endswith("...") and len(rows["a.fa", 3].name) == 103
    assert (rows["b.fa", 1].name, rows["b.fa", 1].sequence) == ("User_Input", "ACGTACGTAACCC")
    assert len({r.seq_id for r in rows.values()}) == len(rows) == 4


def test_text_helpers(spark):
    row = spark.createDataFrame([(TEXT, "ACGTACGT")], "t string, s string").select(
        fasta.parse_fasta("t").alias("one"), S.overlapping_matches("s", "ACGT").alias("m"), S.wrap("s", 3).alias("w")
    ).first()
    assert row.one == "ACGTACGTACGGGGTTTT"
    assert [(m.start_pos, m.match) for m in row.m] == [(1, "ACGT"), (5, "ACGT")]
    assert row.w == "ACG\nTAC\nGT"


def test_sinks_round_trip(spark, make, tmp_path):
    q = make(["GAA" * 70 + "CG" * 20])
    motifs = all_motifs(q).persist()
    sinks.write_motif_csv(motifs, str(tmp_path / "csv"), max_records=2)
    sinks.write_sequence_json(motifs, str(tmp_path / "json"))
    sinks.write_results(motifs, reports.sequence_summary(motifs, q), str(tmp_path / "res"))
    n = motifs.count()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == n
    again = sinks.read_sequence_json(spark, str(tmp_path / "json"), "seq_name string, class string, score double")
    rows = lambda df: sorted((r["class"], r.n, round(r.mean_score, 9)) for r in df.collect())
    assert rows(sinks.class_summary(again)) == rows(sinks.class_summary(motifs))
    assert not list((tmp_path / "json").glob("seq_name=*"))
    summary, details = sinks.read_results(spark, str(tmp_path / "res"))
    assert details.count() == n and summary.first().n_motifs == n
    assert reports.display_rows(motifs).columns[0] == "Sequence Name"
    filled = reports.fill_defaults(motifs, numeric=["Risk_Score", "score"], text=["Gene_Symbol"]).first()
    assert filled.Risk_Score == 0.0 and filled.Gene_Symbol == "Unknown"
    assert reports.disease_rows(motifs).count() >= 1 and reports.cluster_rows(motifs).count() == 0


def test_examples_hold_what_they_name(spark):
    from seqspark.plans.all_motifs import detectors
    from seqspark.sources.examples import EXAMPLES, example_sequences

    q = example_sequences(spark)
    assert [r["length"] for r in q.orderBy("seq_id").collect()] == [len(e[3]) for e in EXAMPLES]
    found = {(r["seq_id"], r["class"]) for r in detectors(q).select("seq_id", "class").collect()}
    assert {c for i, c in found if i == 0} >= {"G-Quadruplex Family", "i-motif family"}
    assert (1, "Z-DNA") in found
    assert {(2, "Triplex"), (2, "Slipped DNA")} & found
    assert example_sequences(spark, "Z-DNA Forming Sequence").count() == 1
    with pytest.raises(ValueError):
        example_sequences(spark, "none")
