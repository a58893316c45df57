"""The input of the interval and report queries holds every class a detector finds."""

from collections import Counter

import pytest

from seqspark.plans import catalog
from seqspark.plans.all_motifs import detectors
from seqspark.sources import fasta
from seqspark.sources.tables import sequences

WORDS = "at cat gag tact aggat"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('core')}"
    rows = [(i, f"{WORDS} {i}" if i % 2 else None if i == 6 else "", "en", "s", 1) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    return base


def test_reports_count_all_detectors(spark, sf_dir):
    found = detectors(fasta.valid_sequences(sequences(spark, sf_dir))).select("seq_id", "class", "subtype").collect()
    want = Counter(r["class"] for r in found)
    assert {"Slipped DNA", "Cruciform DNA"} <= set(want) <= set(catalog.DETECTED_CLASSES)
    assert "Triplex" in {r["subtype"] for r in found}  # H-DNA
    queries = catalog.queries()
    assert {r["class"]: r["n"] for r in queries["class_counts"](spark, sf_dir).collect()} == want
    assert Counter(r["class"] for r in queries["formation_probability"](spark, sf_dir).collect()) == want
    compared = queries["sequence_comparison"](spark, sf_dir).collect()
    assert {c: sum(r[f"{c}_Count"] for r in compared) for c in catalog.DETECTED_CLASSES} == {c: want[c] for c in catalog.DETECTED_CLASSES}
    shares = queries["class_intersections"](spark, sf_dir).collect()
    assert any("Slipped DNA" in r["classes"] for r in shares)


def test_features_of_long_motifs_are_linear(spark):
    """Pairs and palindromes used to be looked up from the first base, each place anew."""
    import time

    from seqspark.functions import features

    rows = spark.createDataFrame([("ACGGTCA" * 6_000,)], "sequence string").select(
        *[v.alias(k) for k, v in features.feature_columns("sequence").items() if k[:3] == "di_" or k in ("struct_stacking_energy", "pattern_palindrome_score")])
    begin = time.time()
    row = rows.first()
    assert time.time() - begin < 20
    assert row["di_GG"] == 6_000 / 41_999 and row["pattern_palindrome_score"] == 5_999 / 42_000  # CAAC
