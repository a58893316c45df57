"""Example sequences to try the detectors on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The built-in examples (title, name, description, sequence).
EXAMPLES = [
    (
        "Human Telomere G4-Rich", "G4_Rich_Human_Telomere_Example",
        "Human telomeric sequence rich in G-quadruplex structures",
        "TTAGGGTTAGGGTTAGGGTTAGGGAAAAATCCGTCGAGCAGAGTTAAAAAGGGGTTAGGGTTAGGGTTAGGGCCCCCTCCCCCTCCCCCTCCCCGAAAGAAAGAAAGAAAGAAACGCGCGCGCGCGCGCGCGCGATCGCACACACACAGCTGCTGCTGC",
    ),
    (
        "Z-DNA Forming Sequence", "Z_DNA_Example_Sequence",
        "Alternating CG sequence prone to Z-DNA formation",
        "CGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCG",
    ),
    (
        "Disease-Associated GAA Repeats", "Disease_GAA_Repeats_Example",
        "Frataxin GAA repeat expansion associated with Friedreich's ataxia",
        "GAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAAGAA",
    ),
]


def example_sequences(spark: SparkSession, *titles: str) -> DataFrame:
    """seq_id, name, title, description, sequence, length of the examples, or of those with one of `titles`."""
    unknown = sorted(set(titles) - {e[0] for e in EXAMPLES})
    if unknown:
        raise ValueError(f"no such example: {unknown}")
    rows = [(i, name, title, about, text) for i, (title, name, about, text) in enumerate(EXAMPLES) if not titles or title in titles]
    return spark.createDataFrame(rows, "seq_id long, name string, title string, description string, sequence string").withColumn(
        "length", F.length("sequence"))
