"""Shuffle counts against plain counting."""

import zlib

import numpy as np

from seqspark.operators import conservation


def test_shuffle_counts():
    for sequence, k, core in (("GGGTTAGGGTTAGGGTTAGGG", 5, ["GGGTT", "TAGGG"]), ("ACACACAC", 4, ["ACAC"]), ("ACGTA", 8, ["ACGTACGT"])):
        rng = np.random.default_rng(zlib.crc32(sequence.encode()))
        bases = np.array(["ACGT".index(c) for c in sequence], np.uint8)
        want = []
        for _ in range(30):
            text = "".join("ACGT"[i] for i in rng.permutation(bases))
            want.append(sum(text[i:i + k] in core for i in range(len(text) - k + 1)))
        assert conservation.shuffle_counts(sequence, k, core, 30).tolist() == want


def test_conserved_motifs(spark):
    rows = [(0, 1, 21, "G-Quadruplex Family", "Canonical G4", "GGGTTAGGGTTAGGGTTAGGG"), (0, 30, 31, "Z-DNA", "Z-DNA", "CG"), (1, 1, 21, "G-Quadruplex Family", "Canonical G4", "GGGTTAGGGTTAGGGTTAGGG")]
    df = spark.createDataFrame(rows, "seq_id long, start_pos int, end_pos int, class string, subtype string, sequence string")
    a, b, c = conservation.with_conservation(df).orderBy("seq_id", "start_pos").collect()
    assert a.conservation_score == c.conservation_score > 0 and a.conservation_p == c.conservation_p <= 0.05
    assert b.conservation_p == 1.0 and b.conservation_score == 0.0


def test_shuffles_worked_out_together_are_the_same(monkeypatch):
    """All shuffles in one step, or a few at a time, equal one permutation after the other."""
    text, k, core = "GGGTTAGGGTTAGGGACC" * 3, 4, ["GGGT", "AGGG"]
    rng, want = np.random.default_rng(zlib.crc32(text.encode())), []
    for _ in range(100):
        mixed = "".join(rng.permutation(list(text)))
        want.append(sum(mixed[i:i + k] in core for i in range(len(text) - k + 1)))
    assert conservation.shuffle_counts(text, k, core).tolist() == want
    monkeypatch.setattr(conservation, "CELLS", 500)
    assert conservation.shuffle_counts(text, k, core).tolist() == want
