"""One sequence per subclass, known disease repeats and cases that must not be found."""

import random

import pytest
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators import (
    cruciform, curved, disease, g4, imotif, rloop, scan, slipped, triplex, zdna,
)
from tests import brute

CASES = [
    (curved.curved_dna, "AAAAACCGTC" * 4, "Global curvature"),
    (curved.curved_dna, "CGCGCGAAAAAAAAAAAACGCGCG", "Local Curvature"),
    (slipped.slipped_dna, "ACGATTGACCATGCAGTTACAGGCATTACG" * 2, "Slipped DNA [Direct Repeat]"),
    (slipped.slipped_dna, "CAG" * 10, "Slipped DNA [STR]"),
    (cruciform.cruciform, "ACGTTGCAATCGGATTCCAGCTGGAATCCGATTGCAACGT", "Cruciform DNA [IR]/HairPin [IR]"),
    (rloop.rloops, "GGGCTAGGGAAAGGG" + "C" * 197, "R-loop"),
    (triplex.hdna, "AGGAAGAGGAAAGGTCGGAAAGGAGAAGGA", "Triplex"),
    (triplex.sticky_dna, "GAA" * 18, "sticky DNA"),
    (g4.g4_family, "TGAGGGTGGGTAGGGTGGGTAA", "Multimeric G4"),
    (g4.g4_candidates, "GGGTTAGGGTTAGGGTTAGGGTTA", "Canonical G4"),
    (g4.g4_candidates, "GGGGGTTTTTTTTGGGGGTTTTGGGGGTTTTTGGGGG", "Relaxed G4"),
    (g4.g4_candidates, "GGGGTTGGTGGGGTTGGGGTTGGGG", "Bulged G4"),
    (g4.g4_candidates, "GGGGGTTGGGGG" + "ATTATAATTATAATT" + "GGGGGTTGGGGG", "Bipartite G4"),
    (g4.g4_candidates, "GGGGGTTGGTTGGGGGTTGGGGG", "Imperfect G4"),
    (g4.g4_candidates, "GGGGTTGGGGTTGGGG", "G-Triplex intermediate"),
    (imotif.imotifs, "CCCTTCCCTTCCCTTCCC", "Canonical i-motif"),
    (imotif.imotifs, "CCCTTTTTTTTCCCTTTTTTTCCCTTTTTTCCCT", "Relaxed i-motif"),
    (imotif.ac_motifs, "CCCACACACACACACACACACACACACCCC", "AC-motif"),
    (zdna.zdna, "CG" * 10, "Z-DNA"),
    (zdna.egz, "CGG" * 13, "eGZ (Extruded-G) DNA"),
]


@pytest.mark.parametrize("find", list(dict.fromkeys(c[0] for c in CASES)), ids=lambda f: f.__name__)
def test_subclasses_are_found(make, find):
    cases = [c for c in CASES if c[0] is find]
    found = {(r.seq_id, r.subtype) for r in find(make([c[1] for c in cases])).collect()}
    assert {(i, c[2]) for i, c in enumerate(cases)} <= found


def test_must_not_be_found(make):
    assert g4.g4_candidates(make(["GGATGGATGGATGGATTGAA"])).count() == 0
    assert rloop.rloops(make(["G" * 7 + "C" * 30, "G" * 7 + "A" * 100, "G" * 7 + "C" * 50])).count() == 0


def test_disease_repeats(spark):
    cases = [
        ("GAA" * 100, None, "Friedreich Ataxia", "FXN", 100), ("CGG" * 250, None, "Fragile X Syndrome", "FMR1", 250),
        ("CAG" * 50, None, "Huntington Disease", "HTT", 50), ("CTG" * 100, None, "Myotonic Dystrophy Type 1", "DMPK", 100),
        ("CAG" * 60, "atxn3", "Spinocerebellar Ataxia Type 3", "ATXN3", 60),
    ]
    q = spark.createDataFrame(
        [(i, c[0], c[1]) for i, c in enumerate(cases)], "seq_id long, sequence string, gene string"
    )
    rows = {(r.seq_id, r.repeat_count): r for r in disease.disease_repeats(q, "gene").collect()}
    for i, (_, _, name, symbol, copies) in enumerate(cases):
        r = rows[i, copies]
        assert (r.disease_name, r.gene_symbol, r.clinical_significance) == (name, symbol, "Pathogenic")


def test_cut_positions_do_not_change_matches(make):
    """Scans of long sequences with tiny pieces equal the scan in one piece."""
    rng = random.Random(3)
    texts = [brute.random_dna(rng, 1500, b) for b in ("ACGT", "GGGAT", "CCCAT", "CGG", "GAATTC", "AACT")]
    q = make(texts)
    for pattern, cut in [
        (g4.FOUR_RUNS, g4.FOUR_RUNS_CUT), (g4.TRIPLEX, g4.G3_CUT), (g4.BIPARTITE, g4.G3_CUT), (g4.TANDEM, g4.G3_CUT),
        (imotif.SEED, imotif.SEED_CUT), ("(?:GAA){2,}|(?:TTC){2,}", "[CT](?=[AG])"), ("A{4,}|T{4,}", "A(?=[^A])|T(?=[^T])|[CG]"),
        *[(p, "[GT]") for p in imotif.AC_PATTERNS],
    ]:
        whole = scan.scan(q, pattern).collect()
        assert sorted(whole) == sorted(scan.scan(q, pattern, cut=cut, size=40).collect()), pattern
    merged = scan.scan(q, "(?:CGG){3,}", merge_gap=3).collect()
    assert sorted(merged) == sorted(scan.scan(q, "(?:CGG){3,}", cut=zdna.EGZ_CUT, merge_gap=3, size=30).collect())


def test_zdna_pieces_and_fallback(make, monkeypatch):
    rng = random.Random(5)
    texts = [brute.random_dna(rng, 3000, "CGCGCGAT") for _ in range(3)] + ["CG" * 300 + "A" * 15 + "CG" * 20]
    whole = zdna.zdna(make(texts)).collect()
    monkeypatch.setattr(scan, "PIECE", 100)
    real = scan.pieces
    monkeypatch.setattr(scan, "pieces", lambda seq, cut, size=100: real(seq, cut, size))
    assert sorted(map(str, zdna.zdna(make(texts)).collect())) == sorted(map(str, whole))
    assert len(whole) > 3


def test_curvature_ties_at_six_places_go_to_the_first(make):
    """Both arrays score 11.166667; the sums of their phases differ in the last bits only."""
    rows = curved.curved_dna(make(["CTATATAAAAATTAGCTAGCCAAAAACAAAACTAATAAAATCTAACCAAAATTAGCAACT"])).collect()
    assert [(r.start_pos, r.end_pos, round(r.score, 6)) for r in rows if r.subtype == "Global curvature"] == [(7, 51, 11.166667)]


def test_only_stretches_with_tracts_become_rows(make):
    q = make(["CG" * 500 + "AAAA" + "CG" * 5 + "TTTTTTTT" + "GC" * 500 + "A" * 9 + "CG" * 500])
    assert curved._tract_groups(q).count() == 2
    assert [(r["start_pos"], r["end_pos"]) for r in curved.local_curvature(q).orderBy("start_pos").collect()] == [(1015, 1022), (2023, 2031)]


def test_a_stretch_of_many_tracts_is_matched_without_recursion(make):
    assert curved._tract_groups(make(["AAAACGCGCG" * 20000])).selectExpr("length(text)").first()[0] == 200000 - 6


def test_running_sum_equals_window_means(make):
    draw = random.Random(3)
    texts = ["", "C", "CG", "C" * 12, "G" * 30] + ["".join(draw.choice("CCCGAT") for _ in range(n)) for n in (5, 12, 13, 24, 25, 26, 300)]
    values = S.ramp_array("sequence", "C", "G")
    rows = make(texts).select(S.imotif_score("sequence"), F.array_max(S.sliding_means(values)), F.size(values), F.length("sequence")).collect()
    assert all(a == b and m == n for a, b, m, n in rows)
    rows = make(texts).select(S.max_sliding_mean(values, 4), F.array_max(S.sliding_means(values, 4))).collect()
    assert all(a == b for a, b in rows)
