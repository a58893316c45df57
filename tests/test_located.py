"""One pass over the sequences finds what scans by pattern find."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import disease, g4, imotif, repeats, rloop, scan, slipped, triplex, zdna
from seqspark.operators.located import Part, located
from seqspark.operators.repeats import _best_arms, _disjoint
from seqspark.plans.all_motifs import detectors, searched
from tests import brute


def texts(n=1200):
    rng = random.Random(11)
    made = [brute.random_dna(rng, n, b) for b in ("ACGT", "GGGAT", "CCCAT", "CGG", "GAATTC", "AACC", "GAA", "CG", "AATT", "GGGGA")]
    made += ["", "A", "GAA" * 30 + "TTC" * 20 + "CGG" * 9 + "ACG" + "CGG" * 4, "CAG" * 50 + "AC" * 30 + "GAT" * 9, "GGGG", "GGGGACGTN" * 40]
    return made


def hits(found, part):
    return sorted((int(r), int(a), int(b)) for r, a, b in zip(found["row"], found["start"], found["end"]))


def whole(part, pattern):
    return [(r, m.start(), m.end()) for r, t in enumerate(part.texts) for m in re.finditer(pattern, t)]


@pytest.mark.parametrize("finder, pattern", [
    (g4.find_bipartite, g4.BIPARTITE), (g4.find_triplex, g4.TRIPLEX),
    (triplex.find_sticky, "(?:GAA){6,}|(?:TTC){6,}"),
])
def test_finders_equal_patterns(finder, pattern):
    part = Part(texts())
    assert hits(finder(part), part) == whole(part, pattern) != []


def test_finders_with_rules_equal_patterns():
    part = Part(texts())
    size = lambda h: h[2] - h[1]
    text = lambda h: part.texts[h[0]][h[1]:h[2]]
    ramp = lambda run: sum(min(i, 4) for i in range(1, len(run) + 1)) * (1 if run[0] == "G" else -1)
    four = [h for h in whole(part, g4.FOUR_RUNS) if sum(map(ramp, re.findall("G+|C+", text(h)))) * 1.1 >= size(h) * 1.2]
    assert set(hits(g4.find_four_runs(part), part)) >= set(four) != set()
    assert set(hits(g4.find_four_runs(part), part)) <= set(whole(part, g4.FOUR_RUNS))
    islands = [h for h in whole(part, "[AC]{12,}") if "CCC" in text(h)]
    assert hits(imotif.find_ac_islands(part), part) == islands != []
    for k, (least, needed) in rloop.MODELS.items():
        run, other = "G{%d,}+" % least, "(?!G{%d})[ACGT]" % least
        zones = whole(part, "%s(?:(?:%s){1,10}+%s)*+" % (run, other, run))
        zones = [h for h in zones if sum((len(r) + 1) // (least + 1) for r in re.findall("G{%d,}" % least, text(h))) >= needed]
        assert hits(rloop.find_zones(part, k), part) == zones != []
    units = [(h, u) for u in disease.units() for h in whole(part, "(?:%s){3,}" % u)]
    found = disease.find_runs(part)
    assert sorted(zip(hits(found, part), found["rest"])) != [] and sorted(
        zip(zip(found["row"].tolist(), found["start"].tolist(), found["end"].tolist()), found["rest"])) == sorted(units)


def test_tandem_repeats_are_tried_wherever_the_pattern_hits():
    part = Part(texts())
    row = lambda a: int(np.searchsorted(part.places, a, side="right") - 1)
    found = [(row(a), a - int(part.places[row(a)]), b - int(part.places[row(a)])) for a, b in slipped._tandem_spans(part)]
    assert found == whole(part, slipped.TANDEM) != []


def test_merged_blocks_equal_the_scan(make):
    q = make(texts())
    rows = lambda df: sorted((r["seq_id"], r["start_pos"], r["end_pos"], r["motif"]) for r in df.collect())
    assert rows(located(q, "cgg", zdna.find_cgg)) == rows(scan.scan(q, "(?:CGG){3,}", merge_gap=3)) != []
    assert rows(located(q, "g4_multimeric", g4.find_multimeric)) == rows(scan.scan(q, g4.TANDEM, merge_gap=20)) != []


def test_promising_runs_keep_all_segments():
    part = Part(texts(4000))
    runs = zdna._runs(zdna.BIT[part.raw], part.starts, zdna.DEFAULT)
    kept = zdna._promising(*runs, 50.0)
    assert zdna._segments(*(x[kept] for x in runs), 50.0, 12) == zdna._segments(*runs, 50.0, 12) != []
    assert kept.sum() < len(kept)
    odd = zdna._runs(zdna.BIT[part.raw], part.starts, zdna.Weights(medium=1.3))
    assert zdna._promising(*odd, 50.0).all()


def test_mirrors_one_candidate_a_centre():
    rng = random.Random(5)
    made = ["GAA" * 60, "A" * 150 + "GA" * 40 + "CT" * 60, *(brute.random_dna(rng, 900, b) for b in ("AG", "AAG", "CTTC", "AGGAC"))]
    part = Part(made)
    want = _disjoint(_best_arms(part.bases, part.starts, triplex.SEED, 12, 100, False, triplex._rate, False))
    found = triplex.find_mirrors(part)
    got = np.stack([found[c] for c in ("row", "start", "end", "size", "spacer", "score")])
    want[2] += want[1]
    assert sorted(map(tuple, got.T.tolist())) == sorted(map(tuple, want.T.tolist())) and len(want.T) > 10


def test_equal_blocks_find_all_runs():
    rng = random.Random(9)
    for made in (["ACGT" * 30 + brute.random_dna(rng, 500, "ACG")], [brute.random_dna(rng, 800, "AC"), "", "GAT" * 90]):
        part = Part(made)
        want = []
        for r, t in enumerate(made):
            for d in range(8, 304):
                equal = "".join("1" if a == b else "0" for a, b in zip(t, t[d:]))
                want += [(r, m.start(), d, m.end() - m.start()) for m in re.finditer("1{16,}", equal)]
        assert sorted(zip(*(x.tolist() for x in repeats._runs(part.bases, part.starts, 16, 8, 303)))) == sorted(want) != []


def test_detection_reads_sequences_once(make):
    """The plan of all detectors made and read the sequences once for each of 19 scans."""
    q = make(["GGGTTAGGGTTAGGGTTAGGG", "CG" * 20, "GAA" * 30]).withColumn("sequence", F.replace("sequence", F.lit("~"), F.lit("")))
    rows = detectors(q)
    assert "~" not in rows._jdf.queryExecution().toString()
    assert {r["class"] for r in rows.select("class").collect()} >= {"Z-DNA", "Triplex", "G-Quadruplex Family"}
    with pytest.raises(ValueError):
        zdna.zdna(searched(q), threshold=40.0)
