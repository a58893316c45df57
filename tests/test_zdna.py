"""Z-DNA parameters and callbacks against a plain loop over steps."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import zdna

PURINE = set("AG")


def plain(text, w, threshold, transitions, min_length):
    """(start, end, sum) of the maximal-sum segments, 1-based."""
    weights, weak, bad = [], 0, 0
    for a, b in zip(text, text[1:]):
        if {a, b} == {"A", "T"}:
            value = w.weak + w.weak_run[min(weak, len(w.weak_run) - 1)]
        elif (a in PURINE) == (b in PURINE):
            value = -(w.mismatch + w.mismatch_step * bad if w.mode == "linear" else w.mismatch * 2.0**bad)
        else:
            value = w.strong if {a, b} == {"G", "C"} else w.medium
        weak = weak + 1 if {a, b} == {"A", "T"} else 0
        bad = bad + 1 if (a in PURINE) == (b in PURINE) else 0
        weights.append(value)
    out, total, best, first, last = [], 0.0, 0.0, 0, 0
    for i, value in enumerate([*weights, float("-inf")]):
        if total <= 0:
            total, best, first = 0.0, 0.0, i
        total += value
        if total > best:
            best, last = total, i
        if total <= 0 and best >= threshold and last - first + 1 >= transitions and last - first + 2 >= min_length:
            out.append((first + 1, last + 2, best))
    return out


@pytest.mark.parametrize("weights,threshold,transitions,min_length", [
    (zdna.DEFAULT, 50.0, 12, 13),
    (zdna.Weights(mode="exponential"), 30.0, 8, 13),
    (zdna.Weights(strong=5.0, medium=2.0, weak=1.0, weak_run=(0.25, -2.0), mismatch=1.0, mismatch_step=0.5), 20.0, 6, 7),
    (zdna.Weights(mismatch_step=0.0), 25.0, 5, 20),
])
def test_parameters(make, weights, threshold, transitions, min_length):
    rng, texts = random.Random(5), ["CG" * 6, "CGCGCGC", "A" * 40, "AT" * 30]
    for _ in range(40):
        texts.append("".join(rng.choice(["CG", "CGCGCGCGCG", "CA", "TGTG", "ATAT", "A", "GG", "ACGT", "TTT"]) for _ in range(40)))
    found = zdna.zdna(make(texts), weights, threshold, transitions, min_length).collect()
    got = sorted((r["seq_id"], r["start_pos"], r["end_pos"], round(r["score"], 6)) for r in found)
    want = [(i, s, e, round(x, 6)) for i, t in enumerate(texts) for s, e, x in plain(t, weights, threshold, transitions, min_length)]
    assert got == sorted(want) and want


def test_callbacks_are_columns(make):
    q = make(["CG" * 20, "CGG" * 12 + "A", "ACGT"])
    factor = lambda motif: F.when(motif.startswith("CGCG"), 1.5).when(motif.startswith("CGG"), 0.2)
    known = lambda motif: F.struct(
        F.length(motif).cast("double").alias("enrichment_score"), F.lit(None).cast("double").alias("p_value"), F.lit("high").alias("significance"))
    plain_rows = {r["seq_id"]: r for r in zdna.zdna(q).unionByName(zdna.egz(q)).collect()}
    rows = zdna.zdna(q, structural_factor=factor, conservation=known).unionByName(zdna.egz(q, structural_factor=factor, conservation=known))
    rows = {r["seq_id"]: r for r in rows.collect()}
    assert set(rows) == set(plain_rows) == {0, 1}
    assert rows[0]["score"] == 1.5 * plain_rows[0]["score"] and rows[1]["score"] == plain_rows[1]["score"]
    assert [rows[i]["attrs"]["Structural_Factor"] for i in (0, 1)] == ["1.5", "0.2"]
    assert rows[0]["attrs"]["Conservation_Score"] == "40.0" and rows[0]["attrs"]["Conservation_P_Value"] == "1.0"
    assert "Structural_Factor" not in plain_rows[0]["attrs"]


def test_egz_parameters(make):
    q = make(["CGG" * 4 + "AAAA" + "CGG" * 3, "CGG" * 3 + "ATA" + "CGG" * 3, "CGGCGG" + "A" * 5000 + "CGGCGG"])
    spans = lambda **kw: sorted((r["seq_id"], r["start_pos"], r["end_pos"]) for r in zdna.egz(q, **kw).collect())
    assert spans() == [(0, 1, 12), (0, 17, 25), (1, 1, 21)]
    assert spans(merge_adjacent=False) == [(0, 1, 12), (0, 17, 25), (1, 1, 9), (1, 13, 21)]
    assert spans(max_gap=4) == [(0, 1, 25), (1, 1, 21)]
    assert spans(min_repeats=4) == [(0, 1, 12)]
    assert spans(min_repeats=2, max_gap=6000)[2:] == [(2, 1, 5012)]


def test_weights_are_checked():
    with pytest.raises(ValueError):
        zdna.Weights(mode="cubic")


def test_step_weights_of_a_long_piece_are_linear(make):
    """No strong step, so no cut: one piece. Each step used to be looked up from the first base."""
    begin = time.time()
    row = zdna.step_weights(make(["CATTAG" * 25_000])).agg(F.count("*").alias("n"), F.max("pos").alias("last")).first()
    assert tuple(row) == (149_999, 149_999) and time.time() - begin < 15


def test_an_unknown_base_is_a_mismatch_and_keeps_positions(make):
    rows = zdna.zdna(make(["A" * 5 + "N" * 4 + "CG" * 10, "CG" * 5 + "N" + "CG" * 5])).select("seq_id", "start_pos", "end_pos", "score").collect()
    # the mismatch of each step beside N costs 3, then 6
    assert sorted(tuple(r) for r in rows) == [(0, 10, 29, 133.0), (1, 1, 21, 117.0)]


def test_runs_in_several_blocks_and_no_row_of_nulls(make, monkeypatch):
    text = "CG" * 30 + "A" * 50 + "CA" * 40
    whole = zdna._segments(*zdna._runs(*_coded([text, text]), zdna.DEFAULT), 50.0, 12)
    monkeypatch.setattr(zdna, "RUNS", 3)
    assert zdna._segments(*zdna._runs(*_coded([text, text]), zdna.DEFAULT), 50.0, 12) == whole and len(whole) == 4
    nulls = make(["CG" * 20]).select(F.lit(1).cast("long").alias("seq_id"), F.lit(None).cast("string").alias("sequence"))
    assert zdna.zdna(nulls).count() == 0


def _coded(texts):
    bases = zdna.BIT[np.frombuffer("".join(texts).encode(), dtype=np.uint8)]
    return bases, np.cumsum([0] + [len(t) for t in texts])
