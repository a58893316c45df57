"""Runs of one base."""

import random
from itertools import groupby

from seqspark.operators import scan
from tests import brute


def test_base_runs_equal_groups_of_letters(make, monkeypatch):
    monkeypatch.setattr(scan, "PART", 50)
    rng = random.Random(2)
    texts = ["", "A", "AAAA", "AANNACGTTé\nGG", *(brute.random_dna(rng, 200, b) for b in ("ACGT", "AC", "GGGT"))]
    want = []
    for i, text in enumerate(texts):
        at = 1
        for letter, run in groupby(text):
            n = len(list(run))
            want += [(i, letter, at, n)] if letter in "ACGT" else []
            at += n
    rows = scan.base_runs(make(texts))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
    # text between the hits of a pattern was cut out twice and folded before
    assert "regexp" not in rows._jdf.queryExecution().toString()
