"""Chains and windows that numpy steps work out, against plain loops."""

import random

import numpy as np

from seqspark.operators import curved, rloop
from tests import brute


def test_best_window_equals_all_windows():
    rng = random.Random(6)
    for n in [0, 1, 24, 49, 50, 75, 76, 400, 1999, 2000]:
        for letters in ("ACGT", "AT", "GGCA", "ATATG"):
            rest = brute.random_dna(rng, n, letters) if n else ""
            best, want = None, (0, 0)
            for a in range(0, n - 49, 25):
                for b in range(a + 50, n // 25 * 25 + 1, 25):
                    gc = sum(c in "GC" for c in rest[a:b])
                    if gc * 2 >= b - a and (best is None or gc > best):
                        best, want = gc, (a, b)
            upto = np.concatenate([[0], np.cumsum([c in "GC" for c in rest])])[::25]
            assert rloop._best_window(upto) == want


def test_long_tracts_inside_chains_are_left_out():
    text = "AAAAACCGTC" * 3 + "AAAAAAAACC" + "G" * 12 + "TTTTTTTTT"
    found = curved._arrays(text)
    chains = [(s, e, n) for s, e, n, *_ in found if n]
    assert chains == [(0, 37, 4), (10, 37, 3)] and [x[:2] for x in found if x[2] is None] == [(52, 60)]


def test_arrays_of_one_part_leave_in_small_batches(make, monkeypatch):
    q = make(["AAAAACCGTC" * 40, "CGATTTTTTTTTGC", "ACGT"])
    want = sorted(map(str, curved._with_arrays(q).collect()))
    monkeypatch.setattr(curved, "BYTES", 100)
    assert sorted(map(str, curved._with_arrays(q).collect())) == want and len(want) == 39
