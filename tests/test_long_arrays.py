"""Long arrays of one unit: detectors stay linear."""

import re
import time

import pytest

from seqspark.operators import imotif, slipped


def test_ac_islands_match_the_patterns(spark, make):
    texts = [
        "AAACACACACACCC", "GTAAAAAAAAACCCACCCT", "CCCAAAAAACCC", "CCCAAAAACCC", "TCCCACACACACCCGAAACCCCCCCCCCCT",
        "AAAACCCCCCCCC", "ACACACACACACAAACCCCCCAAACCC", "CCC" * 8, "AAA" * 9, "GATTACA",
    ]
    q = make(texts)
    found = {(r.seq_id, r.start_pos, r.end_pos, r.pattern_no) for r in imotif.ac_candidates(q).collect()}
    want = set()
    for i, text in enumerate(texts):
        for number, pattern in enumerate(imotif.AC_PATTERNS, start=1):
            want |= {(i, m.start() + 1, m.end(), number) for m in re.finditer(pattern, text) if len(m[0]) >= 15 and "CCC" in m[0]}
    assert found <= want
    scored = {x for x in want if x not in found}
    assert all(x[2] - x[1] + 1 < 30 for x in scored)  # only the score rule takes hits away
    assert found


@pytest.mark.parametrize("unit", ["A", "AT", "GAA", "CAG", "C", "AC"])
def test_ac_motifs_on_arrays(spark, make, unit):
    q = make([(unit * 100_000)[:100_000]])
    begin = time.time()
    imotif.ac_candidates(q).count()
    assert time.time() - begin < 30


@pytest.mark.parametrize("unit", ["CAG", "A", "AT"])
def test_direct_repeats_on_arrays(spark, make, unit):
    q = make([(unit * 24_000)[:24_000]])
    begin = time.time()
    assert slipped.direct_repeat_candidates(q).count() > 0
    assert time.time() - begin < 30
