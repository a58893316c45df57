import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqspark.operators import cruciform, intervals, repeats, slipped, triplex
from tests import brute


@pytest.fixture(scope="module")
def texts():
    return brute.sample_texts()


def by_seq(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def test_direct_repeats_match_brute_force(make, texts):
    rows = slipped.direct_repeat_candidates(make(texts)).select(
        "seq_id", "start_pos", "unit", "spacer", "copies", "length"
    ).collect()
    got = {i: {r[0]: r[1:] for r in v} for i, v in by_seq(rows).items()}
    for i, t in enumerate(texts):
        assert got.get(i, {}) == brute.direct_repeats(t), t


def test_slabs_do_not_change_runs(texts, monkeypatch):
    import pandas as pd

    bases, starts = repeats._concat(pd.Series(texts))
    arms = lambda: [repeats._best_arms(bases, starts, 11, 12, 100, c, triplex._rate, one).tolist() for c in (True, False) for one in (True, False)]
    whole, folds = repeats._equal_runs(pd.Series(texts), 16, 8, 303).tolist(), arms()
    assert all(len(x[0]) for x in folds[2:])
    monkeypatch.setattr(repeats, "SLAB", 50)
    monkeypatch.setattr(repeats, "ARMS", 30)
    assert repeats._equal_runs(pd.Series(texts), 16, 8, 303).tolist() == whole
    assert arms() == folds


def test_tandem_repeats_match_brute_force(make, texts):
    rows = slipped.str_candidates(make(texts)).select("seq_id", "start_pos", "end_pos", "unit").collect()
    got = by_seq(rows)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute.tandem_repeats(t), t


def test_cruciform_candidates_match_brute_force(make, texts):
    rows = cruciform.cruciform_candidates(make(texts)).select("seq_id", "start_pos", "arm", "spacer").collect()
    got = {i: {r[0]: r[1:] for r in v} for i, v in by_seq(rows).items()}
    for i, t in enumerate(texts):
        assert got.get(i, {}) == brute.inverted_repeats(t), t


def test_hdna_matches_brute_force(make, texts):
    got = by_seq(triplex.hdna(make(texts)).select("seq_id", "start_pos", "end_pos", F.round("score", 6)).collect())
    for i, t in enumerate(texts):
        rows = sorted(brute.mirror_repeats(t), key=lambda r: (-r[0], r[1] - r[2], r[1]))
        want = brute.pick([r[1:] for r in rows], True)
        assert sorted(r[:2] for r in got.get(i, [])) == sorted(want), t


@pytest.mark.parametrize("found, candidates", [(cruciform.cruciform, cruciform.cruciform_candidates), (triplex.hdna, triplex.hdna_candidates)])
def test_arms_chosen_in_their_task(make, texts, found, candidates):
    q = make(texts)
    rows = found(q)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    best = [F.desc("score"), F.desc("length"), F.asc("start_pos")]
    want = intervals.greedy(candidates(q), best, overlap="shared_end").select("seq_id", "start_pos", "end_pos", "score").collect()
    rows = rows.select("seq_id", "start_pos", "end_pos", "score", "sequence").collect()
    assert rows and sorted(r[:4] for r in rows) == sorted(tuple(r) for r in want)
    assert all(r["sequence"] == texts[r["seq_id"]][r["start_pos"] - 1:r["end_pos"]] for r in rows)
    assert found(q.limit(0)).count() == 0 == found(make(["ACGT" * 3])).count()


def test_slipped_selection(make, texts):
    got = by_seq(slipped.slipped_dna(make(texts)).select("seq_id", "start_pos", "end_pos").collect())
    q = make(texts)
    cand = slipped.direct_repeat_candidates(q).select("seq_id", "score", F.lit(0).alias("k"), "start_pos", "end_pos").collect()
    cand += slipped.str_candidates(q).select("seq_id", "score", F.lit(1).alias("k"), "start_pos", "end_pos").collect()
    for i, t in enumerate(texts):
        rows = sorted((r for r in cand if r[0] == i), key=lambda r: (-r[1], r[2], r[3]))
        assert sorted(got.get(i, [])) == sorted(brute.pick([(r[3], r[4]) for r in rows], False)), t


def test_batches_are_worked_out_in_parts(texts, monkeypatch):
    import pyarrow as pa

    texts = [t for t in texts if t] + ["ACGGT" * 40, "A" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["seq_id", "sequence"])

    def direct():
        parts, out = list(repeats._parts(iter([batch, batch]))), []
        for part in parts:
            bases, starts = repeats._concat(part.column("sequence").to_pandas())
            rows = repeats._best_direct(bases, starts, 16, (8, 300), 24, 3, slipped._counts)
            out += list(zip(np.asarray(part.column("seq_id"))[rows[0]].tolist(), *(x.tolist() for x in rows[1:])))
        return parts, out

    _, whole = direct()
    for name, value in (("PART", 300), ("SLAB", 50), ("ARMS", 30)):
        monkeypatch.setattr(repeats, name, value)
    parts, cut = direct()
    assert cut == whole and cut
    assert sum((p.column("seq_id").to_pylist() for p in parts), []) == list(range(len(texts))) * 2
    assert all(p.num_rows == 1 or sum(map(len, p.column("sequence").to_pylist())) <= 300 for p in parts)


def test_memory_of_arrays(monkeypatch):
    """Equal k-mers of an array become one run for each distance; they used to be held one by one."""
    import tracemalloc

    bases, starts = repeats._concat(pd.Series(["CAG" * 20_000]))
    tracemalloc.start()
    rows = repeats._runs(bases, starts, 16, 8, 303)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows[0]) == 99 and peak < 10e6


def test_slipped_dna_is_chosen_in_the_task_of_its_sequence(make):
    plan = slipped.slipped_dna(make(["ACGT" * 20]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Join" not in plan and "hashpartitioning" not in plan


def test_disjoint_selection_by_rounds_equals_one_by_one():
    draw = np.random.default_rng(5)
    for rounds in (0, 1, 100):
        for n, most in ((0, 5), (1, 5), (300, 4), (300, 40), (2000, 15)):
            start = draw.integers(0, 1000, n)
            end = start + draw.integers(0, most, n)
            one = intervals.Disjoint(False)
            assert [one.take(s, e) for s, e in zip(start.tolist(), end.tolist())] == intervals.take_disjoint(start, end, rounds).tolist()
