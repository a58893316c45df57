import random

import pytest
from pyspark.sql import functions as F

from seqspark.operators import clusters, hybrid, intervals
from seqspark.plans.all_motifs import all_motifs, filter_motifs, select_by_priority
from tests import brute

COLUMNS = "seq_id long, class string, subtype string, start_pos int, end_pos int, length int, score double"


@pytest.fixture(scope="module")
def motifs(spark):
    rng = random.Random(11)
    rows = []
    for seq in range(6):
        for n in range(60):
            s = rng.randint(1, 900)
            size = rng.choice([5, 12, 30, 80])
            rows.append((seq, rng.choice("ABC"), "t%d" % n, s, s + size - 1, size, round(rng.random() * 50, 3)))
    return rows, spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("mode", ["inclusive", "shared_end", "covered"])
def test_greedy_matches_brute_force(motifs, mode):
    rows, df = motifs
    got = intervals.greedy(df, [F.desc("score")], overlap=mode).collect()
    for seq in range(6):
        mine = sorted((r for r in rows if r[0] == seq), key=lambda r: -r[6])
        spans = [(r[3], r[4]) for r in mine]
        want = brute.pick_covered(spans) if mode == "covered" else brute.pick(spans, mode == "shared_end")
        assert sorted((r.start_pos, r.end_pos) for r in got if r.seq_id == seq) == sorted(want)


def test_joins_match_all_pairs(motifs):
    rows, df = motifs
    want = sum(
        a[0] == b[0] and a[3] <= b[4] and b[3] <= a[4] for a in rows for b in rows
    )
    assert intervals.overlap_join(df, df, size=50).count() == want
    near = sum(
        a[0] == b[0] and i < j and abs(a[3] - b[3]) < 100 for i, a in enumerate(rows) for j, b in enumerate(rows)
    )
    numbered = df.withColumn("motif_no", F.col("subtype"))
    assert intervals.nearby_join(numbered, 100).count() == near


def test_hybrids_match_sweep(motifs):
    rows, df = motifs
    got = hybrid.hybrids(df).collect()
    for seq in range(6):
        mine = sorted((r for r in rows if r[0] == seq), key=lambda r: (r[3], r[1], r[2]))
        events = sorted([(r[3], 1, i) for i, r in enumerate(mine)] + [(r[4] + 1, 0, i) for i, r in enumerate(mine)])
        active, begin, found = set(), None, []
        for pos, kind, i in events:
            if kind:
                active.add(i)
                begin = pos if len(active) == 2 else begin
            else:
                if len(active) >= 2 and len({mine[k][1] for k in active}) >= 2:
                    found.append((begin, pos - 1, len(active)))
                active.discard(i)
        kept, reach = [], -1
        for b, e, n in sorted(found, key=lambda r: (r[0], -(r[1] - r[0]), -r[2])):
            if e > reach:
                kept.append((b, e, n))
                reach = e
        assert sorted((r.start_pos, r.end_pos, r.n_motifs) for r in got if r.seq_id == seq) == sorted(kept)


def test_pairs_are_consolidated_in_order(motifs):
    rows, df = motifs
    pairs = clusters.hybrid_pairs(df)
    got = clusters.consolidate_pairs(pairs).collect()
    listed = sorted(pairs.collect(), key=lambda p: (p.seq_id, *[p[c] for c in clusters.PAIR_ORDER]))
    want = []
    for p in listed:
        cur = want[-1] if want and want[-1][0] == p.seq_id else None
        if cur and p.start_pos <= cur[2] and (p.start_pos - cur[1]) / (cur[2] - cur[1]) < 0.8:
            cur[2], cur[3], cur[4] = max(cur[2], p.end_pos), (cur[3] + p.overlap) / 2, max(cur[4], p.stability)
            cur[5] += 1
        else:
            want.append([p.seq_id, p.start_pos, p.end_pos, p.overlap, p.stability, 1])
    rounded = lambda r: (r[0], r[1], r[2], round(r[3], 6), round(r[4], 6), r[5])
    assert sorted(rounded(w) for w in want) == sorted(
        rounded((r.seq_id, r.start_pos, r.end_pos, r.overlap, r.stability, r.n_pairs)) for r in got
    )


def test_all_motifs_end_to_end(make):
    text = "A" * 19 + "GAA" * 50 + "GGGCTGGGCTGGGCTGGGC" + "C" * 20 + "CG" * 20 + "ACTGATCGATTGACC" * 8 + "CGG" * 30
    q = make([text, "ACGTN", "GGGTTGGGTTGGGTTGGGCCCTTCCCTTCCCTTCCCCGCGCGCGCGCGCGCG"])
    rows = all_motifs(q, report_hotspots=True, conservation=True).collect()
    classes = {r["class"] for r in rows}
    assert {"Triplex", "Z-DNA", "Hybrid", "Disease-Associated Motif", "Slipped DNA", "Non-B DNA cluster regions"} <= classes
    assert all(1 <= r.start_pos <= r.end_pos for r in rows)
    assert {r.seq_id for r in rows} == {0, 2}
    assert all(0 < r.conservation_p <= 1 for r in rows if r.conservation_p is not None)
    fewer = filter_motifs(all_motifs(q, nonoverlap=True), classes=["Triplex", "Z-DNA"], min_length=18)
    assert {r["class"] for r in fewer.collect()} <= {"Triplex", "Z-DNA"}
