"""Scores of hybrids do not depend on the order in which rows arrive."""

from seqspark.operators import hybrid


def test_scores_repeat_to_the_last_bit(spark):
    rows = [(0, "AB"[i % 2], "x", 1 + i, 100, 100 - i, 0.1 * 3 ** i) for i in range(12)]
    schema = "seq_id long, class string, subtype string, start_pos int, end_pos int, length int, score double"
    found = [hybrid.hybrids(spark.createDataFrame(x, schema).coalesce(1)).first() for x in (rows, rows[::-1], rows[5:] + rows[:5])]
    assert len({r["score"] for r in found}) == 1
    # from the least to the greatest start
    total = 0.0
    for r in rows:
        total += r[-1]
    row = found[0]
    assert row["n_motifs"] == 12 and row["score"] == total * (1 + 12 * 0.2) * row["overlap_degree"]
