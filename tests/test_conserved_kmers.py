"""K-mers of a family against plain strings."""

import random

import numpy as np

from seqspark.operators import conservation

STEPS = {"GC", "CG", "GT", "TG", "AC", "CA"}


def plain(text, family, k):
    kmers = [text[i:i + k] for i in range(len(text) - k + 1)]
    if family in "GC":
        runs = [x for x in kmers if family * 3 in x]
        return runs or [x for x in kmers if x.count(family) >= k // 2]
    return [x for x in kmers if {
        "Z": lambda: sum(x[i:i + 2] in STEPS for i in range(k - 1)) >= (k - 1) // 2,
        "AC": lambda: sum(c in "AC" for c in x) / k >= 0.6, "R": lambda: x.count("G") / k >= 0.4,
        "AT": lambda: "AAA" in x or "TTT" in x, "all": lambda: True,
    }[family]()]


def test_kmers_of_families_equal_strings():
    rng = random.Random(8)
    for letters in ("ACGT", "GGGAT", "CCCT", "CG", "AAT", "ACN"):
        for _ in range(15):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            codes = np.frombuffer(text.encode(), np.uint8)
            for family in ("G", "C", "Z", "AC", "R", "AT", "all"):
                for k in (3, 4, 5, 8):
                    kept = conservation._in_family(codes, family, k)
                    assert [text[i:i + k] for i in np.flatnonzero(kept)] == plain(text, family, k)


def test_kmers_are_no_columns_of_the_plan(spark):
    """Arrays of k-mers were worked out anew in every rule that read them."""
    df = spark.createDataFrame([("Z-DNA", "Z-DNA", "CGCGCGTGCACGCG")], "class string, subtype string, sequence string")
    rows = conservation.with_conservation(df)
    assert "regexp" not in rows._jdf.queryExecution().toString() and rows.first()["observed_count"] > 0
