"""What the features count equals a count by hand."""

import random
import re
from functools import reduce
from operator import add

from seqspark.functions import features


def test_counts_of_features_equal_patterns(spark):
    rng = random.Random(4)
    texts = ["", "A", "AC", "A" * 12, "ACNNCA", "GAATTC" * 9, "ANNNNNNNNA", None]
    texts += ["".join(rng.choice(b) for _ in range(rng.randint(1, 60))) for b in ("ACGT", "AC", "GGGAT", "CCAG") for _ in range(10)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", features.counts("s").alias("c"))
    turn = str.maketrans("ACGT", "TGCA")
    for i, c in sorted(rows.collect()):
        t = texts[i]
        if t is None:
            assert c is None or all(v is None for v in c)
            continue
        n = len(t)
        same = lambda a, b: sum(x == y for x, y in zip(a, b))
        runs = re.findall("A+|C+|G+|T+", t)
        assert [c[p] for p in features.PAIRS] == [len(re.findall("%s(?=%s)" % tuple(p), t)) for p in features.PAIRS]
        assert c["palindromes"] == sum(t[p:p + k // 2] == t[p + k - k // 2:p + k][::-1] for k in range(4, 20) for p in range(n - k + 1))
        assert (c["mirror"], c["inverted"]) == (same(t[:n // 2], t[::-1][:n // 2]), same(t, t[::-1].translate(turn)))
        assert (c["runs"], c["longest"]) == (len(runs), max(map(len, runs), default=0))
        assert (c["g_runs"], c["c_runs"]) == (len(re.findall("G{3,}", t)), len(re.findall("C{3,}", t)))
        assert c["repeat"] == sum(1 / (n / u) for u in range(2, 10) if u <= n // 2 and t[:u] * (n // u) in t)
        steps = [features.STACKING.get(t[p:p + 2]) for p in range(n - 1)]
        assert c["stacking"] == (None if None in steps else reduce(add, steps, 0.0))


def test_features_count_a_sequence_once(spark):
    """Places that read the same both ways were matched by 16 patterns at each base, pairs by 16 more."""
    named = [v.alias(k) for k, v in features.feature_columns("s").items()]
    plan = spark.createDataFrame([("ACGT" * 9,)], "s string").select(*named)._jdf.queryExecution()
    assert plan.toString().count("ArrowEvalPython") == plan.analyzed().toString().count("ArrowEvalPython") + 2
    assert "regexp_extract_all" not in plan.optimizedPlan().toString()
