"""Text statistics against plain Python, and rules on rows whose rule is known."""

import re

from pyspark.sql import functions as F
import pytest

from seqspark.llm import quality_rules as Q
from tests.llm.conftest import ODD

TEXTS = [*ODD, "a b c d e f g h a b c d e f g h", "w " * 40, "x y\nx y\n\nx y\n z | # $", "one two three four five six seven eight " * 2 + "nine",
         " ".join(f"w{i % 13}" for i in range(60)), " ".join(f"w{i}" for i in range(500)) * 2]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_statistics(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = {r["doc_id"]: tuple(r[x] for x in names) for r in Q.with_stats(docs, docs.columns).collect()}
    for i, text in enumerate(TEXTS):
        assert found[i] == plain(text), text


@pytest.fixture(scope="module")
def labelled(spark):
    good = [" ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60)) + "." for i in range(150)]
    bad = [" ".join(f"word{(i * 5 + k * 3) % 991}##" for k in range(60)) for i in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good + bad)] + [(None, good[0], None, None, None), (0, good[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 190)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_rules_are_learned(labelled):
    docs, labels = labelled
    out = Q.judge(docs, labels)
    assert out.count() == docs.count()
    rejected = {r["doc_id"] for r in out.where("not kept").select("doc_id").collect()}
    assert rejected == set(range(150, 190))
    kept = Q.keep_by_rules(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 152
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert Q.keep_by_rules(docs, labels.limit(0)).count() == docs.count()
    assert Q.judge(docs.limit(0), labels).count() == 0
    assert Q.keep_by_rules(docs, labels.where("quality = 1")).count() == docs.count()


def test_decision_takes_the_first_rule(spark):
    a, b = Q.Condition("x", True, 5.0), Q.Condition("y", False, 2.0)
    rows = spark.createDataFrame([(6.0, 1.0), (1.0, 1.0), (6.0, 3.0), (1.0, 3.0)], "x double, y double")
    assert [r[0] for r in rows.select(Q.decision([(a, b), (b,)])).collect()] == [1, 2, 0, 0]
    assert rows.where(Q.decision([]) == 0).count() == 4 and rows.where(Q.holds(())).count() == 4
    assert isinstance(F.lit(1), type(Q.decision([])))
