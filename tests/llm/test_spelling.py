"""Word counts, near words, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from seqspark.llm import spelling
from tests.llm.conftest import ODD


def plain_counts(docs, one_in=199):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                total[run] += 1
    return total


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(total):
    words = {w: n for w, n in total.items() if n >= 5}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("one_in", [3, 199])
def test_counts(spark, odd_docs, one_in, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 4)
    got = {r["word"]: r["n"] for r in spelling.counted_words(odd_docs, one_in=one_in).collect()}
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id")]
    assert got == plain_counts(rows, one_in)


def docs_of(seed, n=60):
    """Texts of words of two letters mainly, so that nearly all kinds of edits occur, with falling frequencies."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé×", (4, 3, 1, 1), k=rng.randint(5, 11))) for _ in range(150)]
    words += [w[:i] + x + w[i + d:] for w in words[:80] for i in (0, 2, len(w) // 2, len(w) - 1, len(w)) for x in ("", "b", "éa") for d in (0, 1)]
    weights = [1 / (1 + rng.randint(0, 400)) for _ in words]
    return [(i, " ".join(rng.choices(words, weights, k=400))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = [*docs_of(seed), (None, "abcabcd " * 7), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, word string, n int")
    got = spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[0])
    expected = brute(plain_counts(docs))
    assert rows == sorted(expected, key=lambda r: r[0])
    assert sum(r[4] for r in rows) > 300 and any(r[1] for r in rows) and any(r[1] != r[2] for r in rows if r[1])


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
