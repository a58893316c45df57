"""Weights against plain Python, the k-th largest value, and what is drawn."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqspark.llm import importance as I
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def corpus(spark):
    good = [" ".join(f"word{(i * 7 + k * k) % 97}" for k in range(20 + i)) for i in range(80)]
    bad = [" ".join(f"word{(i * 5 + k * 3) % 97}##" for k in range(60)) for i in range(20)]
    rows = [(i, t, "en", "s", 1.0) for i, t in enumerate(good + bad)] + [(None, good[0], None, None, None), (0, good[0], "en", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 100, 2)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def buckets_of(text, buckets):
    m = 0x9E3779B97F4A7C15
    h = [xxhash.xxh64_intdigest(w) for w in (text or "").split()]
    return [((x * m) % 2**64 >> 32) % buckets for x in h] + [((((a * m + b) % 2**64) * m) % 2**64 >> 32) % buckets for a, b in zip(h, h[1:])]


def test_weights(corpus):
    docs, labels = corpus
    rows = docs.collect()
    raw, target = Counter(), Counter()
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    for r in rows:
        raw.update(buckets_of(r["text"], 256))
        if r["doc_id"] in good:
            target.update(buckets_of(r["text"], 256))
    a, b = sum(target.values()) + 256, sum(raw.values()) + 256
    weight = lambda t: sum(math.log((target[x] + 1) / a) - math.log((raw[x] + 1) / b) for x in buckets_of(t, 256))
    found = {r["doc_id"]: r for r in I.resample(docs, labels, buckets=256).collect()}
    for r in rows:
        assert found[r["doc_id"]]["log_weight"] == pytest.approx(weight(r["text"]), abs=1e-8)
        assert found[r["doc_id"]]["row"] == r


def test_junk_goes_and_clean_text_stays(corpus):
    docs, labels = corpus
    out = I.resample(docs, labels)
    assert {r["doc_id"] for r in out.where("not kept").collect()} == set(range(80, 100))
    kept = I.keep_resampled(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 82


def test_odd_input(corpus, spark, odd_docs):
    docs, labels = corpus
    assert I.resample(odd_docs, labels).count() == len(ODD) + 2
    assert I.keep_resampled(odd_docs, labels.limit(0)).count() == len(ODD) + 2
    assert I.resample(docs.limit(0), labels).count() == 0
    assert I.keep_resampled(docs, labels, share=0.0).count() == 0


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=500)] + [0.25] * 300
    df = spark.createDataFrame([(x,) for x in values], "v double")
    for k in (1, 2, 250, 500, 800):
        assert I.kth_largest(df, k, bins=8, collect=10) == sorted(values, reverse=True)[k - 1]
    assert I.kth_largest(df.where(F.col("v") == 0.25), 7) == 0.25
