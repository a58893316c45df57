"""Forward-backward against enumeration, code-switched words, and held-out accuracy."""

import itertools

import numpy as np
import pytest

from seqspark.llm import language as L
from tests.llm.conftest import ODD

EN = "the of and to in that with for this from they have were which their would there about when after".split()
DE = "der die und das nicht eine auch sich über durch schon wieder zwischen möglich würde können haben wird einer".split()


def enumerated(scores, transitions, start):
    n, k = scores.shape
    p, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            p[t, y] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return p / total, pairs / total


@pytest.mark.parametrize("lengths", [[1], [4], [3, 1, 5, 2], [1, 1, 1], [7]])
def test_forward_backward(lengths):
    rng = np.random.default_rng(sum(lengths))
    transitions, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(sum(lengths), 3)) * 2
    first = np.zeros(len(scores), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p, pairs = L.forward_backward(scores, first, transitions, start)
    parts = [enumerated(x, transitions, start) for x in np.split(scores, np.cumsum(lengths)[:-1])]
    assert np.allclose(p, np.concatenate([x[0] for x in parts]))
    assert np.allclose(pairs, sum(x[1] for x in parts))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(EN if i % 2 else DE, 60)) for i in range(40)]
    return L.train(texts, ["en" if i % 2 else "de" for i in range(40)], rounds=25)


def test_code_switched_words(model, spark):
    text = " ".join(EN[:8] + DE[:8] + EN[8:14])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "12 ½"), (4, "")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in L.language_spans(docs, model).collect()}
    assert [(s["lang"], len(s["words"].split())) for s in spans[1]] == [("en", 8), ("de", 8), ("en", 6)]
    assert spans[2] == spans[3] == spans[4] == []


def test_prediction_of_odd_texts(model, spark, odd_docs):
    rows = {r["doc_id"]: r for r in L.predict_language(odd_docs, model).collect()}
    assert len(rows) == len(ODD) + 1
    for i, text in enumerate(ODD):
        assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= rows[i]["score"] <= 1
    assert L.predict_language(odd_docs.limit(0), model).count() == 0
    nothing = L.fit(odd_docs.where("lang is null and text is null"), L.HELD_OUT)
    assert {r["lang_pred"] for r in L.predict_language(odd_docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, L.HELD_OUT, per_lang=60)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in L.predict_language(docs, model).collect() if r["held_out"]]
    assert len(out) > 200
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_sample_has_every_language_within_its_bytes(spark):
    rows = [(100 * i + j, f"l{i:02d}", f"tongue{chr(97 + i % 26)}{chr(97 + i // 26)}word " * (400 if i == 0 else 9)) for i in range(70) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    seen = []
    old, L.train = L.train, lambda texts, langs: seen.append((texts, langs))
    try:
        L.fit(docs, "false", per_lang=100, most_bytes=70 * 400)
        L.fit(docs.unionByName(docs), "false", per_lang=100, most_bytes=1 << 30)
    finally:
        L.train = old
    (texts, langs), (_, twice) = seen
    assert set(langs) == {r[1] for r in rows} and langs.count("l00") == 1
    assert all(1 <= langs.count(x) < 8 for x in set(langs)) and len(twice) == 2 * len(rows)
    assert max(map(len, texts)) == len(rows[0][2])
