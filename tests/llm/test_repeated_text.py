"""Suffix arrays, common prefixes and removed bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from seqspark.llm import repeated_text as R
from seqspark.llm.runs import distinct
from seqspark.llm.suffix_array import common_prefixes, suffix_array
from tests.llm.conftest import ODD


def pieces(rnd, n, letters=b"ab"):
    some = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(4)]
    return [b"".join(rnd.choice(some) for _ in range(rnd.randrange(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("depth", [1, 5, 7, 10, 23, 100])
def test_suffix_array_and_prefixes(depth):
    for seed in range(6):
        segments = pieces(random.Random(seed), 9) + [b"\0\0\0", b"\xff" * 130, b"\xff" * 120]
        data = np.frombuffer(b"".join(segments), np.uint8)
        left = R.bytes_left(np.array([len(s) for s in segments]))
        suffixes = [bytes(data[i:i + min(n, depth)]) for i, n in enumerate(left)]
        order = suffix_array(data, left, depth)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffixes[i], i))
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b])) if x != y), min(len(suffixes[a]), len(suffixes[b]))) for a, b in zip(order, order[1:])]
        assert common_prefixes(data, left, order, depth).tolist() == shared


def removed_plainly(texts, length):
    seen, out = set(), []
    for text in texts:
        gone = [False] * len(text)
        for s in range(len(text) - length + 1):
            window = text[s:s + length]
            if window in seen:
                gone[s:s + length] = [True] * length
            seen.add(window)
        out.append(gone)
    return out


def digest(text, gone):
    kept = bytes(b for b, g in zip(text, gone) if not g)
    return len(text), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_string_hashes_and_anchors():
    rnd = random.Random(1)
    data = np.frombuffer(bytes(rnd.choice(b"abc") for _ in range(3000)) * 2, np.uint8)
    hashes = R.string_hashes(data, 20)
    assert len(set(zip(hashes.tolist(), (bytes(data[i:i + 20]) for i in range(len(hashes)))))) == len(set(hashes.tolist()))
    sure = R.sure_hashes(data, np.arange(len(hashes)), 20)
    assert len(set(zip(sure.tolist(), hashes.tolist()))) == len(set(hashes.tolist())) == len(set(sure.tolist()))
    # The i-th symbol tells if i has an odd number of bits set: sums of powers modulo 2**64 fall together on such strings.
    odd = np.array([97 + i.bit_count() % 2 for i in range(4096)], np.uint8)
    strings = len({bytes(odd[i:i + 1024]) for i in range(3072)})
    assert len(set(R.sure_hashes(odd, np.arange(3072), 1024).tolist())) == strings
    windows, places, _ = R.anchors_of(data, R.bytes_left(np.array([3000, 3000])), 20)
    assert ((windows <= places) & (places <= windows + 10)).all() and len(windows) == 2 * 2981
    assert (places[:2981] + 3000 == places[2981:]).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, texts = say(60), []
    for i in range(120):
        t = say(rnd.randrange(1, 150))
        if i % 4 == 0:
            t = t[:50] + passage[rnd.randrange(100):] + t[50:] + "é" * (i % 5)
        texts.append(t if i % 9 else texts[i // 2] if i else t)
    texts += [*ODD, passage * 3, "é" * 300, "ab" * 400]
    rows = [(i, t, "en", "s", 0 if t is None else len(t), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found int")


@pytest.mark.parametrize("shard_bytes,length", [(2 << 20, 100), (3000, 100), (500, 30)])
def test_removed_bytes(spark, corpus, tmp_path, monkeypatch, shard_bytes, length):
    monkeypatch.setattr(R, "SHARD_BYTES", shard_bytes)
    rows = corpus.orderBy("doc_id").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    expected = [(i, *digest(t, g)) for i, (t, g) in enumerate(zip(texts, removed_plainly(texts, length)))]
    assert sum(e[2] for e in expected) > 1000
    shuffled = corpus.repartition(5)
    assert sorted(tuple(r) for r in R.repeat_digests(shuffled, length).collect()) == expected
    path = f"file://{tmp_path}/docs"
    corpus.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    assert sorted(tuple(r) for r in R.repeat_digests(spark.read.parquet(path), length).collect()) == expected


def test_text_without_repeats(spark, corpus, odd_docs):
    out = R.without_repeats(corpus)
    assert out.dtypes == corpus.dtypes and out.count() == corpus.count()
    rows = {r["doc_id"]: r for r in corpus.collect()}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and r["found"] == rows[r["doc_id"]]["found"]
        assert "�" not in r["text"] and len(r["text"]) <= len(rows[r["doc_id"]]["text"] or "")
    assert R.repeat_digests(odd_docs).count() == odd_docs.count()
    assert R.repeat_digests(odd_docs.limit(0)).count() == 0
    assert R.without_repeats(odd_docs.limit(0)).count() == 0


def test_equal_hashes_of_different_windows_remove_nothing(spark, tmp_path):
    """16 bits of the first hash only: most windows sent are taken for another shard's, and the second hash tells."""
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passages = [say(60) for _ in range(40)]
    texts = [say(70) + passages[i % 40] + say(70) for i in range(1200)]
    texts += [texts[5], texts[9][:150]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartitionByRange(4, "doc_id").write.parquet(f"file://{tmp_path}/docs")  # a shard for each file
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    found = {r["doc_id"]: r["n_removed"] for r in R.repeat_digests(docs, low=0).collect()}
    assert found == dict(enumerate(map(sum, removed_plainly([x.encode() for x in texts], 100))))


def test_only_windows_whose_anchor_has_other_pieces_are_sent():
    """Copies are settled by whole pieces; where two shards differ around a common part, some windows stay open."""
    rnd = random.Random(4)
    say = lambda n: bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
    copy, common = say(2000), say(300)
    shards = [[copy, say(200) + common + say(200)], [copy, say(150) + common + say(250)], [say(500), copy[:700] + say(90)]]
    runs, made = [], []
    for block, texts in enumerate(shards):
        data, left = np.frombuffer(b"".join(texts), np.uint8), R.bytes_left(np.array([len(x) for x in texts]))
        windows, piece, _, keys, pieces = R.pieces_of(data, left, 100, 0)
        assert len(set(pieces.tolist())) == len(pieces) and (keys[1:] >= keys[:-1]).all()
        found = list(R.piece_runs_of(keys, pieces, block))
        assert [x[:2] for x in found] == [(0, block)]
        runs.append(found[0][2])
        made.append((data, windows, piece))
    seen, n_open, earlier = set(), 0, 0
    for (data, windows, piece), (later, open_) in zip(made, R._known_pieces(runs)):
        strings = [bytes(data[w:w + 100]) for w in windows]
        for x, gone, asked in zip(strings, later[piece], open_[piece]):
            assert not gone or x in seen
            assert gone or asked or x not in seen
            earlier += x in seen
            n_open += asked and not gone
        seen.update(strings)
    assert earlier > 2500 and n_open < 500


def test_distinct():
    for values in ([], [3], [1, 1, 2, 5, 5, 5]):
        assert distinct(np.array(values, np.uint64)).tolist() == sorted(set(values))
