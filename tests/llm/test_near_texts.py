"""Near-duplicate texts against exact similarity of all pairs, and recall by band."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm import near_texts
from tests.llm.conftest import ODD
from tests.llm.test_simhash import roots_of


def plain_set(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, share, rnd):
    """A copy whose similarity is near `share`: whole stretches of words are replaced."""
    n = len(words)
    out, gone = list(words), round((1 - share) / (1 + share) * (n - 4))
    at = rnd.randrange(n - gone)
    for i in range(at + 2, at + max(3, gone - 2)):
        out[min(i, n - 1)] = f"z{rnd.randrange(10**6)}"
    return out


def test_signatures_are_majorities():
    sets = near_texts.shingle_sets([*ODD, "a b c d e f g h", " ".join(f"w{i}" for i in range(700))])
    got = np.unpackbits(near_texts.signatures(sets, 150), axis=1, count=150)
    for row, s in zip(got, sets):
        bits = []
        for k in range(3):
            salted = near_texts.mixed(s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
            bits.append(np.unpackbits(salted.view(np.uint8).reshape(-1, 8), axis=1))
        expected = 2 * np.concatenate(bits, axis=1)[:, :150].sum(axis=0) > len(s)
        assert row.tolist() == expected.astype(int).tolist()
    assert [len(s) for s in near_texts.shingle_sets([None, "", "One", "one", "a b c d e f"])] == [0, 0, 1, 1, 2]


def test_forest_joins_what_all_pairs_join():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 2**63, (6, 4), dtype=np.uint64)
    words = np.concatenate([c ^ (np.uint64(1) << rnd.integers(0, 64, (n, 4)).astype(np.uint64)) for c, n in zip(centres, (1, 2, 5, 40, 90, 3))])
    node = np.concatenate([rnd.permutation(len(words))[:n] for n in (100, 30, 7, 3, 2, 1)])
    variant = np.repeat(np.arange(6, dtype=np.uint64), (100, 30, 7, 3, 2, 1))
    a, b, d = near_texts.near_pairs(variant, node, words, 4, 8)
    assert d.tolist() == [int(np.bitwise_count(words[x] ^ words[y]).sum()) for x, y in zip(a, b)]
    pairs = [(x, y) for v in range(6) for x in node[variant == v] for y in node[variant == v] if x < y and np.bitwise_count(words[x] ^ words[y]).sum() <= 8]
    nodes = range(len(words))
    assert roots_of(nodes, zip(a.tolist(), b.tolist())) == roots_of(nodes, pairs)
    assert len(a) == len(set(nodes)) - len(set(roots_of(nodes, pairs).values()))
    assert [len(x) for x in near_texts.near_pairs(variant[:0], node[:0], words, 4, 8)] == [0, 0, 0]


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(11)
    texts, bands = [], []
    for i in range(240):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([40, 120, 400]))]
        texts.append(" ".join(base))
        texts.append(" ".join(edited(base, [0.7, 0.81, 0.85, 0.9, 0.95, 0.98][i % 6], rnd)))
    base = [f"v{rnd.randrange(5000)}" for _ in range(200)]
    for i in range(60):  # a large class, and copies
        texts += [" ".join(edited(base, 0.95, rnd))] * (1 + i % 3)
    return texts


def test_classes_against_all_pairs(spark, odd_docs, planted):
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(planted)], odd_docs.schema))
    rows = docs.collect()
    sets = [plain_set(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    true = roots_of(range(len(rows)), pairs)
    found = near_texts.near_classes(docs.repartition(3)).collect()
    assert len(found) == len(rows)
    component = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    bands: dict = {}
    for i, j in pairs:
        a, b = rows[i]["doc_id"], rows[j]["doc_id"]
        if a is not None and b is not None:
            bands.setdefault(min(int(jaccard(sets[i], sets[j]) * 20), 19), []).append(component[a] == component[b])
    assert sorted(bands) == [16, 17, 18, 19]
    assert all(sum(x) >= 0.9 * len(x) for x in bands.values()), {k: sum(x) / len(x) for k, x in bands.items()}
    root = {r["doc_id"]: true[i] for i, r in enumerate(rows)}
    assert all(root[i] == root[c] for i, c in component.items())  # nothing is joined that true links don't join
    assert all(c <= i for i, c in component.items())


def test_keep_one_and_empty(spark, odd_docs):
    text = " ".join(f"w{i * i % 83}x{i}" for i in range(300))
    extra = [(100 + i, text if i % 2 else text.replace("x4 ", "y4 ", 1), "en", "s", 1) for i in range(12)]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, odd_docs.schema))
    clash = docs.withColumn("key", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("root", F.lit(3))
    kept = near_texts.keep_one(clash)
    assert kept.columns == clash.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert [x for x in ids if x is not None and x >= 100] == [100]
    assert ids.count(None) == docs.where("doc_id IS NULL").count()
    assert near_texts.near_classes(docs.limit(0)).count() == 0
    assert near_texts.keep_one(docs.limit(0)).count() == 0
