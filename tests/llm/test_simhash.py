"""Fingerprints, runs, components and links against brute force."""

import random

import numpy as np
import pytest
import xxhash

from seqspark.llm import runs, simhash
from seqspark.llm.components import components, spanning_links
from tests.llm.conftest import ODD


def plain_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", data) if w]
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_fingerprints():
    texts = [*ODD, "one", "A b C d", "a  b\tc D e F g h " * 40]
    assert simhash.fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]
    assert len(simhash.masks(2)) == 2081 == len(set(simhash.masks(2).tolist()))


@pytest.mark.parametrize("low", [2, 5])
def test_runs_round_trip(low):
    rng = np.random.default_rng(low)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    got = [int(np.uint64(r << (16 + 8 * low)) | x) for r, _, d in runs.runs_of(np.sort(runs.sent(keys, 3, low)), 1, low) for x in runs.unpacked_run(d, low)]
    assert got == sorted(runs.sent(keys, 3, low).tolist())
    assert list(runs.runs_of(keys[:0], 1, low)) == []
    chosen = np.sort(keys[:70])
    assert runs.among(keys, chosen).tolist() == np.isin(keys, chosen).tolist()


def test_later_and_repeated():
    rng = np.random.default_rng(5)
    some = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (30, 0, 20, 25, 1, 40, 13)]
    seen, everything = set(), np.concatenate(some).tolist()
    for run, (later, shared), repeated in zip(some, runs._later(some), runs._repeated(some)):
        assert run[shared].tolist() == repeated.tolist()
        assert run[later].tolist() == [x for x in run.tolist() if x in seen]
        assert repeated.tolist() == [x for x in run.tolist() if everything.count(x) > 1]
        seen |= set(run.tolist())


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(50)]
    nodes = {x for p in links for x in p}
    expected = {x: r for x, r in roots_of(nodes, links).items() if x != r}
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == expected
    node, root = spanning_links(*np.array(links).T)
    assert dict(zip(node.tolist(), root.tolist())) == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_planted_fingerprints(spark):
    rnd = random.Random(9)
    fps = {0}
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(rnd.randrange(12)):  # chains of changes of 1 to 5 bits
            for b in rnd.sample(range(64), rnd.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = {int(np.uint64(x).astype(np.int64)) for x in fps}
    unsigned = {s: s % 2**64 for s in signed}
    linked = [(a, b) for a in signed for b in signed if a < b and (unsigned[a] ^ unsigned[b]).bit_count() <= 4]
    old, simhash.BLOCK = simhash.BLOCK, 64
    try:
        out = simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))
        found = [(r["a"], r["b"]) for r in out.collect()]
    finally:
        simhash.BLOCK = old
    assert roots_of(signed, found) == roots_of(signed, linked)


def test_near_duplicates(spark, odd_docs):
    text = " ".join(f"w{i * i % 83}" for i in range(300))
    extra = [(100 + i, text if i % 2 else text.replace("w4 ", "x4 ", i % 3), "en", "s", 1) for i in range(12)]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, odd_docs.schema))
    rows = docs.collect()
    fp = [plain_fingerprint(r["text"]) for r in rows]
    linked = [(a, b) for a in set(fp) for b in set(fp) if a < b and (a ^ b).bit_count() <= 4]
    root = roots_of(set(fp), linked)
    least = {}
    for r, f in zip(rows, fp):
        if r["doc_id"] is not None:
            least[root[f]] = min(least.get(root[f], 10**9), r["doc_id"])
    expected = sorted((str(r["doc_id"]), f"{f:016x}", str(least.get(root[f]))) for r, f in zip(rows, fp))
    found = simhash.near_duplicates(docs.repartition(3)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in found) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
