"""Exact copies against brute force, with a weak digest, and over several runs of the stream."""

import hashlib
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from seqspark.llm import stream_dedup
from tests.llm.conftest import ODD


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(plain(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        group = groups[plain(text)]
        best = min(group)
        out.append((doc_id, None if best[1] else best[2], len(group), best[3] == i, hashlib.sha256(plain(text).encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def written(spark, rows, parts=1):
    path = "file://" + tempfile.mkdtemp(prefix="docs-") + "/documents.parquet"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int")
    df.coalesce(parts).write.parquet(path)
    return path


ROWS = [*enumerate(ODD), *((100 + i, t) for i, t in enumerate(ODD)), (200, "a  b c"), (201, "ab\tc "), (3, "a b c"), (3, "a b c"),
        (None, "zz"), (None, "zz"), (300, " z z"), (301, " z z"), *((400 + i, "hot text") for i in range(60))]


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(spark, weak):
    digest = (lambda c: F.substring(stream_dedup.sha256(c), 1, 1).substr(1, 1)) if weak else stream_dedup.sha256
    if weak:  # only a few bits of the digest count, so different texts share it
        digest = lambda c: F.unhex(F.hex(F.crc32(c) % 3))
    got = stream_dedup.exact_copies(spark, written(spark, ROWS), digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(ROWS), key=key)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_empty_table(spark):
    assert stream_dedup.exact_copies(spark, written(spark, [])).count() == 0


def test_many_hits_are_joined(spark, monkeypatch):
    monkeypatch.setattr(stream_dedup, "MOST_BROADCAST", 0)
    got = stream_dedup.exact_copies(spark, written(spark, ROWS, 3))
    assert got.where("kept").count() == len({plain(t) for _, t in ROWS})


def test_state_lasts_over_runs(spark):
    path, checkpoint = written(spark, ROWS), "file://" + tempfile.mkdtemp(prefix="state-")
    stream_dedup.take_in(spark, path, checkpoint)
    more = [(1000, "hot text"), (1001, "hot  text "), (1002, "new")]
    spark.createDataFrame(more, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    stream_dedup.take_in(spark, path, checkpoint)
    state = stream_dedup.state_of(spark, checkpoint)
    found = {r["kept"]["doc_id"]: r["n"] for r in state.collect()}
    assert found[1001] == 62 and found[1002] == 1 and sum(found.values()) == len(ROWS) + 3
    assert state.count() == len({plain(t) for _, t in ROWS}) + 1
