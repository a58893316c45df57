"""Encoding, token files and packing against the libraries applied to whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seqspark.llm import packing, pieces, token_output, tokens
from seqspark.llm.packing import Queue, mixture_phases
from seqspark.llm.shared import ChunkTable
from seqspark.llm.tokens import ChunkEncoder, encode_texts
from tests.llm.conftest import ODD


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    ids, bounds = encode_texts(P.path(name), ODD)
    for text, a, b in zip(ODD, bounds, bounds[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_chunk_table_starts_anew():
    table = ChunkTable(lambda chunks: [[len(c)] * 2 for c in chunks], most=6)
    for chunks in (["a", "bb"], ["ccc", "a"], ["dddd"]):
        ids, _ = table.texts([chunks])
        assert ids.tolist() == [len(c) for c in chunks for _ in range(2)]


def test_pieces(spark, odd_docs):
    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    expected = sorted((r["doc_id"], len(ids := sp.encode(r["text"] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for r in odd_docs.collect() if r["doc_id"] is not None)
    found = [tuple(r) for r in pieces.piece_digests(odd_docs, model).collect()]
    assert sorted(r for r in found if r[0] is not None) == expected
    assert {r["doc_id"]: r["ids"] for r in pieces.encoded(odd_docs, model).collect()}[5] == sp.encode("a b c")
    assert pieces.piece_digests(odd_docs.limit(0), model).count() == 0


def test_token_files(spark, odd_docs):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = odd_docs.where("doc_id is not null").repartition(5)
    at, expected = 0, []
    for doc_id, text in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        expected.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in token_output.token_digests(docs, path).collect()) == expected
    assert token_output.token_digests(docs.limit(0), path).count() == 0


def test_token_files_can_be_read_in_part(spark, odd_docs, tmp_path):
    out = f"file://{tmp_path}/tokens"
    token_output.write_tokens(odd_docs, out, P.path("byte_bpe_50k.json"))
    meta = token_output.read_tokens(spark, out, ids=False)
    assert meta.columns == ["doc_id", "start", "n_tokens"] and meta.count() == odd_docs.count()
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString()


def check_packing(docs, out, size, tokenizer):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    rows, sequences = defaultdict(list), defaultdict(list)
    for r in out.collect():
        rows[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(rows) == set(texts)
    for doc_id, ids in texts.items():
        if len(ids) == 1:
            at = 0
            for r in sorted(rows[doc_id], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids[0]) and r["ids_crc32"] == crc(ids[0][at:at + r["length"]])
                at += r["length"]
            assert at == len(ids[0])
        else:
            assert sum(r["length"] for r in rows[doc_id]) == sum(map(len, ids))
    total = sum(len(i) for ids in texts.values() for i in ids)
    assert sorted(sequences) == list(range(-(-total // size)))
    for number, found in sequences.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at == (size if number < total // size else total % size)


@pytest.mark.parametrize("size,targets", [(64, None), (4096, None), (64, {"src0": 1.0, "src1": 5.0}), (7, {"src2": 0.5})])
def test_packing(spark, odd_docs, size, targets):
    path = P.path("word_bpe_49k.json")
    out = packing.pack(odd_docs.repartition(4), path, size=size, targets=targets)
    check_packing(odd_docs, out, size, Tokenizer.from_file(path))


def test_packing_of_nothing(spark, odd_docs):
    assert packing.pack(odd_docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_windows_hold_the_mixture():
    totals, size = {"=a": 50_000, "=b": 20_000, "=c": 5}, 100
    phases = mixture_phases(totals, {"=a": 3, "=b": 1}, size)
    by_window = defaultdict(dict)
    for name, own in phases.items():
        queue = Queue([dict(zip(packing.FIELDS, p)) for p in own], size)
        got = list(queue.pieces(0, totals[name]))
        assert sum(n for _, n, _, _ in got) == totals[name]
        for _, n, window, _ in got:
            by_window[window][name] = by_window[window].get(name, 0) + n
    assert all(sum(x.values()) == size for w, x in by_window.items() if w < 700)
    assert all(abs(by_window[w]["=a"] - 75) <= 1 for w in range(600))


def test_joined_words_skip_what_lower_case_letters_do_not_need():
    """Chunks that are joined go through no normalizer and no pattern; the ids are those of the whole tokenizer."""
    path = P.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), ChunkEncoder(path)
    assert encoder.plain.normalizer is None and encoder.tokenizer.normalizer is not None
    words = ["été", "straße", "ÿß", "zu", "ªº", "don't", "x1", "a-b", "ĳ", "é"] * 50
    assert encoder(words) == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    texts = ["ab-cd, Été.x' l'été don't 'll x're", "aб é ab­ y\xa0z", "\x1cab\x1f a1b2, _a"]
    ids, bounds = encode_texts(path, texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cuts_part_texts_as_the_patterns_do(name):
    encoder = ChunkEncoder(P.path(name))
    rnd, some = random.Random(5), [*"aZé×÷ÄßÞµ .,!\n\t-'x1€Ł", "\xa0", "  ", " \n ", "ab", "ab."]
    texts = ["".join(rnd.choice(some[:-9] if i % 2 else some) for _ in range(rnd.randrange(0, 14))) for i in range(3000)]
    plain = [x for x in texts if max(x, default="") < "Ā" and "\xa0" not in x]
    lower = [x.lower() if encoder.word_level else x for x in plain]
    data = np.frombuffer("".join(lower).encode(), np.uint8)
    starts, ends = tokens.cuts(data, np.cumsum([0, *(len(x.encode()) for x in lower)]), encoder.word_level)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == [c for x in plain for c in tokens.chunks_of(encoder, x)]
    ids, bounds = encode_texts(P.path(name), pa.array([None, *texts], pa.string())[1:])
    tokenizer = Tokenizer.from_file(P.path(name))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
