"""Encoding and decoding with a sentencepiece model by distinct chunk.

No piece holds a white-space marker after another character, so a marked word (markers, then other characters)
is segmented the same alone as in its text. Each distinct marked word of a worker's texts is segmented and decoded
once and its ids are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from seqspark.llm.shared import ChunkTable, slices

MARK = "▁"
_MARKED = re.compile(" +[^ ]*")


class PieceTable(ChunkTable):
    """A chunk table that also keeps, by chunk, the ids as text and the decoded text."""

    def __init__(self, model: str, most: int = 3_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        if any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.vocab_size())):
            raise ValueError("a piece of this model crosses a white-space marker")
        super().__init__(self._encode, most)

    def clear(self) -> None:
        super().clear()
        self.written: list[str] = []
        self.decoded: list[str] = []

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        alone = self.model.piece_to_id(MARK)
        # Encoding puts one marker before its text: the first of the chunk.
        ids = [[alone] if c == " " else x for c, x in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1))]
        self.written += [",".join(map(str, x)) for x in ids]
        # Decoding drops the first marker.
        self.decoded += [" " + x for x in self.model.decode(ids, num_threads=1)]
        return ids


@lru_cache(maxsize=2)
def table(model: str) -> PieceTable:
    return PieceTable(model)


def marked_words(text: str | None) -> list[str]:
    """The text with its leading marker, cut before each run of markers (written as spaces)."""
    return _MARKED.findall(" " + text.replace(MARK, " ")) if text else []


def encode_decode(model: str, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, str]]:
    """For each text: its ids, the ids as decimal text joined by commas, and the decoded text."""
    pieces = table(model)
    chunked = [marked_words(x) for x in texts]
    numbers = pieces.numbers([c for chunks in chunked for c in chunks])
    at = 0
    for chunks in chunked:
        own = numbers[at:at + len(chunks)].tolist()
        at += len(chunks)
        yield (
            numbers[at - len(chunks):at], ",".join(map(pieces.written.__getitem__, own)),
            "".join(map(pieces.decoded.__getitem__, own))[1:],
        )


def _digest(model: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, written, decoded = [], [], []
            for own, ids, text in encode_decode(model, batch.column("text").to_pylist()):
                counts.append(int(table(model).length[own].sum()))
                written.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(written), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
    return digest


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; a null text counts as empty. No shuffle.

    Other columns, also such with clashing names, are ignored; repeated rows each give a row.
    """
    few = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return few.mapInArrow(_digest(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the ids of its text, as array<int>."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pieces = table(model)
            ids, bounds = pieces.texts([marked_words(x) for x in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    few = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return few.mapInArrow(encode, "doc_id long, ids array<int>")
