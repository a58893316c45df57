"""Exact encoding with public tokenizers by distinct chunk, between places that no token can cross."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from seqspark.llm.shared import WHITE, ChunkTable

WHITESPACE = re.compile(f"[{WHITE}]")
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Letters before marks that end a word: both tokenizers part them, so a word is one chunk with and without marks.
_ENDED = f"[{_LATIN}]++(?=[.,;:!?|#$%&*]+(?:[{WHITE}]|\\Z))"
#: A run of non-space with the one space before it; else white space as the byte-level pattern splits it.
_BYTE_LEVEL = re.compile(f" ?{_ENDED}| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The word-level tokenizer drops white space and parts letters from all that is none, so letters end where ASCII follows.
_WORD_LEVEL = re.compile(f"[{_LATIN}]++(?![^\\x00-\\x7f])|[^{WHITE}]+")
_LOWER = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: Chunks that are encoded as one text.
JOINED = 400


class ChunkEncoder:
    """Ids of chunks. Many are joined to one text, whose ids are dealt back by the bytes that each token stands for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = self.plain = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.word_level = settings["normalizer"] is not None
        if self.word_level:  # joined chunks are lower-case Latin letters: nothing to normalise, parted by spaces alone
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [x["content"] for x in settings["added_tokens"]]
        # Both vocabularies write one character for a byte, but for the mark of a word's end.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token.removesuffix("</w>") if self.word_level else token)

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(chunks)
        alone, joined = [], []
        for i, c in enumerate(chunks):
            (joined if self._plain(c) else alone).append(i)
        groups = [joined[i:i + JOINED] for i in range(0, len(joined), JOINED)]
        between = " " if self.word_level else ""
        for group, found in zip(groups, self._ids(self.plain, [between.join([chunks[i] for i in g]) for g in groups])):
            upto = np.cumsum(self.bytes[found])
            ends = np.cumsum([len(x) if (x := chunks[i]).isascii() else len(x.encode()) for i in group])
            cuts = np.searchsorted(upto, ends) + 1
            if len(upto) == cuts[-1] and np.array_equal(upto[cuts - 1], ends):
                for i, a, b in zip(group, [0, *cuts.tolist()], cuts.tolist()):
                    out[i] = found[a:b]
            else:
                alone += group
        for i, ids in zip(alone, self._ids(self.tokenizer, [chunks[i] for i in alone])):
            out[i] = ids
        return out

    def _ids(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, chunk: str) -> bool:
        """Whether the chunk keeps its bytes and its borders beside other such chunks."""
        if self.word_level:
            return _LOWER.fullmatch(chunk) is not None
        return chunk[0] == " " and len(chunk) > 1 and not WHITESPACE.match(chunk, 1)


@lru_cache(maxsize=4)
def table(path: str) -> tuple[ChunkEncoder, ChunkTable]:
    """Encoder and chunk table of the tokenizer file at `path`, once per worker."""
    encoder = ChunkEncoder(path)
    return encoder, ChunkTable(encoder)


def forget_chunks(path: str) -> None:
    """Gives back the memory of the worker's table for the tokenizer file at `path`."""
    table(path)[1].clear()
    pa.default_memory_pool().release_unused()


def chunks_of(encoder: ChunkEncoder, text: str | None) -> list[str]:
    """A text that holds the string of a special token is one chunk, since that may join what it touches."""
    if not text:
        return []
    lower = text
    if encoder.word_level and (text.isascii() or max(text) < "\u0100"):  # lower case is then the tokenizer's own
        lower = text.lower()
    if any(x in lower for x in encoder.special):
        return [text]
    return (_WORD_LEVEL if encoder.word_level else _BYTE_LEVEL).findall(lower)


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SPACE, _MARK = _flags("\t\n\x0b\x0c\r "), _flags(".,;:!?|#$%&*")
_LETTER = _flags("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _odd(encoder: ChunkEncoder, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts that `cuts` cannot take: with the string of a special token, other white space or, for words, wider letters."""
    wide = (data >= 0xC4) if encoder.word_level else (data >= 0xE1) & (data <= 0xE3)
    two = np.flatnonzero(data == 0xC2)
    places = [np.flatnonzero(wide), two[np.isin(data[two + 1], (0x85, 0xA0))]]
    whole = data.tobytes()
    for x in encoder.special:
        at = whole.find(x := x.encode())
        while at >= 0:
            places.append(np.array([at]))
            at = whole.find(x, at + 1)
    return np.unique(np.searchsorted(bounds, np.concatenate(places), "right") - 1)


def cuts(data: np.ndarray, bounds: np.ndarray, word_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin and end in texts laid one after another, as the two patterns above part them."""
    n = len(data)
    space, letter = _SPACE[data], _LETTER[data]
    two = np.flatnonzero(data == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    letter[two] = letter[two + 1] = True
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True
    edge = np.ones(n + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge |= begins
    start = np.flatnonzero(edge[:-1] & ~space)
    end = np.flatnonzero(edge[1:] & ~space) + 1
    others = np.append(np.flatnonzero(~letter), n)
    if word_level:  # letters at the beginning, if ASCII follows
        split = np.minimum(others[np.searchsorted(others, start)], end)
        split = split[(split > start) & (split < end)]
        split = split[data[split] < 0x80]
        return np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
    cut = begins[:-1]
    cut[end[end < n]] = True
    after = ~begins[start]
    cut[start[after] - 1] = True
    cut[start[after][data[start[after] - 1] != 0x20]] = True
    marked = _MARK[data[end - 1]]  # letters, then marks to the end
    start, end = start[marked], end[marked]
    split = others[np.searchsorted(others, start)]
    plain = np.append(np.flatnonzero(~_MARK[data]), n)
    first = plain[np.searchsorted(plain, split)]
    cut[split[(split > start) & (split < end) & (first >= end)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)[:len(starts)]


def encode_texts(path: str, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of `texts` one after another, and where each text's ids begin (the last entry: where they end)."""
    encoder, table_ = table(path)
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null("")

    def laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        data = _LOWERED[data] if encoder.word_level else data
        return data, bounds - bounds[0]

    data, bounds = laid(texts)
    odd = _odd(encoder, data, bounds)
    apart = [chunks_of(encoder, texts[int(i)].as_py()) for i in odd]
    if len(odd):
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        data, bounds = laid(pa.compute.if_else(pa.array(mask), "", texts))
    if encoder.word_level:
        data = data.copy()
        second = np.flatnonzero(data == 0xC3) + 1
        second = second[(data[second] <= 0x9E) & (data[second] != 0x97)]
        data[second] += 0x20
    starts, ends = cuts(data, bounds, encoder.word_level)
    # Chunks and what lies between them, in turn.
    offsets = np.stack([starts, ends], 1).reshape(-1).astype(np.int32)
    offsets = np.append(offsets, offsets[-1:])
    chunks = pa.StringArray.from_buffers(2 * len(starts), pa.py_buffer(offsets), pa.py_buffer(data)) if len(starts) else pa.array([], pa.string())
    chunks = chunks.take(pa.array(np.arange(0, len(chunks), 2))).dictionary_encode()
    found = chunks.dictionary.to_pylist()
    numbers = table_.numbers(found + [x for one in apart for x in one])
    counts = np.diff(np.searchsorted(starts, bounds))
    flat = numbers[:len(found)][chunks.indices.to_numpy(zero_copy_only=False)] if len(found) else numbers[:0]
    if len(odd):
        sizes = np.fromiter(map(len, apart), np.int64, len(apart))
        text = np.concatenate([np.repeat(np.arange(len(texts)), counts), np.repeat(odd, sizes)])
        flat = np.concatenate([flat, numbers[len(found):]])[np.argsort(text, kind="stable")]
        counts[odd] = sizes
    return table_.ids_of(flat, counts)
