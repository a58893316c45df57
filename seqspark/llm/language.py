"""Language of words in code-switched text by a linear-chain conditional random field, and of whole texts by it.

A word's score for each language is the sum of learned weights of its features: prefixes, suffixes, letter n-grams,
the word itself and the lexicons of the languages. Learned transitions join neighbouring words, and forward-backward
gives each word its probabilities. A text's language is the one with the largest sum over its words.

Words of many texts form one chain, in which the first word of a text forgets what came before. The chain is cut
into about as many blocks as a block has words: numpy multiplies the blocks' transition matrices side by side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.llm.shared import slices

_WORD = re.compile(r"[^\W\d_]+")
#: Distinct words whose scores a worker remembers before it starts anew.
REMEMBERED = 500_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # feature buckets x languages
    transitions: np.ndarray  # languages x languages, log scale
    start: np.ndarray
    lexicon: dict[str, int]  # word to language

    def features(self, word: str) -> list[int]:
        """Buckets of the features of a word."""
        marked = f"<{word}>"
        names = [f"w{word}"]
        names += [f"p{word[:k]}" for k in (1, 2, 3, 4) if k <= len(word)]
        names += [f"s{word[-k:]}" for k in (1, 2, 3, 4) if k <= len(word)]
        names += [f"g{marked[i:i + k]}" for k in (2, 3) for i in range(len(marked) - k + 1)]
        if word in self.lexicon:
            names.append(f"l{self.lexicon[word]}")
        return [zlib.crc32(x.encode()) % len(self.weights) for x in names]

    def scores(self, words: list[str]) -> np.ndarray:
        rows = [self.features(w) for w in words]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(counts.sum()))
        if not len(flat):
            return np.zeros((0, len(self.langs)))
        sums = np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts, axis=0)
        return sums / np.sqrt(counts)[:, None]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def forward_backward(
    scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (words x languages), and expected transition counts, of a chain of texts.

    `first` marks the first word of each text.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    long = max(1, round(n**0.5))
    blocks = -(-n // long)
    unary = np.ones((blocks * long, k))
    unary[:n] = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -60, 0))
    new = np.ones(blocks * long, bool)
    new[:n] = first
    new[0] = True
    unary, new = unary.reshape(blocks, long, k), new.reshape(blocks, long)
    step, begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    any_new = new.any(axis=0)

    def advance(state: np.ndarray, t: int) -> np.ndarray:
        """State row vectors, one more word on."""
        out = state @ step
        if any_new[t]:
            fresh = new[:, t]
            out[fresh] = state[fresh].sum(axis=-1, keepdims=True) * begin
        return out

    # The product of each block's matrices, then the state in which each block begins and ends.
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(long):
        product = advance(product, t) * unary[:, t, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((blocks, k)), np.empty((blocks, k))
    enter[0] = 1 / k
    for b in range(1, blocks):
        x = enter[b - 1] @ product[b - 1]
        enter[b] = x / x.sum()
    leave[-1] = 1 / k
    for b in range(blocks - 1, 0, -1):
        x = product[b] @ leave[b]
        leave[b - 1] = x / x.sum()
    alpha, beta = np.empty((long, blocks, k)), np.empty((long, blocks, k))
    state = enter
    for t in range(long):
        state = _normal(advance(state, t) * unary[:, t])
        alpha[t] = state
    state = leave
    for t in range(long - 1, -1, -1):
        beta[t] = state
        ahead = unary[:, t] * state
        state = ahead @ step.T
        if any_new[t]:
            fresh = new[:, t]
            state[fresh] = (ahead[fresh] @ begin)[:, None]
        state = _normal(state)
    order = lambda x: x.transpose(1, 0, 2).reshape(-1, k)[:n]
    alpha, beta = order(alpha), order(beta)
    # Pairs of neighbours within a text.
    inner = np.flatnonzero(~new.reshape(-1)[:n])
    before, after = alpha[inner - 1], order(unary.transpose(1, 0, 2))[inner] * beta[inner]
    weight = ((before @ step) * after).sum(axis=1, keepdims=True)
    return _normal(alpha * beta), step * ((before / weight).T @ after)


def train(
    texts: list[str], langs: list[str], buckets: int = 1 << 17, rounds: int = 25, rate: float = 0.3, decay: float = 1e-3,
    seed: int = 3,
) -> Model:
    """A model from whole texts and their languages.

    The texts are cut into stretches of 3 to 40 words, dealt in seeded random order and joined by eights into
    training texts, so that transitions are learned from text which switches. Full-batch Adam on log-likelihood.
    """
    names = sorted(set(langs))
    k, rng = len(names), np.random.default_rng(seed)
    model = Model(names, np.zeros((buckets, k)), np.zeros((k, k)), np.zeros(k), {})
    stretches: list[tuple[list[str], int]] = []
    counts: dict[str, np.ndarray] = {}
    for text, lang in zip(texts, langs):
        words, y, at = [w for w in words_of(text) if has_letter(w)], names.index(lang), 0
        for w in words:
            counts.setdefault(w, np.zeros(k))[y] += 1
        while at < len(words):
            n = int(rng.integers(3, 41))
            stretches.append((words[at:at + n], y))
            at += n
    if not stretches:
        return model
    # The lexicon: words seen five times or more, nine of ten times in one language.
    model.lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() >= 0.9 * c.sum()}
    order = rng.permutation(len(stretches))
    chain = [w for i in order for w in stretches[i][0]]
    y = np.repeat([stretches[i][1] for i in order], [len(stretches[i][0]) for i in order])
    first = np.zeros(len(chain), bool)
    starts = np.cumsum([0, *(len(stretches[i][0]) for i in order[:-1])])
    first[starts[::8]] = True
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain))}
    number = np.fromiter(map(vocabulary.__getitem__, chain), np.int64, len(chain))
    rows = [model.features(w) for w in vocabulary]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
    begins, scale = np.cumsum(sizes) - sizes, 1 / np.sqrt(sizes)[:, None]
    truth = np.zeros((len(chain), k))
    truth[np.arange(len(chain)), y] = 1
    inner = np.flatnonzero(~first)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[inner - 1], y[inner]), 1)
    parts = [model.weights, model.transitions, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for r in range(1, rounds + 1):
        emit = np.add.reduceat(model.weights[flat], begins, axis=0) * scale
        p, expected = forward_backward(emit[number], first, model.transitions, model.start)
        miss = truth - p
        by_word = np.stack([np.bincount(number, miss[:, j], minlength=len(rows)) for j in range(k)], axis=1) * scale
        spread = np.repeat(by_word, sizes, axis=0)
        grads = [
            np.stack([np.bincount(flat, spread[:, j], minlength=buckets) for j in range(k)], axis=1),
            pairs - expected, miss[first].sum(axis=0),
        ]
        for part, grad, (m, v) in zip(parts, grads, moments):
            grad = grad / len(chain) - decay * part / len(chain)
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            part += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return model


class Labeller:
    """Scores by distinct word, and labels of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))
        self.real = np.zeros(0, bool)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word, and whether it has a letter."""
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if missing.size:
            if len(self.number) > REMEMBERED:
                self.__init__(self.model)
                return self.scores(words)
            new = list(dict.fromkeys(words[i] for i in missing))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.table = np.concatenate([self.table, self.model.scores(new)])
            self.real = np.concatenate([self.real, np.fromiter(map(has_letter, new), bool, len(new))])
            found[missing] = np.fromiter(map(self.number.get, (words[i] for i in missing)), np.int64, missing.size)
        return self.table[found], self.real[found]

    def words(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, the number of the text of each word, and each word's probabilities."""
        split = [words_of(x) for x in texts]
        flat = [w for words in split for w in words]
        scores, real = self.scores(flat)
        if not real.all():
            split = [[w for w in words if has_letter(w)] for words in split]
            scores = scores[real]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        text = np.repeat(np.arange(len(split)), sizes)
        first = np.ones(len(text), bool)
        first[1:] = text[1:] != text[:-1]
        p, _ = forward_backward(scores, first, self.model.transitions, self.model.start)
        return split, text, p


#: Languages whose counts are small enough to broadcast.
BROADCAST_LANGS = 100_000


def fit(docs: DataFrame, held_out: str, per_lang: int = 150, most_bytes: int = 64 << 20, **training: float) -> Model:
    """A model from a bounded sample: about `per_lang` whole documents of every language, `most_bytes` of text in all.

    `docs` has doc_id, text and lang; rows for which the SQL condition `held_out` holds, or without text or
    language, are not used. The sample is taken by hash of doc_id, so it is the same every time. Every language has
    an equal share of the bytes; its documents are taken in the order of their hash until that is used up, the first
    one always. Repeated rows count as often as they occur. Without a usable row the model knows no language.
    """
    usable = docs.where(f"NOT ({held_out})").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = usable.groupBy("lang").agg(F.count("*").alias("of_lang"))
    langs = counts.count()
    share = most_bytes // max(1, langs)
    if langs <= BROADCAST_LANGS:  # else Spark chooses
        counts = F.broadcast(counts)
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.join(counts, "lang").where(part < F.lit(1.0 * per_lang) / F.col("of_lang"))
    before = Window.partitionBy("lang").orderBy(part, "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    sample = sample.select("doc_id", "lang", "text", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).alias("bytes_before"))
    rows = sample.where(F.col("bytes_before") < share).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **training)


def _text_langs(model: Model):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        k = max(1, len(model.langs))
        for batch in slices(batches, "text"):
            n = batch.num_rows
            langs, scores, switches = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
            if model.langs:
                split, text, p = labeller.words(batch.column("text").to_pylist())
                sums = np.stack([np.bincount(text, p[:, j], minlength=n) for j in range(k)], axis=1)
                best = sums.argmax(axis=1)
                sizes = np.bincount(text, minlength=n)
                langs = [model.langs[b] if s else "und" for b, s in zip(best, sizes)]
                scores = np.where(sizes > 0, sums[np.arange(n), best] / np.maximum(sizes, 1), 0.0).clip(0, 1)
                word = p.argmax(axis=1)
                change = np.flatnonzero((word[1:] != word[:-1]) & (text[1:] == text[:-1])) + 1
                switches = np.bincount(text[change], minlength=n)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()),
                pa.array(scores, pa.float64()), pa.array(switches, pa.int64()),
            ], names=["doc_id", "held_out", "lang_pred", "score", "n_switches"])
    return label


HELD_OUT = "crc32(coalesce(cast(doc_id AS string), '')) % 4 = 2"


def predict_language(docs: DataFrame, model: Model, held_out: str = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_switches (changes of language between words) of every whole text.

    A null text, or one without a letter, is `und` with score 0, as every text is if the model knows no language; of
    equal scores the first language in order counts. Only the text is used, so repeated rows have equal results and
    other columns are ignored; an empty table gives no row. No shuffle.
    """
    few = docs.selectExpr("cast(doc_id AS long) AS doc_id", f"({held_out}) AS held_out", "cast(text AS string) AS text")
    return few.mapInArrow(_text_langs(model), "doc_id long, held_out boolean, lang_pred string, score double, n_switches long")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and `spans`: stretches of words of one language, as (lang, words, score), in order."""
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.string()), ("score", pa.float64())]))
        for batch in slices(batches, "text"):
            split, _, p = labeller.words(batch.column("text").to_pylist())
            out, at = [], 0
            for words in split:
                own, runs = p[at:at + len(words)], []
                at += len(words)
                best = own.argmax(axis=1)
                cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(words)] if words else []
                for a, b in zip(cuts, cuts[1:]):
                    runs.append({"lang": model.langs[best[a]], "words": " ".join(words[a:b]), "score": float(own[a:b, best[a]].mean())})
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    few = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return few.mapInArrow(spans, "doc_id long, spans array<struct<lang: string, words: string, score: double>>")
