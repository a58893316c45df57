"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

1. Words are counted in tasks, by document and then by batch, so that a shuffle has a row for each task and word.
2. Of two near words the shorter (or either, if as long) is cut into two disjoint chunks. One edit leaves one of them
   whole, and moves it by one place at most; the other word sends all its grams that can be that chunk, with their
   places. A chunk alone is shared by thousands of words ("tion"), so the part that the edit is in is cut in two
   again, and one of these is whole as well: a key is a chunk, a half of the other one, and their places. No key
   groups many words, and no link is lost.
3. Words join on equal keys; pairs are verified in the join, and counted once.
4. Each word takes its commonest near word; roots are found by doubling the paths of forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import slices, stored

#: Words of a task that are held before they are sent.
HELD = 400_000


def counted_words(docs: DataFrame, least_length: int = 6, one_in: int = 199) -> DataFrame:
    """word and n of the runs of letters in `docs` (doc_id, text), after the planned misspelling of one in `one_in`.

    Letters are A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased. Where `one_in` divides h, the crc32 of
    "<doc_id>:<run>", code point h % length of the run is deleted. Words under `least_length` are left out.
    """
    # U+00C0 to U+00FF are the byte C3 and another one. Runs shorter than the least length can't become longer.
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def send() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                # bytes.lower() takes A-Z only
                found = Counter(run.findall((text or "").encode().lower()))
                base = zlib.crc32((doc_id or "").encode() + b":")
                for word in list(found):
                    h = zlib.crc32(word, base)
                    if h % one_in == 0:
                        n, letters = found.pop(word), word.decode()
                        at = h % len(letters)
                        if len(letters) > least_length:
                            total[(letters[:at] + letters[at + 1:]).encode()] += n
                total.update(found)
            if len(total) > HELD:
                yield send()
                total.clear()
        yield send()

    few = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(word: Column, at: Column, to: Column) -> Column:
    """Code points `at` (from 0) up to `to`."""
    return F.substring(word, at + 1, to - at)


def _keys(size: Column, by: int, word: Column) -> list[Column]:
    """The keys of chunks of a word of `size` code points, read from `word`, which is `by` longer.

    A chunk before the edit has its place as it is; one after it is moved by `by`. For the word itself `by` is 0.
    """
    middle = F.floor(size / 2).cast("int")
    first, last = F.floor(middle / 2).cast("int"), (middle + F.floor((size - middle) / 2)).cast("int")
    ends = {"a": (F.lit(0), first), "b": (first, middle), "c": (middle, last), "d": (last, size)}
    # The chunk that is whole, with the half of the other one that is; what comes after the edit is moved.
    whole = [("ab", "c", "d"), ("ab", "d", "c"), ("cd", "a", "b"), ("cd", "b", "a")]
    keys = []
    for k, (chunk, half, edited) in enumerate(whole):
        parts = [F.lit(str(k)), size.cast("string")]
        for name in sorted(chunk + half):
            low, high = ends[name]
            move = by if name > edited else 0
            parts.append(_cut(word, low + move, high + move))
        keys.append(F.concat_ws(" ", *parts))
    return keys


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: both ways for every two of `words` (word, n) that exactly one edit tells apart.

    An edit is a code point inserted, deleted or replaced. `words` must be distinct and free of spaces.
    """
    size, word = F.length("word"), F.col("word")
    chunks = words.select("word", "n", F.explode(F.array(*_keys(size, 0, word))).alias("key"))
    same = [F.struct(k.alias("key"), F.lit(0).alias("longer")) for k in _keys(size, 0, word)]
    longer = [F.struct(k.alias("key"), F.lit(1).alias("longer")) for k in _keys(size - 1, 1, word)]
    grams = words.select(word.alias("other"), F.col("n").alias("other_n"), F.explode(F.array(*same, *longer)).alias("gram")).select(
        "other", "other_n", F.col("gram.key").alias("key"), F.col("gram.longer").alias("longer"))
    # Of two words of one length either comes as the first once.
    pairs = chunks.join(grams, "key").where(
        ((F.col("longer") == 1) | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    pairs = pairs.select("word", "n", "other", "other_n").distinct()
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(back)


def roots_of(forms: DataFrame) -> DataFrame:
    """word and root for `forms` (word, form): forms are followed to the last. Each round doubles the steps taken."""
    ahead = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(ahead.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")), "roots")
        ahead = step.select("word", "root")
        if step.where("moved").isEmpty():
            return ahead


def spelling_variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs` (doc_id, text) with `least` occurrences.

    Words are those of `counted_words`. Two are near if one edit tells them apart. form is a word's near word of
    largest n (ties: smallest in code-point order) if that is at least `times` its own n, else null; root follows the
    forms to the last. Null texts have no words and a null doc_id counts as empty; repeated rows count each time. An
    empty table gives no row; other columns are not read.
    """
    words = stored(counted_words(docs, least_length).where(F.col("n") >= least), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    all_ = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")).select(
        "word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")), "forms")
    roots = roots_of(all_.where("form IS NOT NULL"))
    return all_.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
