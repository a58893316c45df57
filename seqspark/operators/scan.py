"""Row-local pattern scans with exact positions.

A regex engine returns the matches of a pattern but not where they are.  ``split`` gives the
text between the matches, so the running sum of gap and match lengths gives every position.
The fold is kept short by cutting long sequences into pieces first.  A cut is only made where
the caller's ``cut`` pattern says that no match can reach across, so a match is never split and
the left-to-right scan gives the same result as on the whole sequence.  Where no cut exists the
rest of the sequence stays in one piece.  Nothing here shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from seqspark.functions.sequence import col, matches

PIECE = 16384

#: Number of each base, -1 for other letters.
BASE_NO = np.full(256, -1, np.int8)
BASE_NO[[ord(c) for c in "ACGT"]] = range(4)

PIECES = "array<struct<offset:int,text:string>>"
HITS = "array<struct<at:int,text:string>>"


def pieces(seq, cut: str | None, size: int = PIECE) -> Column:
    """array<struct<offset, text>> of a sequence cut behind ``cut`` matches."""
    seq = col(seq)
    if cut is None:
        return F.array(F.struct(F.lit(0).alias("offset"), seq.alias("text")))
    texts = matches(seq, "(?s).{%d}.*?(?:%s)|.+" % (size, cut))
    if size > 0:
        texts = F.when(F.length(seq) <= size, F.array(seq)).otherwise(texts)
    start = F.struct(F.lit(0).alias("offset"), F.array().cast(PIECES).alias("out"))
    return F.aggregate(
        texts,
        start,
        lambda acc, t: F.struct(
            (acc["offset"] + F.length(t)).alias("offset"),
            F.concat(acc["out"], F.array(F.struct(acc["offset"].alias("offset"), t.alias("text")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def hits(text, pattern: str) -> Column:
    """array<struct<at, text>>: matches with their 0-based start inside ``text``."""
    text = col(text)
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches(text, pattern).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(HITS).alias("out"))

    def step(acc, x):
        at = acc["at"] + F.length(x["gap"])
        return F.struct(
            (at + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct(at.alias("at"), x["hit"].alias("text")))))
            .alias("out"),
        )

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def merge_hits(found, text, gap: int) -> Column:
    """Join neighbouring hits whose gap is at most ``gap``; same struct as ``hits``."""
    text = col(text)

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))
        end = last["at"] + F.length(last["text"])
        joined = F.struct(
            last["at"].alias("at"),
            F.substring(text, last["at"] + 1, x["at"] + F.length(x["text"]) - last["at"]).alias("text"),
        )
        return F.when(
            (F.size(out) > 0) & (x["at"] - F.coalesce(end, F.lit(0)) <= gap),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(found, F.array().cast(HITS), step)


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are worked out once.

    Catalyst copies the expression behind a plain column into every filter above it.  A generator
    ends that, which matters for folds over a sequence.
    """
    row = F.struct(*[v.alias(name) for name, v in values.items()])
    return df.select("*", F.inline(F.array(row)))


def unnest(df: DataFrame, keep, values, name: str = "h") -> DataFrame:
    """One row per array element.  The outer form keeps Catalyst from adding a size check that
    would work out the array a second time."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def scan_pieces(seqs: DataFrame, cut: str | None, size: int = PIECE, keep=("seq_id",)) -> DataFrame:
    return seqs.select(*keep, F.inline(pieces("sequence", cut, size)))


def scan(
    seqs: DataFrame, pattern: str, cut: str | None = None, keep=("seq_id",), merge_gap=None, size: int = PIECE
) -> DataFrame:
    """One row per match: ``keep`` columns, start_pos, end_pos (1-based, inclusive), motif.

    The fold over the matches of a piece is quadratic, so dense patterns use a small ``size``.

    A sequence without any match is dropped before it is cut up.
    """
    found = seqs.where(F.col("sequence").rlike(pattern))
    cut_up = scan_pieces(found, cut, size, keep=keep)
    spans = hits("text", pattern)
    if merge_gap is not None:
        spans = merge_hits(spans, "text", merge_gap)
    rows = unnest(cut_up, [*keep, "offset"], spans)
    start = F.col("offset") + F.col("h.at") + 1
    return rows.select(
        *keep,
        start.alias("start_pos"),
        (start + F.length("h.text") - 1).alias("end_pos"),
        F.col("h.text").alias("motif"),
    )


#: Letters worked out at a time, and rows of a batch that leaves a task.
PART, ROWS = 1 << 20, 1 << 16


def base_runs(seqs: DataFrame, keep=("seq_id",)) -> DataFrame:
    """Maximal runs of one base: base, start_pos, length.

    A small step on Arrow batches finds where the letter changes; the sequence stays behind.
    """
    keep = list(keep)

    def step(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column("sequence")).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, a = np.cumsum(sizes), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PART, side="right")))
                part = batch.slice(a, b - a)
                yield from runs(part, part.column("sequence").to_pylist())
                a = b

    def runs(part, texts):
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        # one byte for each letter, also for one that is none of ASCII
        letters = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)
        opens = np.append(True, letters[1:] != letters[:-1])
        opens[starts[:-1][starts[:-1] < len(letters)]] = True
        first = np.flatnonzero(opens)
        size = np.diff(np.append(first, len(letters))).astype(np.int32)
        known = BASE_NO[letters[first]]
        some = known >= 0
        first, size, known = first[some], size[some], known[some]
        row = np.searchsorted(starts, first, side="right") - 1
        for a in range(0, len(first), ROWS):
            cut = slice(a, a + ROWS)
            base = pa.DictionaryArray.from_arrays(pa.array(known[cut]), pa.array(list("ACGT"))).dictionary_decode()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(row[cut])) for c in keep), base,
                 pa.array((first[cut] - starts[row[cut]] + 1).astype(np.int32)), pa.array(size[cut])],
                names=[*keep, "base", "start_pos", "length"])

    fields = [P.StructField(c, seqs.schema[c].dataType) for c in keep]
    schema = P.StructType(fields + [
        P.StructField("base", P.StringType()), P.StructField("start_pos", P.IntegerType()), P.StructField("length", P.IntegerType())])
    return seqs.where(F.length("sequence") > 0).select(*keep, "sequence").mapInArrow(step, schema)
