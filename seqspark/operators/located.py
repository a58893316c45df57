"""What the detectors look for, found in one pass over the sequences.

A finder is a small Python step on a part of some sequences: it gives places and a few numbers, by running sums and
regular expressions.  All finders of a detection read the same part, so a sequence is made and handed over once, not
once for each detector.  What they find is small next to the sequences; scores, rules and selection are Spark columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from seqspark.operators.repeats import CODE, ROWS, _parts
from seqspark.sources.stored import stored

FIELDS = {
    "kind": "string", "start_pos": "int", "end_pos": "int", "motif": "string", "rest": "string", "size": "int",
    "copies": "int", "spacer": "int", "score": "double",
}
ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
#: Characters that "." of a Java pattern does not match, which Python's does.
LINE_ENDS = {ord(c): "\n" for c in "\r\u0085\u2028\u2029"}


class Part:
    """Some sequences, also as one text with a line break behind each, which no pattern used here can match."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.places = np.concatenate([[0], np.cumsum(sizes + 1)])

    @cached_property
    def text(self) -> str:
        text = "\n".join(self.texts) + "\n"
        return text if text.isascii() and "\r" not in text else text.translate(LINE_ENDS)

    @cached_property
    def letters(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("ascii", "replace"), np.uint8)

    @cached_property
    def raw(self) -> np.ndarray:
        """The letters without line breaks; ``starts`` says where each sequence begins."""
        return np.frombuffer("".join(self.texts).encode("ascii", "replace"), np.uint8)

    @cached_property
    def bases(self) -> np.ndarray:
        return CODE[self.raw]

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, length and letter of every run of one letter."""
        at = np.flatnonzero(np.append(True, self.letters[1:] != self.letters[:-1]))
        return at, np.diff(np.append(at, len(self.letters))), self.letters[at]

    def runs_of(self, bases: str, least: int) -> tuple[np.ndarray, np.ndarray]:
        at, size, letter = self.runs
        some = np.flatnonzero((size >= least) & np.isin(letter, np.frombuffer(bases.encode(), np.uint8)))
        return at[some], size[some]

    @cached_property
    def unknown(self) -> np.ndarray:
        """How many letters before each place are none of A, C, G, T."""
        known = np.zeros(256, bool)
        known[[ord(c) for c in "ACGT"]] = True
        return np.concatenate([[0], np.cumsum(~known[self.letters])])

    def upto(self, base: str) -> np.ndarray:
        """How many times ``base`` comes before each place."""
        return np.concatenate([[0], np.cumsum(self.letters == ord(base))])

    def ramp(self, plus: str, minus: str) -> np.ndarray:
        """Ramp scores summed up to each place: base number k of a run counts min(k, 4), negative for ``minus``."""
        at, size, letter = self.runs
        sign = (letter == ord(plus)).astype(np.int8) - (letter == ord(minus))
        step = np.minimum(np.arange(1, len(self.letters) + 1) - np.repeat(at, size), 4) * np.repeat(sign, size)
        return np.concatenate([[0], np.cumsum(step)])

    def spans(self, pattern: str) -> np.ndarray:
        """First place and the place behind the last, of all hits from left to right."""
        return np.array([m.span() for m in re.finditer(pattern, self.text)], np.int64).reshape(-1, 2)

    def arrays(self, unit: str, least: int) -> np.ndarray:
        """The hits of (?:unit){least,}."""
        text, seed, more, out = self.text, unit * least, re.compile("(?:%s)*" % unit).match, []
        at = text.find(seed)
        while at >= 0:
            end = more(text, at).end()
            out.append((at, end))
            at = text.find(seed, end)
        return np.array(out, np.int64).reshape(-1, 2)

    def merged(self, spans: np.ndarray, gap: int) -> np.ndarray:
        """Neighbouring hits at most ``gap`` letters apart, of one sequence, as one."""
        row = np.searchsorted(self.places, spans[:, 0], side="right")
        opens = (spans[1:, 0] - spans[:-1, 1] > gap) | (row[1:] != row[:-1])
        first = np.flatnonzero(np.append(True, opens)[:len(spans)])
        return np.stack([spans[first, 0], spans[np.append(first[1:], len(spans))[:len(first)] - 1, 1]], axis=1)

    def grouped(self, at, end, gap: int) -> np.ndarray:
        """Number of the group of each stretch; a known stretch of at most ``gap`` bases joins it to the one before."""
        joins = (at[1:] - end[:-1] <= gap) & (self.unknown[at[1:]] == self.unknown[end[:-1]])
        return np.concatenate([[0], np.cumsum(~joins)])[:len(at)]

    def rows(self, spans: np.ndarray, **more) -> dict:
        """Places in the whole text as columns of `locate`."""
        row = np.searchsorted(self.places, spans[:, 0], side="right") - 1
        return {"row": row, "start": spans[:, 0] - self.places[row], "end": spans[:, 1] - self.places[row], **more}


Finder = Callable[[Part], dict]


class Located:
    """What all finders of a detection have found in some sequences, stored."""

    def __init__(self, seqs: DataFrame, finders: dict[str, Finder], keep=("seq_id",)):
        self.rows = stored(locate(seqs, finders, keep), "located")


def locate(seqs: DataFrame, finders: dict[str, Finder], keep=("seq_id",)) -> DataFrame:
    """One row for everything found: ``keep`` columns, kind (the name of its finder), start_pos, end_pos (1-based,
    inclusive), motif and what else the finder tells."""
    keep = list(keep)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column("sequence").to_pylist()
            part, found = Part(texts), []
            for kind, finder in finders.items():
                hit = finder(part)
                row, start, end = (hit[c].astype(np.int64) for c in ("row", "start", "end"))
                if not len(row):
                    continue
                spans = list(zip(row.tolist(), start.tolist(), end.tolist()))
                tail = hit.get("tail")
                given = {
                    "kind": [kind] * len(row), "start_pos": start + 1, "end_pos": end,
                    "motif": [texts[r][a:b] for r, a, b in spans],
                    "rest": hit.get("rest") if tail is None else [texts[r][b:b + tail] for r, _, b in spans],
                    **{c: hit.get(c) for c in ("size", "copies", "spacer", "score")},
                }
                columns = [batch.column(c).take(pa.array(row)) for c in keep]
                for name, type_ in FIELDS.items():
                    values = given[name]
                    if values is None:
                        columns.append(pa.nulls(len(row), ARROW[type_]))
                    elif type_ == "int":
                        columns.append(pa.array(np.asarray(values).astype(np.int32)))
                    else:
                        columns.append(pa.array(values, ARROW[type_]))
                found.append(pa.RecordBatch.from_arrays(columns, names=[*keep, *FIELDS]))
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches(max_chunksize=ROWS)

    fields = [P.StructField(c, seqs.schema[c].dataType) for c in keep]
    schema = P.StructType(fields + [P.StructField(c, P.DoubleType() if t == "double" else P.IntegerType() if t == "int" else P.StringType()) for c, t in FIELDS.items()])
    return seqs.where(F.length("sequence") > 0).select(*keep, "sequence").mapInArrow(step, schema)


def located(source: DataFrame | Located, kind: str, finder: Finder, keep=("seq_id",)) -> DataFrame:
    """What one finder finds, read back where it has been stored."""
    if isinstance(source, Located):
        return source.rows.where(F.col("kind") == kind).select(*keep, *list(FIELDS)[1:])
    return locate(source, {kind: finder}, keep).drop("kind")
