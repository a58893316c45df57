"""Curved DNA: phased A/T tract arrays (global) and long isolated tracts (local)."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators import scan as T
from seqspark.operators.intervals import greedy
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_motifs, union

CLASS = "Curved DNA"
MIN_TRACT, LOCAL_TRACT = 4, 7
MIN_SPACING, MAX_SPACING = 6, 15
MIN_COUNT, MIN_SCORE = 3, 4.0

# Two tracts of four or more with sixteen tract-free bases between them have centres more than
# MAX_SPACING apart, so no chain of tracts reaches across such a stretch.
TRACT_GAP = 15

#: Bases of a batch that leaves a task.
BYTES = 4 << 20


def poly_at_tracts(seqs: DataFrame, min_len: int = LOCAL_TRACT, keep=("seq_id",)) -> DataFrame:
    """Contiguous A or T runs of at least ``min_len``."""
    return T.scan(seqs, "A{%d,}|T{%d,}" % (min_len, min_len), cut="A(?=[^A])|T(?=[^T])|[CG]", keep=keep)


def find_tracts(part: Part) -> dict:
    """Stretches of neighbouring tracts that hold enough of them for an array, or a long one."""
    at, size = part.runs_of("AT", MIN_TRACT)
    group = part.grouped(at, at + size, TRACT_GAP)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    if not len(first):
        return part.rows(np.zeros((0, 2), np.int64))
    last = np.append(first[1:], len(at)) - 1
    some = (last - first + 1 >= MIN_COUNT) | (np.maximum.reduceat(size, first) >= LOCAL_TRACT)
    return part.rows(np.stack([at[first], (at + size)[last]], axis=1)[some])


FINDERS = {"tracts": find_tracts}


def _tract_groups(seqs: DataFrame | Located) -> DataFrame:
    """One row per stretch of neighbouring tracts: seq_id, offset, text."""
    return located(seqs, "tracts", find_tracts).select("seq_id", (F.col("start_pos") - 1).alias("offset"), F.col("motif").alias("text"))


def _phase(spacing: int) -> float:
    """`S.phase_term` of a number."""
    x = (spacing - 10.5) / 3.0
    return max(0.0, 1.0 - x * x)


PHASE = {spacing: _phase(spacing) for spacing in range(MIN_SPACING, MAX_SPACING + 1)}


def _chain(tracts, i: int):
    """The chain that starts at tract ``i``: number of tracts, their bases, phase, last base."""
    first, last, centre = tracts[i]
    n, bases, phase = 1, last - first + 1, 0.0
    for s, e, c in islice(tracts, i + 1, None):
        spacing = c - centre
        if MIN_SPACING <= spacing <= MAX_SPACING:
            n, bases, phase, last, centre = n + 1, bases + e - s + 1, phase + PHASE[spacing], e, c
        # once three tracts are in, the first tract that does not fit ends the chain;
        # beyond MAX_SPACING nothing can fit any more
        elif n >= MIN_COUNT or spacing > MAX_SPACING:
            break
    return n, bases, phase, last


def _arrays(text: str):
    """first, last, tracts, bases, phase of every chain of three or more tracts, and of every long tract with neither
    end inside a chain (no tracts)."""
    tracts = [(m.start(), m.end() - 1, (m.start() + m.end() - 1) // 2) for m in re.finditer("A{4,}|T{4,}", text)]
    found, starts, reach = [], [], []
    for i, (s, _, _) in enumerate(tracts):
        n, bases, phase, last = _chain(tracts, i)
        if n >= MIN_COUNT:
            found.append((s, last, n, bases, phase))
            starts.append(s)
            reach.append(max(last, reach[-1]) if reach else last)
    inside = lambda x: (k := bisect_right(starts, x)) > 0 and reach[k - 1] >= x
    return found + [
        (s, e, None, None, None) for s, e, _ in tracts if e - s + 1 >= LOCAL_TRACT and not inside(s) and not inside(e)]


def _with_arrays(seqs: DataFrame | Located) -> DataFrame:
    """seq_id, start_pos, end_pos, motif, tracts, bases, phase of `_arrays`; a small step on the stretches."""
    groups = _tract_groups(seqs)
    names = ["seq_id", "start_pos", "end_pos", "motif", "tracts", "bases", "phase"]

    def step(batches):
        for batch in batches:
            texts = zip(batch.column("offset").to_pylist(), batch.column("text").to_pylist())
            rows, size = [], 0
            for row, (offset, text) in enumerate(texts):
                for s, e, *rest in _arrays(text):
                    rows.append((row, offset + s + 1, offset + e + 1, text[s:e + 1], *rest))
                    size += e - s
                    if size > BYTES:
                        yield record(batch, rows)
                        rows, size = [], 0
            if rows:
                yield record(batch, rows)

    def record(batch, rows):
        row, *columns = zip(*rows)
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [batch.column("seq_id").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kind = groups.schema["seq_id"].dataType.simpleString()
    return groups.mapInArrow(
        step, f"seq_id {kind}, start_pos int, end_pos int, motif string, tracts int, bases int, phase double")


def global_curvature(seqs: DataFrame | Located) -> DataFrame:
    """Arrays of three or more tracts with centres 6 to 15 apart, one per possible first tract."""
    score = (
        F.col("bases") / 8.0 + 1.5 * F.col("tracts") + 3.0 * F.col("phase")
        + S.length_step_bonus(F.col("end_pos") - F.col("start_pos") + 1)
    )
    rows = _with_arrays(seqs).where(F.col("tracts").isNotNull())
    rows = rows.withColumn("score", score).where(F.col("score") >= MIN_SCORE)
    return as_motifs(
        rows, CLASS, "Global curvature", F.col("score"), "PhasedTracts",
        detail=F.concat(F.lit("Tracts="), F.col("tracts")),
        spacer=F.lit(f"Spacing={MIN_SPACING}-{MAX_SPACING}"),
    )


def local_curvature(seqs: DataFrame | Located) -> DataFrame:
    """Tracts of seven or more with neither end inside a phased array."""
    rows = _with_arrays(seqs).where(F.col("tracts").isNull())
    return as_motifs(rows, CLASS, "Local Curvature", S.curvature_score("motif"), "TractCurvature")


def curved_dna(seqs: DataFrame) -> DataFrame:
    """Both kinds, best score first, without overlaps (ties: global first, then position).

    Scores count to six places: phases summed up in another order are a tie, not a better score.
    """
    both = union([global_curvature(seqs), local_curvature(seqs)])
    return greedy(both, [F.desc(F.round("score", 6)), F.asc("subtype"), F.asc("start_pos")])
