"""Z-DNA (maximal-sum alternating segments) and extruded-G CGG repeats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators import scan as T
from seqspark.operators.intervals import greedy
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_motifs, union
from seqspark.operators.triplex import best_first

CLASS = "Z-DNA"
MIN_TRANSITIONS, MIN_SUM = 12, 50.0


@dataclass(frozen=True)
class Weights:
    """Weights of one base-to-base step; the defaults are fixed values.

    ``weak_run`` is added to ``weak`` for the 1st, 2nd, ... AT/TA step in a row; its last value
    stays.  A streak of mismatches costs ``mismatch`` for its first step; every further one costs
    ``mismatch_step`` more (linear) or twice the one before (exponential).
    """

    strong: float = 7.0
    medium: float = 1.25
    weak: float = 0.5
    weak_run: tuple[float, ...] = (0.5, 0.5, 0.5, 0.0, 0.0, -5.0, -100.0)
    mismatch: float = 3.0
    mismatch_step: float = 3.0
    mode: str = "linear"

    def __post_init__(self):
        if self.mode not in ("linear", "exponential") or self.mismatch < 0 or self.mismatch_step < 0 or not self.weak_run:
            raise ValueError(self)

    def weak_at(self, streak) -> Column:
        """Weight of the ``streak``-th weak step in a row."""
        out = F.lit(self.weak + self.weak_run[-1])
        for i in range(len(self.weak_run) - 1, 0, -1):
            out = F.when(streak <= i, F.lit(self.weak + self.weak_run[i - 1])).otherwise(out)
        return out

    def mismatch_at(self, streak) -> Column:
        """Weight of the ``streak``-th mismatch in a row."""
        if self.mode == "linear":
            return -(self.mismatch + self.mismatch_step * (streak - 1))
        return -(self.mismatch * F.pow(F.lit(2.0), streak - 1))

    def run_cost(self, n: np.ndarray) -> np.ndarray:
        """What the ``n - 1`` mismatches inside a run of ``n`` purines or pyrimidines cost."""
        if self.mode == "linear":
            return self.mismatch * (n - 1) + self.mismatch_step * (n - 1) * (n - 2) / 2.0
        # 2**1000 is more than any sum, and no infinity
        return self.mismatch * (2.0 ** np.minimum(n - 1, 1000) - 1)


DEFAULT = Weights()

def step_weights(seqs: DataFrame, weights: Weights = DEFAULT) -> DataFrame:
    """One row per base-to-base step: pos (1-based), step, weight.

    Steps are written as one letter per class, so a streak is one regex match and the streak
    number is the place inside it.  Long sequences are cut at a strong step, which ends every
    streak; each piece takes the first base of the next one along.
    """
    rows = seqs.where(F.length("sequence") >= 2).select(
        "seq_id", "sequence", F.inline(T.pieces("sequence", "G(?=C)|C(?=G)"))
    )
    rows = rows.withColumn("text", F.expr("substring(sequence, offset + 1, length(text) + 1)"))
    rows = rows.where(F.length("text") >= 2)
    dinucs = S.windows("text", 2)
    kinds = F.array_join(
        F.transform(
            dinucs,
            lambda d: F.when(d.isin("GC", "CG"), "s").when(d.isin("GT", "TG", "AC", "CA"), "m")
            .when(d.isin("AT", "TA"), "w").otherwise("x"),
        ),
        "",
    )
    values = F.flatten(
        F.transform(
            S.matches(kinds, "s+|m+|w+|x+"),
            lambda r: F.transform(
                S.span(F.lit(1), F.length(r)),
                lambda k: F.when(r.startswith("s"), F.lit(weights.strong)).when(r.startswith("m"), F.lit(weights.medium))
                .when(r.startswith("w"), weights.weak_at(k)).otherwise(weights.mismatch_at(k).cast("double")),
            ),
        )
    )
    rows = rows.select("seq_id", "offset", F.posexplode(F.arrays_zip(dinucs.alias("step"), values.alias("weight"))))
    return rows.select(
        "seq_id", (F.col("offset") + F.col("pos") + 1).alias("pos"), F.col("col.step"), F.col("col.weight")
    )


#: One bit for each base; an unknown base has none and so makes a mismatch with every other.
BIT = np.zeros(256, dtype=np.uint8)
BIT[[ord(c) for c in "AGCT"]] = [1, 2, 4, 8]
PURINES, PYRIMIDINES, WEAK, STRONG = 3, 12, 9, 6
#: Runs that are lists of Python numbers at a time.
RUNS = 1 << 16


def _runs(bases: np.ndarray, starts: np.ndarray, weights: Weights):
    """Start of each run without a step between purine and pyrimidine, weight of the step to it, cost of its mismatches.

    A sequence begins with a run of its own, and its last run costs all that is left.
    """
    a, b = bases[:-1], bases[1:]
    opens = np.zeros(len(bases), bool)
    opens[1:] = ((a & PURINES != 0) & (b & PYRIMIDINES != 0)) | ((a & PYRIMIDINES != 0) & (b & PURINES != 0))
    opens[starts[:-1]] = True
    head = np.flatnonzero(opens)
    begins = np.zeros(len(head) + 1, bool)
    begins[np.searchsorted(head, starts)] = True
    n = np.diff(np.append(head, len(bases)))
    pair = bases[head - 1] | bases[head]
    weak = (pair == WEAK) & ~begins[:-1]
    # a weak step goes on with a streak if the run before it is a single base
    place = np.arange(len(head))
    first = weak & ~np.append(False, weak[:-1] & (n[:-1] == 1))
    streak = place - np.maximum.accumulate(np.where(first, place, 0)) + 1
    table = np.array([weights.weak + x for x in weights.weak_run])
    weight = np.where(pair == STRONG, weights.strong, weights.medium)
    weight = np.where(weak, table[np.minimum(streak, len(table)) - 1], np.where(begins[:-1], 0.0, weight))
    return head, weight, np.where(begins[1:], np.inf, weights.run_cost(n))


def _segments(head: np.ndarray, weight: np.ndarray, cost: np.ndarray, least: float, transitions: int):
    """First and last base behind a step, and sum, of the segments: a left fold over runs.

    Steps inside a run are mismatches and only lower the sum, steps between runs never are, so the fold needs one round
    per run. The sum is reset when it is not above zero; a segment is the best prefix between two resets.
    """
    out, total, best, first, last = [], 0.0, 0.0, 0, 0
    for a in range(0, len(head), RUNS):
        for at, w, c in zip(*(x[a:a + RUNS].tolist() for x in (head, weight, cost))):
            raised = total + w
            if total > 0:
                if raised > best:
                    best, last = raised, at
            else:
                first, best = at, 0.0
                if raised > 0:
                    best, last = raised, at
            total = raised - c
            if total <= 0:
                total = 0.0
                if best >= least and last - first + 1 >= transitions:
                    out.append((first, last, best))
    return out


def _promising(head: np.ndarray, weight: np.ndarray, cost: np.ndarray, least: float) -> np.ndarray:
    """Mask of the runs between two resets of `_segments` if the sum between them reaches ``least``.

    A sum that never falls below zero is a running sum less its lowest value. That holds exactly for quarters only, so
    all runs are kept where weights are none.
    """
    ends = np.isinf(cost)
    cost = np.where(ends, weight.clip(0).sum() + 1.0, cost)
    upto = np.cumsum(weight - cost)
    if (weight * 4 % 1).any() or (cost * 4 % 1).any() or not np.abs(upto).max(initial=0) < 2.0 ** 50:
        return np.ones(len(head), bool)
    total = upto - np.minimum(np.minimum.accumulate(upto), 0.0)
    between = np.concatenate([[0], np.cumsum(total == 0)[:-1]])[:len(head)]
    kept = np.zeros(len(head) + 1, bool)
    kept[between[np.append(0.0, total[:-1])[:len(head)] + weight >= least]] = True
    return kept[between]


def find_segments(part: Part, weights: Weights = DEFAULT, least: float = MIN_SUM, transitions: int = MIN_TRANSITIONS) -> dict:
    """Segments of all sequences with their sum as score."""
    runs = _runs(BIT[part.raw], part.starts, weights)
    kept = _promising(*runs, least)
    found = np.array(_segments(*(x[kept] for x in runs), least, transitions)).reshape(-1, 3)
    first, last = found[:, 0].astype(np.int64), found[:, 1].astype(np.int64)
    row = np.searchsorted(part.starts, first, side="right") - 1
    # the run start is the base behind the step
    return {"row": row, "start": first - part.starts[row] - 1, "end": last - part.starts[row] + 1, "score": found[:, 2]}


def find_cgg(part: Part) -> dict:
    """Blocks of three or more CGG copies, joined where at most three bases apart."""
    return part.rows(part.merged(part.arrays("CGG", 3), 3))


FINDERS = {"segments": find_segments, "cgg": find_cgg}


def _called(structural_factor, conservation) -> tuple[Column | None, dict[str, Column]]:
    """The factor on the score, at least 1, and the attributes that the two callbacks give for ``motif``."""
    attrs, factor = {}, None
    if structural_factor is not None:
        value = F.coalesce(structural_factor(F.col("motif")).cast("double"), F.lit(1.0))
        factor, attrs["Structural_Factor"] = F.greatest(F.lit(1.0), value), F.round(value, 3)
    if conservation is not None:
        found = conservation(F.col("motif"))
        attrs["Conservation_Score"] = F.coalesce(found["enrichment_score"].cast("double"), F.lit(0.0))
        attrs["Conservation_P_Value"] = F.coalesce(found["p_value"].cast("double"), F.lit(1.0))
        attrs["Conservation_Significance"] = F.coalesce(found["significance"], F.lit(""))
    return factor, attrs


def zdna(
    seqs: DataFrame | Located, weights: Weights = DEFAULT, threshold: float = MIN_SUM, min_transitions: int = MIN_TRANSITIONS,
    min_length: int = 13, structural_factor: Callable[[Column], Column] | None = None,
    conservation: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Maximal segments with sum >= ``threshold`` over at least ``min_transitions`` steps and ``min_length`` bases.

    ``structural_factor`` makes a number of the motif column; where above 1, it multiplies the score.
    ``conservation`` makes a struct (enrichment_score, p_value, significance) of it, kept in attrs. Both
    are column expressions, so they stay in the plan; their nulls count as 1 and as "not known".

    The fold is a small step on Arrow batches, one round for each run of purines or pyrimidines, and its time and
    memory grow with the sequence.
    """
    plain = (weights, threshold, min_transitions) == (DEFAULT, MIN_SUM, MIN_TRANSITIONS)
    if isinstance(seqs, Located) and not plain:
        raise ValueError("segments are stored for the default weights and limits only")
    rows = located(seqs, "segments", partial(find_segments, weights=weights, least=threshold, transitions=min_transitions))
    if min_length > min_transitions + 1:
        rows = rows.where(F.length("motif") >= min_length)
    factor, called = _called(structural_factor, conservation)
    return as_motifs(
        rows, CLASS, "Z-DNA", F.col("score") if factor is None else F.col("score") * factor, "MaximalSum",
        attrs={
            "GC_Content": F.round(S.fraction("motif", "GC"), 3),
            "GC_CG_Dinucleotides": S.n_matches("motif", "G(?=C)|C(?=G)"),
            **called,
        },
    )


EGZ_CUT = "(?:(?!CGG)[ACGT]){8}"


def egz(
    seqs: DataFrame | Located, max_gap: int = 3, min_repeats: int = 3, merge_adjacent: bool = True,
    structural_factor: Callable[[Column], Column] | None = None, conservation: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``min_repeats`` or more CGG copies; blocks at most ``max_gap`` apart are joined where ``merge_adjacent``.

    The callbacks are those of ``zdna``.
    """
    if (max_gap, max(1, min_repeats), merge_adjacent) == (3, 3, True):
        rows = located(seqs, "cgg", find_cgg)
    else:
        # a cut of eight bases without CGG never parts blocks that would be joined
        cut = EGZ_CUT if max_gap <= 3 or not merge_adjacent else None
        rows = T.scan(seqs, "(?:CGG){%d,}" % max(1, min_repeats), cut=cut, merge_gap=max_gap if merge_adjacent else None)
    factor, called = _called(structural_factor, conservation)
    copies = F.floor(F.length("motif") / 3).cast("int")
    g = S.fraction("motif", "G")
    return as_motifs(
        rows, CLASS, "eGZ (Extruded-G) DNA", copies * (1.0 + 2.0 * g) * (1.0 if factor is None else factor), "CGGCopies",
        detail=F.concat(F.lit("Unit=CGG;Copies="), copies),
        attrs={"CGG_Repeats": copies, "G_Fraction": F.round(g, 3), **called},
    )


def zdna_and_egz(seqs: DataFrame) -> DataFrame:
    """Z-DNA first; eGZ first in a sequence where more than half of all triplet slots are CGG."""
    n = F.length("sequence")
    rich = (n - F.length(F.replace("sequence", F.lit("CGG"), F.lit("")))) / 3 / F.greatest(F.floor(n / 3), F.lit(1)) > 0.5
    marked = seqs.select("seq_id", rich.alias("cgg_rich"))
    both = union([zdna(seqs), egz(seqs)]).join(marked, "seq_id")
    first = F.when(F.col("cgg_rich"), F.col("subtype") != "Z-DNA").otherwise(F.col("subtype") == "Z-DNA")
    return greedy(both.withColumn("first", first), [F.desc("first")] + best_first(), overlap="shared_end").drop(
        "first", "cgg_rich"
    )
