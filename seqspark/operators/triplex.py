"""Triplex DNA: homopurine or homopyrimidine mirror repeats and GAA/TTC repeats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators.intervals import greedy
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_motifs, union
from seqspark.operators.repeats import best_arms, chosen_folds

CLASS = "Triplex"
MIN_ARM, MAX_ARM, MAX_SPACER = 10, 100, 12
# Arms of 10 need a loop of 5 for the shortest total and then score 21 at most.
SEED = MIN_ARM + 1
MIN_TOTAL, MIN_SCORE = 25, 25.0
PATHOGENIC_COPIES = 59


def best_first():
    return [F.desc("score"), F.desc("length"), F.asc("start_pos"), F.asc("subtype")]


def _rate(arm, spacer, rich):
    total = 2 * arm + spacer
    score = arm + 1.5 * rich - 0.8 * spacer + (total >= 50)
    return score, (10 * rich >= 9 * arm) & (total >= MIN_TOTAL) & (score >= MIN_SCORE)


def hdna_candidates(seqs: DataFrame) -> DataFrame:
    """Mirror repeats with pure arms that reach the length and score limits, the best for each start and end.

    Both arms of a letterwise mirror have the same composition, so both are purine-rich or both
    are pyrimidine-rich. Of candidates with the same start and end only the best can ever be chosen.
    """
    return best_arms(seqs, SEED, MAX_SPACER, MAX_ARM, False, _rate, one_a_start=False).withColumn("score", F.round("score", 6))


def find_mirrors(part: Part) -> dict:
    return chosen_folds(part.bases, part.starts, SEED, MAX_SPACER, MAX_ARM, False, _rate)


def find_sticky(part: Part) -> dict:
    """Six or more copies of GAA or TTC."""
    return part.rows(np.concatenate([part.arrays(unit, 6) for unit in ("GAA", "TTC")]))


FINDERS = {"mirrors": find_mirrors, "sticky": find_sticky}


def hdna(seqs: DataFrame | Located) -> DataFrame:
    """The best candidates without overlaps, chosen in the task that holds their sequence."""
    chosen = located(seqs, "mirrors", find_mirrors).withColumnRenamed("size", "arm").withColumn("score", F.round("score", 6))
    left = F.expr("substring(motif, 1, arm)")
    purity = F.greatest(S.purine_fraction(left), S.pyrimidine_fraction(left))
    return as_motifs(
        chosen, CLASS, "Triplex", F.col("score"), "MirrorArms",
        detail=F.concat(F.lit("Arms="), F.col("arm")), spacer=F.col("spacer"),
        attrs={"Arm_Length": F.col("arm"), "Homogeneity": F.round(purity, 3)},
    )


def sticky_dna(seqs: DataFrame | Located) -> DataFrame:
    """Six or more GAA or TTC copies; pathogenic from 59 copies."""
    rows = located(seqs, "sticky", find_sticky)
    copies = (F.length("motif") / 3).cast("int")
    at = S.fraction("motif", "AT")
    return as_motifs(
        rows, CLASS, "sticky DNA", copies * (1.0 + 0.3 * at), "TripletCopies",
        detail=F.concat(F.lit("Unit="), F.substring("motif", 1, 3), F.lit(";Copies="), copies),
        attrs={
            "RepeatCount": copies,
            "AT_Fraction": F.round(at, 3),
            "Pathogenic": copies >= PATHOGENIC_COPIES,
        },
    )


def triplex_and_sticky(seqs: DataFrame) -> DataFrame:
    """Mirror repeats first, then sticky DNA where nothing is in the way."""
    both = union([hdna(seqs), sticky_dna(seqs)])
    return greedy(both, [F.desc(F.col("subtype") == "Triplex")] + best_first(), overlap="shared_end")
