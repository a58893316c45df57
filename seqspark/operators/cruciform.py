"""Cruciform DNA: perfect inverted repeats with a short spacer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_motifs
from seqspark.operators.repeats import best_arms, chosen_arms

CLASS = "Cruciform DNA"
MIN_ARM, MAX_ARM, MAX_SPACER, MIN_SCORE = 10, 100, 5, 2.0
# Arms of 10 and 11 score 1 at most, so seeds can be as long as the shortest arm that counts.
SEED = 12


def _rate(arm, spacer, _):
    total = 2 * arm + spacer
    score = np.select([arm >= 100, arm >= 70, arm >= 50, arm >= 30, arm >= 20, arm >= 15, arm >= 12], [8.0, 7, 6, 5, 4, 3, 2], 1)
    score = score + np.select([total >= 60, total >= 40], [2, 1], 0) - np.select([spacer >= 11, spacer >= 4, spacer >= 1], [3, 2, 1], 0)
    return score, score >= MIN_SCORE


def cruciform_candidates(seqs: DataFrame) -> DataFrame:
    """Per start the longest arm (then the smallest spacer) that reaches the score limit."""
    return best_arms(seqs, SEED, MAX_SPACER, MAX_ARM, True, _rate, one_a_start=True)


def find_inverted(part: Part) -> dict:
    return chosen_arms(part.bases, part.starts, SEED, MAX_SPACER, MAX_ARM, True, _rate)


FINDERS = {"inverted": find_inverted}


def cruciform(seqs: DataFrame | Located) -> DataFrame:
    """The best candidates without overlaps, chosen in the task that holds their sequence."""
    chosen = located(seqs, "inverted", find_inverted).withColumnRenamed("size", "arm")
    return as_motifs(
        chosen, CLASS, "Cruciform DNA [IR]/HairPin [IR]", F.col("score"), "PerfectInvertedRepeat",
        detail=F.concat(F.lit("Arms="), F.col("arm")), spacer=F.col("spacer"),
        attrs={
            "Arm_Length": F.col("arm"),
            "AT_Fraction": F.round(S.fraction(F.expr("substring(motif, 1, arm)"), "AT"), 3),
        },
    )
