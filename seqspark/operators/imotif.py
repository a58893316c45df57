"""i-motif family: canonical and relaxed i-motifs and AC-motifs."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators import scan as T
from seqspark.operators.intervals import greedy
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_motifs, union
from seqspark.operators.triplex import best_first

CLASS = "i-motif family"
SEED = "C+.{1,12}C+.{1,12}C+.{1,12}C+"
SEED_CUT = "[AGT]{13}"

# Tried in this order.
AC_PATTERNS = ["C{3,}[AC]{6,}C{3,}", "(?:AC|CA){6,}", "A{3,}[AC]{6,}C{3,}"]


#: What the first four runs of a hit must be, where it has no unknown base.
FIRST_RUNS = re.compile("(?:C{3,}+[AGT]{1,12}+){3}C{3}")


def find_seeds(part: Part) -> dict:
    """Hits of the seed whose first four runs are long enough, loops short enough."""
    spans = part.spans(SEED)
    odd = part.unknown[spans[:, 1]] > part.unknown[spans[:, 0]]
    good = [x or FIRST_RUNS.match(part.text, a, b) is not None for x, (a, b) in zip(odd.tolist(), spans.tolist())]
    return part.rows(spans[np.array(good, bool)])


def find_ac_islands(part: Part) -> dict:
    """Stretches of A and C of twelve or more that hold CCC."""
    ac = np.isin(part.letters, np.frombuffer(b"AC", np.uint8))
    edge = np.flatnonzero(np.diff(ac, prepend=False))  # the text ends with a line break
    spans = edge.reshape(-1, 2)
    spans = spans[spans[:, 1] - spans[:, 0] >= 12]
    return part.rows(spans[np.array(["CCC" in part.text[a:b] for a, b in spans.tolist()], bool)])


def find_ac_pairs(part: Part) -> dict:
    """Hits of the second pattern that hold CCC, as all must."""
    islands = find_ac_islands(part)
    start = part.places[islands["row"]]
    # possessive, so that no turn of the group is taken back
    pairs, out = re.compile(AC_PATTERNS[1] + "+"), []
    for a, b in zip((start + islands["start"]).tolist(), (start + islands["end"]).tolist()):
        out += [m.span() for m in pairs.finditer(part.text, a, b) if "CCC" in m[0]]
    return part.rows(np.array(out, np.int64).reshape(-1, 2))


FINDERS = {"imotif_seeds": find_seeds, "ac_islands": find_ac_islands, "ac_pairs": find_ac_pairs}


def _hits(source, kind: str) -> DataFrame:
    return located(source, kind, FINDERS[kind]).select("seq_id", "start_pos", "end_pos", "motif")


def imotif_candidates(seqs: DataFrame | Located) -> DataFrame:
    """Four C runs: the seed cut down to its first four runs, with loop and score rules."""
    rows = _hits(seqs, "imotif_seeds")
    rows = T.computed(rows.where(F.col("motif").contains("CCC")), parts=S.matches("motif", "C+|[AGT]+"))
    rows = T.computed(rows.where(F.size("parts") >= 7), first=F.slice("parts", 1, 7)).drop("parts")
    rows = rows.withColumnRenamed("first", "parts")
    size = lambda i: F.length(F.try_element_at("parts", F.lit(i)))
    runs3 = (size(1) >= 3) & (size(3) >= 3) & (size(5) >= 3) & (size(7) >= 3)
    longest = F.greatest(size(2), size(4), size(6))
    rows = rows.where(runs3 & (longest <= 12))
    rows = rows.withColumn("motif", F.array_join("parts", "")).withColumn("loops", F.array(size(2), size(4), size(6)))
    rows = rows.withColumn("end_pos", F.col("start_pos") + F.length("motif") - 1)
    rows = T.computed(rows, mean=S.imotif_score("motif"))
    subtype = F.when((longest <= 7) & (F.col("mean") >= 0.45), "Canonical i-motif").when(
        (longest > 7) & (F.col("mean") >= 0.30), "Relaxed i-motif"
    )
    rows = rows.withColumn("subtype", subtype).where(F.col("subtype").isNotNull())
    factor = S.structural_factor("motif", "i-motif", "loops")
    return rows.withColumn("factor", factor).withColumn(
        "score", F.col("mean") * F.greatest(F.lit(1.0), F.col("factor"))
    )


def imotifs(seqs: DataFrame) -> DataFrame:
    rows = as_motifs(
        imotif_candidates(seqs), CLASS, F.col("subtype"), F.col("score"), "CRampWindowMean",
        attrs={
            "iMotif_Mean": F.round("mean", 6), "Structural_Factor": F.round("factor", 3),
            "C_Fraction": F.round(S.fraction("motif", "C"), 3),
            "Loop_Lengths": F.array_join(F.transform("loops", lambda l: l.cast("string")), ","),
        },
    )
    return greedy(rows, [F.asc("subtype")] + best_first(), overlap="shared_end")


def _between(islands: DataFrame, opening: str) -> DataFrame:
    """In each island of A and C the stretch from the first ``opening`` to the last CCC, of 12 bases or more.

    That is the one hit of opening{3,}[AC]{6,}C{3,} in an island, found without backtracking.
    """
    first = F.instr("motif", opening * 3)
    last = F.length("motif") - F.instr(F.reverse("motif"), "CCC") + 1
    found = (first > 0) & F.col("motif").contains("CCC") & (last - first >= 11)
    rows = islands.where(found).withColumn("_first", first).withColumn("_last", last)
    start = F.col("start_pos") + F.col("_first") - 1
    return rows.select(
        "seq_id", start.alias("start_pos"), (F.col("start_pos") + F.col("_last") - 1).alias("end_pos"),
        F.expr("substring(motif, _first, _last - _first + 1)").alias("motif"),
    )


def ac_candidates(seqs: DataFrame) -> DataFrame:
    """Hits of the three patterns that reach 15 bases, have CCC and score 10 or more."""
    islands = _hits(seqs, "ac_islands")
    rows = [_between(islands, "C"), _hits(seqs, "ac_pairs"), _between(islands, "A")]
    out = None
    for number, found in enumerate(rows, start=1):
        found = found.withColumn("pattern_no", F.lit(number))
        out = found if out is None else out.unionByName(found)
    out = out.where((F.length("motif") >= 15) & (S.fraction("motif", "AC") >= 0.6) & F.col("motif").contains("CCC"))
    return out.withColumn("score", S.ac_motif_score("motif")).where(F.col("score") >= 10.0)


def ac_motifs(seqs: DataFrame) -> DataFrame:
    """Earlier patterns win, then the leftmost hit."""
    rows = ac_candidates(seqs)
    a3, c3 = S.n_matches("motif", "A{3,}"), S.n_matches("motif", "C{3,}")
    motifs = as_motifs(
        rows, CLASS, "AC-motif", F.col("score"), "ACContentRuns",
        detail=F.concat(F.lit("A3="), a3, F.lit(";C3="), c3),
        attrs={
            "AC_Fraction": F.round(S.fraction("motif", "AC"), 3), "A3_Runs": a3, "C3_Runs": c3,
            "Pattern_No": F.col("pattern_no"),
        },
    )
    return greedy(motifs, [F.asc(F.col("attrs")["Pattern_No"]), F.asc("start_pos")], overlap="shared_end")


def imotif_and_ac(seqs: DataFrame) -> DataFrame:
    """Canonical before relaxed before AC-motif."""
    rank = F.when(F.col("subtype") == "Canonical i-motif", 1).when(F.col("subtype") == "Relaxed i-motif", 2).otherwise(3)
    rows = union([imotifs(seqs), ac_motifs(seqs)]).withColumn("_rank", rank)
    return greedy(rows, [F.asc("_rank")] + best_first(), overlap="shared_end").drop("_rank")
