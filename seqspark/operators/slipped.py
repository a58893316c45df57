"""Slipped DNA: direct repeats and short tandem repeats."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_map, as_motifs
from seqspark.operators.repeats import best_direct, chosen_repeats

CLASS = "Slipped DNA"
STR = "Slipped DNA [STR]"
MIN_UNIT, MAX_UNIT = 8, 300
MIN_SCORE = 10.0

# With two copies the score can only reach 10 when the whole repeat has 50 bases (no spacer) or
# 100 bases (spacer 1 to 3; a wider spacer never reaches it).  Three copies need a unit of 8, so
# text[i] = text[i + d] holds for at least 16 bases.  With a spacer and a third partial copy the
# unit is at least 24, because a shorter one is beaten by the repeat without spacer.
MAX_SPACER = 3
SEED = 16
SPACED_UNIT = 24


def _score(unit, copies, total, spacer):
    """`S.direct_repeat_score` of arrays, summed up in the same order."""
    steps = np.select([total >= 100, total >= 50, total >= 30, total >= 20], [4.0, 3.0, 2.0, 1.0], 0.0)
    return np.maximum(2.0, 8.0 / unit) + np.minimum(copies * 2.5, 12.0) + steps - spacer * 0.3


def _counts(unit, copies, total, spacer):
    """Which direct repeats reach the score limit."""
    return _score(unit, copies, total, spacer) >= MIN_SCORE


def direct_repeat_candidates(seqs: DataFrame) -> DataFrame:
    """Per start the longest unit (then the smallest spacer) that reaches the score limit."""
    best = best_direct(seqs, SEED, (MIN_UNIT, MAX_UNIT), SPACED_UNIT, MAX_SPACER, _counts)
    copies = F.when(F.col("spacer") == 0, F.floor(F.col("length") / F.col("unit"))).otherwise(2).cast("int")
    best = best.withColumn("copies", copies)
    score = S.direct_repeat_score(F.col("unit"), F.col("copies"), F.col("length"), F.col("spacer"))
    return best.withColumn("score", score).withColumn("end_pos", F.col("start_pos") + F.col("length") - 1)


# One alternative per unit length, tried in this order at every position.  Copy numbers and the
# 15-base minimum are built in, the trailing optional groups take the partial copy.  A GAA or TTC
# like unit is left to sticky DNA when a GAAGAA or TTCTTC lies within fifty bases.
STICKY_UNIT = r"(?!(?=GAA|TTC|AAG|AGG|GGA|TCT|CTC|CTT)(?=.{0,44}(?:GAAGAA|TTCTTC)))"
TANDEM = "|".join(
    [
        r"(.)\1{14,}",
        r"(.)(.)(?:(?:\2\3){7,}\2?|(?:\2\3){6}\2)",
        STICKY_UNIT + r"(.)(.)(.)(?:\4\5\6){4,}(?:\4\5?)?",
        r"(.)(.)(.)(.)(?:(?:\7\8\9\10){3,}(?:\7(?:\8\9?)?)?|(?:\7\8\9\10){2}\7\8\9)",
        r"(.)(.)(.)(.)(.)(?:\11\12\13\14\15){2,}(?:\11(?:\12(?:\13\14?)?)?)?",
        r"(.)(.)(.)(.)(.)(.)(?:\16\17\18\19\20\21){2,}(?:\16(?:\17(?:\18(?:\19\20?)?)?)?)?",
    ]
)
MIN_COPIES = {1: 6, 2: 5, 3: 4, 4: 3, 5: 3, 6: 3}


_TANDEM = re.compile(TANDEM)
#: Bases that equal the one a unit further on, in the shortest hit of each alternative.
EQUAL = {1: 14, 2: 13, 3: 12, 4: 11, 5: 10, 6: 12}
WEIGHT = {1: 4.0, 2: 3.0, 3: 2.5, 4: 2.0, 5: 1.5, 6: 1.0}
STICKY = {"GAA", "TTC", "AAG", "AGG", "GGA", "TCT", "CTC", "CTT"}


def _unit(motif: str, window: str) -> int | None:
    """The shortest unit that counts, none where the repeat is left to sticky DNA or has too few copies."""
    n = len(motif)
    for u, copies in MIN_COPIES.items():
        if n // u >= copies and motif[u:] == motif[:-u]:
            if u != 3 or motif[:3] not in STICKY or not ("GAAGAA" in window or "TTCTTC" in window):
                return u
    return None


def _tandem_spans(part: Part) -> list[tuple[int, int]]:
    """The hits of TANDEM from left to right; only places with enough bases that recur are tried."""
    letters, n = part.letters, len(part.letters)
    tried = np.zeros(n, bool)
    for u, least in EQUAL.items():
        equal, have = letters[:-u] == letters[u:], 1
        while have < least:
            step = min(have, least - have)
            equal, have = equal[:-step] & equal[step:], have + step
        tried[:len(equal)] |= equal
    places, text, i, out = np.flatnonzero(tried).tolist(), part.text, 0, []
    while i < len(places):
        hit = _TANDEM.match(text, places[i])
        if hit:
            out.append(hit.span())
            i = bisect_left(places, hit.end())
        else:
            i += 1
    return out


def find_tandem(part: Part) -> dict:
    """Tandem repeats of 1 to 6 bases that count; the scan goes on behind every repeat found."""
    spans, unit, copies, score = [], [], [], []
    for a, b in _tandem_spans(part):
        u, n = _unit(part.text[a:b], part.text[a:a + 50].split("\n", 1)[0]), b - a
        if u is not None:
            rated = WEIGHT[u] + min(n // u * 1.5, 12.0) + (3.0 if n >= 100 else 2.0 if n >= 50 else 1.0 if n >= 30 else 0.0)
            if rated >= MIN_SCORE:
                spans.append((a, b))
                unit.append(u)
                copies.append(n // u)
                score.append(rated)
    return part.rows(np.array(spans, np.int64).reshape(-1, 2), size=unit, copies=copies, score=score)


def find_slipped(part: Part) -> dict:
    """Direct and tandem repeats without overlaps. Direct repeats may be a row for every base, and only chosen ones leave."""
    found = find_tandem(part)
    tandem = np.stack([np.asarray(found[c], float) for c in ("row", "start", "end", "size", "copies", "score")])
    return chosen_repeats(part.bases, part.starts, tandem, SEED, (MIN_UNIT, MAX_UNIT), SPACED_UNIT, MAX_SPACER, _score, MIN_SCORE)


FINDERS = {"slipped": find_slipped}


def str_candidates(seqs: DataFrame) -> DataFrame:
    """Tandem repeats of 1 to 6 bases."""
    return located(seqs, "tandem", find_tandem).withColumnRenamed("size", "unit")


def str_repeats(seqs: DataFrame) -> DataFrame:
    return _str_motifs(str_candidates(seqs))


def _str_motifs(rows: DataFrame) -> DataFrame:
    return as_motifs(rows, CLASS, STR, F.col("score"), "TandemRepeat", detail=_str_detail(), attrs=_str_attrs())


def _unit_text() -> Column:
    return F.expr("substring(motif, 1, unit)")


def _str_detail() -> Column:
    return F.concat(F.lit("Unit="), _unit_text(), F.lit(";Copies="), F.col("copies"))


def _str_attrs() -> dict[str, Column]:
    return {"Unit": _unit_text(), "Copies": F.col("copies"), "GC_Fraction": F.round(S.fraction(_unit_text(), "GC"), 3)}


def slipped_dna(seqs: DataFrame | Located) -> DataFrame:
    """Direct repeats and STRs, best score first (ties: direct repeats, then position).

    STRs alone never overlap, so running the selection without any direct repeat changes nothing. Both kinds meet in
    the task that holds the sequence: direct repeats may be a row for every base, and only chosen ones leave it.
    """
    rows = located(seqs, "slipped", find_slipped).withColumnRenamed("size", "unit")
    direct = F.col("spacer") >= 0
    pick = lambda a, b: F.when(direct, a).otherwise(b)
    return as_motifs(
        rows, CLASS, pick(F.lit("Slipped DNA [Direct Repeat]"), F.lit(STR)), F.col("score"),
        pick(F.lit("DirectRepeat"), F.lit("TandemRepeat")),
        detail=pick(F.concat(F.lit("UnitLen="), F.col("unit"), F.lit(";Copies="), F.col("copies")), _str_detail()),
        spacer=pick(F.col("spacer").cast("string"), F.lit("")),
        attrs=pick(
            as_map({
                "Unit_Length": F.col("unit"), "Copies": F.col("copies"),
                "AT_Fraction": F.round(S.fraction(_unit_text(), "AT"), 3),
            }),
            as_map(_str_attrs()),
        ),
    )
