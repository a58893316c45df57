"""Sequence features and heuristic formation probabilities as Columns."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from seqspark.functions import sequence as S
from seqspark.functions.sequence import col

# Stacking energy of each dinucleotide.
STACKING = {
    "AA": -1.0, "AT": -0.88, "AG": -1.28, "AC": -1.44, "TA": -0.58, "TT": -1.0, "TG": -1.44, "TC": -1.28,
    "GA": -1.28, "GT": -1.44, "GG": -1.84, "GC": -2.17, "CA": -1.44, "CT": -1.28, "CG": -2.17, "CC": -1.84,
}
SALT, SALT_MOLAR = 0.114, 0.05


#: Letters worked out at a time.
LETTERS = 1 << 20
PAIRS = [a + b for a in "ATGC" for b in "ATGC"]
UNITS = range(2, 10)
#: Half the sizes of the places that read the same both ways, 4 to 19.
HALVES = range(2, 10)
COUNTS = P.StructType(
    [P.StructField(p, P.IntegerType()) for p in PAIRS]
    + [P.StructField("stacking", P.DoubleType()), P.StructField("repeat", P.DoubleType()), P.StructField("palindromes", P.LongType())]
    + [P.StructField(c, P.IntegerType()) for c in ("mirror", "inverted", "g_runs", "c_runs", "runs", "longest")])


def _counted(texts: list[str]) -> pd.DataFrame:
    """What the features count in each text, from sums over all letters of all texts."""
    n = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(n + 1) - n  # one letter before each text and one behind the last
    letters = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    # what parts two texts equals no letter and is not what parts the next two
    parts = np.append(0, first + n)
    letters[parts] = -1 - np.arange(len(parts)) % 2
    row = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(row)) + np.repeat(first - (np.cumsum(n) - n), n)
    mine = letters[place]
    per_row = lambda some: np.bincount(row[some], minlength=len(texts))
    out = {}

    code = np.full(128, -1, np.int8)
    code[[ord(c) for c in "ATGC"]] = range(4)
    number = np.where((letters >= 0) & (letters < 128), code[letters.clip(0, 127)], -1)
    pair = np.where((number[place] >= 0) & (number[place + 1] >= 0), number[place] * 4 + number[place + 1], -1)
    inside = np.flatnonzero(pair >= 0)
    found = np.bincount(row[inside] * 16 + pair[inside], minlength=16 * len(texts)).reshape(-1, 16)
    out.update({p: found[:, i] for i, p in enumerate(PAIRS)})
    # added up from left to right; an unknown step makes the sum unknown
    energy = np.bincount(row[inside], weights=np.array([STACKING[p] for p in PAIRS])[pair[inside]], minlength=len(texts))
    out["stacking"] = np.where(found.sum(axis=1) == (n - 1).clip(0), energy, np.nan)

    repeat = []
    for text in texts:
        total, size = 0.0, len(text)
        for unit in UNITS:
            if unit <= size // 2 and text[:unit] * (size // unit) in text:
                total += 1.0 / (size / unit)
        repeat.append(total)
    out["repeat"] = repeat

    found = np.zeros(len(letters), np.int64)
    for odd in (0, 1):
        # equal letters on both sides of a place, ever further out
        same = np.ones(len(letters), bool)
        for half in range(1, HALVES[-1] + 1):
            gap = 2 * half - 1 + odd
            equal = np.zeros(len(letters), bool)
            m = max(len(letters) - gap, 0)
            equal[half - 1 + odd:half - 1 + odd + m] = letters[:m] == letters[gap:]
            same &= equal
            if half in HALVES:
                found += same
    found = np.concatenate([[0], np.cumsum(found)])
    out["palindromes"] = found[first + n] - found[first]

    other = letters[np.repeat(2 * first + n - 1, n) - place]
    turned = other.copy()
    for a, b in zip("ACGT", "TGCA"):
        turned[other == ord(a)] = ord(b)
    out["mirror"] = (per_row(mine == other) - n % 2) // 2
    out["inverted"] = per_row(mine == turned)

    opens = mine != letters[place - 1]
    start, known = np.flatnonzero(opens), np.isin(mine[opens], [ord(c) for c in "ACGT"])
    size = np.diff(np.append(start, len(mine)))[known]
    start = start[known]
    count = lambda some: np.bincount(row[start[some]], minlength=len(texts))
    out["g_runs"], out["c_runs"] = (count((mine[start] == ord(c)) & (size >= 3)) for c in "GC")
    out["runs"] = count(np.ones(len(start), bool))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, row[start], size)
    out["longest"] = longest
    return pd.DataFrame(out)


def _batch(texts: pd.Series) -> pd.DataFrame:
    known = texts.dropna()
    upto, found, a = np.cumsum(known.str.len().to_numpy(np.int64)), [], 0
    while a < len(known):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LETTERS, side="right")))
        found.append(_counted(known.iloc[a:b].tolist()))
        a = b
    if not found:
        found.append(_counted([]))
    return pd.concat(found).set_index(known.index).astype(object).reindex(texts.index)


@cache
def _counts():
    return F.pandas_udf(_batch, COUNTS)


def counts(seq) -> Column:
    """All that is counted of a sequence; worked out once for a row, however many features ask for it."""
    return _counts()(col(seq))


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _share_equal(a, b) -> Column:
    """Number of positions at which two strings of one length agree."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    return _total(same)


def composition(seq) -> dict[str, Column]:
    names = {"A": "A", "T": "T", "G": "G", "C": "C", "GC": "GC", "AT": "AT", "purine": "AG", "pyrimidine": "CT"}
    return {name: S.fraction(seq, bases) for name, bases in names.items()}


def dinucleotide_frequencies(seq) -> dict[str, Column]:
    n = F.nullif(F.length(col(seq)) - 1, F.lit(0))
    return {p: F.coalesce(counts(seq)[p] / n, F.lit(0.0)) for p in PAIRS}


def structural(seq) -> dict[str, Column]:
    gc = S.fraction(seq, "GC")
    n = F.length(col(seq))
    zero = F.lit(0.0)
    return {
        "twist": 36.0 + (gc - 0.5) * 2.0, "rise": 3.4 - (gc - 0.5) * 0.2, "tilt": zero, "roll": zero, "slide": zero,
        "shift": zero, "bendability": S.fraction(seq, "AT") * 100, "stability": gc * 100,
        "groove_width": F.lit(22.0), "stacking_energy": F.when(n > 1, counts(seq)["stacking"] / (n - 1)).otherwise(0.0),
    }


def thermodynamic(seq) -> dict[str, Column]:
    gc, n = S.fraction(seq, "GC"), F.length(col(seq))
    return {
        "melting_temp": 81.5 + 16.6 * F.log10(F.lit(SALT_MOLAR)) + 0.41 * gc * 100 - 675 / n,
        "free_energy": gc * -10.0, "enthalpy": gc * -79.0, "entropy": gc * -222.0,
        "salt_effect": SALT * F.log(F.lit(SALT_MOLAR)),
    }


def patterns(seq) -> dict[str, Column]:
    seq = col(seq)
    n = F.length(seq)
    half = F.floor(n / 2).cast("int")
    found = counts(seq)
    return {
        "repeat_score": found["repeat"], "palindrome_score": found["palindromes"] / n,
        "mirror_score": F.when(half > 0, found["mirror"] / half), "inverted_score": found["inverted"] / n,
        "g_runs": found["g_runs"].cast("double"), "c_runs": found["c_runs"].cast("double"),
        "alternating": F.when(n > 1, (found["runs"] - 1) / (n - 1)), "homopolymer": found["longest"] / n,
    }


def conservation(seq) -> dict[str, Column]:
    gc = S.fraction(seq, "GC")
    diversity = F.size(F.array_distinct(F.split(col(seq), ""))) / 4.0
    return {
        "phylogeny": gc * 0.8 + 0.2, "selection": 1.0 - F.abs(gc - 0.5) * 2.0,
        "constraint": F.least(F.lit(1.0), diversity), "diversity": diversity,
    }


def feature_columns(seq) -> dict[str, Column]:
    """The 51 features in order."""
    out = {}
    for prefix, group in (
        ("comp", composition), ("di", dinucleotide_frequencies), ("struct", structural), ("thermo", thermodynamic),
        ("pattern", patterns), ("cons", conservation),
    ):
        out.update({f"{prefix}_{name}": value.cast("double") for name, value in group(seq).items()})
    return out


def feature_vector(seq) -> Column:
    return F.array(*[v.cast("float") for v in feature_columns(seq).values()])


# --- formation probability ------------------------------------------------------------------


def g4_probability(seq) -> dict[str, Column]:
    seq = col(seq)
    n, g = F.length(seq), S.count_bases(seq, "G")
    runs = F.transform(S.matches(seq, "G+"), lambda r: F.length(r))
    bonus = F.aggregate(
        runs, F.lit(0.0),
        lambda a, r: a + F.when(r.between(3, 7), 0.2).when(r >= 8, 0.1).otherwise(0.0),
    )
    pattern = F.when(F.size(runs) >= 4, 0.3).otherwise(0.0)
    size = F.when(n < 15, n / 15.0).when(n <= 40, 1.0).otherwise(40.0 / n)
    stability = F.least(F.lit(1.0), g / (n * 0.3)) * size * 0.3
    p = F.least(F.lit(1.0), F.least(F.lit(1.0), g / n * 2.0) + bonus + pattern + stability)
    return {
        "probability": p, "confidence": F.least(F.lit(0.95), p * 0.8 + 0.2), "stability": stability, "pattern": pattern,
    }


def zdna_probability(seq) -> dict[str, Column]:
    seq = col(seq)
    n = F.length(seq)
    alternating = (F.size(S.matches(seq, "[AG]+|[CT]+")) - 1) / (n - 1)
    found = F.lit(0)
    for pair in ("CG", "GC", "CA", "TG"):
        found = found + (n - F.length(F.replace(seq, F.lit(pair), F.lit("")))) / 2
    pattern = found / (n - 1)
    bonus = F.greatest(F.lit(0.0), (S.fraction(seq, "GC") - 0.5) * 2.0)
    p = F.least(F.lit(1.0), alternating * 0.5 + bonus * 0.3 + pattern * 0.2)
    return {
        "probability": p, "confidence": F.least(F.lit(0.90), p * 0.7 + 0.3), "stability": F.lit(0.5), "pattern": pattern,
    }


def rloop_probability(seq) -> dict[str, Column]:
    seq = col(seq)
    g, c = S.fraction(seq, "G"), S.fraction(seq, "C")
    skew = F.when(g + c > 0, (g - c) / (g + c)).otherwise(0.0)
    stability = F.least(F.lit(1.0), g * 0.5)
    clusters = S.n_matches(seq, "G{3,}") * 0.1
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), skew) * 0.4 + g * 0.3 + stability * 0.2 + clusters * 0.1)
    return {
        "probability": p, "confidence": F.least(F.lit(0.85), p * 0.6 + 0.4), "stability": stability,
        "pattern": F.lit(0.5),
    }


def repeat_share(seq) -> Column:
    """Largest share of the sequence that is one unit of 2 to 9 bases repeated in place."""
    seq = col(seq)
    n = F.length(seq)
    best = F.lit(0.0)
    for unit in range(2, 10):
        a, b = F.substring(seq, F.lit(1), n - unit), F.substring(seq, F.lit(unit + 1), n)
        same = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, "1").otherwise("0")), "")
        run = F.coalesce(F.array_max(F.transform(S.matches(same, "1+"), lambda r: F.length(r))), F.lit(0))
        share = (1 + F.floor(run / unit)) * unit / n
        best = F.greatest(best, F.when(F.lit(unit) < F.floor(n / 2), share).otherwise(0.0))
    return F.when(n < 6, 0.0).otherwise(best)


def general_probability(seq, kind) -> dict[str, Column]:
    seq, kind = col(seq), F.lower(kind)
    n = F.length(seq)
    p = (
        F.when(kind.contains("triplex"), S.purine_fraction(seq))
        .when(kind.contains("cruciform"), F.when(n < 4, 0.0).otherwise(_share_equal(seq, S.reverse_complement(seq)) / n))
        .when(kind.contains("slipped"), repeat_share(seq))
        .otherwise(0.5)
    )
    return {
        "probability": F.least(F.lit(1.0), p), "confidence": F.lit(0.7), "stability": F.lit(0.5), "pattern": F.lit(0.5),
    }


def with_probability(motifs: DataFrame) -> DataFrame:
    """Adds ml_probability, ml_confidence, ml_stability, ml_pattern_score, enhanced_score.

    Motifs below six bases get (0.5, 0.3) and nothing else.
    """
    seq, cls = F.col("sequence"), F.col("class")
    g4, z, r, other = g4_probability(seq), zdna_probability(seq), rloop_probability(seq), general_probability(seq, cls)
    short = F.length(seq) < 6

    def routed(name):
        return (
            F.when(cls == "G-Quadruplex Family", g4[name]).when(cls == "Z-DNA", z[name])
            .when(cls == "R-loop", r[name]).otherwise(other[name])
        )

    rows = motifs.withColumn("ml_probability", F.when(short, 0.5).otherwise(routed("probability")))
    rows = rows.withColumn("ml_confidence", F.when(short, 0.3).otherwise(routed("confidence")))
    rows = rows.withColumn("ml_stability", F.when(~short, routed("stability")))
    rows = rows.withColumn("ml_pattern_score", F.when(~short, routed("pattern")))
    return rows.withColumn(
        "enhanced_score", F.when(~short, F.col("score") * 0.7 + F.col("ml_probability") * 30.0)
    )
