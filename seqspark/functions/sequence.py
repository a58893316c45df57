"""Scalar sequence functions: every one takes and returns Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def span(first, last) -> Column:
    """first .. last, empty when last is smaller (``sequence`` would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def let(value, use) -> Column:
    """``use(value)`` with the value computed once (lambda bodies have no common subexpressions)."""
    return F.transform(F.array(value), use).getItem(0)


def matches(seq, pattern: str) -> Column:
    """All non-overlapping matches of a Java regex, left to right."""
    return F.regexp_extract_all(col(seq), F.lit(pattern), F.lit(0))


def n_matches(seq, pattern: str) -> Column:
    return F.size(matches(seq, pattern))


def windows(seq, size) -> Column:
    """All strings of ``size`` bases, one for each start; one pass, where a substring by place would go from the first base."""
    return F.regexp_extract_all(col(seq), F.concat(F.lit("(?=(.{"), F.lit(size).cast("string"), F.lit("}))")), F.lit(1))


def count_bases(seq, bases: str) -> Column:
    """How many characters of ``seq`` are in ``bases``."""
    seq = col(seq)
    return F.length(seq) - F.length(F.translate(seq, bases, ""))


def fraction(seq, bases: str) -> Column:
    seq = col(seq)
    return F.when(F.length(seq) > 0, count_bases(seq, bases) / F.length(seq)).otherwise(F.lit(0.0))


def clean(seq) -> Column:
    """Upper-case, drop blanks, RNA to DNA."""
    return F.translate(F.upper(col(seq)), "U \t\r\n", "T")


def gc_content(seq) -> Column:
    """GC percentage, 0 for an empty sequence."""
    return fraction(seq, "GC") * 100.0


def purine_fraction(seq) -> Column:
    return fraction(seq, "AG")


def pyrimidine_fraction(seq) -> Column:
    return fraction(seq, "CT")


def is_homopurine(seq, threshold: float = 0.9) -> Column:
    return purine_fraction(seq) >= threshold


def is_homopyrimidine(seq, threshold: float = 0.9) -> Column:
    return pyrimidine_fraction(seq) >= threshold


def complement(seq) -> Column:
    return F.translate(col(seq), "ACGT", "TGCA")


def reverse_complement(seq) -> Column:
    return F.reverse(complement(seq))


def is_palindrome(seq) -> Column:
    return col(seq) == reverse_complement(seq)


def wrap(seq, width: int = 60) -> Column:
    """Insert a line break after every ``width`` characters."""
    return F.regexp_replace(col(seq), "(.{%d})(?=.)" % width, "$1\n")


def overlapping_matches(seq, pattern: str) -> Column:
    """array<struct<start_pos, match>>: a match is looked for again from start + 1."""
    seq = col(seq)
    found = F.transform(
        span(F.lit(1), F.greatest(F.length(seq), F.lit(1))),
        lambda p: F.struct(
            p.alias("start_pos"),
            F.regexp_extract(F.substring(seq, p, F.length(seq)), "^(?:%s)" % pattern, 0).alias("match"),
        ),
    )
    return F.filter(found, lambda h: F.length(h["match"]) > 0)


# --- run based scores -----------------------------------------------------------------------


def _signed_runs(seq, plus: str, minus: str, per_run) -> Column:
    runs = matches(seq, f"{plus}+|{minus}+")
    return F.aggregate(
        runs,
        F.lit(0).cast("double"),
        lambda acc, r: acc
        + F.when(r.startswith(plus), F.lit(1.0)).otherwise(F.lit(-1.0)) * per_run(F.length(r)),
    )


def _ramp_sum(n: Column) -> Column:
    """1 + 2 + 3 + 4 + 4 + ... over a run of n bases."""
    return F.when(n <= 4, n * (n + 1) / 2.0).otherwise(10.0 + 4.0 * (n - 4))


def hunter_score(seq, target: str = "G", against: str = "C") -> Column:
    """Mean over all bases of +-min(run length, 4), the same value on every base of a run."""
    seq = col(seq)
    total = _signed_runs(seq, target, against, lambda n: n * F.least(n, F.lit(4)))
    return F.when(F.length(seq) > 0, total / F.length(seq)).otherwise(F.lit(0.0))


def g4hunter_score(seq) -> Column:
    """Mean base score; base number k of a G run counts min(k, 4), C runs count negative."""
    seq = col(seq)
    return F.when(F.length(seq) > 0, _signed_runs(seq, "G", "C", _ramp_sum) / F.length(seq)).otherwise(
        F.lit(0.0)
    )


def ramp_array(seq, plus: str, minus: str) -> Column:
    """Per-base ramp score as array<int>."""

    def ramp(r):
        n = F.length(r)
        steps_up = lambda sign: F.transform(F.sequence(F.lit(1), n), lambda k: F.least(k, F.lit(4)) * sign)
        return F.when(r.startswith(plus), steps_up(1)).when(r.startswith(minus), steps_up(-1)).otherwise(
            F.array_repeat(F.lit(0), n))

    return F.flatten(F.transform(matches(seq, f"{plus}+|{minus}+|[ACGT]"), ramp))


def sliding_means(values, window: int = 25) -> Column:
    """Centred mean of an array, the window cut off at both ends."""
    half = window // 2

    def means(v):
        n = F.size(v)

        def at(i):
            lo = F.greatest(i - half, F.lit(1))
            part = F.slice(v, lo, F.least(i + half, n) - lo + 1)
            return F.aggregate(part, F.lit(0), lambda a, x: a + x) / (F.least(i + half, n) - lo + 1)

        return F.transform(span(F.lit(1), n), at)

    return let(col(values), means)


def max_sliding_mean(values, window: int = 25) -> Column:
    """Largest of the `sliding_means` of an array of integers, from a running sum: one step for each place."""
    half = window // 2

    def largest(v):
        n = F.size(v)
        enter = F.slice(v, F.lit(half + 1), F.greatest(n, F.lit(1)))
        leave = F.slice(F.concat(F.array_repeat(F.lit(0), half + 1), v), F.lit(1), F.greatest(n, F.lit(1)))
        change = F.zip_with(enter, leave, lambda e, l: F.coalesce(e, F.lit(0)) - l)
        before = F.aggregate(F.slice(v, 1, half), F.lit(0), lambda a, x: a + x)
        start = F.struct(F.lit(0).alias("at"), before.alias("sum"), F.lit(None).cast("double").alias("best"))

        def step(acc, x):
            at, total = acc["at"] + 1, acc["sum"] + x
            width = F.least(at + half, n) - F.greatest(at - half, F.lit(1)) + 1
            return F.struct(at.alias("at"), total.alias("sum"), F.greatest(acc["best"], total / width).alias("best"))

        return F.when(n > 0, F.aggregate(change, start, step, lambda acc: acc["best"]))

    return let(col(values), largest)


def imotif_score(seq, window: int = 25) -> Column:
    """Largest centred window mean of the C-positive ramp score."""
    return max_sliding_mean(ramp_array(seq, "C", "G"), window)


# --- class specific scores ------------------------------------------------------------------


def curvature_score(seq) -> Column:
    """n (1 + AT fraction) + half the sum of square roots of the A and T run lengths."""
    seq = col(seq)
    roots = F.aggregate(
        matches(seq, "A+|T+"), F.lit(0.0), lambda acc, r: acc + F.sqrt(F.length(r).cast("double"))
    )
    return F.length(seq) * (1.0 + fraction(seq, "AT")) + 0.5 * roots


def phase_term(spacing, target: float = 10.5, tolerance: float = 3.0) -> Column:
    """Contribution of one centre-to-centre distance to the phasing score."""
    x = (spacing - F.lit(target)) / tolerance
    return F.greatest(F.lit(0.0), 1.0 - x * x)


def steps(value, *levels) -> Column:
    """Step function: the value of the first (bound, value) with value >= bound, else 0."""
    out = None
    for bound, v in levels:
        out = F.when(value >= bound, F.lit(float(v))) if out is None else out.when(value >= bound, F.lit(float(v)))
    return out.otherwise(F.lit(0.0))


def length_step_bonus(length) -> Column:
    return steps(length, (100, 2), (50, 1))


def cruciform_score(arm, spacer, total) -> Column:
    weight = steps(arm, (100, 8), (70, 7), (50, 6), (30, 5), (20, 4), (15, 3), (12, 2), (0, 1))
    penalty = steps(spacer, (11, 3), (4, 2), (1, 1))
    return weight + steps(total, (60, 2), (40, 1)) - penalty


def direct_repeat_score(unit, copies, total, spacer) -> Column:
    return (
        F.greatest(F.lit(2.0), 8.0 / F.greatest(unit, F.lit(1)))
        + F.least(copies * 2.5, F.lit(12.0))
        + steps(total, (100, 4), (50, 3), (30, 2), (20, 1))
        - spacer * 0.3
    )


def str_score(unit, copies, total) -> Column:
    weight = (
        F.when(unit == 1, 4.0).when(unit == 2, 3.0).when(unit == 3, 2.5)
        .when(unit == 4, 2.0).when(unit == 5, 1.5).otherwise(1.0)
    )
    return weight + F.least(copies * 1.5, F.lit(12.0)) + steps(total, (100, 3), (50, 2), (30, 1))


def triplex_score(arm, homogeneity, spacer, total) -> Column:
    return arm * (1.0 + 1.5 * homogeneity) - 0.8 * spacer + steps(total, (50, 1))


def structural_factor(seq, kind: str, loops=None) -> Column:
    """Stability factor for G4, i-motif, R-loop and Z-DNA; at least 0.1.

    ``loops`` is an optional array<int> column of loop lengths.
    """
    seq = col(seq)
    value = F.lit(1.0)
    mean_loop = None
    if loops is not None:
        loops = col(loops)
        mean_loop = F.aggregate(loops, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(loops), F.lit(0))
    if kind == "G4":
        value = value + 0.1 * F.greatest(F.lit(0), n_matches(seq, "G{3,}") - 4)
        if mean_loop is not None:
            bonus = F.when(mean_loop <= 7, F.lit(0.1)).otherwise(-0.05 * (mean_loop - 7))
            value = value + F.coalesce(bonus, F.lit(0.0))
    elif kind == "i-motif":
        value = value + 0.1 * F.greatest(F.lit(0), n_matches(seq, "C{3,}") - 4)
        if mean_loop is not None:
            bonus = F.when(mean_loop <= 7, F.lit(0.15)).when(mean_loop <= 12, F.lit(0.05)).when(
                mean_loop > 12, F.lit(-0.1)
            )
            value = value + F.coalesce(bonus, F.lit(0.0))
    elif kind == "R-loop":
        value = value + 0.01 * gc_content(seq) + 0.05 * n_matches(seq, "G{3,}")
    elif kind == "Z-DNA":
        value = value + 0.05 * n_matches(seq, "[AG][CT]") + 0.1 * n_matches(seq, "GC|CG")
    return F.greatest(F.lit(0.1), value)


def rloop_score(riz, rez) -> Column:
    """Mean of a GC and G-run term and a G-bias term over RIZ + REZ."""
    both = F.concat(col(riz), col(rez))
    n = F.length(both)
    classic = (fraction(both, "GC") * 50.0 + n_matches(both, "G{3,}") * 10.0) * F.pow(n, F.lit(0.25))
    return (classic + hunter_score(both) * n * structural_factor(both, "R-loop")) / 2.0


def ac_motif_score(seq) -> Column:
    seq = col(seq)
    return (
        F.length(seq) * fraction(seq, "AC") * 0.3
        + 1.5 * (n_matches(seq, "A{3,}") + n_matches(seq, "C{3,}"))
        + n_matches(seq, "(?:AC|CA){3,}")
    )


def repeat_purity(seq) -> Column:
    """Share of positions equal to the first three bases repeated; 0 below six bases."""
    seq = col(seq)
    n = F.length(seq)
    whole = (F.floor(n / 3) * 3).cast("int")
    expected = F.repeat(F.substring(seq, 1, 3), F.floor(n / 3).cast("int"))
    same = F.zip_with(
        F.split(F.substring(seq, F.lit(1), whole), ""),
        F.split(expected, ""),
        lambda a, b: F.when(a == b, 1).otherwise(0),
    )
    return F.when(n < 6, F.lit(0.0)).otherwise(F.aggregate(same, F.lit(0), lambda a, v: a + v) / n)


def repeat_conservation(seq) -> Column:
    """100 (0.4 GC fraction + 0.6 distinct bases among the first nine / 9)."""
    seq = col(seq)
    distinct = F.size(F.array_distinct(F.split(F.substring(seq, 1, 9), "")))
    return (fraction(seq, "GC") * 0.4 + distinct / 9.0 * 0.6) * 100.0
