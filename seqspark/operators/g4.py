"""G-quadruplex family: four-run hits, bipartite, multimeric and G-triplex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.functions import sequence as S
from seqspark.operators import scan as T
from seqspark.operators.intervals import greedy
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_motifs, union
from seqspark.operators.triplex import best_first

CLASS = "G-Quadruplex Family"
MIN_MEAN, MIN_TRIPLEX_MEAN = 1.2, 1.5

FOUR_RUNS = "G+.{1,15}G+.{1,15}G+.{1,15}G+"
FOUR_RUNS_CUT = "[ACT]{16}"
BIPARTITE = "G{3,}.{1,12}G{3,}.{15,50}G{3,}.{1,12}G{3,}"
TANDEM = "G{3,}.{1,7}G{3,}.{1,7}G{3,}.{1,7}G{3,}"
TRIPLEX = "G{3,}.{1,15}G{3,}.{1,15}G{3,}"
# no G3 run for 55 starts: longer than any linker above
G3_CUT = "(?:(?!GGG)[ACGT]){55}"

# The official order, best first.
PRIORITY = [
    "Multimeric G4", "Canonical G4", "Relaxed G4", "Bulged G4", "Bipartite G4", "Imperfect G4",
    "G-Triplex intermediate",
]


def priority(subtype) -> Column:
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), S.col(subtype)), F.lit(0)),
        F.lit(len(PRIORITY) + 1),
    )


def _g3(pattern: str) -> str:
    """The same pattern with runs that begin with letters, which Python looks for faster."""
    return pattern.replace("G{3,}", "GGGG*")


def find_four_runs(part: Part) -> dict:
    """Hits whose mean can reach the limit; the loop rule raises it by 1.1 at most."""
    spans, ramp = part.spans(FOUR_RUNS), part.ramp("G", "C")
    total = ramp[spans[:, 1]] - ramp[spans[:, 0]]
    return part.rows(spans[total * 1.1 >= (spans[:, 1] - spans[:, 0]) * MIN_MEAN - 1e-6])


def find_bipartite(part: Part) -> dict:
    return part.rows(part.spans(_g3(BIPARTITE)))


def find_multimeric(part: Part) -> dict:
    """Tight G4 hits, joined when at most 20 bases apart."""
    return part.rows(part.merged(part.spans(_g3(TANDEM)), 20))


def find_triplex(part: Part) -> dict:
    return part.rows(part.spans(_g3(TRIPLEX)))


FINDERS = {
    "g4_four_run": find_four_runs, "g4_bipartite": find_bipartite, "g4_multimeric": find_multimeric,
    "g4_triplex": find_triplex,
}


def _hits(source, kind: str) -> DataFrame:
    return located(source, kind, FINDERS[kind]).select("seq_id", "start_pos", "end_pos", "motif")


def four_run_candidates(seqs: DataFrame | Located) -> DataFrame:
    """Four G runs with loops of 1 to 15; adds mean (after the loop rule) and subtype."""
    rows = _hits(seqs, "g4_four_run")
    runs = F.transform(F.slice(S.matches("motif", "G+"), 1, 4), lambda r: F.length(r))
    loops = F.transform(F.slice(S.matches("motif", "[ACT]+"), 1, 3), lambda r: F.length(r))
    rows = T.computed(rows.where(S.n_matches("motif", "G+") >= 4), mean=S.g4hunter_score("motif"), runs=runs, loops=loops)
    factor = (
        F.when(F.exists("loops", lambda l: l == 1), 0.75)
        .when(F.forall("loops", lambda l: l.between(2, 4)), 1.10)
        .when(F.exists("loops", lambda l: l > 12), 0.5)
        .otherwise(1.0)
    )
    rows = T.computed(rows.where(F.col("mean") * 1.1 >= MIN_MEAN), factor=factor)
    rows = rows.withColumn("mean", F.col("mean") * F.col("factor")).where(F.col("mean") >= MIN_MEAN)
    short = F.forall("loops", lambda l: l <= 12)
    all3 = F.forall("runs", lambda r: r >= 3)
    bulged = F.col("motif").rlike("GG[ACT]GG") & (F.size(F.filter("runs", lambda r: r >= 3)) >= 2)
    kind = (
        F.when(bulged, "Bulged")
        .when(all3 & F.forall("loops", lambda l: l <= 7), "Canonical")
        .when(all3 & short, "Long-Loop")
        .when(F.forall("runs", lambda r: r == 2) & short, "Two-Tetrad")
        .when(F.forall("runs", lambda r: r >= 2) & short, "Generalized")
    )
    subtype = (
        F.when(kind == "Bulged", "Bulged G4").when(kind == "Canonical", "Canonical G4")
        .when(kind == "Long-Loop", "Relaxed G4").otherwise("Imperfect G4")
    )
    return T.computed(rows, kind=kind).where(F.col("kind").isNotNull()).withColumn("subtype", subtype)


def _mean_filtered(rows: DataFrame, least: float) -> DataFrame:
    return T.computed(rows, mean=S.g4hunter_score("motif")).where(F.col("mean") >= least)


def bipartite_candidates(seqs: DataFrame) -> DataFrame:
    return _mean_filtered(_hits(seqs, "g4_bipartite"), MIN_MEAN)


def multimeric_candidates(seqs: DataFrame) -> DataFrame:
    """Tight G4 hits, joined when at most 20 bases apart."""
    return _mean_filtered(_hits(seqs, "g4_multimeric"), MIN_MEAN)


def triplex_candidates(seqs: DataFrame) -> DataFrame:
    """Three G3 runs; the first three G runs of the hit are long and loops are 1 to 15."""
    rows = _hits(seqs, "g4_triplex")
    runs = F.slice(S.matches("motif", "G+"), 1, 3)
    loops = F.slice(S.matches("motif", "[ACT]+"), 1, 2)
    rows = rows.where(
        (F.size(runs) >= 3)
        & F.forall(runs, lambda r: F.length(r) >= 3)
        & F.forall(loops, lambda l: F.length(l) <= 15)
    )
    return _mean_filtered(rows, MIN_TRIPLEX_MEAN)


def _motifs(rows: DataFrame, subtype) -> DataFrame:
    return as_motifs(
        rows, CLASS, subtype, F.col("mean"), "G4Hunter_Mean",
        attrs={"G_Runs": S.n_matches("motif", "G+")},
    )


def g4_candidates(seqs: DataFrame) -> DataFrame:
    return union(
        [
            _motifs(four_run_candidates(seqs), F.col("subtype")),
            _motifs(bipartite_candidates(seqs), "Bipartite G4"),
            _motifs(multimeric_candidates(seqs), "Multimeric G4"),
            _motifs(triplex_candidates(seqs), "G-Triplex intermediate"),
        ]
    )


def g4_family(seqs: DataFrame) -> DataFrame:
    """All kinds in official priority, without overlaps."""
    rows = g4_candidates(seqs).withColumn("_rank", priority("subtype"))
    return greedy(rows, [F.asc("_rank")] + best_first(), overlap="shared_end").drop("_rank")


def g4_priority_filter(motifs: DataFrame) -> DataFrame:
    """Of G4 rows with the same coordinates keep the one of highest priority.

    One pass: rows of other classes are told apart by class and a spread number, so that they form
    groups of their own and no place is hot.
    """
    is_g4 = F.coalesce(F.col("class") == CLASS, F.lit(False))
    other = F.when(~is_g4, F.xxhash64("seq_id", "class", "subtype", "start_pos", "end_pos"))
    order = Window.partitionBy("seq_id", "start_pos", "end_pos", other).orderBy(
        priority("subtype"), F.desc("score"), F.col("subtype")
    )
    rows = motifs.withColumn("_n", F.row_number().over(order))
    return rows.where(~is_g4 | (F.col("_n") == 1)).drop("_n")
