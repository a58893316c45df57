"""The complete detection: sequences in, one table of all motifs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions.features import with_probability
from seqspark.operators import (
    cruciform, curved, disease, g4, hotspots, hybrid, imotif, rloop, slipped, triplex, zdna,
)
from seqspark.operators.clusters import (
    cluster_motifs, cluster_windows, hybrid_structure_motifs, hybrid_structures, merge_clusters,
)
from seqspark.operators.conservation import with_conservation
from seqspark.operators.intervals import greedy
from seqspark.operators.located import Located
from seqspark.operators.motifs import MOTIF_COLUMNS, union
from seqspark.sources.fasta import valid_sequences
from seqspark.sources.stored import stored
from seqspark.sources.tables import small_batches

# Selection order of classes and subtypes when overlaps are removed.
SELECTION_ORDER = [
    "Multimeric G4", "Bipartite G4", "Imperfect G4", "Canonical G4", "Relaxed G4", "Bulged G4",
    "G-Triplex intermediate", "Canonical i-motif", "AC-motif", "Z-DNA", "eGZ (Extruded-G) DNA", "Curved DNA",
    "Cruciform DNA", "Slipped DNA", "Triplex", "R-loop", "sticky DNA", "Hybrid", "Non-B DNA cluster regions",
]


def searched(seqs: DataFrame, keep=("seq_id",)) -> Located:
    """One pass over the sequences for all detectors; what it finds is stored."""
    finders = {}
    for module in (curved, slipped, cruciform, rloop, triplex, g4, imotif, zdna, disease):
        finders |= module.FINDERS
    return Located(seqs, finders, keep)


def detectors(seqs: DataFrame, gene: str | None = None) -> DataFrame:
    """All detectors side by side on what one pass over the sequences has found.

    A filter on ``class`` removes the branches it rules out.
    """
    seqs = searched(seqs, ("seq_id", gene) if gene else ("seq_id",))
    return union(
        [
            curved.curved_dna(seqs), slipped.slipped_dna(seqs), cruciform.cruciform(seqs), rloop.rloops(seqs),
            triplex.hdna(seqs), triplex.sticky_dna(seqs), g4.g4_family(seqs), imotif.imotifs(seqs),
            imotif.ac_motifs(seqs), zdna.zdna(seqs), zdna.egz(seqs),
            disease.as_motif_rows(disease.disease_repeats(seqs, gene)),
        ]
    )


def valid_motifs(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows with all required fields and 1 <= start <= end <= sequence length."""
    required = ["class", "subtype", "start_pos", "end_pos", "length", "sequence"]
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    rows = motifs.where(complete & (F.col("start_pos") >= 1) & (F.col("start_pos") <= F.col("end_pos")))
    rows = rows.join(lengths.select("seq_id", F.col("length").alias("_n")), "seq_id")
    return rows.where(F.col("end_pos") <= F.col("_n")).drop("_n")


def select_by_priority(motifs: DataFrame, order=None, share: float = 0.5) -> DataFrame:
    """Best class first, then score; a motif may be covered by better ones up to ``share``.

    The class is looked up before the subtype; names outside the list come last.
    """
    order = list(order or SELECTION_ORDER)
    place = lambda c: F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(c)), F.lit(0))
    rank = F.coalesce(place("class"), place("subtype"), F.lit(len(order) + 1))
    rows = motifs.withColumn("_rank", rank)
    return greedy(rows, [F.asc("_rank"), F.desc("score")], overlap="covered", share=share).drop("_rank")


def complete_fields(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Adds seq_name and fills what may be missing."""
    rows = motifs.join(seqs.select("seq_id", F.col("name").alias("seq_name")), "seq_id", "left")
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default)).alias(c)
    rest = [c for c in motifs.columns if c not in MOTIF_COLUMNS]
    return rows.select(
        "seq_id", text("seq_name", "Sequence"), text("class"), text("subtype"), "start_pos", "end_pos", "length",
        text("sequence"), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"),
        text("score_method"), text("detail"), text("spacer"), "attrs", *rest,
    )


def all_motifs(
    seqs: DataFrame, nonoverlap: bool = False, report_hotspots: bool = False, gene: str | None = None,
    conservation: bool = False,
) -> DataFrame:
    """Every motif of every valid sequence (columns seq_id, name, sequence, length).

    ``nonoverlap`` keeps the best motifs per region, ``report_hotspots`` adds cluster regions,
    ``gene`` names a column used to match disorders, ``conservation`` adds the shuffle statistic.

    The found motifs are small next to the sequences and feed hybrids, selection and regions. Each
    stage is written once to the shared folder and read by the next, so plans stay short and a lost
    executor costs no more than the stage at work.
    """
    small_batches(seqs.sparkSession)
    seqs = valid_sequences(seqs)
    lengths = stored(seqs.select("seq_id", "name", "length"), "lengths")
    found = stored(valid_motifs(detectors(seqs, gene), lengths), "found-motifs", dealt=True)
    motifs = union([found, stored(hybrid.hybrid_motifs(found, seqs), "hybrids")])
    if nonoverlap:
        motifs = stored(select_by_priority(motifs), "selected")
    if report_hotspots:
        regions = stored(hotspots.hotspot_motifs(motifs, lengths), "hotspots")
        with_regions = union([motifs, regions])
        windows = stored(cluster_windows(with_regions, lengths), "cluster-windows")
        pairs = stored(hybrid_structures(with_regions), "hybrid-structures")
        motifs = union([with_regions, cluster_motifs(merge_clusters(windows)), hybrid_structure_motifs(pairs)])
    motifs = with_probability(motifs)
    if conservation:
        motifs = with_conservation(motifs)
    return complete_fields(g4.g4_priority_filter(motifs), lengths)


def filter_motifs(
    motifs: DataFrame, classes=None, sequences=None, min_score=None, min_length=None, max_length=None,
    max_overlap=None,
) -> DataFrame:
    """The user filters; ``max_overlap`` is the largest covered share a motif may have."""
    rows = motifs
    if classes is not None:
        rows = rows.where(F.col("class").isin(list(classes)))
    if sequences is not None:
        rows = rows.where(F.col("seq_name").isin(list(sequences)))
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    if min_length is not None:
        rows = rows.where(F.col("length") >= min_length)
    if max_length is not None:
        rows = rows.where(F.col("length") <= max_length)
    return rows if max_overlap is None else select_by_priority(rows, share=max_overlap)
