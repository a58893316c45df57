"""Non-B DNA cluster regions: dense windows and their merged form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators.hybrid import _listing
from seqspark.operators.intervals import islands
from seqspark.operators.motifs import as_motifs

CLASS = "Non-B DNA cluster regions"


def complexity(classes) -> Column:
    return F.when(classes >= 5, "High").when(classes >= 3, "Moderate").otherwise("Low")


def diversity_score(classes, subclasses, subtypes) -> Column:
    return (classes * 10 + subclasses * 5 + subtypes * 2).cast("double")


def _window_counts(motifs: DataFrame, lengths: DataFrame, window: int) -> DataFrame:
    """Per window and (class, subtype): number of motifs touching it and their score sum.

    Window number w covers w * step + 1 .. w * step + window.  A motif is copied to the windows
    it touches and counted before the shuffle.
    """
    step = window // 4
    m = motifs.select("seq_id", "class", "subtype", "start_pos", "end_pos", "score").join(
        lengths.select("seq_id", F.col("length").alias("seq_len")), "seq_id"
    )
    first = F.greatest(F.lit(0), F.ceil((F.col("start_pos") - window) / step))
    last = F.least(F.floor((F.col("end_pos") - 1) / step), F.floor((F.col("seq_len") - window) / step))
    rows = m.where((F.col("seq_len") >= window) & (first <= last))
    rows = rows.withColumn("w", F.explode(S.span(first, last)))
    return rows.groupBy("seq_id", "w", "class", "subtype").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")
    )


def hotspot_windows(motifs: DataFrame, lengths: DataFrame, window: int = 100, min_count: int = 3) -> DataFrame:
    """Windows (step window / 4) touched by at least ``min_count`` motifs."""
    step = window // 4
    rows = _window_counts(motifs, lengths, window).groupBy("seq_id", "w").agg(
        F.sum("n").alias("motif_count"),
        F.sum("score").alias("score_sum"),
        # at most one entry per (class, subtype)
        F.collect_list(F.struct("class", "subtype", "n")).alias("parts"),
    )
    # counted from the entries: two distinct counts would send each row three times
    different = lambda name: F.size(F.array_distinct(F.array_compact(F.col("parts")[name]))).cast("long")
    rows = rows.where(F.col("motif_count") >= min_count).select(
        "*", different("class").alias("class_diversity"), F.size("parts").cast("long").alias("subclass_diversity"),
        different("subtype").alias("subtype_diversity"),
    )
    bonus = diversity_score(F.col("class_diversity"), F.col("subclass_diversity"), F.col("subtype_diversity"))
    return rows.select(
        "seq_id", (F.col("w") * step + 1).cast("int").alias("start_pos"),
        (F.col("w") * step + window).cast("int").alias("end_pos"),
        "motif_count", "class_diversity", "subclass_diversity", "subtype_diversity",
        bonus.alias("diversity_score"), (F.col("score_sum") + bonus).alias("score"),
        complexity(F.col("class_diversity")).alias("complexity"), "parts",
    )


def merge_hotspots(windows: DataFrame) -> DataFrame:
    """Join overlapping windows.

    Counts and scores are added up, so a motif counts once for each window it touches; the
    diversity figures are taken anew from the joined counts.
    """
    rows = islands(windows, out="region").select(
        "seq_id", "region", "end_pos", "motif_count", "score", F.posexplode("parts").alias("_part", "_p")
    )
    # the figures of a window are in its first part's row only, so one chain of aggregates does all
    once = lambda c: F.when(F.col("_part") == 0, F.col(c))
    parts = rows.groupBy("seq_id", "region", F.col("_p.class").alias("class"), F.col("_p.subtype").alias("subtype")).agg(
        F.sum("_p.n").alias("n"), F.max("end_pos").alias("end_pos"), F.sum(once("motif_count")).alias("motif_count"),
        F.sum(once("score")).alias("score"), F.count(once("motif_count")).alias("n_windows"),
    )
    by_class = parts.groupBy("seq_id", "region", "class").agg(
        F.sum("n").alias("n"), F.max("end_pos").alias("end_pos"), F.sum("motif_count").alias("motif_count"),
        F.sum("score").alias("score"), F.sum("n_windows").alias("n_windows"),
        F.collect_list(F.struct("subtype", "n")).alias("kinds"),
    )
    named = F.transform(F.col("kinds"), lambda k: F.struct(F.concat_ws(":", "class", k["subtype"]).alias("key"), k["n"].alias("value")))
    out = by_class.withColumn("named", named).groupBy("seq_id", "region").agg(
        F.max("end_pos").alias("end_pos"), F.sum("motif_count").alias("motif_count"), F.sum("score").alias("score"),
        F.sum("n_windows").alias("n_windows"), F.count(F.lit(1)).alias("class_diversity"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("class_breakdown"),
        F.sort_array(F.flatten(F.collect_list("named"))).alias("entries"),
        F.flatten(F.collect_list(F.transform("kinds", lambda k: k["subtype"]))).alias("subtypes"),
    ).select(
        "*", F.size("entries").cast("long").alias("subclass_diversity"),
        F.size(F.array_distinct("subtypes")).cast("long").alias("subtype_diversity"),
        F.map_from_entries("entries").alias("subclass_breakdown"),
    )
    return out.select(
        "seq_id", F.col("region").cast("int").alias("start_pos"), "end_pos",
        (F.col("end_pos") - F.col("region") + 1).cast("int").alias("length"), "n_windows", "motif_count",
        "class_diversity", "subclass_diversity", "subtype_diversity",
        diversity_score(F.col("class_diversity"), F.col("subclass_diversity"), F.col("subtype_diversity")).alias(
            "diversity_score"
        ),
        "score", complexity(F.col("class_diversity")).alias("complexity"),
        F.concat(F.lit("Cluster_"), complexity(F.col("class_diversity")), F.lit("_Complexity")).alias("subtype"),
        _listing(F.col("class_breakdown"), "; ").alias("class_detail"),
        _listing(F.col("subclass_breakdown"), "; ", lambda k: F.try_element_at(F.split(k, ":"), F.lit(2))).alias("subclass_detail"),
        "class_breakdown", "subclass_breakdown",
    )


def hotspots(motifs: DataFrame, lengths: DataFrame, window: int = 100, min_count: int = 3) -> DataFrame:
    return merge_hotspots(hotspot_windows(motifs, lengths, window, min_count))


def hotspot_motifs(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    rows = hotspots(motifs, lengths).withColumn("motif", F.lit(""))
    return as_motifs(
        rows, CLASS, F.col("subtype"), F.col("score"), "WindowDensity",
        detail=F.concat(
            F.lit("Classes="), F.col("class_diversity"), F.lit(";Subclasses="), F.col("subclass_diversity")
        ),
        attrs={
            "MotifCount": F.col("motif_count"), "ClassDetail": F.col("class_detail"),
            "SubclassDetail": F.col("subclass_detail"), "ComplexityLevel": F.col("complexity"),
            "ClassBreakdown": F.to_json("class_breakdown"), "SubclassBreakdown": F.to_json("subclass_breakdown"),
            "DiversityScore": F.col("diversity_score"),
        },
    )
