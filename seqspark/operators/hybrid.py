"""Hybrid regions: where motifs of two or more classes lie on top of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.operators.intervals import BIN, islands, overlap_join, running_max_before, with_copy_no
from seqspark.operators.motifs import as_motifs
from seqspark.operators.sweep import mixed_regions

CLASS = "Hybrid"
NOTE = "Several non-B DNA classes overlap here; longer and more diverse regions have more biological impact."


def _breakdown(keys) -> Column:
    """map<key, count> of an array of keys."""
    names = F.array_sort(F.array_distinct(keys))
    return F.map_from_arrays(
        names, F.transform(names, lambda n: F.size(F.filter(keys, lambda k: k == n)))
    )


def _listing(counts, link: str, label=lambda k: k) -> Column:
    return F.array_join(
        F.transform(F.map_entries(counts), lambda e: F.concat(label(e["key"]), F.lit("("), e["value"], F.lit(")"))), link
    )


def hybrid_regions(motifs: DataFrame) -> DataFrame:
    """Raw regions of the sweep over motif starts and ends.

    At every motif end with two or more open motifs of two or more classes, the region from the
    last rise to two open motifs up to that end.  Ends come before starts at one position, and
    ends at one position come in the order of (start, class, subtype, copy).
    """
    m = with_copy_no(motifs).select("seq_id", "class", "subtype", "motif_no", "start_pos", "end_pos", "length", "score")
    stretch = islands(m, out="stretch", order=[F.col("end_pos"), F.col("class"), F.col("subtype"), F.col("motif_no")])
    tie = F.struct("start_pos", "class", "subtype", "end_pos", "motif_no")
    events = stretch.select(
        "*", F.inline(F.array(
            F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("delta")),
            F.struct((F.col("end_pos") + 1).alias("pos"), F.lit(-1).alias("delta")),
        ))
    )
    # open motifs only matter inside one connected stretch
    order = Window.partitionBy("seq_id", "stretch").orderBy("pos", "delta", tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    events = events.withColumn("open", F.sum("delta").over(order))
    rise = F.when((F.col("delta") == 1) & (F.col("open") == 2), F.col("pos"))
    events = events.withColumn("region_start", F.last(rise, ignorenulls=True).over(order))
    ends = events.where((F.col("delta") == -1) & (F.col("open") >= 1)).select(
        "seq_id", "class", "subtype", "motif_no", "region_start", F.col("start_pos").alias("own_start"),
        F.col("end_pos").alias("start_pos"), "end_pos",
    )
    # motifs open at that end: they cover its position
    pairs = overlap_join(ends, m, BIN)
    still_open = (F.col("r_end_pos") > F.col("end_pos")) | (
        F.struct("r_start_pos", "r_class", "r_subtype", "r_motif_no")
        >= F.struct("own_start", "class", "subtype", "motif_no")
    )
    pairs = pairs.where(still_open)
    return _described(pairs, ["seq_id", "region_start", "end_pos", "own_start", "class", "subtype", "motif_no"])


def _described(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Regions of two or more classes from pairs of a region and a motif on it."""
    part = F.struct(
        F.col("r_start_pos").alias("start_pos"), F.col("r_end_pos").alias("end_pos"), F.col("r_class").alias("class"),
        F.col("r_subtype").alias("subtype"), F.col("r_score").alias("score"),
    )
    rows = pairs.groupBy(*key).agg(
        F.sort_array(F.collect_list(part)).alias("contributing"),
        F.count(F.lit(1)).cast("int").alias("n_motifs"),
        F.max("r_length").alias("longest"),
    )
    # added up in the order of the array, so that the last bits are the same in each run
    total = F.aggregate("contributing", F.lit(0.0), lambda a, c: a + F.coalesce(c["score"], F.lit(0.0)))
    rows = rows.withColumn("score_sum", F.when(F.exists("contributing", lambda c: c["score"].isNotNull()), total))
    rows = rows.withColumn("class_breakdown", _breakdown(F.transform("contributing", lambda c: c["class"])))
    rows = rows.withColumn(
        "subclass_breakdown",
        _breakdown(F.transform("contributing", lambda c: F.concat(c["class"], F.lit(":"), c["subtype"]))),
    )
    rows = rows.where(F.size("class_breakdown") >= 2)
    length = F.col("end_pos") - F.col("region_start") + 1
    degree = length / F.col("longest")
    bonus = F.col("n_motifs") * 0.2
    return rows.select(
        "seq_id", F.col("region_start").cast("int").alias("start_pos"), "end_pos", length.cast("int").alias("length"),
        "n_motifs", F.map_keys("class_breakdown").alias("classes"), "class_breakdown", "subclass_breakdown",
        F.concat(F.lit("Hybrid_"), _listing(F.col("class_breakdown"), "_")).alias("subtype"),
        _listing(F.col("subclass_breakdown"), "; ", lambda k: F.try_element_at(F.split(k, ":"), F.lit(2))).alias("subclass_detail"),
        degree.alias("overlap_degree"), bonus.alias("interaction_strength"),
        (F.col("score_sum") * (1 + bonus) * degree).alias("score"), "contributing",
    )


def collapse_nested(regions: DataFrame) -> DataFrame:
    """Drop regions inside an earlier one (order: start, then the longer, then more motifs)."""
    order = [F.desc("length"), F.desc("n_motifs"), F.col("subtype")]
    rows = running_max_before(regions, "end_pos", "_reach", order)
    return rows.where(F.col("_reach").isNull() | (F.col("end_pos") > F.col("_reach"))).drop("_reach")


def hybrids(motifs: DataFrame) -> DataFrame:
    """What ``collapse_nested`` leaves of ``hybrid_regions``, found first; motifs are joined to these regions only."""
    m = motifs.select("seq_id", "class", "subtype", "start_pos", "end_pos", "length", "score")
    points = mixed_regions(m).select(
        "seq_id", F.col("start_pos").alias("region_start"), F.col("end_pos").alias("start_pos"), "end_pos"
    )
    return _described(overlap_join(points, m, BIN), ["seq_id", "region_start", "end_pos"])


def hybrid_motifs(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Hybrids in the common motif schema, with their sequence."""
    rows = hybrids(motifs).join(seqs.select("seq_id", "sequence"), "seq_id")
    rows = rows.withColumn("motif", F.expr("substring(sequence, start_pos, length)"))
    return as_motifs(
        rows, CLASS, F.col("subtype"), F.col("score"), "OverlapSweep",
        detail=F.concat(
            F.lit("Classes="), F.size("class_breakdown"), F.lit(";Subtypes="), F.size("subclass_breakdown")
        ),
        attrs={
            "MotifClasses": F.array_join("classes", ","), "SubclassDetail": F.col("subclass_detail"),
            "ClassBreakdown": F.to_json("class_breakdown"), "SubclassBreakdown": F.to_json("subclass_breakdown"),
            "ContributingMotifs": F.to_json("contributing"),
            "OverlapDegree": F.round("overlap_degree", 3), "InteractionStrength": F.round("interaction_strength", 3),
            "Annotation": F.lit(NOTE),
        },
    )


def longest_hybrid(regions: DataFrame, motifs: DataFrame) -> DataFrame:
    """Per sequence the longest region (then most classes, then leftmost) and the motifs on it."""
    best = regions.groupBy("seq_id").agg(
        F.max_by(
            F.struct("start_pos", "end_pos", "length", "classes"),
            F.struct(F.col("length"), F.size("classes"), -F.col("start_pos")),
        ).alias("b")
    ).select("seq_id", "b.*")
    others = motifs.where(F.col("class") != CLASS).select("seq_id", "start_pos", "end_pos")
    pairs = overlap_join(best, others, BIN)
    rows = pairs.groupBy("seq_id", "start_pos", "end_pos", "length", "classes").agg(
        F.count(F.lit(1)).alias("overlap_count")
    )
    return rows.withColumn(
        "summary",
        F.concat(
            F.lit("Longest hybrid: "), F.col("length"), F.lit("bp, "), F.col("overlap_count"),
            F.lit(" overlapping motifs, Classes="), F.array_join("classes", "+"),
        ),
    )
