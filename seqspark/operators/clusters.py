"""Cluster regions with interaction scores, and pairwise hybrid structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.functions import sequence as S
from seqspark.operators.disease import CLASS as DISEASE
from seqspark.operators.intervals import chain_groups, islands, overlap_join, with_copy_no
from seqspark.operators.motifs import as_motifs
from seqspark.sources.stored import stored

CLUSTER_CLASS, PAIR_CLASS = "Advanced Non-B DNA Clusters", "Hybrid Structures"
WINDOW, MIN_MOTIFS, DISTANCE, MIN_OVERLAP = 500, 3, 200, 0.1

# Fixed values.  The short names of the rule tables, in official subtypes.
NAMES = {
    "G4": ["Canonical G4"],
    "i-motif": ["Canonical i-motif"],
    "R-loop": ["R-loop"],
    "Z-DNA": ["Z-DNA"],
    "eGZ": ["eGZ (Extruded-G) DNA"],
    "cruciform": ["Cruciform DNA [IR]/HairPin [IR]"],
    "slipped": ["Slipped DNA [Direct Repeat]", "Slipped DNA [STR]"],
    "G-triplex": ["G-Triplex intermediate"],
    "triplex": ["Triplex"],
    "sticky": ["sticky DNA"],
    "curved": ["Global curvature", "Local Curvature"],
}
INTERACTION = {
    ("G4", "G4"): 0.8, ("G4", "i-motif"): 0.9, ("G4", "R-loop"): 0.6, ("G4", "Z-DNA"): 0.4,
    ("Z-DNA", "cruciform"): 0.5, ("Z-DNA", "slipped"): 0.6, ("Z-DNA", "eGZ"): 0.7,
    ("R-loop", "G-triplex"): 0.8, ("R-loop", "sticky"): 0.5, ("triplex", "sticky"): 0.8,
    ("G-triplex", "G4"): 0.6, ("slipped", "cruciform"): 0.7,
}
DEFAULT_INTERACTION = 0.3
# pair -> impact level, stability bonus, function
PAIRS = {
    ("G4", "i-motif"): ("high", 0.8, "pH-sensitive gene regulation"),
    ("Z-DNA", "cruciform"): ("high", 0.6, "Transcriptional pausing and recombination"),
    ("R-loop", "G-triplex"): ("high", 0.7, "Enhanced transcription-replication conflicts"),
    ("triplex", "sticky"): ("high", 0.9, "Chromatin compaction and silencing"),
    ("G4", "R-loop"): ("minor", 0.3, "Transcriptional regulation"),
    ("slipped", "cruciform"): ("moderate", 0.3, "Replication fork stalling"),
    ("Z-DNA", "curved"): ("moderate", 0.3, "Nucleosome positioning"),
    ("G4", "Z-DNA"): ("moderate", 0.3, "Unknown functional impact"),
}
DEFAULT_PAIR = ("minor", 0.3, "Unknown functional impact")
MAJOR, SIGNIFICANT, ALTERED, CHANGED, MINOR = (
    "Major structural reorganization", "Significant structural change", "Moderate structural alteration",
    "Moderate structural change", "Minor structural perturbation",
)
SEVERITY = {MAJOR: 4, SIGNIFICANT: 3, ALTERED: 2, CHANGED: 2, MINOR: 1}
LABELS = ["Research Interest", "Regulatory Significance", "Moderate Clinical Significance", "High Clinical Significance"]
CANCER, REGULATORY = ["G4", "G-triplex", "R-loop"], ["Z-DNA", "cruciform", "curved"]


def _pairs(table: dict) -> list[tuple]:
    """Both subtypes in sorted order, then the values."""
    out = {}
    for (a, b), value in table.items():
        for x in NAMES[a]:
            for y in NAMES[b]:
                out[tuple(sorted((x, y)))] = value
    return [(*k, *(v if isinstance(v, tuple) else (v,))) for k, v in sorted(out.items())]


def interaction_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(INTERACTION), "sub_a string, sub_b string, weight double")


def pair_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(PAIRS), "sub_a string, sub_b string, level string, bonus double, function string")


# --- windows --------------------------------------------------------------------------------


def _in_windows(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Copies of every motif for the windows it lies in; window w starts at 250 w + 1."""
    step = WINDOW // 2
    m = motifs.select("seq_id", "class", "subtype", "start_pos", "end_pos", "length", "score", "motif_no")
    m = m.join(lengths.select("seq_id", F.col("length").alias("seq_len")), "seq_id")
    first = F.greatest(F.lit(0), F.ceil((F.col("end_pos") - WINDOW - 1) / step))
    last = F.least(
        F.floor((F.col("start_pos") - 1) / step), F.floor((F.col("seq_len") - WINDOW - 1) / step)
    )
    rows = m.where((F.col("seq_len") > WINDOW) & (first <= last))
    return rows.withColumn("w", F.explode(S.span(first, last)))


def _entropy(counts, total) -> Column:
    return -F.aggregate(
        counts, F.lit(0.0), lambda acc, n: acc + n / total * F.log2(n / total)
    )


def interaction_scores(inside: DataFrame) -> DataFrame:
    """Per window: mean of weight (1 - d / 200) over pairs at most 200 apart.

    Each motif is in two windows at most; a window spans 500 bases, so its motif number is
    bounded by the sequence, not by the size of the data.
    """
    a = inside.select("seq_id", "w", "class", "subtype", "start_pos", "end_pos", "motif_no")
    b = a.select([F.col(c).alias("r_" + c) for c in a.columns])
    key = ["start_pos", "end_pos", "class", "subtype", "motif_no"]
    on = (
        (F.col("seq_id") == F.col("r_seq_id")) & (F.col("w") == F.col("r_w"))
        & (F.struct(*["r_" + c for c in key]) > F.struct(*key))
    )
    distance = F.least(
        F.abs(F.col("start_pos") - F.col("r_end_pos")), F.abs(F.col("r_start_pos") - F.col("end_pos"))
    )
    pairs = a.join(b, on & (distance <= DISTANCE)).select(
        "seq_id", "w", F.least("subtype", "r_subtype").alias("sub_a"), F.greatest("subtype", "r_subtype").alias("sub_b"),
        distance.alias("distance"),
    )
    dim = F.broadcast(interaction_dim(inside.sparkSession))
    rows = pairs.join(dim, ["sub_a", "sub_b"], "left")
    score = F.coalesce("weight", F.lit(DEFAULT_INTERACTION)) * (1.0 - F.col("distance") / DISTANCE)
    return rows.groupBy("seq_id", "w").agg(F.avg(score).alias("interaction_score"), F.count(F.lit(1)).alias("n_pairs"))


def cooperative_scores(inside: DataFrame) -> DataFrame:
    """Per window: proximity of neighbours, base coverage and subtype diversity, at most 1."""
    order = Window.partitionBy("seq_id", "w").orderBy("start_pos", "end_pos", "class", "subtype", "motif_no")
    gap = F.lead("start_pos").over(order) - F.col("end_pos")
    rows = inside.withColumn("gap", gap)
    near = F.when(F.col("gap") <= DISTANCE, 1.0 - F.col("gap") / DISTANCE).otherwise(0.0)
    sums = rows.groupBy("seq_id", "w").agg(
        F.count(F.lit(1)).alias("n"), F.sum(near).alias("near"), F.sum("length").alias("bases"),
        (F.max("end_pos") - F.min("start_pos")).alias("span"), F.count_distinct("subtype").alias("kinds"),
    )
    proximity = F.col("near") / F.greatest(F.col("n") - 1, F.lit(1))
    density = F.when(F.col("span") > 0, F.col("bases") / F.col("span")).otherwise(0.0)
    diversity = F.col("kinds") / F.least(F.col("n"), F.lit(7))
    score = F.least(F.lit(1.0), proximity * 0.4 + density * 0.3 + diversity * 0.3)
    return sums.select("seq_id", "w", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(score).alias("cooperative_score"))


def _groups_present(subtypes, names: list[str]) -> Column:
    """How many of the named groups have a subtype in the array."""
    total = F.lit(0)
    for name in names:
        has = F.arrays_overlap(subtypes, F.array(*[F.lit(s) for s in NAMES[name]]))
        total = total + F.when(has, 1).otherwise(0)
    return total


def clinical_level(classes, subtypes) -> Column:
    """Rank 0..3 into LABELS."""
    return (
        F.when(F.array_contains(classes, DISEASE), 3)
        .when(_groups_present(subtypes, CANCER) >= 2, 2)
        .when(_groups_present(subtypes, REGULATORY) >= 2, 1)
        .otherwise(0)
    )


def label(level) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), level + 1)


def cluster_windows(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Windows of 500 (step 250) holding three or more whole motifs, with all scores."""
    inside = _in_windows(with_copy_no(motifs), lengths)
    counts = inside.groupBy("seq_id", "w", "class", "subtype").agg(F.count(F.lit(1)).alias("n"))
    by_kind = counts.groupBy("seq_id", "w", "subtype").agg(
        F.sum("n").alias("n"), F.collect_set("class").alias("classes")
    )
    rows = by_kind.groupBy("seq_id", "w").agg(
        F.sum("n").alias("motif_count"), F.sort_array(F.collect_list("subtype")).alias("motif_types"),
        F.sort_array(F.collect_list("n")).alias("counts"),
        F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes"),
    ).where(F.col("motif_count") >= MIN_MOTIFS)
    rows = rows.withColumn("diversity_index", _entropy(F.col("counts"), F.col("motif_count")))
    rows = rows.withColumn("clinical_level", clinical_level(F.col("classes"), F.col("motif_types")))
    rows = rows.join(interaction_scores(inside), ["seq_id", "w"], "left").join(
        cooperative_scores(inside), ["seq_id", "w"], "left"
    )
    start = F.col("w") * (WINDOW // 2) + 1
    return rows.select(
        "seq_id", start.cast("int").alias("start_pos"), (start + WINDOW).cast("int").alias("end_pos"),
        "motif_count", "motif_types", "diversity_index",
        F.coalesce("interaction_score", F.lit(0.0)).alias("interaction_score"),
        F.coalesce("cooperative_score", F.lit(0.0)).alias("cooperative_score"), "clinical_level",
    )


def merge_clusters(windows: DataFrame) -> DataFrame:
    """Join overlapping windows: counts add up, types unite, scores and label take the maximum."""
    spans = islands(windows, out="region").groupBy("seq_id", "region").agg(
        F.max("end_pos").alias("end_pos"), F.sum("motif_count").alias("motif_count"),
        F.max("diversity_index").alias("diversity_index"), F.max("interaction_score").alias("interaction_score"),
        F.max("cooperative_score").alias("cooperative_score"), F.max("clinical_level").alias("clinical_level"),
        # distinct lists of types: as many as there are sets of types, not as windows
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("motif_types")))).alias("motif_types"),
    )
    return spans.select(
        "seq_id", F.col("region").cast("int").alias("start_pos"), "end_pos", "motif_count", "motif_types",
        "diversity_index", "interaction_score", "cooperative_score",
        label(F.col("clinical_level")).alias("clinical_significance"),
    )


def clusters(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    return merge_clusters(cluster_windows(motifs, lengths))


def cluster_motifs(regions: DataFrame) -> DataFrame:
    """Cluster regions in the common motif schema; lengths are end - start here."""
    rows = regions.withColumn("motif", F.lit(""))
    n, kinds = F.col("motif_count"), F.size("motif_types")
    return as_motifs(
        rows, CLUSTER_CLASS, "Advanced_Cluster", F.col("interaction_score") * 100, "WindowInteraction",
        detail=F.concat(n, F.lit(" motifs")), spacer=F.concat(kinds, F.lit(" types")),
        attrs={
            "Motif_Count": n, "Motif_Types": F.array_join("motif_types", "; "),
            "Diversity_Index": F.round("diversity_index", 3), "Interaction_Score": F.round("interaction_score", 3),
            "Cooperative_Score": F.round("cooperative_score", 3),
            "Clinical_Significance": F.col("clinical_significance"),
            "Conservation_Score": F.col("diversity_index") * 100,
            "Structural_Impact": F.concat(F.lit("Multi-motif cooperative binding ("), n, F.lit(" structures)")),
        },
    ).withColumn("length", F.col("end_pos") - F.col("start_pos"))


def profile_clusters(regions: DataFrame, k: int = 5) -> DataFrame:
    """Group regions by profile: adds ``profile`` (0 .. k - 1) from six standardised features."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = regions.withColumn("n_types", F.size("motif_types")).withColumn(
        "span", F.col("end_pos") - F.col("start_pos")
    )
    features = ["motif_count", "diversity_index", "interaction_score", "cooperative_score", "n_types", "span"]
    # the fit passes over the regions many times
    rows = stored(rows, "cluster-regions")
    rows = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows)
    # not centred: the first split starts from a share of the centre's length
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=False, withStd=True).fit(rows)
    rows = scaler.transform(rows).drop("_raw")
    model = BisectingKMeans(k=k, seed=1, featuresCol="features", predictionCol="profile").fit(rows)
    return model.transform(rows).drop("features")


def profile_summary(profiled: DataFrame) -> DataFrame:
    """Extent and mean scores of every profile."""
    return profiled.groupBy("profile").agg(
        F.count(F.lit(1)).alias("regions"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
        F.sum("motif_count").alias("motif_count"), F.avg("diversity_index").alias("diversity_index"),
        F.max("interaction_score").alias("interaction_score"), F.avg("cooperative_score").alias("cooperative_score"),
    )


# --- pairwise hybrid structures -------------------------------------------------------------


def hybrid_pairs(motifs: DataFrame) -> DataFrame:
    """Pairs of motifs whose overlap is at least a tenth of the shorter one."""
    m = with_copy_no(motifs).select(
        "seq_id", "class", "subtype", "start_pos", "end_pos", "score", "motif_no"
    )
    key = ["start_pos", "end_pos", "class", "subtype", "motif_no"]
    pairs = overlap_join(m, m).where(F.struct(*key) < F.struct(*["r_" + c for c in key]))
    inner = F.least("end_pos", "r_end_pos") - F.greatest("start_pos", "r_start_pos")
    shorter = F.least(F.col("end_pos") - F.col("start_pos"), F.col("r_end_pos") - F.col("r_start_pos"))
    pairs = pairs.withColumn("overlap", F.when((inner > 0) & (shorter > 0), inner / shorter))
    pairs = pairs.where(F.col("overlap") >= MIN_OVERLAP)
    dim = F.broadcast(pair_dim(motifs.sparkSession))
    rows = pairs.withColumn("sub_a", F.least("subtype", "r_subtype")).withColumn(
        "sub_b", F.greatest("subtype", "r_subtype")
    ).join(dim, ["sub_a", "sub_b"], "left")
    level = F.coalesce("level", F.lit(DEFAULT_PAIR[0]))
    impact = (
        F.when((level == "high") & (F.col("overlap") > 0.7), MAJOR)
        .when((level == "high") & (F.col("overlap") > 0.4), SIGNIFICANT)
        .when(level == "high", ALTERED).when(level == "moderate", CHANGED).otherwise(MINOR)
    )
    stability = F.least(
        F.lit(1.0),
        (F.col("score") + F.col("r_score")) / 200.0 + F.col("overlap") * 0.3
        + F.coalesce("bonus", F.lit(DEFAULT_PAIR[1])),
    )
    return rows.select(
        "seq_id", F.least("start_pos", "r_start_pos").alias("start_pos"),
        F.greatest("end_pos", "r_end_pos").alias("end_pos"),
        F.col("subtype").alias("first_subtype"), F.col("r_subtype").alias("second_subtype"),
        F.col("start_pos").alias("first_start"), F.col("r_start_pos").alias("second_start"),
        F.col("r_end_pos").alias("second_end"),
        "overlap", stability.alias("stability"), impact.alias("impact"),
        F.coalesce("function", F.lit(DEFAULT_PAIR[2])).alias("function"),
    )


PAIR_ORDER = ["start_pos", "end_pos", "first_subtype", "second_start", "second_end", "second_subtype"]


def consolidate_pairs(pairs: DataFrame) -> DataFrame:
    """Join a pair to the open group while it starts in the first four fifths of its span.

    Overlaps are averaged pairwise along the chain, so member i of n has the weight
    2^-(n - i + 1), the first one 2^-(n - 1).
    """
    rows = chain_groups(
        pairs, [F.col(c) for c in PAIR_ORDER],
        lambda start, end, first, last: start <= last and (start - first) / (last - first) < 0.8,
    )
    key = ["seq_id", "_stretch", "chain"]
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    size = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = rows.withColumn("size", size)
    weight = F.pow(
        F.lit(2.0), -(F.col("size") - F.col("chain_place") + F.when(F.col("chain_place") == 1, 0).otherwise(1))
    )
    worst = F.struct(severity[F.col("impact")].alias("rank"), (-F.col("chain_place")).alias("place"))
    grouped = rows.groupBy(*key).agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("overlap") * weight).alias("overlap"),
        F.max("stability").alias("stability"), F.max_by("impact", worst).alias("impact"),
        F.sort_array(F.collect_list(F.struct("chain_place", "function", "first_subtype", "second_subtype"))).alias("m"),
    )
    return grouped.select(
        "seq_id", "start_pos", "end_pos", "n_pairs", "overlap", "stability", "impact",
        F.array_join(F.transform("m", lambda x: x["function"]), "; ").alias("function"),
        F.array_join(
            F.flatten(F.transform("m", lambda x: F.array(x["first_subtype"], x["second_subtype"]))), "; "
        ).alias("components"),
    )


def hybrid_structures(motifs: DataFrame) -> DataFrame:
    return consolidate_pairs(hybrid_pairs(motifs))


def hybrid_structure_motifs(structures: DataFrame) -> DataFrame:
    rows = structures.withColumn("motif", F.lit(""))
    return as_motifs(
        rows, PAIR_CLASS, "Hybrid_Structure", F.col("stability") * 100, "PairOverlap",
        detail=F.concat(F.col("n_pairs") * 2, F.lit(" components")),
        spacer=F.concat(F.format_number(F.col("overlap") * 100, 1), F.lit("% overlap")),
        attrs={
            "Component_Motifs": F.col("components"), "Overlap_Degree": F.round("overlap", 3),
            "Structural_Impact": F.col("impact"), "Stability_Enhancement": F.round("stability", 3),
            "Functional_Prediction": F.col("function"), "Conservation_Score": F.col("stability") * 100,
            "Structural_Impact_Detail": F.concat(F.lit("Hybrid of "), F.replace("components", F.lit("; "), F.lit(" + "))),
        },
    ).withColumn("length", F.col("end_pos") - F.col("start_pos"))
