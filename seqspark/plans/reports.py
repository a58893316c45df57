"""Summary tables over motifs: aggregates, shares, distributions and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.functions import sequence as S
from seqspark.sources.stored import stored


def per_kb(count, length) -> Column:
    return S.col(count) / S.col(length) * 1000.0


def class_counts(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def motifs_per_sequence(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Every sequence with its motif count, also those without any."""
    counts = motifs.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_motifs"))
    return seqs.join(counts, "seq_id", "left").withColumn("n_motifs", F.coalesce("n_motifs", F.lit(0)))


def sequence_summary(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    rows = motifs_per_sequence(motifs, seqs.select("seq_id", "name", "length"))
    return rows.withColumn("motifs_per_kb", F.round(per_kb("n_motifs", "length"), 2))


def overview(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    a = seqs.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("length").alias("total_bp"))
    b = motifs.agg(
        F.count(F.lit(1)).alias("n_motifs"), F.count_distinct("class").alias("n_classes"),
        F.count_distinct("subtype").alias("n_subtypes"),
    )
    return a.join(F.broadcast(b)).withColumn("motifs_per_sequence", F.col("n_motifs") / F.col("n_sequences")).withColumn(
        "motifs_per_kb", per_kb("n_motifs", "total_bp")
    )


def count_statistics(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    rows = motifs_per_sequence(motifs, seqs.select("seq_id", "length"))
    return rows.agg(
        F.avg("n_motifs").alias("mean_motifs"), F.median("n_motifs").alias("median_motifs"),
        F.stddev_pop("n_motifs").alias("std_motifs"), F.min("n_motifs").alias("min_motifs"),
        F.max("n_motifs").alias("max_motifs"), F.avg("length").alias("mean_length"),
        F.median("length").alias("median_length"), F.sum("length").alias("total_length"),
    )


def shares(motifs: DataFrame, by: str) -> DataFrame:
    """Count and percentage per value of one column.  The window runs over the grouped rows."""
    rows = motifs.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percentage", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def top_shares(motifs: DataFrame, by: str = "class", n: int = 5) -> DataFrame:
    return shares(motifs, by).orderBy(F.desc("n"), by).limit(n)


def positional_density(motifs: DataFrame, seqs: DataFrame, bins: int = 100) -> DataFrame:
    """Motif starts per bin; a sequence has about ``bins`` bins of at least one base."""
    size = F.greatest(F.floor(F.col("seq_len") / bins), F.lit(1))
    rows = motifs.select("seq_id", "start_pos").join(
        seqs.select("seq_id", F.col("length").alias("seq_len")), "seq_id"
    )
    return rows.groupBy("seq_id", F.floor(F.col("start_pos") / size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_bins(motifs: DataFrame, size: int = 100) -> DataFrame:
    return motifs.groupBy("class", F.floor(F.col("start_pos") / size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_subtype_counts(motifs: DataFrame) -> DataFrame:
    """Counts per class and subtype with margins (null)."""
    return motifs.cube("class", "subtype").agg(F.count(F.lit(1)).alias("n"))


def score_pivot(motifs: DataFrame, classes: list[str]) -> DataFrame:
    """Mean score, one row per subtype and one column per class, 0 where there is none.

    A class that is not listed is an error, not a silent gap.
    """
    known = F.col("class").isin(classes)
    checked = F.when(known, F.col("class")).otherwise(F.raise_error(F.concat(F.lit("class not listed: "), "class")))
    return motifs.withColumn("class", checked).groupBy("subtype").pivot("class", classes).agg(F.avg("score")).fillna(0.0)


def distribution(motifs: DataFrame, value: str, by: str = "class") -> DataFrame:
    """Box-plot figures per group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = motifs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q"),
    )
    return rows.select(
        by, "n", "mean", "std", "min", "max", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    )


def length_score_trend(motifs: DataFrame) -> DataFrame:
    return motifs.agg(
        F.regr_slope("score", "length").alias("slope"), F.regr_intercept("score", "length").alias("intercept")
    )


def score_histogram(motifs: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest score, the largest in the last bin."""
    ends = motifs.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    place = F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    rows = motifs.select("score").join(F.broadcast(ends))
    return rows.groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def circular_positions(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    rows = motifs.select("seq_id", "class", "start_pos", "end_pos").join(
        seqs.select("seq_id", F.col("length").alias("seq_len")), "seq_id"
    )
    return rows.select(
        "seq_id", "class", "start_pos", "end_pos",
        (F.col("start_pos") * 360.0 / F.col("seq_len")).alias("angle"),
    )


def mean_probability(scored: DataFrame) -> DataFrame:
    return scored.groupBy("class").agg(F.avg("ml_probability").alias("mean_probability")).orderBy("mean_probability", "class")


# --- comparison of sequences ----------------------------------------------------------------


def gc_category(gc) -> Column:
    return F.when(gc < 40, "Low GC").when(gc <= 55, "Medium GC").otherwise("High GC")


def sequence_comparison(motifs: DataFrame, seqs: DataFrame, classes: list[str]) -> DataFrame:
    """Per sequence: GC, category, motif density (of all motifs) and count and density of the classes."""
    of_class = [F.count_if(F.col("class") == c).alias(f"_{i}") for i, c in enumerate(classes)]
    counts = motifs.groupBy("seq_id").agg(F.count(F.lit(1)).alias("_all"), *of_class)
    rows = seqs.select("seq_id", "name", "length", S.gc_content("sequence").alias("gc")).join(counts, "seq_id", "left")
    counted = [F.coalesce(F.col(f"_{i}"), F.lit(0)) for i in range(len(classes))]
    total = F.coalesce("_all", F.lit(0))
    out = rows.select(
        "seq_id", "name", "length", "gc", gc_category(F.col("gc")).alias("gc_category"), total.alias("n_motifs"),
        per_kb(total, "length").alias("motif_density"),
        *[c.alias(f"{name}_Count") for c, name in zip(counted, classes)],
        *[per_kb(c, "length").alias(f"{name}_Density") for c, name in zip(counted, classes)],
    )
    return out


def category_statistics(compared: DataFrame) -> DataFrame:
    return compared.groupBy("gc_category").agg(
        F.min("gc").alias("min_gc"), F.max("gc").alias("max_gc"), F.avg("motif_density").alias("mean_density"),
        F.stddev_samp("motif_density").alias("std_density"), F.count(F.lit(1)).alias("n_sequences"),
        F.sum("n_motifs").alias("n_motifs"),
    )


def category_class_means(compared: DataFrame, classes: list[str]) -> DataFrame:
    return compared.groupBy("gc_category").agg(*[F.avg(f"{c}_Count").alias(c) for c in classes])


def gc_density_correlation(compared: DataFrame) -> DataFrame:
    return compared.agg(F.corr("gc", "motif_density").alias("r"), F.count(F.lit(1)).alias("n"))


# --- genes and clinical tables --------------------------------------------------------------


def gene_summary(motifs: DataFrame, disease: DataFrame, seqs: DataFrame) -> DataFrame:
    """Per sequence its gene, length, GC and numbers of motifs and disease motifs."""
    d = disease.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_disease"))
    # texts stay behind, only what is told of them is joined
    told = seqs.select("seq_id", "name", "gene", "length", S.gc_content("sequence").alias("gc"))
    rows = motifs_per_sequence(motifs, told).join(d, "seq_id", "left")
    return rows.select(
        "seq_id", "name", F.coalesce("gene", F.lit("Unknown")).alias("gene"), "length",
        "gc", "n_motifs", F.coalesce("n_disease", F.lit(0)).alias("n_disease"),
        per_kb("n_motifs", "length").alias("motif_density"),
    )


def gene_statistics(genes: DataFrame) -> DataFrame:
    return genes.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("n_motifs").alias("n_motifs"),
        F.sum("n_disease").alias("n_disease"), F.avg("n_motifs").alias("mean_motifs"),
        F.avg("n_disease").alias("mean_disease"), F.avg("length").alias("mean_length"), F.avg("gc").alias("mean_gc"),
        F.count_if(F.col("n_disease") > 0).alias("with_disease"),
        F.max_by("name", F.struct("n_motifs", -F.col("seq_id"))).alias("most_motifs_name"),
        F.max("n_motifs").alias("most_motifs"),
    )


def top_sequences(genes: DataFrame, n: int = 10) -> DataFrame:
    """The n sequences with most motifs, with metrics in standard deviations from the mean of all."""
    genes = stored(genes, "genes")  # read twice
    ends = genes.agg(
        *[F.avg(c).alias("m_" + c) for c in ("n_motifs", "gc", "motif_density")],
        *[F.stddev_pop(c).alias("s_" + c) for c in ("n_motifs", "gc", "motif_density")],
    )
    top = genes.orderBy(F.desc("n_motifs"), "seq_id").limit(n)
    return top.join(F.broadcast(ends)).select(
        "seq_id", "name", "n_motifs",
        *[((F.col(c) - F.col("m_" + c)) / F.nullif(F.col("s_" + c), F.lit(0.0))).alias("z_" + c)
          for c in ("n_motifs", "gc", "motif_density")],
    )


def clinical_counts(disease: DataFrame) -> DataFrame:
    label = F.col("clinical_significance")
    return disease.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(label == "Pathogenic").alias("pathogenic"),
        F.count_if(label == "Likely Pathogenic").alias("likely_pathogenic"),
        F.count_if(label == "Variant of Uncertain Significance").alias("uncertain"),
        F.count_distinct("disease_name").alias("diseases"), F.count_distinct("gene_symbol").alias("genes"),
    )


def clinical_table(disease: DataFrame) -> DataFrame:
    return disease.select(
        "seq_id", "disease_name", "gene_symbol", "repeat_unit", "repeat_count", "normal_range", "threshold",
        "clinical_significance", "risk_score", "inheritance",
        (F.col("clinical_significance") == "Pathogenic").alias("pathogenic"),
    )


def risk_bands(disease: DataFrame) -> DataFrame:
    r = F.col("risk_score")
    band = F.when(r >= 85, "Very High").when(r >= 70, "High").when(r >= 50, "Moderate").otherwise("Low")
    return disease.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def highest_risk(disease: DataFrame) -> DataFrame:
    key = F.struct(F.col("risk_score"), F.col("repeat_count"), -F.col("seq_id"), -F.col("start_pos"))
    what = F.struct("seq_id", "start_pos", "disease_name", "gene_symbol", "risk_score", "clinical_significance")
    return disease.agg(F.max_by(what, key).alias("b")).select("b.*")


def therapy_diseases(disease: DataFrame) -> DataFrame:
    rows = disease.where(F.col("therapeutic_target") != "No specific targets identified")
    return rows.groupBy("therapeutic_target").agg(
        F.array_join(F.sort_array(F.collect_set("disease_name")), "; ").alias("diseases"), F.count(F.lit(1)).alias("n")
    )


# Fixed values.
INHERITANCE = {
    "AR": "Autosomal Recessive - Both parents are carriers",
    "AD": "Autosomal Dominant - One affected parent passes the condition",
    "XL": "X-Linked - Passed through X chromosome",
    "MT": "Mitochondrial - Maternal inheritance",
}


def counselling_notes(disease: DataFrame) -> DataFrame:
    explained = F.create_map(*[F.lit(x) for kv in INHERITANCE.items() for x in kv])
    return disease.groupBy("genetic_counseling", "inheritance").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "explanation", F.try_element_at(explained, F.col("inheritance"))
    )


# --- intersections and edges ----------------------------------------------------------------


def cooccurrence(motifs: DataFrame) -> DataFrame:
    """Overlapping pairs per ordered pair of different classes."""
    from seqspark.operators.sweep import overlaps_by_class

    return overlaps_by_class(motifs)


def class_intersections(motifs: DataFrame, classes: list[str], top: int = 15) -> DataFrame:
    """Bases covered by one, two or three classes at once, the largest first.

    Intervals of a class are joined, so at every breakpoint a sum of powers of two says which
    classes are open; no base is ever a row of its own. A class that is not listed is an error.
    """
    from seqspark.operators.intervals import islands

    m = motifs.select("seq_id", "class", "start_pos", "end_pos")
    merged = islands(m, key=("seq_id", "class")).groupBy("seq_id", "class", "island").agg(
        F.max("end_pos").alias("end_pos")
    ).withColumnRenamed("island", "start_pos")
    bit = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(1 << i))])
    merged = islands(merged, out="stretch", order=["end_pos", "class"]).withColumn("bit", F.coalesce(
        F.try_element_at(bit, F.col("class")), F.raise_error(F.concat(F.lit("class not listed: "), "class")).cast("int")))
    events = merged.select(
        "seq_id", "stretch", F.inline(F.array(
            F.struct(F.col("start_pos").alias("pos"), F.col("bit").alias("delta")),
            F.struct((F.col("end_pos") + 1).alias("pos"), (-F.col("bit")).alias("delta")),
        ))
    )
    events = events.groupBy("seq_id", "stretch", "pos").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy("seq_id", "stretch").orderBy("pos")
    events = events.withColumn("mask", F.sum("delta").over(order)).withColumn(
        "bases", F.lead("pos").over(order) - F.col("pos")
    )
    sizes = events.where(F.col("mask") > 0).groupBy("mask").agg(F.sum("bases").alias("bases"))
    combos = [[c] for c in range(len(classes))]
    for depth in (2, 3):
        combos += [c + [n] for c in combos if len(c) == depth - 1 for n in range(c[-1] + 1, len(classes))]
    table = F.array(*[
        F.struct(F.lit(sum(1 << i for i in c)).alias("bits"), F.lit(" + ".join(classes[i] for i in c)).alias("classes"))
        for c in combos
    ])
    rows = sizes.select("mask", "bases", F.inline(table)).where(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"))
    out = rows.groupBy("classes").agg(F.sum("bases").alias("bases"))
    return out.orderBy(F.desc("bases"), "classes").limit(top)


def proximity_edges(motifs: DataFrame, distance: int = 1000) -> DataFrame:
    """Pairs of motifs with starts closer than ``distance`` and the weight distance - d.

    This is the edge list itself; ``proximity_by_class`` counts it without making it.
    """
    from seqspark.operators.intervals import nearby_join, with_copy_no

    m = with_copy_no(motifs).select("seq_id", "class", "subtype", "start_pos", "end_pos", "motif_no")
    m = m.withColumn("motif_no", F.concat_ws("|", "end_pos", "class", "subtype", "motif_no"))
    pairs = nearby_join(m, distance)
    return pairs.select(
        "seq_id", "class", "start_pos", F.col("r_class").alias("other_class"), F.col("r_start_pos").alias("other_start"),
        (F.lit(distance) - (F.col("r_start_pos") - F.col("start_pos"))).alias("weight"),
    )


# --- tables for display ---------------------------------------------------------------------


def display_rows(motifs: DataFrame) -> DataFrame:
    """Ordered ten-column projection with defaults."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return motifs.select(
        text("seq_name").alias("Sequence Name"), text("class").alias("Class"), text("subtype").alias("Subtype"),
        F.col("start_pos").alias("Start"), F.col("end_pos").alias("End"), F.col("length").alias("Length"),
        S.wrap(text("sequence")).alias("Sequence"), F.col("score").alias("Score"),
        text("detail").alias("Arms/Repeat Unit/Copies"), text("spacer").alias("Spacer"),
    )


def comprehensive_table(motifs: DataFrame) -> DataFrame:
    """Flat table with motif ids numbered inside each sequence and fragments cut at 100 bases."""
    order = Window.partitionBy("seq_id").orderBy("start_pos", "end_pos", "class", "subtype")
    cut = F.when(F.length("sequence") > 100, F.concat(F.substring("sequence", 1, 100), F.lit("..."))).otherwise(
        F.col("sequence")
    )
    return motifs.select(
        F.concat_ws("_", "seq_id", F.row_number().over(order)).alias("motif_id"), "seq_id", "class", "subtype",
        "start_pos", "end_pos", "length", "score", cut.alias("fragment"),
    )


def fill_defaults(df: DataFrame, numeric=(), text=()) -> DataFrame:
    """Missing report columns become 0 or "Unknown"; numbers are read from text where needed."""
    rows = df
    for c in numeric:
        value = F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
        rows = rows.withColumn(c, F.coalesce(value, F.lit(0.0)))
    for c in text:
        value = F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(None).cast("string")
        rows = rows.withColumn(c, F.coalesce(value, F.lit("Unknown")))
    return rows


def cluster_rows(motifs: DataFrame) -> DataFrame:
    return motifs.where(F.lower("class").contains("cluster"))


def disease_rows(motifs: DataFrame) -> DataFrame:
    return motifs.where(F.col("class").contains("Disease"))
