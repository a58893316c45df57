"""The registered queries.  All of them run over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import features, sequence as S
from seqspark.operators import (
    classify, clusters, conservation, cruciform, curved, disease, g4, hotspots, hybrid, imotif, intervals, rloop, scan,
    slipped, sweep, triplex, zdna,
)
from seqspark.operators.motifs import union
from seqspark.plans import reports
from seqspark.plans.all_motifs import all_motifs, detectors, filter_motifs, searched, select_by_priority
from seqspark.sources import fasta
from seqspark.sources.stored import stored
from seqspark.sources.tables import sequences

CORE_CLASSES = [
    "Curved DNA", "R-loop", "Triplex", "Z-DNA", "G-Quadruplex Family", "i-motif family", disease.CLASS,
]
#: The official classes that a detector emits (hybrids and cluster regions are made of them), and the diseases.
DETECTED_CLASSES = [c for c, subclasses in classify.TAXONOMY.items() if subclasses] + [disease.CLASS]
R6 = lambda c: F.round(c, 6)
#: For sums whose last bits depend on their order: a tie at the sixth place is rounded alike.
R6_TIES = lambda c: F.round(F.round(c, 12), 6)


def core_motifs(seqs: DataFrame) -> DataFrame:
    """The detectors whose rows have SQL; slipped, cruciform and H-DNA have none.

    Scores are rounded to six places, so that SQL and Spark sum up the same numbers.
    """
    seqs = searched(seqs)
    rows = union(
        [
            curved.curved_dna(seqs), triplex.sticky_dna(seqs), zdna.egz(seqs), zdna.zdna(seqs), rloop.rloops(seqs),
            g4.g4_family(seqs), imotif.imotifs(seqs), imotif.ac_motifs(seqs),
            disease.as_motif_rows(disease.disease_repeats(seqs)),
        ]
    )
    return rows.withColumn("score", R6(F.col("score")))


_kept: dict = {}


def detected_motifs(seqs: DataFrame) -> DataFrame:
    """The rows of all detectors, scores rounded to six places: the common input of the interval and report queries."""
    return detectors(fasta.valid_sequences(seqs)).withColumn("score", R6(F.col("score")))


def _core(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detected motifs, written once to the shared folder for the other queries of the session, and sequences."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        seqs = sequences(spark, sf_dir)
        _kept[key] = (stored(detected_motifs(seqs), "detected-motifs", dealt=True), seqs)
    return _kept[key]


def _on_core(build):
    def query(spark, sf_dir):
        return build(*_core(spark, sf_dir))

    return query


def _on_lengths(build):
    """A query on detected motifs that asks for names and lengths only, which are stored too: a sequence is not made anew
    each time that its length is joined."""

    def query(spark, sf_dir):
        motifs, seqs = _core(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir, "lengths")
        if key not in _kept:
            _kept[key] = stored(seqs.select("seq_id", "name", "gene", "length"), "lengths")
        return build(motifs, _kept[key])

    return query


def _on_seqs(build):
    def query(spark, sf_dir):
        return build(sequences(spark, sf_dir))

    return query


POS = ["seq_id", "start_pos", "end_pos"]


def _motif_rows(motifs: DataFrame) -> DataFrame:
    return motifs.select(*POS, "class", "subtype", "length", "sequence", R6("score").alias("score"), "detail", "spacer")


def _found_rows(motifs: DataFrame) -> DataFrame:
    return _motif_rows(motifs.withColumn("detail", F.coalesce("detail", F.lit("")))).drop("sequence")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, R6(F.col(n)))
    return df


# --- sequence functions ---------------------------------------------------------------------


def seq_stats(q):
    return q.select(
        "seq_id", "length", R6(S.gc_content("sequence")).alias("gc"),
        R6(S.purine_fraction("sequence")).alias("purine"), R6(S.pyrimidine_fraction("sequence")).alias("pyrimidine"),
        F.md5(S.reverse_complement("sequence")).alias("revcomp_md5"),
        S.is_palindrome("sequence").alias("palindrome"), F.md5(S.wrap("sequence")).alias("wrapped_md5"),
    )


def hunter_scores(q):
    return q.select(
        "seq_id", R6(S.hunter_score("sequence")).alias("hunter"), R6(S.g4hunter_score("sequence")).alias("g4hunter"),
        R6(S.ac_motif_score("sequence")).alias("ac_score"), R6(S.curvature_score("sequence")).alias("curvature"),
        R6(S.structural_factor("sequence", "R-loop")).alias("rloop_factor"),
        R6(S.structural_factor("sequence", "Z-DNA")).alias("zdna_factor"),
    )


def base_runs(q):
    return scan.base_runs(q).groupBy("seq_id", "base").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bases"), F.max("length").alias("longest"),
        F.sum(F.col("start_pos").cast("long")).alias("start_sum"),
    )


def fasta_records(q):
    text = F.concat(
        F.lit("> \n"), S.wrap("sequence"), F.lit("\n>"), F.col("name"), F.lit("|"), F.coalesce("gene", F.lit("")),
        F.lit("|a > b\n"), F.lower(S.wrap("sequence", 50)), F.lit("\n>empty\n\n"),
    )
    rows = fasta.with_header_fields(fasta.parse_fasta_text(q.select(F.col("name").alias("file"), text.alias("text"))))
    return rows.select(
        "file", "record_no", "name", "gene_symbol", "disease_info", "length", F.md5("sequence").alias("md5")
    )


# --- detectors ------------------------------------------------------------------------------


def zdna_weights(q):
    return zdna.step_weights(q).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.min("weight").alias("lowest"),
        F.sum(F.col("pos") * F.col("weight")).alias("moment"),
    )


def rlfs_zones(q):
    zones = [rloop.initiating_zones(q.select("seq_id", "sequence"), m) for m in ("m1", "m2")]
    return zones[0].unionByName(zones[1]).select(*POS, "model", "riz")


def imotif_windows(q):
    return q.select("seq_id", R6(S.imotif_score("sequence")).alias("score"))


def disease_table(q):
    return _rounded(
        disease.disease_repeats(q, "gene").drop("motif", "repeat_type"),
        "risk_score", "instability_score", "population_percentile", "conservation_score",
    )


# --- intervals ------------------------------------------------------------------------------


def hotspot_windows(m, q):
    return _rounded(hotspots.hotspot_windows(m, q).drop("parts"), "score")


def hotspots_merged(m, q):
    return _rounded(hotspots.hotspots(m, q).drop("class_breakdown", "subclass_breakdown"), "score")


def hybrid_list(m, q):
    rows = hybrid.hybrids(m).select(
        *POS, "length", "n_motifs", "subtype", "subclass_detail", "overlap_degree", "interaction_strength", "score"
    )
    return _rounded(rows, "overlap_degree", "interaction_strength", "score")


def longest_hybrids(m, q):
    return hybrid.longest_hybrid(hybrid.hybrids(m), m).drop("classes")


def _cluster_scores(rows):
    for name in ("interaction_score", "cooperative_score"):
        rows = rows.withColumn(name, R6_TIES(F.col(name)))
    return _rounded(rows, "diversity_index")


def cluster_windows(m, q):
    rows = clusters.cluster_windows(m, q).withColumn("motif_types", F.array_join("motif_types", "; "))
    return _cluster_scores(rows)


def clusters_merged(m, q):
    return _cluster_scores(clusters.clusters(m, q).withColumn("motif_types", F.array_join("motif_types", "; ")))


def cluster_profiles(m, q):
    return clusters.profile_summary(clusters.profile_clusters(clusters.clusters(m, q)))


def hybrid_pairs(m, q):
    return _rounded(clusters.hybrid_pairs(m), "overlap", "stability")


def hybrid_structures(m, q):
    return _rounded(clusters.hybrid_structures(m), "overlap", "stability")


def proximity(m, q):
    return sweep.proximity_by_class(m)


def selected(m, q):
    return select_by_priority(m).select(*POS, "class", "subtype", R6("score").alias("score"))


def g4_priority(m, q):
    return g4.g4_priority_filter(m).select(*POS, "class", "subtype", "score")


# --- classification, statistics -------------------------------------------------------------


def official_classes(m, q):
    """Motif names in older spelling, brought back to the official ones."""
    other = {v: k for k, v in reversed(list(classify.ALIASES.items()))}
    table = F.create_map(*[F.lit(x) for kv in other.items() for x in kv])
    old = m.select(
        F.coalesce(F.try_element_at(table, F.col("class")), F.col("class")).alias("class"),
        F.coalesce(F.try_element_at(table, F.col("subtype")), F.col("subtype")).alias("subtype"),
    )
    rows = classify.official_names(old)
    return rows.groupBy("class", "subtype", "official_class", "official_subtype").agg(F.count(F.lit(1)).alias("n"))


def subtype_defaults(m, q):
    """Motifs of even length lose their subtype, which is then looked up or "Canonical"."""
    blank = m.select("class", F.when(F.col("length") % 2 == 0, F.lit("")).otherwise(F.col("subtype")).alias("subtype"))
    rows = classify.official_names(blank)
    rows = rows.withColumn("filled", classify.ensure_subtype("subtype", "official_subtype"))
    return rows.groupBy("class", "subtype", "filled").agg(F.count(F.lit(1)).alias("n"))


def filtered_motifs(m, q):
    """The user filters over class, sequence, score and length."""
    named = m.join(q.select("seq_id", F.col("name").alias("seq_name")), "seq_id")
    rows = filter_motifs(named, classes=["Z-DNA", "Slipped DNA", "R-loop"], min_score=20.0, min_length=13, max_length=400)
    return rows.select(*POS, "seq_name", "class", "subtype", "length", "score")


def column_defaults(m, q):
    """Report columns that are missing, blank or no numbers are filled."""
    loose = m.select(
        *POS, "class", F.when(F.col("length") > 20, F.col("subtype")).otherwise("").alias("subtype"),
        F.when(F.col("length") % 2 == 0, F.col("score").cast("string")).otherwise("n/a").alias("score"),
    )
    return reports.fill_defaults(loose, numeric=["score", "conservation_score"], text=["subtype", "gene"])


def disease_subset(m, q):
    return reports.disease_rows(m).select(*POS, "class", "subtype", "length", "score")


def cluster_subset(m, q):
    rows = union([m, hotspots.hotspot_motifs(m, q)])
    return reports.cluster_rows(rows).select(*POS, "class", "subtype", "length", R6("score").alias("score"))


def guarded_sequences(q):
    """Every sequence, as it is and with an ambiguous base at its end, and whether the guard lets it pass."""
    both = q.select("seq_id", F.explode(F.array(F.lower("sequence"), F.concat("sequence", F.lit("N")))).alias("sequence"))
    passed = lambda rows, ok: rows.select("seq_id", F.lit(ok).alias("valid"), F.length("sequence").alias("length"), F.md5("sequence").alias("md5"))
    return passed(fasta.valid_sequences(both), True).unionByName(passed(fasta.rejected_sequences(both), False))


def conserved(m, q):
    rows = conservation.with_conservation(m)
    out = rows.select(
        *POS, "class", "subtype", "observed_count", "null_mean", "null_std", "conservation_score", "conservation_p",
        "conservation_significance",
    )
    return _rounded(out, "null_mean", "null_std", "conservation_score", "conservation_p")


def feature_rows(m, q):
    named = {k: R6_TIES(v).alias(k) for k, v in features.feature_columns("sequence").items()}
    return m.select(*POS, "subtype", *named.values())


def probabilities(m, q):
    rows = features.with_probability(m).select(
        *POS, "class", "subtype", "ml_probability", "ml_confidence", "ml_stability", "ml_pattern_score", "enhanced_score"
    )
    return _rounded(rows, "ml_probability", "ml_confidence", "ml_stability", "ml_pattern_score", "enhanced_score")


def mean_probability(m, q):
    return _rounded(reports.mean_probability(features.with_probability(m)), "mean_probability")


def _doubles(df: DataFrame) -> DataFrame:
    return _rounded(df, *[n for n, t in df.dtypes if t == "double"])


def comparison(m, q):
    return reports.sequence_comparison(m, q, DETECTED_CLASSES)


def genes(m, q):
    return reports.gene_summary(m, m.where(F.col("class") == disease.CLASS), q)


def _on_disease(build):
    return _on_seqs(lambda q: _doubles(build(disease.disease_repeats(q, "gene"))))


def queries() -> dict:
    on_seqs = {
        "seq_stats": seq_stats,
        "hunter_scores": hunter_scores,
        "imotif_windows": imotif_windows,
        "base_runs": base_runs,
        "fasta_records": fasta_records,
        "guarded_sequences": guarded_sequences,
        "poly_at_tracts": lambda q: curved.poly_at_tracts(q),
        "global_curvature": lambda q: _motif_rows(curved.global_curvature(q)),
        "local_curvature": lambda q: _motif_rows(curved.local_curvature(q)),
        "curved_dna": lambda q: _motif_rows(curved.curved_dna(q)),
        "sticky_dna": lambda q: _motif_rows(triplex.sticky_dna(q)),
        "hdna": lambda q: _motif_rows(triplex.hdna(q)),
        "triplex_and_sticky": lambda q: _motif_rows(triplex.triplex_and_sticky(q)),
        "egz": lambda q: _motif_rows(zdna.egz(q)),
        "zdna_weights": zdna_weights,
        "zdna": lambda q: _motif_rows(zdna.zdna(q)),
        "zdna_and_egz": lambda q: _motif_rows(zdna.zdna_and_egz(q)),
        "direct_repeats": lambda q: _doubles(slipped.direct_repeat_candidates(q)),
        "str_repeats": lambda q: _motif_rows(slipped.str_repeats(q)),
        "slipped_dna": lambda q: _motif_rows(slipped.slipped_dna(q)),
        "cruciform_candidates": lambda q: _doubles(cruciform.cruciform_candidates(q)),
        "cruciform": lambda q: _motif_rows(cruciform.cruciform(q)),
        "rlfs_zones": rlfs_zones,
        "rloops": lambda q: _motif_rows(rloop.rloops(q)),
        "g4_four_run": lambda q: _doubles(g4.four_run_candidates(q).select(*POS, "motif", "mean", "subtype")),
        "g4_bipartite": lambda q: _doubles(g4.bipartite_candidates(q)),
        "g4_multimeric": lambda q: _doubles(g4.multimeric_candidates(q)),
        "g4_triplex": lambda q: _doubles(g4.triplex_candidates(q)),
        "g4_family": lambda q: _motif_rows(g4.g4_family(q)),
        "imotif_candidates": lambda q: _doubles(
            imotif.imotif_candidates(q).select(*POS, "motif", "subtype", "mean", "factor", "score")
        ),
        "imotifs": lambda q: _motif_rows(imotif.imotifs(q)),
        "ac_motifs": lambda q: _motif_rows(imotif.ac_motifs(q)),
        "imotif_and_ac": lambda q: _motif_rows(imotif.imotif_and_ac(q)),
        "disease_runs": lambda q: disease.repeat_runs(q),
        "disease_repeats": disease_table,
        "core_motifs": lambda q: _motif_rows(core_motifs(q)),
        "all_detectors": lambda q: _motif_rows(detectors(fasta.valid_sequences(q))),
        "all_motifs": lambda q: _found_rows(all_motifs(q, report_hotspots=True, gene="gene")),
        "all_motifs_nonoverlap": lambda q: _found_rows(all_motifs(q, nonoverlap=True)),
        "displayed_motifs": lambda q: reports.display_rows(all_motifs(q)),
    }
    on_core = {
        "selected_motifs": selected,
        "g4_priority": g4_priority,
        "hybrids": hybrid_list,
        "longest_hybrids": longest_hybrids,
        "hybrid_pairs": hybrid_pairs,
        "hybrid_structures": hybrid_structures,
        "cooccurrence": lambda m, q: reports.cooccurrence(m),
        "class_intersections": lambda m, q: reports.class_intersections(m, DETECTED_CLASSES),
        "proximity": proximity,
        "official_classes": official_classes,
        "subtype_defaults": subtype_defaults,
        "column_defaults": column_defaults,
        "disease_subset": disease_subset,
        "class_distribution": lambda m, q: classify.class_distribution(m),
        "subclass_distribution": lambda m, q: classify.subclass_distribution(m),
        "conservation": conserved,
        "features": feature_rows,
        "formation_probability": probabilities,
        "mean_probability": mean_probability,
        "class_counts": lambda m, q: reports.class_counts(m),
        "class_shares": lambda m, q: _doubles(reports.shares(m, "class")),
        "top_classes": lambda m, q: _doubles(reports.top_shares(m)),
        "top_subtypes": lambda m, q: _doubles(reports.top_shares(m, "subtype", 10)),
        "class_bins": lambda m, q: reports.class_bins(m),
        "class_subtype_counts": lambda m, q: reports.class_subtype_counts(m),
        "score_pivot": lambda m, q: _doubles(reports.score_pivot(m, DETECTED_CLASSES)),
        "score_distribution": lambda m, q: _doubles(reports.distribution(m, "score")),
        "length_distribution": lambda m, q: _doubles(reports.distribution(m, "length", "subtype")),
        "length_score_trend": lambda m, q: _doubles(reports.length_score_trend(m)),
        "score_histogram": lambda m, q: reports.score_histogram(m),
        "sequence_comparison": lambda m, q: _doubles(comparison(m, q)),
        "gc_category": lambda m, q: _doubles(reports.category_statistics(comparison(m, q))),
        "gc_category_means": lambda m, q: _doubles(reports.category_class_means(comparison(m, q), DETECTED_CLASSES)),
        "gc_correlation": lambda m, q: _doubles(reports.gc_density_correlation(comparison(m, q))),
        "gene_summary": lambda m, q: _doubles(genes(m, q)),
        "gene_statistics": lambda m, q: _doubles(reports.gene_statistics(genes(m, q))),
        "top_sequences": lambda m, q: _doubles(reports.top_sequences(genes(m, q))),
        "comprehensive_table": lambda m, q: _doubles(reports.comprehensive_table(m)),
    }
    on_lengths = {
        "hotspot_windows": hotspot_windows,
        "hotspots": hotspots_merged,
        "cluster_windows": cluster_windows,
        "clusters": clusters_merged,
        "cluster_profiles": cluster_profiles,
        "filtered_motifs": filtered_motifs,
        "cluster_subset": cluster_subset,
        "sequence_summary": lambda m, q: reports.sequence_summary(m, q),
        "overview": lambda m, q: _doubles(reports.overview(m, q)),
        "count_statistics": lambda m, q: _doubles(reports.count_statistics(m, q)),
        "positional_density": lambda m, q: reports.positional_density(m, q),
        "circular_positions": lambda m, q: _doubles(reports.circular_positions(m, q)),
    }
    on_disease = {
        "clinical_counts": reports.clinical_counts,
        "clinical_table": reports.clinical_table,
        "risk_bands": reports.risk_bands,
        "highest_risk": reports.highest_risk,
        "therapy_diseases": reports.therapy_diseases,
        "counselling_notes": reports.counselling_notes,
    }
    out = {name: _on_seqs(f) for name, f in on_seqs.items()}
    out.update({name: _on_core(f) for name, f in on_core.items()})
    out.update({name: _on_lengths(f) for name, f in on_lengths.items()})
    out.update({name: _on_disease(f) for name, f in on_disease.items()})
    return out
