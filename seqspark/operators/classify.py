"""Official taxonomy and name normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Official classes in order with their fixed subclasses.
TAXONOMY = {
    "Curved DNA": ["Global curvature", "Local Curvature"],
    "Slipped DNA": ["Slipped DNA [Direct Repeat]", "Slipped DNA [STR]"],
    "Cruciform DNA": ["Cruciform DNA [IR]/HairPin [IR]"],
    "R-loop": ["R-loop"],
    "Triplex": ["Triplex", "sticky DNA"],
    "G-Quadruplex Family": [
        "Multimeric G4", "Canonical G4", "Relaxed G4", "Bulged G4", "Bipartite G4", "Imperfect G4",
        "G-Triplex intermediate",
    ],
    "i-motif family": ["Canonical i-motif", "Relaxed i-motif", "AC-motif"],
    "Z-DNA": ["Z-DNA", "eGZ (Extruded-G) DNA"],
    "Hybrid": [],
    "Non-B DNA cluster regions": [],
}
G4_SUBTYPES = TAXONOMY["G-Quadruplex Family"]

# Other names in use -> official class or subclass.
ALIASES = {
    "Curved_DNA": "Curved DNA", "Local_Curved_Strict_PolyA_or_PolyT": "Local Curvature",
    "Global_Curved_PolyA_PolyT": "Global curvature", "Global curvature (phased A-tracts)": "Global curvature",
    "Local curvature (long A-tract)": "Local Curvature",
    "Slipped_DNA": "Slipped DNA", "Direct_Repeat": "Slipped DNA [Direct Repeat]", "STR": "Slipped DNA [STR]",
    "Cruciform": "Cruciform DNA", "Cruciform_IR": "Cruciform DNA [IR]/HairPin [IR]",
    "R-Loop": "R-loop", "RLFS": "R-loop",
    "Mirror_Repeat": "Triplex", "Triplex_Motif": "Triplex", "Sticky_DNA": "sticky DNA",
    "G-Triplex": "G-Quadruplex Family", "G_Triplex": "G-Triplex intermediate",
    "G4_Canonical": "Canonical G4", "G4_Relaxed": "Relaxed G4", "G4_Bulged": "Bulged G4",
    "G4_Bipartite": "Bipartite G4", "G4_Multimeric": "Multimeric G4", "G4_Imperfect": "Imperfect G4",
    "i-Motif": "i-motif family", "Canonical_iMotif": "Canonical i-motif", "LongLoop_iMotif": "Relaxed i-motif",
    "Other_iMotif": "Relaxed i-motif", "Relaxed_iMotif": "Relaxed i-motif",
    "AC-Motif": "i-motif family", "AC_Motif": "AC-motif",
    "Z-Seeker_Kadane": "Z-DNA", "eGZ": "eGZ (Extruded-G) DNA", "CGG_Expansion": "eGZ (Extruded-G) DNA",
    "Non-B_Clusters": "Non-B DNA cluster regions", "Non-B DNA Clusters": "Non-B DNA cluster regions",
}
SINGLE_SUBTYPE = {"R-loop": "R-loop", "Z-DNA": "Z-DNA", "Cruciform DNA": "Cruciform DNA [IR]/HairPin [IR]"}


def class_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (no, name, sub, i)
        for no, (name, subs) in enumerate(TAXONOMY.items(), start=1)
        for i, sub in enumerate(subs or [None], start=1)
    ]
    return spark.createDataFrame(rows, "class_no int, class string, subclass string, subclass_no int")


def alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, official string")


def class_counts(spark: SparkSession) -> DataFrame:
    """Number of official classes and fixed subclasses."""
    return class_dim(spark).agg(
        F.count_distinct("class").alias("classes"), F.count("subclass").alias("subclasses"),
        ((F.count_distinct("class") == 10) & (F.count("subclass") >= 20)).alias("valid"),
    )


def official_names(df: DataFrame, cls: str = "class", subtype: str = "subtype") -> DataFrame:
    """Adds official_class and official_subtype; the alias table is broadcast (fixed size)."""
    dim = alias_dim(df.sparkSession)
    rows = df.join(F.broadcast(dim.toDF("_a", "_oc")), F.col(cls) == F.col("_a"), "left").drop("_a")
    rows = rows.join(F.broadcast(dim.toDF("_a", "_os")), F.col(subtype) == F.col("_a"), "left").drop("_a")
    oc, os = F.coalesce("_oc", cls), F.coalesce("_os", subtype)
    g4_class, g4_sub = oc.isin(G4_SUBTYPES), F.coalesce(os.isin(G4_SUBTYPES), F.lit(False))
    empty = os.isNull() | (os == "")
    single = F.create_map(*[F.lit(x) for kv in SINGLE_SUBTYPE.items() for x in kv])
    new_class = (
        F.when(F.col(cls) == "Cruciform_IR", "Cruciform DNA")
        .when(g4_class | g4_sub, "G-Quadruplex Family").otherwise(oc)
    )
    new_sub = (
        F.when(F.col(cls) == "Cruciform_IR", SINGLE_SUBTYPE["Cruciform DNA"])
        .when(g4_class, oc)
        .when(empty & ~g4_sub, F.coalesce(F.try_element_at(single, oc), os))
        .otherwise(os)
    )
    return rows.withColumn("official_class", new_class).withColumn("official_subtype", new_sub).drop("_oc", "_os")


def ensure_subtype(subtype, official) -> Column:
    """A missing subtype becomes the official one or "Canonical"."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(F.col(subtype)), blank(F.col(official)), F.lit("Canonical"))


def class_distribution(motifs: DataFrame) -> DataFrame:
    """All official classes with count, status and percentage, zero rows included."""
    spark = motifs.sparkSession
    counts = official_names(motifs).groupBy(F.col("official_class").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    dim = class_dim(spark).select("class_no", "class").distinct()
    return _distribution(dim.join(counts, "class", "left"), "class_no", "class")


def subclass_distribution(motifs: DataFrame) -> DataFrame:
    spark = motifs.sparkSession
    counts = official_names(motifs).groupBy(F.col("official_subtype").alias("subclass")).agg(
        F.count(F.lit(1)).alias("n")
    )
    dim = class_dim(spark).where("subclass is not null").select(
        (F.col("class_no") * 100 + F.col("subclass_no")).alias("subclass_no"), "subclass"
    )
    return _distribution(dim.join(counts, "subclass", "left"), "subclass_no", "subclass")


def _distribution(rows: DataFrame, number: str, name: str) -> DataFrame:
    """Percentages over the few taxonomy rows."""
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).select(
        number, name, F.col("n").alias("count"),
        F.when(F.col("n") > 0, "Detected").otherwise("Not Found").alias("status"),
        F.round(F.coalesce(F.col("n") * 100.0 / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 2).alias("percentage"),
    )
