"""The common motif row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOTIF_COLUMNS = [
    "seq_id", "class", "subtype", "start_pos", "end_pos", "length", "sequence",
    "score", "score_method", "detail", "spacer", "attrs",
]


def as_map(attrs: dict[str, Column]) -> Column:
    entries = []
    for name, value in attrs.items():
        entries += [F.lit(name), value.cast("string")]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def as_motifs(df: DataFrame, cls, subtype, score, method, detail=None, spacer=None, attrs=None) -> DataFrame:
    """Bring detector output (seq_id, start_pos, end_pos, motif, ...) to the motif schema."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        F.col("seq_id").cast("long").alias("seq_id"),
        as_col(cls).alias("class"),
        as_col(subtype).alias("subtype"),
        F.col("start_pos").cast("int").alias("start_pos"),
        F.col("end_pos").cast("int").alias("end_pos"),
        (F.col("end_pos") - F.col("start_pos") + 1).cast("int").alias("length"),
        F.col("motif").alias("sequence"),
        score.cast("double").alias("score"),
        as_col(method).alias("score_method"),
        (F.lit("") if detail is None else detail).alias("detail"),
        (F.lit("") if spacer is None else spacer).cast("string").alias("spacer"),
        (attrs if isinstance(attrs, Column) else as_map(attrs or {})).alias("attrs"),
    )


def union(frames) -> DataFrame:
    out = frames[0].select(*MOTIF_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*MOTIF_COLUMNS))
    return out
