"""R-loops: a G-run cluster (initiating zone) and the best GC-rich stretch behind it."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators.located import Located, Part, located
from seqspark.operators.motifs import as_motifs

CLASS = "R-loop"
SEARCH, STEP, MIN_WINDOW, MIN_TOTAL = 2000, 25, 50, 100

# model -> (shortest G run, G runs needed)
MODELS = {"m1": (3, 3), "m2": (4, 2)}
MAX_GAP = 10


def find_zones(part: Part, model: str) -> dict:
    """Clusters of G runs at most ten bases apart that hold enough runs, with the text behind.

    A run of n bases can serve as floor((n + 1) / (k + 1)) runs of k with one base between.
    """
    k, needed = MODELS[model]
    at, size = part.runs_of("G", k)
    group = part.grouped(at, at + size, MAX_GAP)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    if not len(first):
        return part.rows(np.zeros((0, 2), np.int64))
    last = np.append(first[1:], len(at)) - 1
    some = np.add.reduceat((size + 1) // (k + 1), first) >= needed
    spans = np.stack([at[first], (at + size)[last]], axis=1)[some]
    upto = part.upto("G") + part.upto("C")
    ends = part.places[np.searchsorted(part.places, spans[:, 0], side="right")] - 1
    windows = [_best_window(upto[a:min(a + SEARCH, b) + 1:STEP]) for a, b in zip(spans[:, 1].tolist(), ends.tolist())]
    return part.rows(spans, tail=SEARCH, size=[w[0] for w in windows], copies=[w[1] for w in windows])


def _best_window(upto: np.ndarray) -> tuple[int, int]:
    """Offsets of the best window behind a zone, from G and C counted up to the end of each block; (0, 0) if there is none.

    Windows start every 25 bases and grow in steps of 25, so each one is a row of whole blocks.
    Among windows of at least 50 % GC the one with the most GC bases wins, the earliest and then
    shortest on a tie.
    """
    blocks = np.arange(len(upto))
    wide = blocks - blocks[:, None]
    gc = upto - upto[:, None]
    gc = np.where((wide >= MIN_WINDOW // STEP) & (gc * 2 >= wide * STEP), gc, -1)
    best = int(gc.argmax())
    a, b = divmod(best, len(upto))
    return (a * STEP, b * STEP) if gc[a, b] >= 0 else (0, 0)


FINDERS = {f"zones_{model}": partial(find_zones, model=model) for model in MODELS}


def initiating_zones(seqs: DataFrame | Located, model: str) -> DataFrame:
    """The clusters of `find_zones` as riz, and rest, the text behind them, with its best window."""
    rows = located(seqs, f"zones_{model}", FINDERS[f"zones_{model}"])
    return rows.select("seq_id", "start_pos", "end_pos", F.col("motif").alias("riz"), "rest", F.lit(model).alias("model"),
                       F.col("size").alias("rez_from"), F.col("copies").alias("rez_to"))


def with_extending_zone(zones: DataFrame) -> DataFrame:
    """Zones with a window behind them: rez_from, rez_to (offsets behind the zone) of the best."""
    return zones.where(F.col("rez_to") > 0)


def rloops(seqs: DataFrame | Located, models=("m1", "m2")) -> DataFrame:
    """Both models are reported, also where they overlap."""
    out = None
    for model in models:
        rows = with_extending_zone(initiating_zones(seqs, model))
        rez = F.expr("substring(rest, rez_from + 1, rez_to - rez_from)")
        rows = rows.withColumn("rez", rez).where(F.length("riz") + F.length("rez") >= MIN_TOTAL)
        rows = rows.withColumn("score", S.rloop_score("riz", "rez"))
        rows = rows.withColumn("end_pos", F.col("end_pos") + F.col("rez_to")).withColumn(
            "motif", F.concat("riz", "rez")
        )
        part = as_motifs(
            rows, CLASS, "R-loop", F.col("score"), "InitiatingAndExtendingZone",
            detail=F.concat(F.lit("RIZ="), F.length("riz"), F.lit(";REZ="), F.length("rez")),
            attrs={
                "Model": F.col("model"), "RIZ_Length": F.length("riz"), "REZ_Length": F.length("rez"),
                "REZ_GC_Content": F.round(S.gc_content("rez"), 3),
            },
        # the two zones are joined without what lies between them
        ).withColumn("length", F.length("sequence"))
        out = part if out is None else out.unionByName(part)
    return out
