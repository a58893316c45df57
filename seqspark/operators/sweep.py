"""Open intervals counted by a sweep in tiles, without pairs of intervals.

Starts and ends are summed up per position first, so a dense spot is as many rows as it has
positions.  Running values are two-level: totals of tiles add up along a sequence (one row for
each tile), and a tile goes on from the total before it.  A chromosome is thus many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.operators.intervals import with_copy_no

TILE = 1 << 16


def boundaries(df: DataFrame, key, end: Column | None = None) -> DataFrame:
    """Per ``key`` and position: how many intervals start there and how many have just ended."""
    end = F.col("end_pos") if end is None else end
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    events = df.select(*key, F.inline(F.array(
        F.struct(F.col("start_pos").cast("long").alias("pos"), one.alias("starts"), none.alias("ends")),
        F.struct((end + 1).cast("long").alias("pos"), none.alias("starts"), one.alias("ends")),
    )))
    return events.groupBy(*key, "pos").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))


def running(events: DataFrame, key, sums=(), maxes=(), tile: int = TILE) -> DataFrame:
    """Adds <name>_upto, the sum over all positions up to this one, and <name>_before, the
    largest value before it.  ``events`` has one row for each ``key`` and ``pos``.
    """
    rows = events.withColumn("_tile", F.floor(F.col("pos") / tile))
    totals = rows.groupBy(*key, "_tile").agg(
        *[F.sum(c).alias("_" + c) for c in sums], *[F.max(c).alias("_" + c) for c in maxes]
    )
    ahead = Window.partitionBy(*key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *key, "_tile", *[F.coalesce(F.sum("_" + c).over(ahead), F.lit(0)).alias("_" + c) for c in sums],
        *[F.max("_" + c).over(ahead).alias("_" + c) for c in maxes],
    )
    here = Window.partitionBy(*key, "_tile").orderBy("pos")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(totals, [*key, "_tile"])
    return rows.select(
        *events.columns, *[(F.col("_" + c) + F.sum(c).over(upto)).alias(c + "_upto") for c in sums],
        *[F.greatest("_" + c, F.max(c).over(before)).alias(c + "_before") for c in maxes],
    )


def class_names(motifs: DataFrame) -> list[str]:
    """The classes of a motif table: a handful of names, as many as the taxonomy has."""
    return sorted(r[0] for r in motifs.where(F.col("class").isNotNull()).select("class").distinct().collect())


def _wide(events: DataFrame, classes: list[str], values: dict[str, Column]) -> DataFrame:
    """One row for each position, with a column <name><i> for value and class number."""
    return events.groupBy("seq_id", "pos").agg(*[
        F.sum(F.when(F.col("class") == c, value).otherwise(0)).alias(f"{name}{i}")
        for i, c in enumerate(classes) for name, value in values.items()
    ])


def _meetings(rows: DataFrame, cells: Column, wanted) -> DataFrame:
    """A row for each class that starts (``x``) and each other cell (``y``) that ``wanted`` lets pass."""
    rows = rows.select("pos", cells.alias("cells"))
    rows = rows.select("pos", "cells", F.explode(F.filter("cells", lambda c: c["s"] > 0)).alias("x"))
    return rows.select("pos", "x", F.explode(F.filter("cells", lambda c: wanted(F.col("x"), c))).alias("y"))


def overlaps_by_class(motifs: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Overlapping pairs for each ordered pair of different classes; a null class counts nowhere.

    A pair meets where its later motif starts, so at every start the open motifs of the other
    classes are added up.
    """
    classes = class_names(motifs) if classes is None else classes
    if not classes:
        return motifs.sparkSession.createDataFrame([], "class string, other_class string, n long")
    events = boundaries(motifs.select("seq_id", "class", "start_pos", "end_pos"), ["seq_id", "class"])
    rows = _wide(events, classes, {"s": F.col("starts"), "c": F.col("starts") - F.col("ends")})
    rows = running(rows, ["seq_id"], sums=[f"c{i}" for i in range(len(classes))])
    cells = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"s{i}").alias("s"), (F.col(f"c{i}_upto") - F.col(f"s{i}")).alias("o"))
        for i, c in enumerate(classes)
    ])
    met = _meetings(rows, cells, lambda x, y: (y["class"] != x["class"]) & (y["o"] + y["s"] > 0))
    counted = lambda a, b, n: F.struct(F.col(a + ".class").alias("class"), F.col(b + ".class").alias("other_class"), n.alias("n"))
    both = met.select(F.inline(F.array(
        counted("x", "y", F.col("x.s") * (F.col("y.o") + F.col("y.s"))), counted("y", "x", F.col("x.s") * F.col("y.o")),
    )))
    return both.where(F.col("n") > 0).groupBy("class", "other_class").agg(F.sum("n").alias("n"))


def proximity_by_class(motifs: DataFrame, distance: int = 1000, classes: list[str] | None = None) -> DataFrame:
    """Number and weight of the edges of ``reports.proximity_edges`` per pair of classes, without the edges.

    A motif is open for ``distance`` bases from its start on; the sum of the open starts gives the
    weights.  Motifs of one start are told apart in the order of the edge list.
    """
    classes = class_names(motifs) if classes is None else classes
    if not classes:
        return motifs.sparkSession.createDataFrame([], "class string, other_class string, n long, weight long")
    numbers = range(len(classes))
    events = boundaries(motifs.select("seq_id", "class", "start_pos"), ["seq_id", "class"], F.col("start_pos") + (distance - 1))
    rows = _wide(events, classes, {
        "s": F.col("starts"), "c": F.col("starts") - F.col("ends"),
        "p": F.col("starts") * F.col("pos") - F.col("ends") * (F.col("pos") - distance),
    })
    rows = running(rows, ["seq_id"], sums=[f"{v}{i}" for i in numbers for v in "cp"])
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("class"), F.col(f"s{i}").alias("s"), (F.col(f"c{i}_upto") - F.col(f"s{i}")).alias("o"),
            (F.col(f"p{i}_upto") - F.col(f"s{i}") * F.col("pos")).alias("sum"),
        ) for i, c in enumerate(classes)
    ])
    met = _meetings(rows, cells, lambda x, y: y["o"] > 0).select(
        F.col("y.class").alias("class"), F.col("x.class").alias("other_class"), (F.col("x.s") * F.col("y.o")).alias("n"),
        (F.col("x.s") * ((F.lit(distance) - F.col("pos")) * F.col("y.o") + F.col("y.sum"))).alias("weight"),
    )
    m = with_copy_no(motifs).select(
        "seq_id", "class", "start_pos", F.concat_ws("|", "end_pos", "class", "subtype", "motif_no").alias("_no")
    )
    earlier = Window.partitionBy("seq_id", "start_pos").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.array(*[
        F.struct(F.lit(c).alias("class"), F.count(F.when(F.col("class") == c, 1)).over(earlier).alias("n")) for c in classes
    ])
    tied = m.where(F.col("class").isNotNull()).withColumn("seen", seen).select(
        F.col("class").alias("other_class"), F.explode(F.filter("seen", lambda c: c["n"] > 0)).alias("e")
    ).select(F.col("e.class").alias("class"), "other_class", F.col("e.n").alias("n"), (F.col("e.n") * distance).alias("weight"))
    return met.unionByName(tied).groupBy("class", "other_class").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def mixed_regions(motifs: DataFrame) -> DataFrame:
    """The regions left after nesting: seq_id, start_pos, end_pos.

    A region begins where a second motif opens.  Until fewer than two are open all regions have that
    start, and the next start lies behind all their ends; so the longest one, up to the last end at
    which two classes are open, holds all others.
    """
    kinds = boundaries(motifs, ["seq_id", "class"]).withColumn("change", F.col("starts") - F.col("ends"))
    kinds = running(kinds, ["seq_id", "class"], sums=["change"])
    is_open = lambda n: (n > 0).cast("long")
    kinds = kinds.withColumn("turn", is_open(F.col("change_upto")) - is_open(F.col("change_upto") - F.col("change")))
    events = kinds.groupBy("seq_id", "pos").agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "change", "turn")])
    events = running(events, ["seq_id"], sums=["change", "turn"])
    rises = (F.col("change_upto") - F.col("starts") < 2) & (F.col("change_upto") >= 2)
    events = running(events.withColumn("rise", F.when(rises, F.col("pos"))), ["seq_id"], maxes=["rise"])
    mixed = (F.col("change_upto") - F.col("change") >= 2) & (F.col("turn_upto") - F.col("turn") >= 2)
    return events.where((F.col("ends") > 0) & mixed).groupBy("seq_id", F.col("rise_before").cast("int").alias("start_pos")).agg(
        (F.max("pos") - 1).cast("int").alias("end_pos")
    )
