"""Interval operators: islands, greedy selection and overlap joins.

A sequence is one record and so at most 2 GB of text, a vanishing part of a large data set.
Windows over a sequence keep one running value and read rows that Spark has sorted (and spilled
where needed), so no sequence is ever held in memory as a group.  The work behind them, best-first
selection and chains, is spread by connected stretch, not by sequence.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.functions import sequence as S

BIN = 1000


def running_max_before(df: DataFrame, value: str, out: str, order=None, key=("seq_id",), inclusive=False) -> DataFrame:
    """Largest ``value`` over all rows of ``key`` that come before this row.

    Rows are ordered by start_pos and then ``order``.  ``inclusive`` counts the row itself.
    """
    upto = Window.partitionBy(*key).orderBy("start_pos", *(order or ["end_pos"])).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    return df.withColumn(out, F.max(value).over(upto))


def islands(df: DataFrame, gap: int = 0, out: str = "island", order=None, key=("seq_id",)) -> DataFrame:
    """Label rows of one connected stretch with the start of that stretch.

    A row opens a new stretch when it starts more than ``gap`` behind everything before it
    (gap 0: a shared base joins two rows).  Both windows use one exchange and one sort.
    """
    rows = running_max_before(df, "end_pos", "_reach", order, key)
    opens = F.col("_reach").isNull() | (F.col("start_pos") > F.col("_reach") + gap)
    rows = rows.withColumn("_opens", F.when(opens, F.col("start_pos")))
    return running_max_before(rows, "_opens", out, order, key, inclusive=True).drop("_reach", "_opens")


# --- greedy selection -----------------------------------------------------------------------


class Disjoint:
    """Chosen intervals of one stretch; they meet in at most one boundary base."""

    def __init__(self, shared_end: bool):
        self.slack = 0 if shared_end else 1
        self.chosen = []

    def take(self, start, end):
        """Accept unless a chosen interval is in the way."""
        i = bisect_left(self.chosen, (start, end))
        for s, e in self.chosen[max(i - 1, 0):i + 1]:
            if not (end + self.slack <= s or start >= e + self.slack):
                return False
        insort(self.chosen, (start, end))
        return True


def take_disjoint(start: np.ndarray, end: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mask of the intervals that a selection without a shared base takes; they are given best first, on one axis.

    A round takes the best of every connected stretch at once. What is left after ``rounds`` goes one by one.
    """
    taken, live = np.zeros(len(start), bool), np.arange(len(start))
    for _ in range(rounds):
        if not len(live):
            return taken
        s, e = start[live], end[live]
        order = np.argsort(s, kind="stable")
        opens = np.append(True, s[order][1:] > np.maximum.accumulate(e[order])[:-1])
        stretch = np.empty(len(live), np.int64)
        stretch[order] = np.cumsum(opens) - 1
        best = np.unique(stretch, return_index=True)[1]
        taken[live[best]] = True
        live = live[(e < s[best][stretch]) | (s > e[best][stretch])]
    state = Disjoint(False)
    for i, s, e in zip(live.tolist(), start[live].tolist(), end[live].tolist()):
        taken[i] = state.take(s, e)
    return taken


class _Covered:
    """Accept while at most ``share`` of the bases are covered by what was accepted before."""

    def __init__(self, share: float):
        self.share = share
        self.merged = []

    def take(self, start, end):
        i = bisect_left(self.merged, (start, start))
        if i and self.merged[i - 1][1] >= start:
            i -= 1
        j, covered, lo, hi = i, 0, start, end
        while j < len(self.merged) and self.merged[j][0] <= end:
            s, e = self.merged[j]
            covered += min(e, end) - max(s, start) + 1
            lo, hi = min(lo, s), max(hi, e)
            j += 1
        if covered > self.share * (end - start + 1):
            return False
        self.merged[i:j] = [(lo, hi)]
        return True


def greedy(df: DataFrame, order: list[Column], overlap: str = "inclusive", share: float = 0.5) -> DataFrame:
    """Best-first selection inside each sequence.

    ``overlap``: ``inclusive`` rejects a row sharing any base with a chosen one; ``shared_end``
    allows one common boundary base; ``covered`` accepts a row while at most ``share`` of it is
    covered.  Only rows of one connected stretch can affect each other, so stretches are spread
    over the cluster, sorted by Spark and read as a stream; a task keeps the chosen intervals of
    the current stretch, never its rows.
    """
    if overlap not in ("inclusive", "shared_end", "covered"):
        raise ValueError(overlap)
    # a total order makes the result independent of how rows arrive
    order = list(order) + [F.col(c) for c in ("start_pos", "end_pos", "class", "subtype") if c in df.columns]
    schema = df.schema
    rows = islands(df, out="_stretch")
    rows = rows.repartition("seq_id", "_stretch").sortWithinPartitions("seq_id", "_stretch", *order)
    width = len(schema)

    def select(batches):
        current, state = None, None
        for batch in batches:
            keys = zip(
                batch.column("seq_id").to_pylist(), batch.column("_stretch").to_pylist(),
                batch.column("start_pos").to_pylist(), batch.column("end_pos").to_pylist(),
            )
            mask = []
            for seq_id, stretch, start, end in keys:
                if (seq_id, stretch) != current:
                    current = (seq_id, stretch)
                    state = _Covered(share) if overlap == "covered" else Disjoint(overlap == "shared_end")
                mask.append(state.take(start, end))
            yield batch.filter(pa.array(mask, type=pa.bool_())).select(list(range(width)))

    return rows.select(*schema.names, "_stretch").mapInArrow(select, schema)


# --- joins ----------------------------------------------------------------------------------


def _binned(df: DataFrame, size: int, reach: int = 0) -> DataFrame:
    first = F.floor(F.greatest(F.col("start_pos") - reach, F.lit(0)) / size)
    last = F.floor((F.col("end_pos") + reach) / size)
    return df.withColumn("_bin", F.explode(S.span(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, size: int = BIN) -> DataFrame:
    """Pairs of rows that share a base; columns of ``right`` get the prefix ``r_``.

    Both sides are copied to the bins they touch and joined on (seq_id, bin).  A pair is kept
    only in the bin of the larger start, so no pair appears twice.
    """
    r = right.select([F.col(c).alias("r_" + c) for c in right.columns])
    lb = _binned(left, size)
    rb = r.withColumn(
        "_rbin", F.explode(S.span(F.floor(F.col("r_start_pos") / size), F.floor(F.col("r_end_pos") / size)))
    )
    on = (F.col("seq_id") == F.col("r_seq_id")) & (F.col("_bin") == F.col("_rbin"))
    meets = (F.col("start_pos") <= F.col("r_end_pos")) & (F.col("r_start_pos") <= F.col("end_pos"))
    home = F.col("_bin") == F.floor(F.greatest("start_pos", "r_start_pos") / size)
    return lb.join(rb, on & meets & home).drop("_bin", "_rbin", "r_seq_id")


def nearby_join(df: DataFrame, distance: int) -> DataFrame:
    """Unordered pairs with starts closer than ``distance``; needs a unique ``motif_no``.

    A row is looked up in its own start bin and the next one only.
    """
    a = df.withColumn("_bin", F.floor(F.col("start_pos") / distance))
    b = df.select([F.col(c).alias("r_" + c) for c in df.columns])
    here = F.floor(F.col("r_start_pos") / distance)
    b = b.withColumn("_rbin", F.explode(F.array(here, here - 1)))
    on = (F.col("seq_id") == F.col("r_seq_id")) & (F.col("_bin") == F.col("_rbin"))
    later = F.struct("r_start_pos", "r_motif_no") > F.struct("start_pos", "motif_no")
    close = F.col("r_start_pos") - F.col("start_pos") < distance
    return a.join(b, on & later & close).drop("_bin", "_rbin", "r_seq_id")


def with_copy_no(motifs: DataFrame) -> DataFrame:
    """Adds motif_no, which tells apart rows equal in position, class and subtype."""
    same = Window.partitionBy("seq_id", "start_pos", "end_pos", "class", "subtype").orderBy("score")
    return motifs.withColumn("motif_no", F.row_number().over(same))


def chain_groups(df: DataFrame, order: list[Column], joins, out: str = "chain") -> DataFrame:
    """Number the groups of an ordered chain of intervals.

    ``joins(start, end, first, last)`` says whether an interval belongs to the open group that
    spans first..last.  A group never reaches over a break between connected stretches, so
    stretches are spread over the cluster and each is read as a sorted stream.
    """
    schema = df.schema
    rows = islands(df, out="_stretch")
    rows = rows.repartition("seq_id", "_stretch").sortWithinPartitions("seq_id", "_stretch", *order)

    def number(batches):
        current, first, last, no, place = None, 0, 0, 0, 0
        for batch in batches:
            numbers, places = [], []
            for seq_id, stretch, start, end in zip(
                batch.column("seq_id").to_pylist(), batch.column("_stretch").to_pylist(),
                batch.column("start_pos").to_pylist(), batch.column("end_pos").to_pylist(),
            ):
                if (seq_id, stretch) != current:
                    current, first, last, no, place = (seq_id, stretch), start, end, 1, 1
                elif joins(start, end, first, last):
                    last, place = max(last, end), place + 1
                else:
                    first, last, no, place = start, end, no + 1, 1
                numbers.append(no)
                places.append(place)
            yield batch.append_column(out, pa.array(numbers, pa.int32())).append_column(
                out + "_place", pa.array(places, pa.int32())
            )

    from pyspark.sql import types as P

    result = P.StructType(
        list(schema.fields) + [rows.schema["_stretch"], P.StructField(out, P.IntegerType()),
                               P.StructField(out + "_place", P.IntegerType())]
    )
    return rows.select(*schema.names, "_stretch").mapInArrow(number, result)
