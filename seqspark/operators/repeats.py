"""Seed-and-extend for repeats inside a sequence: direct, inverted and mirror.

Finding all equal k-mer pairs at a bounded distance with a join would turn every base into a
shuffled row.  Here Spark hands Arrow batches of sequences to a small numpy step that compares
packed k-mers along each diagonal and returns only what is chosen of the runs that are equal.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.operators.intervals import Disjoint, take_disjoint

Rate = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
RateDirect = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Bases whose k-mers are compared at a time, so that they stay in the cache.
SLAB = 1 << 18
#: Bases worked out at a time; a longer sequence is a part of its own.
PART = 1 << 18
#: Arms or starts worked out at a time.
ARMS = 1 << 20
#: Equal blocks looked at more closely at a time.
HITS = 1 << 13
#: Rows of a batch that leaves a task.
ROWS = 1 << 16
CODE = np.zeros(256, dtype=np.uint8)
CODE[[ord(c) for c in "ACGT"]] = [0, 1, 2, 3]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in parts of at most PART bases, or one longer sequence."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("sequence")).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PART, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _concat(texts: pd.Series):
    """All sequences of a batch as one code array, with the start of each."""
    sizes = texts.str.len().to_numpy(dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return CODE[np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8)], starts


def _packed(bases: np.ndarray, k: int) -> np.ndarray:
    """2-bit code of the k-mer starting at every position (k <= 16)."""
    out, width = bases.astype(np.uint32), 1
    total, have = None, 0
    todo = k
    while todo:
        if todo & 1:
            if total is None:
                total, have = out, width
            else:
                m = max(len(bases) - have - width + 1, 0)
                total, have = (total[:m] << np.uint32(2 * width)) | out[have:have + m], have + width
        todo >>= 1
        if todo:
            m = max(len(out) - width, 0)
            out, width = (out[:m] << np.uint32(2 * width)) | out[width:width + m], 2 * width
    return total


def _slabs(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, SLAB):
        yield a, min(a + SLAB, n)


def _per_row(owner, order, columns, n_rows):
    """Split parallel arrays into one list of dicts per batch row."""
    owner = owner[order]
    columns = {name: values[order] for name, values in columns.items()}
    cuts = np.searchsorted(owner, np.arange(n_rows + 1))
    return pd.Series(
        [
            [dict(zip(columns, v)) for v in zip(*(c[a:b].tolist() for c in columns.values()))]
            for a, b in zip(cuts[:-1], cuts[1:])
        ]
    )


def _runs(bases, starts, k: int, nearest: int, farthest: int):
    """Row, start (0-based in its row), d and length (>= k) of maximal runs with s[i] == s[i + d], in this order.

    Equal k-mers become runs distance by distance, so a long array costs one run for each distance, not its bases.
    """
    ends = starts[1:]
    heads, sizes, dist = [], [], []
    width = min(8, (k + 1) // 2)
    back = np.arange(1 - width, 1)
    for a, b in _slabs(len(bases)):
        codes = _packed(bases[a:b + farthest + k], k)
        place = np.arange(a, b)
        room = ends[np.searchsorted(ends, place, side="right")] - place
        # any k bases hold one block of `width` that begins within the first `width` of them at a multiple of it, so
        # equal blocks at these places show where equal k-mers may be
        blocks = _packed(bases[a:b + farthest + k + width], width).astype(np.uint16)
        phases = [np.ascontiguousarray(blocks[r::width]) for r in range(width)]
        mine = phases[0][:(b - a + 2 * width - 2) // width]
        hits, n_hits = [], 0
        for d in range(nearest, farthest + 1):
            theirs = phases[d % width][d // width:]
            m = min(len(mine), len(theirs))
            if m > 0:
                found = np.flatnonzero(mine[:m] == theirs[:m])
                if len(found):
                    hits.append((d, found))
                    n_hits += len(found)
            if hits and (n_hits >= HITS or d == farthest):
                far = np.repeat([d for d, _ in hits], [len(f) * width for _, f in hits])
                at = ((np.concatenate([f for _, f in hits]) * width)[:, None] + back).ravel()
                some = (at >= 0) & (at < b - a) & (at + far < len(codes))
                at, far = at[some], far[some]
                some = codes[at] == codes[at + far]
                at, far = at[some], far[some]
                some = room[at] >= far + k
                at, far = at[some], far[some]
                if len(at):
                    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(far) != 0)) + 1
                    head = np.append(0, cut)
                    heads.append(at[head] + a)
                    sizes.append(at[np.append(cut - 1, len(at) - 1)] - at[head] + 1)
                    dist.append(far[head])
                hits, n_hits = [], 0
    if not heads:
        return (np.zeros(0, np.int64),) * 4
    at, size, dist = np.concatenate(heads), np.concatenate(sizes), np.concatenate(dist)
    row = np.searchsorted(ends, at, side="right")
    order = np.lexsort((at, dist, row))
    at, size, dist, row = at[order], size[order], dist[order], row[order]
    # runs that a slab has cut
    first = np.ones(len(at), dtype=bool)
    first[1:] = (at[1:] != at[:-1] + size[:-1]) | (dist[1:] != dist[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    last = np.append(head[1:], len(at)) - 1
    return row[head], at[head] - starts[row[head]], dist[head], at[last] + size[last] - at[head] + k - 1


def _equal_runs(texts: pd.Series, k: int, nearest: int, farthest: int) -> pd.Series:
    """The runs of each text: at (0-based), d, len."""
    row, at, dist, size = _runs(*_concat(texts), k, nearest, farthest)
    return _per_row(row, np.arange(len(row)), {"at": at, "d": dist, "len": size}, len(texts))


def _tails(bases, ends, row, at, far) -> np.ndarray:
    """How many bases from ``at`` on equal those at the distance ``far`` in their sequence.

    Most tails end within a few bases; the others are read off one pass over the sequence for each distance.
    """
    tail, live = np.zeros(len(at), np.int64), np.arange(len(at))
    for step in range(32):
        left = at[live] + step
        inside = left + far[live] < ends[row[live]]
        live, left = live[inside], left[inside]
        live = live[bases[left] == bases[left + far[live]]]
        if not len(live):
            return tail
        tail[live] = step + 1
    live = live[np.lexsort((far[live], row[live]))]
    for part in np.split(live, np.flatnonzero((np.diff(row[live]) != 0) | (np.diff(far[live]) != 0)) + 1):
        r, distance = row[part[0]], far[part[0]]
        low = at[part].min()
        text = bases[low:ends[r]]
        stops = np.append(np.flatnonzero(text[:-distance] != text[distance:]), len(text) - distance) + low
        tail[part] = stops[np.searchsorted(stops, at[part])] - at[part]
    return tail


def _best_direct(bases, starts, k: int, units: tuple[int, int], spaced: int, spacers: int, rate: RateDirect):
    """Row, start (0-based in its row), unit, spacer, length of the best direct repeat of each start.

    The longest unit that counts is best, then the least spacer. The unit is d less the spacer. Where d bases match
    behind a start, the unit of d without spacer is longer and wins, so with a spacer only starts whose match is
    shorter than d matter, or all where d is beyond the longest unit.
    """
    ends = starts[1:]
    row, at, d, size = _runs(bases, starts, k, units[0], units[1] + spacers)
    at = at + starts[row]
    stop = at + size
    some = d <= units[1]
    parts = [np.stack([row[some], at[some], (size - d + 1)[some], d[some], np.zeros(some.sum(), np.int64), stop[some]])]
    first = np.where(d > units[1], at, np.maximum(at, stop - d + 1))
    for spacer in range(1, spacers + 1):
        some = (d - spacer >= spaced) & (d - spacer <= units[1])
        unit = (d - spacer)[some]
        parts.append(np.stack([row[some], first[some], (stop[some] - unit - first[some] + 1), unit, np.full(len(unit), spacer), stop[some]]))
    families = np.concatenate(parts, axis=1)
    families = families[:, families[2] > 0]
    # unit, spacer and length in one number, the best of each start
    best = np.zeros(len(bases), np.int64)
    upto = np.cumsum(families[2])
    for a in range(0, int(upto[-1]) if len(upto) else 0, ARMS):
        x, y = np.searchsorted(upto, [a, a + ARMS])  # families whose last start lies in this part
        row, first, n, unit, spacer, stop = families[:, x:y]
        i = np.repeat(np.arange(y - x), n)
        at = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        unit, spacer = unit[i], spacer[i]
        reach = stop[i] - at
        copies, length = 1 + reach // unit, unit + reach
        wide = np.flatnonzero(spacer)
        copies[wide] = 2
        length[wide] = 2 * unit[wide] + spacer[wide] + _tails(
            bases, ends, row[i[wide]], at[wide], 2 * unit[wide] + spacer[wide])
        good = rate(unit, copies, length, spacer)
        np.maximum.at(best, at[good], ((unit * 8 + 7 - spacer) << 32 | length)[good])
    at = np.flatnonzero(best)
    row, head = np.searchsorted(ends, at, side="right"), best[at] >> 32
    return row, at - starts[row], head >> 3, 7 - (head & 7), best[at] & 0xFFFFFFFF


def best_direct(
    seqs: DataFrame, k: int, units: tuple[int, int], spaced: int, spacers: int, rate: RateDirect,
) -> DataFrame:
    """seq_id, start_pos, unit, spacer, length of direct repeats, chosen as in `_best_direct`.

    `rate` tells from arrays of unit, copies, length and spacer which ones count; units of at least `units[0]`, with a
    spacer of at least `spaced`. Only the best of each start leaves its task; the sequence stays behind.
    """
    names = ["seq_id", "start_pos", "unit", "spacer", "length"]

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            bases, starts = _concat(part.column("sequence").to_pandas())
            row, start, *rest = _best_direct(bases, starts, k, units, spaced, spacers, rate)
            columns = [part.column("seq_id").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (start + 1, *rest))]
            for a in range(0, len(row), ROWS):
                yield pa.RecordBatch.from_arrays([c[a:a + ROWS] for c in columns], names=names)

    kind = seqs.schema["seq_id"].dataType.simpleString()
    return seqs.where(F.length("sequence") >= k + units[0]).select("seq_id", "sequence").mapInArrow(
        repeats, f"seq_id {kind}, start_pos int, unit int, spacer int, length int")


def chosen_repeats(bases, starts, tandem: np.ndarray, k: int, units: tuple[int, int], spaced: int, spacers: int, score: RateDirect, least: float) -> dict:
    """Repeats that share no base, best score first, as columns of `located.locate`; unit is ``size``, and a tandem repeat
    has no spacer.

    They are direct repeats as in `best_direct` with a score of at least `least`, and rows of `tandem` (row, start, end,
    unit, copies, score). Ties: direct repeats, then the start.
    """
    row, at, unit, spacer, length = _best_direct(bases, starts, k, units, spaced, spacers, lambda *repeat: score(*repeat) >= least)
    copies = np.where(spacer == 0, length // unit, 2)
    direct = np.stack([row, at, at + length, unit, copies, score(unit, copies, length, spacer), spacer])
    rows = np.concatenate([direct, np.concatenate([tandem, np.full((1, tandem.shape[1]), -1.0)])], axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[6] < 0, -rows[5]))]
    row, at, end = rows[:3].astype(np.int64)
    rows = rows[:, take_disjoint(starts[row] + at, starts[row] + end - 1)]
    return dict(zip(("row", "start", "end", "size", "copies", "score", "spacer"), rows))


def _folds(bases, starts, k: int, max_spacer: int, max_arm: int, complement: bool):
    """Row, inner arm end (0-based, in all bases), spacer and how far both arms match outward (>= k), in this order."""
    ends = starts[1:]
    other = (3 - bases) if complement else bases
    n = len(bases)
    at, spacers = [], []
    for a, b in _slabs(n):
        hi = min(b + 2 * k + max_spacer, n)
        left = _packed(bases[a:hi], k)
        # the reversed k-mer at every position: pack the reversed text and flip it back
        right = _packed(other[a:hi][::-1], k)[::-1]
        for spacer in range(max_spacer + 1):
            m = min(b - a, len(left) - k - spacer)
            if m > 0:
                found = np.flatnonzero(left[:m] == right[k + spacer:k + spacer + m])
                if len(found):
                    at.append(found + a + k - 1)
                    spacers.append(np.full(len(found), spacer))
    if not at:
        return (np.zeros(0, np.int64),) * 4
    at, spacers = np.concatenate(at), np.concatenate(spacers)
    row = np.searchsorted(ends, at, side="right")
    inside = (at - k + 1 >= starts[row]) & (at + spacers + k < ends[row])
    at, spacers, row = at[inside], spacers[inside], row[inside]
    reach = np.full(len(at), k)
    live = np.arange(len(at))
    for step in range(k, max_arm):
        l, r = at[live] - step, at[live] + spacers[live] + 1 + step
        ok = (l >= starts[row[live]]) & (r < ends[row[live]])
        live, l, r = live[ok], l[ok], r[ok]
        same = bases[l] == other[r]
        live = live[same]
        if not len(live):
            break
        reach[live] = step + 1
    order = np.lexsort((spacers, at, row))
    return row[order], at[order], spacers[order], reach[order]


def _best_arms(bases, starts, k: int, max_spacer: int, max_arm: int, complement: bool, rate: Rate, one_a_start: bool) -> np.ndarray:
    """row, start (0-based in its row), length, arm, spacer, score of the best fold for each start and length, or each start.

    A start with a length takes the best score (ties: the longest arm), a start alone the longest arm (then the least spacer).
    """
    pure = np.concatenate([[0], np.cumsum((bases == CODE[ord("A")]) | (bases == CODE[ord("G")]))])

    def best(rows: np.ndarray) -> np.ndarray:
        row, start, length, arm, spacer, score = rows
        rows = rows[:, np.lexsort((-arm, -score, length, start, row))]
        first = np.ones(rows.shape[1], bool)
        first[1:] = (np.diff(rows[:3]) != 0).any(axis=0)
        return rows[:, first]

    row, at, spacer, reach = _folds(bases, starts, k, max_spacer, max_arm, complement)
    upto, found = np.cumsum(reach - k + 1), [np.zeros((6, 0))]
    longest = np.zeros(len(bases) if one_a_start else 0, np.int64)  # arm and spacer of each start in one number
    for a in range(0, int(upto[-1]) if len(upto) else 0, ARMS):
        x, y = np.searchsorted(upto, [a, a + ARMS])  # folds whose last arm lies in this part
        n = reach[x:y] - k + 1
        i = np.repeat(np.arange(x, y), n)
        arm = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + k
        rich = pure[at[i] + 1] - pure[at[i] + 1 - arm]
        score, good = rate(arm, spacer[i], np.maximum(rich, arm - rich))
        i, arm, score = i[good], arm[good], score[good]
        if one_a_start:
            np.maximum.at(longest, at[i] - arm + 1, arm * (max_spacer + 1) + max_spacer - spacer[i])
            continue
        found.append(best(np.stack([row[i], at[i] - starts[row[i]] - arm + 1, 2 * arm + spacer[i], arm, spacer[i], score])))
    if one_a_start:
        first = np.flatnonzero(longest)
        arm, gap = longest[first] // (max_spacer + 1), max_spacer - longest[first] % (max_spacer + 1)
        rich = pure[first + arm] - pure[first]
        row = np.searchsorted(starts[1:], first, side="right")
        return np.stack([row, first - starts[row], 2 * arm + gap, arm, gap, rate(arm, gap, np.maximum(rich, arm - rich))[0]])
    return best(np.concatenate(found, axis=1))


def _disjoint(rows: np.ndarray) -> np.ndarray:
    """Of rows as `_best_arms` gives them, best score to six places first (then the longest, then the first), those
    that no better one of their sequence overlaps; a boundary base may be shared."""
    row, start, length, score = rows[0], rows[1], rows[2], np.round(rows[5], 6)
    order = np.lexsort((start, -length, -score, row))
    known, state, taken = None, None, []
    for i, r, a, n in zip(order.tolist(), row[order].tolist(), start[order].tolist(), length[order].tolist()):
        if r != known:
            known, state = r, Disjoint(True)
        if state.take(a, a + n - 1):
            taken.append(i)
    return rows[:, taken]


def chosen_arms(bases, starts, k: int, max_spacer: int, max_arm: int, complement: bool, rate: Rate) -> dict:
    """The best of `_best_arms`, one a start, without overlaps as columns of `located.locate`; the arm is ``size``."""
    row, start, length, arm, spacer, score = _disjoint(_best_arms(bases, starts, k, max_spacer, max_arm, complement, rate, True))
    return {"row": row, "start": start, "end": start + length, "size": arm, "spacer": spacer, "score": score}


def chosen_folds(bases, starts, k: int, max_spacer: int, max_arm: int, complement: bool, rate: Rate) -> dict:
    """The same choice from the best arm for each start and length, where scores rise with the arm around one centre.

    A centre then needs one candidate at a time: its longest arm that counts, and where a better one is in the way, the
    longest that reaches no further than to it.
    """
    row, at, spacer, reach = _folds(bases, starts, k, max_spacer, max_arm, complement)
    pure = np.concatenate([[0], np.cumsum((bases == CODE[ord("A")]) | (bases == CODE[ord("G")]))])

    def rated(at, spacer, arm):
        rich = pure[at + 1] - pure[at + 1 - arm]
        return rate(arm, spacer, np.maximum(rich, arm - rich))

    arm, score, live = reach.copy(), np.zeros(len(at)), np.arange(len(at))
    while len(live):
        score[live], good = rated(at[live], spacer[live], arm[live])
        live = live[~good]
        arm[live] -= 1
        live = live[arm[live] >= k]
    key = lambda i, arm, score: (-np.round(score, 6), -2 * arm - spacer[i], at[i] - arm + 1, arm, score, i)
    some = np.flatnonzero(arm >= k)
    columns = key(some, arm[some], score[some])
    order = np.lexsort((-columns[3], *columns[2::-1]))
    ready = zip(*(x[order].tolist() for x in columns))
    inner, gap = at.tolist(), spacer.tolist()
    chosen, taken, waiting, dead = [], [], [], bytearray(len(at))
    first = next(ready, None)
    while first or waiting:
        if waiting and (first is None or waiting[0] < first):
            best = heappop(waiting)
        else:
            best, first = first, next(ready, None)
        _, less, start, _, _, i = best
        if dead[i]:
            continue
        end, place, most = start - less - 1, bisect_left(chosen, (start, start)), None
        for s, e in chosen[place - 1 if place else 0:place + 1]:
            if end > s and start < e:
                left = max(s - inner[i] - gap[i], inner[i] + 1 - e)
                most = left if most is None or left < most else most
        if most is None:
            insort(chosen, (start, end))
            taken.append(best)
            # centres that even the shortest arm would bring too near
            x, y = bisect_right(inner, start - k), bisect_left(inner, end + k - 1)
            dead[x:y] = b"\1" * (y - x)
        elif most >= k:
            arms = np.arange(k, most + 1)
            scores, good = rated(inner[i], gap[i], arms)
            if good.any():
                j = np.flatnonzero(good)[-1]
                heappush(waiting, tuple(x.item() for x in key(i, arms[j], scores[j])[:5]) + (i,))
    found = np.array([(row[i], start - starts[row[i]], size, spacer[i], score) for _, _, start, size, score, i in taken]).reshape(-1, 5).T
    row, start, arm, spacer, score = found
    return {"row": row, "start": start, "end": start + 2 * arm + spacer, "size": arm, "spacer": spacer, "score": score}


def best_arms(seqs: DataFrame, k: int, max_spacer: int, max_arm: int, complement: bool, rate: Rate, one_a_start: bool) -> DataFrame:
    """seq_id, start_pos, end_pos, arm, spacer, length, score of inverted (or mirror) repeats, chosen as in `_best_arms`.

    `rate` gives scores, and which arms count, from arrays of arm, spacer and the number of purines or pyrimidines in
    an arm, whichever is more. Only chosen rows leave the task; the sequence stays behind.
    """
    names = ["seq_id", "start_pos", "end_pos", "arm", "spacer", "length", "score"]

    def arms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            bases, starts = _concat(batch.column("sequence").to_pandas())
            row, start, length, arm, spacer, score = _best_arms(bases, starts, k, max_spacer, max_arm, complement, rate, one_a_start)
            ids = batch.column("seq_id").take(pa.array(row.astype(np.int64)))
            ints = [x.astype(np.int32) for x in (start + 1, start + length, arm, spacer, length)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, ints), pa.array(score)], names=names)

    kind = seqs.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {kind}, start_pos int, end_pos int, arm int, spacer int, length int, score double"
    return seqs.where(F.length("sequence") >= 2 * k).select("seq_id", "sequence").mapInArrow(arms, schema)
