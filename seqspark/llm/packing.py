"""Packing of token ids into sequences of a set length under target proportions of the sources.

Every source is a queue. Deficit round-robin serves the queues window by window: in each window a queue earns its
quantum, its share of the window, and what it cannot spend in whole tokens stays as its deficit and is carried to
the next. Documents may be cut anywhere, so a queue spends its deficit but for fractions of tokens. These are
settled in a binary tree over the queues: of the n tokens that a node was served, its left side got the floor of
its share and its right side the rest. So what a queue was served by window w follows from w and the tree alone,
never falls as w grows, and adds up to full windows. Each document finds its own pieces in whatever task it is:
deficits cross partitions as well as windows. No window but the last has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.shared import slices, stored
from seqspark.llm.tokens import encode_texts, forget_chunks

#: A phase: windows [first, last) share `tokens` tokens. The queue has `own` of the phase's `whole` shares and stands
#: at `served` when the phase begins; `path` leads from the root of the tree to it.
PHASE = (
    "first: long, last: long, tokens: long, own: long, whole: long, served: long, "
    "path: array<struct<right: boolean, left: long, whole: long>>"
)


def _tokens(tokenizer: str, end_id: int, keep_chunks: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in slices(batches, "text"):
            ids, bounds = encode_texts(tokenizer, batch.column("text"))
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("ids of more than two bytes")
            narrow, within, packed = ids.astype("<u2"), [], []
            end = np.array([end_id], "<u2").tobytes()
            queues = batch.column("queue").to_pylist()
            for queue, a, b in zip(queues, bounds, bounds[1:]):
                within.append(seen.get(queue, 0))
                seen[queue] = within[-1] + int(b - a) + 1
                packed.append(narrow[a:b].tobytes() + end)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("queue"), batch.column("part"), pa.array(within, pa.int64()),
                pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(packed, pa.binary()),
            ], names=["doc_id", "queue", "part", "within", "n", "ids"])
        if not keep_chunks:
            forget_chunks(tokenizer)
    return encode


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, targets: dict[str, float] | None, keep_chunks: bool = True) -> DataFrame:
    """A stored row per document: its queue, place in its partition's part of the queue, token count and ids."""
    queue = F.concat(F.lit("="), F.col("source").cast("string"))
    if targets is not None:  # sources without a target share one queue
        queue = F.when(F.col("source").cast("string").isin(list(targets)), queue)
    few = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(queue, F.lit("")).alias("queue"),
        F.spark_partition_id().alias("part"), F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, queue string, part int, within long, n long, ids binary"
    return stored(few.mapInArrow(_tokens(tokenizer, end_id, keep_chunks), schema), "packing")


FIELDS = ["first", "last", "tokens", "own", "whole", "served", "path"]


def tree_paths(shares: dict[str, int]) -> dict[str, list[tuple[bool, int, int]]]:
    """The path from the root to each queue: whether it goes right, the left side's shares, the node's shares."""
    names = sorted(shares)
    out: dict[str, list] = {q: [] for q in names}
    for level in reversed(range((len(names) - 1).bit_length())):
        for node in range(0, len(names), 2 << level):
            left, right = names[node:node + (1 << level)], names[node + (1 << level):node + (2 << level)]
            lefts = sum(shares[q] for q in left)
            whole = lefts + sum(shares[q] for q in right)
            for q in left + right:
                out[q].append((q in right, lefts, whole))
    return out


def mixture_phases(totals: dict[str, int], targets: dict[str, float], size: int) -> dict[str, list[tuple]]:
    """Phases by queue for target weights: a queue that runs dry leaves, and the others share on by their weights."""
    left = {q: n for q, n in sorted(totals.items()) if n}
    weight = {q: max(1, round(float(targets.get(q, 0)) * 1_000_000)) for q in left}
    served, window, out = dict.fromkeys(left, 0), 0, {q: [] for q in left}

    def phase(shares: dict[str, int], windows: int, tokens: int) -> None:
        nonlocal window
        whole = sum(shares.values())
        for q, path in tree_paths(shares).items():
            p = (window, window + windows, tokens, shares[q], whole, served[q], path)
            out[q].append(p)
            got = Queue([dict(zip(FIELDS, p))], size).upto(0, window + windows)[0] - served[q]
            served[q] += got
            left[q] -= got
        window += windows
        for q in [q for q, n in left.items() if not n]:
            del left[q]

    while left:
        room = sum(left.values())
        shares = {q: weight[q] for q in left}
        whole = sum(shares.values())
        spare = 1 + len(shares).bit_length()  # a queue may be ahead of its share by a token for each level
        windows = min((left[q] - spare) * whole // (shares[q] * size) for q in left)
        if windows > 0:
            phase(shares, windows, windows * size)
            continue
        # One window in which the driest queues end and the others fill what these leave.
        need, grant = min(size, room), dict.fromkeys(left, 0)
        while need:
            open_ = [q for q in left if grant[q] < left[q]]
            whole = sum(weight[q] for q in open_)
            gave = {q: min(left[q] - grant[q], need * weight[q] // whole) for q in open_}
            if not any(gave.values()):
                gave = {open_[0]: min(need, left[open_[0]] - grant[open_[0]])}
            for q, n in gave.items():
                grant[q] += n
                need -= n
        phase({q: n for q, n in grant.items() if n}, 1, sum(grant.values()))
    return out


def plan(rows: DataFrame, size: int, targets: dict[str, float] | None) -> DataFrame:
    """For each part of each queue: `base`, the queue's tokens before that part, and the queue's phases.

    Without targets the corpus' own proportions hold, in one phase. Only counts by part and queue are read.
    """
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    totals = parts.groupBy("queue").agg(F.sum("n").alias("n"))
    if targets is None:
        # The tree's nodes, level by level; each queue has a row for each level.
        totals = totals.withColumn("place", F.row_number().over(Window.orderBy("queue")) - 1)
        size_of = totals.agg(F.count("*").alias("queues"), F.sum("n").alias("tokens"))
        levels = totals.crossJoin(F.broadcast(size_of)).withColumn(
            "level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("queues")).cast("int"))))
        levels = levels.withColumn("block", F.expr("shiftright(place, level)"))
        node = Window.partitionBy("level", F.expr("shiftright(place, level + 1)"))
        levels = levels.select(
            "queue", "n", "tokens", "level", (F.col("block") % 2 == 1).alias("right"),
            F.sum(F.when(F.col("block") % 2 == 0, F.col("n")).otherwise(0)).over(node).alias("left"),
            F.sum("n").over(node).alias("whole"))
        paths = levels.groupBy("queue", "n", "tokens").agg(F.sort_array(F.collect_list(
            F.struct((-F.col("level")).alias("top"), "right", "left", "whole"))).alias("path"))
        phases = paths.select("queue", F.array(F.struct(
            F.lit(0).cast("long").alias("first"), F.ceil(F.col("tokens") / size).alias("last"), "tokens",
            F.col("n").alias("own"), F.col("tokens").alias("whole"), F.lit(0).cast("long").alias("served"),
            F.transform("path", lambda x: F.struct(x["right"], x["left"], x["whole"])).alias("path"),
        )).alias("phases"))
    else:  # one row per target and one for all other sources
        found = {r["queue"]: r["n"] for r in totals.collect()}
        by_queue = mixture_phases(found, {f"={k}": v for k, v in targets.items()}, size)
        phases = rows.sparkSession.createDataFrame(
            list(by_queue.items()), f"queue string, phases array<struct<{PHASE}>>")
    return stored(parts.join(phases, "queue").select("queue", "part", "base", "phases"), "packing-plan")


class Queue:
    """What one queue is served by each window."""

    def __init__(self, phases: list[dict], size: int):
        self.phases, self.size = phases, size
        self.paths = [[tuple(x.values()) if isinstance(x, dict) else x for x in p["path"]] for p in phases]

    def upto(self, at: int, window: int) -> tuple[int, int]:
        """Tokens that this queue, and the queues before it in the windows' order, were served before `window`."""
        p = self.phases[at]
        mine, ahead = min(self.size * (window - p["first"]), p["tokens"]), 0
        for right, left, whole in self.paths[at]:
            lefts = mine * left // whole
            mine, ahead = (mine - lefts, ahead + lefts) if right else (lefts, ahead)
        return p["served"] + mine, ahead

    def window(self, at: int, x: int) -> tuple[int, int]:
        """Phase and window that serve the queue's token `x`, from phase `at` on."""
        while at + 1 < len(self.phases) and self.phases[at + 1]["served"] <= x:
            at += 1
        p = self.phases[at]
        share, y, spare = p["own"] * self.size, x - p["served"], 1 + len(p["path"])
        low = max(p["first"], p["first"] + (y - spare) * p["whole"] // share - 1)
        high = min(p["last"] - 1, p["first"] + (y + spare) * p["whole"] // share + 1)
        while low < high:  # the last window with no more than x served before it
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.upto(at, middle)[0] <= x else (low, middle - 1)
        return at, low

    def pieces(self, begin: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset) of a document at `begin` in the queue."""
        x, at = begin, 0
        while x < begin + n:
            at, window = self.window(at, x)
            since, ahead = self.upto(at, window)
            until, ahead_next = self.upto(at, window + 1)
            length = min(until, begin + n) - x
            yield x - begin, length, window, ahead_next - ahead + x - since
            x += length


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "queue string"
)


def _cut(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            known: dict[str, Queue] = {}
            out: list[list] = [[] for _ in range(8)]
            columns = (batch.column(x) for x in ("doc_id", "queue", "base", "within", "n", "ids", "phases"))
            doc_ids, queues, bases, withins, counts, ids, phases = columns
            for i, (doc, name, n, data) in enumerate(zip(*(x.to_pylist() for x in (doc_ids, queues, counts, ids)))):
                if name not in known:
                    known[name] = Queue(phases[i].as_py(), size)
                wide = np.frombuffer(data, "<u2").astype("<u4")
                for start, length, window, offset in known[name].pieces(bases[i].as_py() + withins[i].as_py(), n):
                    crc = zlib.crc32(wide[start:start + length].tobytes())
                    for column, x in zip(out, (doc, start, length, crc, n, window, offset, name)):
                        column.append(x)
            kinds = [pa.int64()] * 7 + [pa.string()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)
    return cut


def pack(
    docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, targets: dict[str, float] | None = None,
    keep_chunks: bool = True,
) -> DataFrame:
    """Packs every document (doc_id, source, text) and returns its pieces.

    A null text is empty and gives its end id alone. A null source is a queue of its own. Repeated rows are packed
    each; an empty table gives no piece. With `targets` (source to weight, null and other sources under one queue)
    windows hold those proportions as long as all queues last. Workers keep their encoded chunks for the next task;
    without `keep_chunks` each task begins anew, and what comes after has that memory.
    """
    if size < 1 or (targets is not None and not all(w > 0 for w in targets.values())):
        raise ValueError("size and weights must be positive")
    if targets is not None:  # the driver plans one phase for each target
        targets = {str(k): float(v) for k, v in targets.items()}
    rows = tokenized(docs, tokenizer, end_id, targets, keep_chunks)
    planned = plan(rows, size, targets)
    # Ids stay where they are if Spark finds the stored plan (a row per part and queue) small enough to broadcast.
    return rows.join(planned, ["queue", "part"]).mapInArrow(_cut(size), PIECES)
