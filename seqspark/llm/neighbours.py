"""Approximate nearest neighbours by inner product: one small-world graph per shard, shard results merged.

Equal vectors are one class with its smallest ids, so copies neither fill the graphs nor a query's candidates. The
classes are dealt to shards by hash, each query visits every shard in blocks, and a query's candidates are merged
by exact inner product in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.hnsw import Graph
from seqspark.llm.runs import mixed
from seqspark.llm.shared import stored


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector of rows whose vector is neither null nor zero and has only finite components.

    Vectors of floats stay floats, all others are doubles, so no component loses digits.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    few = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return few.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False)))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: `rep`, the smallest id, and `members`, the k + 1 smallest ids, which are all a query can name.

    The rank limit cuts each task's rows of a class before the shuffle, so a hot class is never gathered.
    """
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    ranked = rows.select("vec_id", "vec").withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k + 1)
    return ranked.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("members"))


def _searcher(k: int, links: int, ef_build: int, ef: int, rows_per_ef: int):
    def matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
        flat = np.concatenate([b.column("vec").flatten().to_numpy(zero_copy_only=False) for b in batches])
        return flat.reshape(sum(b.num_rows for b in batches), -1)

    def found(graph: Graph, x: np.ndarray, ids: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        q = matrix([batch])
        rows = graph.search(q, k, max(ef, len(x) // rows_per_ef))
        at, place = np.nonzero(rows >= 0)
        row = rows[at, place]
        score = np.einsum("pd,pd->p", q[at].astype(np.float64), x[row].astype(np.float64))
        asked = batch.column("rep").to_numpy()[at]
        return pa.RecordBatch.from_arrays(
            [pa.array(asked), pa.array(ids[row]), pa.array(score)], names=["query", "rep", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard: first its vectors, then the queries."""
        shard, held, graph = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist(), batch.column("asks").to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                part, (dim, number, asks) = batch.slice(a, b - a), keys[a]
                if (dim, number) != shard:
                    shard, held, graph = (dim, number), [], None
                if not asks:
                    held.append(part)
                    continue
                if graph is None and held:
                    x = matrix(held)
                    ids = np.concatenate([h.column("rep").to_numpy() for h in held])
                    graph, held = Graph(x, mixed(ids.astype(np.uint64)), links, ef_build), []
                for c in range(0, part.num_rows if graph is not None else 0, 2048):
                    yield found(graph, x, ids, part.slice(c, 2048))
    return search


def nearest(
    vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, shard_rows: int = 32_768, least_shards: int = 12,
    links: int = 16, ef_build: int = 64, ef: int = 96, rows_per_ef: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest rows found for each row that the SQL condition picks.

    Nearness is the largest inner product, ties go to the smaller vec_id, and a query's own row is left out. Rows
    without a usable vector or vec_id take no part; vectors of different lengths are not compared. Rows that repeat a
    vec_id count as one, the one of the smallest vector (compared by components). An empty table gives no rows, other
    columns are ignored.

    A graph is searched with a list of `ef` nodes, or of one for every `rows_per_ef` rows of its shard if that is more,
    since a list of set length finds ever less as shards fill.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    classes = stored(classes_of(rows, k), "vector-classes")
    n = classes.count()
    shards = max(least_shards, -(-n // shard_rows))
    dim = F.size("vec").alias("dim")
    index = classes.select(
        dim, F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "rep", "vec")
    members = rows.where(queries).select("vec_id", "vec").join(classes.select("vec", "rep"), "vec").select("vec_id", "rep")
    members = stored(members, "vector-queries")
    asked = classes.join(members.select("rep").distinct(), "rep")
    blocks = asked.select(
        dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "rep", "vec")
    dealt = index.unionByName(blocks).repartition(shards, "shard").sortWithinPartitions("dim", "shard", "asks")
    found = dealt.mapInArrow(_searcher(k + 1, links, ef_build, ef, rows_per_ef), "query long, rep long, score double")
    # The classes nearest to each query's class, then the rows of these that any row of that class could name.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    named = found.join(classes.select("rep", "members"), "rep").select("query", "score", F.explode("members").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    of_class = named.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    # Each query: its class' list without itself, at most k of it.
    own = members.join(of_class, F.col("rep") == F.col("query")).select(
        F.col("vec_id").alias("query_id"),
        F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("place", "x")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
