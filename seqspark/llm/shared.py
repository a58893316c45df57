"""Helpers that several operators share: stored tables, batches by bytes and encoding by distinct chunk."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The characters Unicode calls White_Space, for a regular-expression class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The characters that separate words, as the contracts of the operators define words.
WORD_SPACE = r"\x20\x09-\x0D"
#: Text that one step in a task works on at a time.
SLICE_BYTES = 4 << 20


#: Paths given out so far and names of tables made, in order.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def making(step: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """What `step` gives, and the paths and tables that it stored on its way."""
    begin = len(_made)
    return step(), _made[begin:]


def drop(docs: DataFrame, made: list[str]) -> list[str]:
    """Deletes the paths and tables of `made`, but for those that `docs` reads, which are returned."""
    spark, read = docs.sparkSession, docs.inputFiles()
    keep = [path for path in made if any(path.rsplit("/", 1)[-1] in file for file in read)]
    files = spark._jvm.org.apache.hadoop.fs
    for path in [x for x in made if x not in keep]:
        if "/" not in path:
            spark.sql(f"DROP TABLE IF EXISTS {path}")
        else:
            place = files.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return keep


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """`df` stored in the shared folder as a table bucketed by `column`, so that joins on it don't shuffle it."""
    spark, table = df.sparkSession, f"llm_{name}_{uuid.uuid4().hex}"
    df.write.option("path", shared_path(spark, name)).bucketBy(buckets, column).saveAsTable(table)
    _made.append(table)
    return spark.table(table)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written once to the shared folder and read back: a cut of the lineage that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `most` bytes of `column`; a longer single row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column)
        lengths = pa.compute.binary_length(lengths).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            yield batch.slice(begin, end - begin)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `lengths` of them, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class ChunkTable:
    """Distinct chunks of text with their ids: each is encoded once and looked up afterwards.

    The table lives as long as a Python worker and starts anew beyond `most` ids, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 3_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chunks: list[str] = []
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; a chunk that is new is encoded."""
        found = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if missing.size:
            if len(self.ids) + len(self.chunks) > self.most:
                self.clear()
                return self.numbers(chunks)
            new = list(dict.fromkeys(chunks[i] for i in missing))
            ids = self.encode(new)
            self.number.update(zip(new, range(len(self.chunks), len(self.chunks) + len(new))))
            self.chunks += new
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            flat = np.fromiter((x for one in ids for x in one), np.uint32, int(lengths.sum()))
            self.ids = np.concatenate([self.ids, flat])
            found[missing] = np.fromiter(map(self.number.get, (chunks[i] for i in missing)), np.int64, missing.size)
        return found

    def texts(self, chunked: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For texts given as chunks: all ids one after another, and where each text's ids begin (and the last end)."""
        flat = [chunk for chunks in chunked for chunk in chunks]
        return self.ids_of(self.numbers(flat), np.fromiter(map(len, chunked), np.int64, len(chunked)))

    def ids_of(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`texts` for the numbers of all chunks, one after another, and each text's count of them."""
        lengths = self.length[numbers]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return self.ids[ranges(self.start[numbers], lengths)], upto[ends]
