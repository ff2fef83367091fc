"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An Arrow batch holds so many rows and bytes at most: documents can be long, so a batch is kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: What a worker remembers of words, in characters; each costs MEMO_ENTRY of them besides its own.
MEMO_CHARS, MEMO_ENTRY = 24_000_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _give_back() -> None:
    """Hands the memory that a worker has freed back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema), with the session's Arrow batches bounded in rows and bytes. A worker gives back what a
    task has freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which the driver and all executors share.

    Only a session on one machine without that setting (as in tests) gets a temporary folder; elsewhere it must be set.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewell-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df by way of checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df by way of a Parquet table in the shared folder: compressed, and it survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables that stored() has written: for callers whose results, made from them, are written."""
    while _written:
        drop(spark, _written.pop())


def added(df: DataFrame, **types: T.DataType) -> T.StructType:
    """The schema of df with more fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, t) for k, t in types.items())])


def plain(df: DataFrame, *keep: str) -> DataFrame:
    """df with its columns but `keep` named c0, c1, ..., so that no name clashes with an operator's own."""
    return df.toDF(*(c if c in keep else f"c{i}" for i, c in enumerate(df.columns)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a long of its own for every row, in the order of doc_id; a null one comes first.

    Rows of one doc_id follow one another by a hash of their text, then by the text. Where ids are unique they are the
    keys; else rows are sorted in ranges of (doc_id, hash), so that rows of one id may lie in several, and numbered
    as they lie there.
    """
    x = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if x["n"] == x["d"]:
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = docs.withColumn("_hash", F.xxhash64("text")).repartitionByRange(ranges, "doc_id", "_hash")
    return stored(wide.sortWithinPartitions("doc_id", "_hash", "text").withColumn("_row", F.monotonically_increasing_id()).drop("_hash"))


class Memo(dict):
    """What a worker remembers of words; all of it is forgotten when the words come to MEMO_CHARS.

    make: what a word gives; many: what a list of words gives, if that is cheaper than one by one.
    """

    def __init__(self, make: Callable[[str], object], many: Callable[[list[str]], Iterable] | None = None, most: int = MEMO_CHARS):
        super().__init__()
        self.many, self.most, self.held = many or (lambda words: map(make, words)), most, 0

    def learn(self, words: set[str]) -> None:
        """Sees to it that all these words are known."""
        new = [w for w in words if w not in self]
        if new and self.held > self.most:
            self.clear()
            self.held, new = 0, list(words)
        new.sort()
        self.update(zip(new, self.many(new), strict=True))
        self.held += sum(map(len, new)) + MEMO_ENTRY * len(new)

    def of(self, words: list[str]) -> list:
        found = list(map(self.get, words))
        if None in found:
            self.learn(set(words))
            found = list(map(self.__getitem__, words))
        return found


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64()."""
    x = x.astype(np.uint64, copy=True)
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal key values from batches that come sorted by those keys. One group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


#: A node of a graph is a hub if it has this share of all edge ends, so hubs are few whatever the graph.
HUB = 1 / 2048


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """edges(u, v) with least(u, m, n) of their u. A hub's row is broadcast (there are 2 / HUB at most), so that no
    task gets all edges of one."""
    hubs = least.where(F.col("n") >= max(8.0, HUB * ends)).select("u", F.col("m").alias("hub_m"))
    met = edges.join(F.broadcast(hubs), "u", "left")
    rest = met.where("hub_m is null").select("u", "v").join(least.select("u", "m"), "u")
    return rest.select("u", "v", "m").union(met.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u long, v long): a row (id, component) for every id that has an edge.

    component is the smallest id that can be reached. Alternates the large-star and small-star steps; the star
    centres' neighbours are only ever reduced to a minimum, which Spark combines before the shuffle, and joins keep
    hubs apart, so a component of any size is never gathered in one task. Each round is checkpointed. Ends when the
    edge set stays the same.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, ends = None, 2 * edges.count()
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, ends).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, ends).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, ends = now, 2 * now[0]
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return roots.union(roots.select(F.col("component").alias("id"), "component").distinct())
