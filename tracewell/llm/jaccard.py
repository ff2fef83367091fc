"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide.

Texts with equal n-gram sets are one representative with a number of copies. Representatives that share a band hash
are tied to the smallest id of their bucket, so a bucket of any size gives as many rows as it has members. The sets
of tied representatives meet in blocks of bounded size, where every pair is verified by counting common n-grams;
pairs are never emitted, only each member's number of links and a spanning set of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Memo, components, cut_lineage, grouped, keyed, mapped, mix64, plain, table, texts

WORDS, THRESHOLD = 5, 0.8
#: Least probability that a pair at the threshold shares a band, and the number of hashes to spend.
RECALL, HASHES = 0.9999, 128
#: Representatives of a group that meet in one block.
BLOCK = 256
#: Rows up to which the tied representatives are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000

_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, thus the fewest false candidates, that still reach the recall."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


class Shingler:
    """Sorted distinct 64-bit hashes of the n-grams of words of a text.

    Words are runs of letters, digits and underscores in lower case. A text of fewer words is one n-gram of all it
    has; one without words is one n-gram of its characters, so equal texts always have equal sets.
    """

    def __init__(self, n: int = WORDS):
        self.n, self.memo = n, Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")))

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), seed=7)], np.uint64)
        h = np.array(self.memo.of(words), np.uint64)
        n = min(self.n, len(h))
        sh = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            sh = sh * _P + h[k : k + len(sh)]
        return np.unique(mix64(sh + np.uint64(n)))


def signature(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of a set: MinHash by `bands * rows` multiplications modulo 2^64, a band's minima mixed together."""
    rng = np.random.default_rng(20_240_101)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (a[:, None] * shingles[None, i : i + 1024] + b[:, None]).min(1), out=least)
    least = least.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _P
    for k in range(rows):
        out = mix64(out + least[:, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs(doc_id, text) as (doc_id, h1, h2, n_grams, bands): h1 and h2 name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            h1, h2, size, sig = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingle(text)
                h1.append(np.add.reduce(mix64(s + np.uint64(1))).astype(np.int64))
                h2.append(np.add.reduce(mix64(s * _P)).astype(np.int64))
                size.append(len(s))
                sig.append(signature(s, bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "n_grams", "bands"])

    return mapped(docs, run, "doc_id long, h1 long, h2 long, n_grams long, bands array<long>")


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs (of a with b, or within a) have Jaccard similarity >= threshold; none of a set with itself."""
    both = sets_a + (sets_b or [])
    sizes = np.array([len(s) for s in both])
    flat = np.concatenate(both)
    values, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    shared = many > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    na = len(sets_a)
    common = np.zeros((na, len(sets_b) if sets_b is not None else na), np.float64)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(both), width), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        common += m[:na] @ (m[na:] if sets_b is not None else m[:na]).T
    sb = sizes[na:] if sets_b is not None else sizes
    union = sizes[:na, None] + sb[None, :] - common
    out = common >= threshold * union - 1e-9
    if sets_b is None:
        np.fill_diagonal(out, False)
    return out


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def verify(sets: DataFrame, threshold: float) -> DataFrame:
    """Links within blocks: sets(g, bi, bj, side, id, copies, grams) as (id, links, root).

    links: copies of the linked representatives of the block; root: the smallest id that the block ties to id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["g", "bi", "bj"]):
            ids, copies, side = t.column("id").to_numpy(), t.column("copies").to_numpy(), t.column("side").to_numpy()
            grams = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
            if t.column("bi")[0].as_py() == t.column("bj")[0].as_py():
                hit = linked(grams, None, threshold)
                a, b = np.nonzero(hit)
                links = hit @ copies
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(left) or not len(right):
                    continue
                hit = linked([grams[i] for i in left], [grams[i] for i in right], threshold)
                a, b = np.nonzero(hit)
                a, b, links = left[a], right[b], np.zeros(len(ids), np.int64)
                links[left], links[right] = hit @ copies[right], hit.T @ copies[left]
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), int)
            place[order] = np.arange(len(ids))
            roots = np.array(_roots(len(ids), np.stack([place[a], place[b]], 1)), int)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(links[some].astype(np.int64), pa.int64()), pa.array(ids[order][roots[place[some]]], pa.int64())], ["id", "links", "root"])

    return mapped(sets.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj"), run, "id long, links long, root long")


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """docs(doc_id, text) as (doc_id, class_id, n_links, n_copies), a row for every row of docs.

    class_id: the smallest doc_id that links lead to, its own if there are none. n_links: other documents whose sets
    of n words have Jaccard similarity >= threshold with this one's, copies included. n_copies: documents with the
    same set, itself included. Null text: empty; empty texts are copies of each other. Equal rows are copies of each
    other too. A null doc_id links with nothing. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    lost = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    docs = docs.where("doc_id is not null")
    bands, rows = choose_bands(threshold, recall, hashes)
    sig = cut_lineage(signatures(docs, n, bands, rows))
    name = ["h1", "h2", "n_grams"]
    reps = cut_lineage(sig.groupBy(*name).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    banded = reps.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    ties = banded.join(buckets, "band").where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    groups = components(ties).withColumnRenamed("component", "g")
    sizes = groups.groupBy("g").agg(F.count("*").alias("size"))
    tied = cut_lineage(groups.join(sizes, "g").join(reps.select("id", "copies"), "id"))
    small = tied.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(tied) if small else tied, docs["doc_id"] == tied["id"]).select("id", "g", "size", "copies", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, names = Shingler(n), ["g", "bi", "bj", "side", "id", "copies", "grams"]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            out: list[tuple] = []
            held = 0
            for i, g, size, copies, text in zip(*cols, texts(batch.column(4)), strict=True):
                grams, blocks = shingle(text).tobytes(), -(-size // BLOCK)
                own = int(mix64(np.array([i], np.int64).view(np.uint64))[0]) % blocks
                out += [(g, min(own, x), max(own, x), int(own > x), i, copies, grams) for x in range(blocks)]
                held += blocks * len(grams)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    sets = mapped(found, spread, "g long, bi int, bj int, side int, id long, copies long, grams binary")
    hits = cut_lineage(verify(sets, threshold))
    classes = components(hits.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = hits.groupBy("id").agg(F.sum("links").alias("links"))
    whole = reps.select(*name, "id", "copies").join(links, "id", "left").join(classes, "id", "left")
    named = whole.select(*name, F.coalesce("component", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return sig.select("doc_id", *name).join(named, name).select("doc_id", "class_id", "n_links", "n_copies").union(lost)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: one of each class, that with the smallest doc_id. Every row counts for itself: of
    repeated rows one stays, and rows without a doc_id are compared too and come first. Null text: empty. An empty
    table gives an empty one; other columns may have any names."""
    wide = keyed(plain(docs, "doc_id", "text"))
    rows = join(wide.select(F.col("_row").alias("doc_id"), "text"), **options)
    kept = rows.where("doc_id = class_id").select(F.col("doc_id").alias("_row"))
    return wide.join(kept, "_row", "left_semi").drop("_row").toDF(*docs.columns)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
