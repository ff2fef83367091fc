"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept a group.

Equal vectors of a label are one representative with a number of copies. Each label has centroids of its own, fitted
on a bounded sample; a vector belongs to the cell of its nearest centroid, and visits every other cell that could hold
a vector within the threshold, by the triangle inequality of angles on the cell's radius, so no link is missed. A cell
of any size is cut into blocks of bounded size; a vector is sent once to its own block, and to the other blocks of its
cell and of those that it visits. Pairs are counted in the products and never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import components, cut_lineage, mapped, mix64, table

THRESHOLD = 0.93
#: Vectors that a cell should have, cells of all labels together, and vectors that centroids are fitted on.
CELL, CELLS, SAMPLE = 2_000, 4_096, 20_000
#: Home vectors of a cell that are held together.
BLOCK = 1_024
ROUNDS = 8
#: Parts that the vectors of a label without centroids are dealt in where its size is looked up.
SALTS = 32


def unit(rows: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision of a list column whose rows are of one length. The largest component is made 1
    first, so that squares of huge or tiny ones stay within doubles."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids (fewer if x has fewer rows), from evenly spaced rows of x."""
    if k <= 1 or len(x) <= k:
        c = x.mean(0, keepdims=True)
        n = np.linalg.norm(c)
        return c / n if n > 1e-9 else x[:1].copy()
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        n = np.linalg.norm(total, axis=1)
        some = n > 1e-9
        c[some] = total[some] / n[some, None]
    return c


def _usable() -> Column:
    """Whether a row can link: an id, a label and a vector, not zero, all of it finite."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that the pairs tie to each index, by propagation of minima."""
    root = np.arange(n)
    while len(a):
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return root


_BY = ["label", "dim", "cell", "hb"]


def _linked(ids: np.ndarray, x: np.ndarray, home: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, links, root) of the vectors that link with home vectors: links are theirs alone, roots also the homes'."""
    hit = (x @ home[2].T >= threshold) & (ids[:, None] != home[0][None, :])
    v, h = np.nonzero(hit)
    if len(v):
        names, place = np.unique(np.concatenate([ids, home[0]]), return_inverse=True)
        root = _roots(len(names), place[v], place[len(ids) + h])
        links = np.bincount(place[: len(ids)], hit @ home[1].astype(float), len(names))
        some = np.unique(np.concatenate([place[v], place[len(ids) + h]]))
        yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array(links[some].astype(np.int64), pa.int64()), pa.array(names[root[some]], pa.int64())], ["id", "links", "root"])


def _products(threshold: float):
    """Home vectors of a block, then its visitors, as they come: (id, links, root) of those that link.

    A block's home vectors are held and compared with each other; visitors, however many, pass by an Arrow batch at a
    time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, settled = None, [], True

        def homes() -> Iterator[pa.RecordBatch]:
            """Once all of a block's home vectors are here."""
            nonlocal held, settled
            if not settled:
                held, settled = [tuple(np.concatenate(p) for p in zip(*held, strict=True))], True
                yield from _linked(held[0][0], held[0][2], held[0], threshold)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _BY]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows else []
            cuts = [0, *change, batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                key, t = tuple(c[lo] for c in cols), batch.slice(lo, hi - lo)
                if key != last:
                    yield from homes()
                    last, held = key, []
                ids, copies, role = (t.column(t.schema.get_field_index(c)).to_numpy() for c in ("id", "copies", "role"))
                x = unit(t.column(t.schema.get_field_index("embedding")))
                if (own := role == 0).any():
                    held.append((ids[own], copies[own], x[own]))
                    settled = False
                if not own.all():
                    yield from homes()
                    if held:
                        yield from _linked(ids[~own], x[~own], held[0], threshold)
        yield from homes()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vectors(vec_id, embedding, label) as (vec_id, n_links, component_id, kept), a row for every row.

    Vectors link if their labels are equal and their cosine in double precision is >= threshold. A vector that is
    null, empty, zero or holds null or non-finite components, and one without a label, links with nothing, and so do
    vectors of different length. Equal rows are linked with each other (they are told by 128 bits of hashes). Where
    vec_id is null the row links with nothing, component_id is null and it is not kept. An empty table gives an empty
    result; other columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"), F.col("label").cast("long"))
    name = ["label", "h1", "h2"]
    hashed = vectors.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    good = hashed.where(_usable())
    reps = cut_lineage(good.groupBy(*name).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")))
    sizes = {(r["label"], r["dim"]): r["n"] for r in reps.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dim").limit(CELLS).collect()}
    total = sum(sizes.values())
    picked = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("label", "dim", "embedding").toArrow()
    centroids: dict[tuple[int, int], np.ndarray] = {}
    labels, dims = (picked.column(c).to_numpy() for c in ("label", "dim"))
    for key in sorted(set(zip(labels.tolist(), dims.tolist(), strict=True))):
        x = unit(picked.column("embedding").take(pa.array(np.flatnonzero((labels == key[0]) & (dims == key[1])))).combine_chunks())
        share = max(1, min(-(-sizes.get(key, 1) // cell), CELLS * sizes.get(key, 1) // max(1, total)))
        centroids[key] = spherical_k_means(x, share)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # CELLS and one a label of the sample at most
    fields = f"id long, copies long, label long, dim int, embedding array<{kind}>"

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of each vector, -1 where its label has no centroids, and the angle to its centroid."""
        for b in batches:
            cells, angles = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            labels, dims = b.column(2).to_numpy(), b.column(3).to_numpy()
            for key in set(zip(labels.tolist(), dims.tolist(), strict=True)):
                own = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                if (c := shared.value.get(key)) is not None:
                    near = unit(b.column(4).take(pa.array(own))) @ c.T
                    cells[own] = near.argmax(1)
                    angles[own] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32()), pa.array(angles, pa.float64())], [*b.schema.names, "cell", "angle"])

    homes = cut_lineage(mapped(reps.select("id", "copies", "label", "dim", "embedding"), at_home, f"{fields}, cell int, angle double"))
    found = homes.where("cell >= 0").groupBy("label", "dim", "cell").agg(F.max("angle").alias("far"), F.count("*").alias("n"))
    radius = {(r["label"], r["dim"], r["cell"]): (r["far"], r["n"]) for r in found.collect()}  # a row a centroid at most
    cells_of = vectors.sparkSession.sparkContext.broadcast(radius)
    # labels without centroids are a cell each, of which only the size is asked; a label's rows are dealt over salts
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    alone = homes.where("cell < 0").groupBy("label", "dim").agg(F.count("*").alias("n"))
    alone = alone.select("label", "dim", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    single = homes.where("cell < 0").select("*", salt).join(alone, ["label", "dim", "salt"])
    order = ["id", "copies", "label", "dim", "embedding", "cell", "n"]
    sized = homes.where("cell >= 0").withColumn("n", F.lit(0).cast("long")).select(order).union(single.select(order))
    reach = float(np.arccos(threshold)) + 1e-6

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*"id copies label dim embedding cell hb role".split()]
        for b in batches:
            labels, dims, own_cell, alone_n = (b.column(k).to_numpy() for k in (2, 3, 5, 6))
            spread = (mix64(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(1)).astype(np.int64)
            rows, cells, blocks, roles = [], [], [], []

            def sent(own: np.ndarray, k: int, n: int, home: bool) -> None:
                split = -(-n // BLOCK)
                if home:
                    rows.append(own)
                    blocks.append(spread[own] % split)
                    cells.append(np.full(len(own), k))
                    roles.append(np.zeros(len(own), int))
                to, at = np.tile(np.arange(split), len(own)), np.repeat(own, split)
                keep = to != spread[at] % split if home else np.ones(len(at), bool)
                rows.append(at[keep])
                blocks.append(to[keep])
                cells.append(np.full(int(keep.sum()), k))
                roles.append(np.ones(int(keep.sum()), int))

            for key in set(zip(labels.tolist(), dims.tolist(), strict=True)):
                own = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                c = shared.value.get(key)
                if c is None:
                    sent(own, 0, int(alone_n[own[0]]), True)
                    continue
                angle = np.arccos(np.clip(unit(b.column(4).take(pa.array(own))) @ c.T, -1, 1)) if len(c) > 1 else np.zeros((len(own), 1))
                for k in range(len(c)):
                    if (key[0], key[1], k) in cells_of.value:
                        far, n = cells_of.value[key[0], key[1], k]
                        home = own_cell[own] == k
                        sent(own[home], k, n, True)
                        sent(own[~home & (angle[:, k] <= far + reach)], k, n, False)
            rows, cells, blocks, roles = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cells, blocks, roles))
            for lo in range(0, len(rows), 20_000):
                part = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([*(col.take(pa.array(rows[part])) for col in b.columns[:5]), *(pa.array(x[part], pa.int32()) for x in (cells, blocks, roles))], names)

    met = mapped(sized, visits, f"{fields}, cell int, hb int, role int").repartition(*_BY).sortWithinPartitions(*_BY, "role")
    hits = cut_lineage(mapped(met, _products(threshold), "id long, links long, root long"))
    links = hits.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(hits.select(F.col("id").alias("u"), F.col("root").alias("v")))
    whole = reps.select(*name, "id", "copies").join(links, "id", "left").join(tied, "id", "left")
    whole = whole.select(*name, F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = good.select("vec_id", *name).join(whole, name).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
