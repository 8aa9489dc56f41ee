"""Near-duplicate embeddings by spherical k-means cells.

Unit vectors are assigned to the nearest of the cells' centres, which are fitted on a
bounded sample; every vector also visits the next nearest cells. Vectors of each length
have cells of their own. Equal vectors are one
class, compared once by its smallest id and weighed by its copies, so a large group of
copies costs no products. Inside a cell, blocks of classes meet pairwise in matrix
products, so tasks stay bounded whatever the size of a cell, and only counts and spanning
edges leave them. One vector per group is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from polysense.llm.common import Forest, batch_of, components, rows_of
from polysense.sources.store import materialize

MIN_COSINE = 0.9
#: vectors per cell to aim at, and the bound of the number of cells (their centres go to every task)
CELL, MAX_CELLS = 1024, 4096
#: bound of the sample the centres are fitted on, in vectors
SAMPLE = 16_384
#: cells a vector is compared in
PROBES = 4
BLOCK = 2048
ROUNDS = 10


def usable(value: list[float] | None) -> bool:
    """Not null, not empty, no null or non-finite component, not zero."""
    if not value or any(x is None for x in value):
        return False
    with np.errstate(all="ignore"):
        top = np.abs(np.array(value, float)).max()
    return bool(np.isfinite(top) and top > 0)


#: rows whose products with all centres are held at a time
_SLICE = 512


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres of the sample's unit rows; empty cells restart at the worst served rows."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        home, fit = np.empty(len(sample), np.int64), np.empty(len(sample))
        for at in range(0, len(sample), _SLICE):
            near = sample[at : at + _SLICE] @ centres.T
            home[at : at + _SLICE] = best = near.argmax(axis=1)
            fit[at : at + _SLICE] = near[np.arange(len(near)), best]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        if len(empty):
            sums[empty] = sample[np.argsort(fit)[: len(empty)]]
            size = np.linalg.norm(sums, axis=1)
        centres = sums / np.maximum(size, 1e-12)[:, None]
    return centres


def _unpacked(column: pa.ChunkedArray | pa.Array, kind: type, dim: int) -> np.ndarray:
    """Unit rows in double precision of packed usable vectors of one length."""
    rows = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _pack(kind: type):
    """Usable vectors as bytes, in the precision they came in, with their length."""
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("dim", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            good = [i for i, v in enumerate(values) if usable(v)]
            yield batch_of(schema, batch.column(0).take(pa.array(good, pa.int64())), [np.array(values[i], kind).tobytes() for i in good], [len(values[i]) for i in good])
    return run


ASSIGNED = "vec_id long, vec binary, dim int, copies long, cells array<int>"
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("dim", pa.int32()), ("copies", pa.int64()), ("cells", pa.list_(pa.int32()))])


def _assign(centres: dict[int, np.ndarray], probes: int, kind: type):
    """The nearest cells of each vector among those of its length; a length without centres is one cell."""
    def nearest(part: pa.RecordBatch, dim: int) -> list[np.ndarray]:
        own = centres.get(dim)
        if own is None or len(own) == 1:
            return [np.zeros(1, np.int32)] * part.num_rows
        near = -(_unpacked(part.column(1), kind, dim) @ own.T)
        top = np.argpartition(near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.argsort(near, axis=1)
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
        return list(top.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                same = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, same.num_rows, _SLICE):
                    part = same.slice(at, _SLICE)
                    yield batch_of(_ASSIGNED, *part.columns, nearest(part, dim))
    return run


FOUND = "u long, v long, n long"
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _compare(min_cosine: float, kind: type):
    """Counts and spanning edges of one pair of blocks of a cell; a row is at home or visits.

    A row stands for its copies: it gives its partner that many links.

    A pair is counted in the smaller of the cells where it meets with one side at home.
    """
    def run(key, table):
        dim, cell, low, high = (x.as_py() for x in key)
        ids = table.column("vec_id").to_numpy()
        rows = _unpacked(table.column("vec"), kind, dim)
        copies = table.column("copies").to_numpy()
        cells = np.stack(table.column("cells").to_numpy())
        block = table.column("block").to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links = np.zeros(len(ids), np.int64)
        forest = Forest()
        home = cells[:, 0]
        label = np.arange(len(ids))
        for at in range(0, len(left), 512):
            a = left[at : at + 512]
            i, j = np.nonzero(rows[a] @ rows[right].T >= min_cosine)
            i, j = a[i], right[j]
            keep = ids[i] < ids[j] if low == high else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            for flip in (False, True):  # the pair with i at home here, then with j at home here only
                x, y = (j, i) if flip else (i, j)
                ok = home[x] == cell
                if flip:
                    ok &= home[y] != cell
                # y may be at home in a smaller cell that x visits: then the pair is counted there
                there = home[y]
                ok &= ~((there < cell) & (cells[x] == there[:, None]).any(axis=1))
                x, y = x[ok], y[ok]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                # per row, join the classes of its partners; a class is named by one of its rows
                by = np.argsort(x, kind="stable")
                x, y = x[by], y[by]
                cuts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else x
                for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(x)).tolist()):
                    mine = label[x[s]]
                    others = np.unique(label[y[s:e]])
                    others = others[others != mine]
                    for other in others.tolist():
                        forest.join(int(ids[mine]), int(ids[other]))
                    if len(others):
                        label[np.isin(label, others)] = mine
        some = np.flatnonzero(links)
        u = np.concatenate((ids[some], np.array(forest.a, np.int64)))
        v = np.concatenate((ids[some], np.array(forest.b, np.int64)))
        n = np.concatenate((links[some], np.zeros(len(forest.a), np.int64)))
        return pa.table([u, v, n], schema=_FOUND)
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE,
                    cell: int = CELL, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Links are pairs of different ids with a cosine of ``min_cosine`` or more, taken in
    double precision, between vectors of one length; each length has cells of its own. Vectors
    that are null, empty, zero or not finite link with nothing, nor do rows without an id.
    Rows that repeat an id share its result; of different usable vectors under one id, the
    smallest is compared. An empty table gives an empty result.
    """
    rows = rows_of(vectors, vec_id=id_col, vec=vec_col)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
    element = vectors.schema[vec_col].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    every = rows.filter("vec_id IS NOT NULL").mapInArrow(_pack(kind), "vec_id long, vec binary, dim int")
    one = every.groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("vec_id", "v.vec", "v.dim")
    packed = materialize(one.withColumn("digest", F.unhex(F.sha2("vec", 256))), "vectors")
    first = F.min(F.struct("vec_id", "vec", "dim"))
    classes = packed.groupBy("digest").agg(first.alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.select("digest", "first.vec_id", "first.vec", "first.dim", "copies"), "classes")
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row per length
    n = sum(counts.values())
    cut = min(1.0, 1.1 * sample / max(n, 1))
    drawn = classes.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(cut * (1 << 30))).limit(sample).select("vec", "dim").toArrow()
    dims, centres = drawn.column("dim").to_numpy(), {}
    for dim in np.unique(dims).tolist():
        points = _unpacked(drawn.column("vec").take(pa.array(np.flatnonzero(dims == dim))), kind, dim)
        centres[dim] = spherical_kmeans(points, max(1, min(MAX_CELLS, -(-counts[dim] // cell), len(points) // 4)))
    assigned = materialize(classes.select("vec_id", "vec", "dim", "copies").mapInArrow(_assign(centres, probes, kind), ASSIGNED), "assigned")
    # at most MAX_CELLS rows a length, and never more than a quarter of the sample beside a cell for each length
    sizes = assigned.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").count()
    sizes = sizes.select("dim", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    met = assigned.select("*", F.explode("cells").alias("cell")).join(F.broadcast(sizes), ["dim", "cell"])
    met = met.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    found = materialize(met.groupBy("dim", "cell", "low", "high").applyInArrow(_compare(min_cosine, kind), FOUND), "cosines")
    counted = found.filter("n > 0").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("n = 0").select("u", "v")).select(F.col("node").alias("vec_id"), "root")
    # the smallest id of a component is its root, as the smallest of a class stands for it
    judged = classes.select("digest", "vec_id", "copies").join(counted, "vec_id", "left").join(roots, "vec_id", "left").select(
        "digest", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("root"))
    members = packed.select("vec_id", "digest").join(judged, "digest").drop("digest")
    out = rows.select("vec_id").join(members, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
                      (F.col("vec_id").isNotNull() & (F.coalesce("root", "vec_id") == F.col("vec_id"))).alias("kept"))
