"""Centroid clustering with an incremental distance matrix.

Each vector keeps its exact integer dot products with all centroids in a written table.
When centroids move, only the components that changed are multiplied: the product with
the difference is added to the stored dot product. Squared distances follow from stored
squared lengths, and the smallest names the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polysense.llm.common import batch_of, rows_of
from polysense.sources.store import Versions

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: components beyond this could leave the range of exact long distances
_LARGEST = 1 << 27

STATE = "vec_id long, q array<long>, dots array<long>, cluster int, distance long"
_STATE = pa.schema([("vec_id", pa.int64()), ("q", pa.list_(pa.int64())), ("dots", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64())])


def quantized(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``(vec_id, q)`` of vectors with ``dim`` components, none null or not finite."""
    rows = rows_of(vectors, vec_id=id_col, vec=vec_col)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
    usable = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # a NaN is above infinity here
    exact = lambda x: F.when(F.abs(x) <= _LARGEST, x.cast("long")).otherwise(
        F.raise_error(F.lit(f"a component beyond {_LARGEST} has no exact long distances")).cast("long"))
    return rows.filter((F.size("vec") == dim) & usable).select("vec_id", F.transform("vec", lambda x: exact(F.floor(x * scale))).alias("q"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def changes(before: np.ndarray, after: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(centroid, components, differences)`` of the centroids that moved; only nonzero differences."""
    delta = after - before
    return [(c, at, delta[c, at]) for c in range(len(delta)) if len(at := np.flatnonzero(delta[c]))]


def _assigned(dots: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number on ties, and the squared distance to it."""
    distance = (q * q).sum(axis=1)[:, None] - 2 * dots + lengths
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(q)), cluster]


def _state(vec_id: pa.Array, q: np.ndarray, dots: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    cluster, distance = _assigned(dots, q, lengths)
    return batch_of(_STATE, vec_id, _lists(q), _lists(dots), cluster.astype(np.int32), distance)


_SLICE = 8192


def _start(centroids: np.ndarray):
    """All dot products of the first assignment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                q = _matrix(batch.column("q"), centroids.shape[1])
                yield _state(batch.column("vec_id"), q, q @ centroids.T, (centroids * centroids).sum(axis=1))
    return run


def _move(moved: list[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray):
    """Dot products of the centroids that moved, by their changed components alone, and the new nearest ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                q = _matrix(batch.column("q"), centroids.shape[1])
                dots = _matrix(batch.column("dots"), len(centroids)).copy()
                for c, components, difference in moved:
                    dots[:, c] += q[:, components] @ difference
                yield _state(batch.column("vec_id"), q, dots, (centroids * centroids).sum(axis=1))
    return run


_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _partial_sums(k: int, dim: int):
    """At most one row per cluster leaves a task, however many vectors are in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            sizes += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, _matrix(batch.column("q"), dim))
        some = np.flatnonzero(sizes)
        if len(some):
            yield batch_of(_SUMS, some.astype(np.int32), sizes[some], _lists(sums[some]))
    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean, exactly; an empty cluster's centroid stays. ``k * dim`` sums reach the driver."""
    k, dim = centroids.shape
    parts = state.select("cluster", "q").mapInArrow(_partial_sums(k, dim), "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    after = centroids.copy()
    for row in totals.collect():
        after[row["cluster"], row["at"]] = int(row["total"]) // int(row["n"])
    return after


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = CLUSTERS,
             rounds: int = ROUNDS, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per kept vector.

    Vectors with another number of components than ``dim``, or with null or non-finite
    ones, are not kept; components ``x`` become ``floor(scale * x)``. Centroids start as
    the ``k`` kept rows of smallest sha256 of ``seed:id`` (a null id as the empty text; ties,
    which are repeated ids, by components); with fewer kept rows there are fewer centroids.
    Each round assigns all and moves centroids to the floor of their means; a last
    assignment follows. Repeated rows are vectors of their own; equal distances go to the
    smaller number. A component whose integer is beyond 2^27 stops the job rather than
    leave exact arithmetic. An empty table gives an empty result.

    ``k`` is a parameter: ``k`` centroids are on the driver, and each vector holds ``k``
    dot products. The state of a round is written once; the one before is deleted then.
    """
    spark = vectors.sparkSession
    tables = Versions(spark)
    base = tables.put("vectors", quantized(vectors, id_col, vec_col, dim, scale))
    named = base.withColumn("name", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    first = named.orderBy("name", "q").limit(k).select("q").collect()
    if not first:
        return base.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["q"] for r in first], np.int64)
    state = tables.put("state", base.mapInArrow(_start(centroids), STATE))
    tables.drop("vectors")
    for _ in range(rounds):
        after = moved_centroids(state, centroids)
        state = tables.put("state", state.mapInArrow(_move(changes(centroids, after), after), STATE))
        centroids = after
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    inertia = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    inertia = {r["cluster"]: int(r["own"]) for r in inertia.collect()}  # at most k rows
    total = sum(inertia.values())
    facts = spark.createDataFrame([(c, inertia.get(c, 0), total, digest) for c, digest in digests],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
