"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polysense.sources.store import Versions, materialize

#: white space that separates words, as a character class for regular expressions
SPACE = "\\x20\\x09-\\x0D"


def rows_of(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names; other columns cannot clash."""
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


class Forest:
    """Union-find over int64 node names; remembers the unions, at most one per node."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.a: list[int] = []
        self.b: list[int] = []

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.a.append(a)
            self.b.append(b)


EDGE = "u long, v long"
#: so many edges (16 bytes each) are joined by one task; more go through distributed rounds
LOCAL_EDGES = 1 << 20
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def edge_batch(u, v) -> pa.RecordBatch:
    return batch_of(_EDGE, np.asarray(u, np.int64), np.asarray(v, np.int64))


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges of each chunk of a partition."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
        if len(forest.parent) > 500_000:
            yield edge_batch(forest.a, forest.b)
            forest = Forest()
    yield edge_batch(forest.a, forest.b)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a bounded set of edges under the smallest node it reaches."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
    nodes = list(forest.parent)
    yield edge_batch(nodes, [forest.find(x) for x in nodes])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of ``edges(u, v)`` -> ``(node, root)``, root being the smallest node.

    Edges are thinned to forests inside tasks. Up to ``local_edges`` of them, by count, are
    then joined by one task. More go through large-star and small-star steps, until few
    enough are left or all are stars. Every step is written to the shared folder, so a
    lost executor costs one step. Nodes without edges are not listed; null ends and loops
    are ignored; an empty table gives an empty result.
    """
    tables = Versions(edges.sparkSession)
    clean = edges.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    thin = clean.mapInArrow(_local_forest, EDGE)
    current = tables.put("edges", thin.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        size = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if size["n"] <= local_edges:
            current = current.coalesce(1).mapInArrow(_stars, EDGE)
            stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
            stars = materialize(stars.union(stars.select(F.col("root").alias("node"), "root").distinct()), "components")
            tables.drop_all()
            return stars
        if tuple(size) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(size)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # large star: neighbours above a node hang on the smallest of its neighbourhood
        large = both.filter("v > u").join(low.hint("merge"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        hung = large.join(least.hint("merge"), F.col("u") == F.col("c"))
        small = hung.select("u", F.col("m").alias("v")).union(hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = tables.put("edges", small.distinct())
