"""Nearest-word queries over vector tables ``(word, sense, vec)``."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from polysense.functions.vecmath import dot, norm

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

BLOCK_ROWS = 131_072  # vectors of one side that one task holds
SLICE_ROWS = 256       # queries scored at once inside a task
SLICE_COLUMNS = 4096   # against so many vectors, so that scores stay in the processor's cache
SCORE_DIGITS = 9       # scores are compared at this precision, so equal vectors tie exactly


def get_vectors(vectors: DataFrame) -> DataFrame:
    """The word -> vector listing."""
    return vectors.select("word", "sense", "vec")


def lookup_vector(vectors: DataFrame, word: str, sense: int | None = None) -> DataFrame:
    """Rows of a word; raises when the table does not know it."""
    rows = vectors.filter(F.col("word") == word)
    if sense is not None:
        rows = rows.filter(F.col("sense") == sense)
    if rows.isEmpty():
        raise KeyError(f"{word!r} is not in the vocabulary")
    return rows.select("word", "sense", "vec")


def find_synonyms_vector(vectors: DataFrame, query: list[float], n: int) -> DataFrame:
    """``(word, sense, score)`` of ranks 2..n+1 by ``query . vec / |vec|``.

    The best hit is dropped, being the query word itself in the usual case. Zero
    vectors have no direction and are left out. Plans as a top-k, not a sort.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    dim = len(query)
    literal = F.array(*[F.lit(float(x)) for x in query])
    length = norm(F.col("vec"), dim)
    score = F.round(dot(literal, F.col("vec"), dim) / length, SCORE_DIGITS)
    return (
        vectors.filter(length > 0)
        .select("word", "sense", score.alias("score"))
        .orderBy(F.col("score").desc(), "word", "sense")
        .offset(1)
        .limit(n)
    )


def top_columns(u: np.ndarray, m: np.ndarray, mine: np.ndarray, k: int):
    """The ``k`` best columns of each row of ``u @ m.T``, without column ``mine``; among equal scores the lower column wins.

    Columns are scored a few at a time. Those that may still round up to the k-th best score found so
    far are kept, so memory does not grow with the columns and few scores are looked at twice.
    """
    keep = min(k, len(m))
    rows, cols, scores = np.empty(0, int), np.empty(0, int), np.empty(0)
    if keep == 0:
        return rows, cols, scores
    edge, slack = np.empty(0), 2 * 10.0**-SCORE_DIGITS
    step = max(SLICE_COLUMNS, keep)
    for s in range(0, len(m), step):
        x = u @ m[s : s + step].T
        own = np.flatnonzero((mine >= s) & (mine < s + step))
        x[own, mine[own] - s] = -np.inf
        if s == 0:
            edge = np.partition(x, -keep, axis=1)[:, -keep]
        r, c = np.divmod(np.flatnonzero((x >= (edge - slack)[:, None])), x.shape[1])
        near = x[r, c]
        some = near > -np.inf
        if not some.any():
            continue
        rows, cols, scores = (np.concatenate(p) for p in ((rows, r[some]), (cols, c[some] + s), (scores, near[some])))
        order = np.lexsort((-scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        full = np.flatnonzero(np.bincount(rows, minlength=len(u)) >= keep)
        edge[full] = np.maximum(edge[full], scores[np.searchsorted(rows, full) + keep - 1])
        stay = scores >= (edge - slack)[rows]
        rows, cols, scores = rows[stay], cols[stay], scores[stay]
    near = np.round(scores, SCORE_DIGITS)
    order = np.lexsort((cols, -near, rows))
    rows, cols, near = rows[order], cols[order], near[order]
    best_ones = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
    return rows[best_ones], cols[best_ones], near[best_ones]


def top_scores(queries: DataFrame, vectors: DataFrame, query_key: list[str], key: list[str], k: int,
               unit_query: bool = False, skip_self: bool = False) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for every row of ``queries``, exactly
    -> ``(query_key.., key.., score, rank)``.

    Both sides are cut into hash blocks of bounded size and each pair of blocks meets
    in one task, which multiplies the two matrices and passes on only each query's
    ``k`` best, so no pair is ever written out. Copies of a vector spread over the
    blocks like any other rows. ``unit_query`` divides by the query's length as well;
    ``skip_self`` leaves out the row with the query's own key.
    """
    query_blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    blocks = max(1, math.ceil(vectors.count() / BLOCK_ROWS))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(blocks, min(cores, blocks * query_blocks * 4) // query_blocks)

    def spread(df: DataFrame, names: list[str], prefix: str, n_own: int, n_other: int) -> DataFrame:
        """Own block by hash, one copy of the row for each block of the other side."""
        return df.select(
            *[F.col(n).alias(prefix + n) for n in [*names, "vec"]],
            F.pmod(F.xxhash64(*names), F.lit(n_own)).alias("_own"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))).alias("_other"),
        )

    left = spread(queries, query_key, "q_", query_blocks, blocks)
    right = spread(vectors, key, "", blocks, query_blocks)
    fields = [T.StructField(f"q_{f}", queries.schema[f].dataType) for f in query_key]
    fields += [T.StructField(f, vectors.schema[f].dataType) for f in key]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema]

    query_names = [f"q_{f}" for f in query_key]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        sizes = lists.value_lengths()
        if sizes.null_count or len(sizes.unique()) > 1:
            raise ValueError("vectors of a table must have one length")
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)

    def keys_of(table: pa.Table, names: list[str]):
        return zip(*[table.column(n).to_pylist() for n in names])

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        u, m = (matrix(t.column(c)) if t.num_rows else None for t, c in ((q, "q_vec"), (v, "vec")))
        if u is None or m is None:
            return pa.table({**{n: q.column(n)[:0] for n in query_names}, **{n: v.column(n)[:0] for n in key}, "score": pa.array([], pa.float64())})
        q = q.select(query_names)
        v = v.select(key).append_column("_at", pa.array(np.arange(len(m)))).sort_by([(n, "ascending") for n in key])
        length = np.linalg.norm(m, axis=1)
        at = v.column("_at").to_numpy()
        real = length[at] > 0
        v, at = v.filter(pa.array(real)), at[real]
        m = m[at]
        m /= length[at, None]
        if unit_query:
            size = np.linalg.norm(u, axis=1, keepdims=True)
            u = np.divide(u, size, out=np.zeros_like(u), where=size > 0)
        mine = np.full(len(u), -1)
        if skip_self:
            place = {t: i for i, t in enumerate(keys_of(v, key))}
            mine = np.array([place.get(t, -1) for t in keys_of(q, query_names)])
        found = [top_columns(u[s : s + SLICE_ROWS], m, mine[s : s + SLICE_ROWS], k) for s in range(0, len(u), SLICE_ROWS)]
        rows = np.concatenate([r + i * SLICE_ROWS for i, (r, _, _) in enumerate(found)])
        cols, scores = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
        left_part, right_part = q.take(pa.array(rows)), v.select(key).take(pa.array(cols))
        return pa.table([*left_part.columns, *right_part.columns, pa.array(scores)], names=names)

    pairs = left.groupBy("_own", "_other").cogroup(right.groupBy("_other", "_own"))
    local = pairs.applyInArrow(best, schema)
    order = Window.partitionBy(*query_names).orderBy(F.col("score").desc(), *key)
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def find_synonyms_batch(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """Synonyms of many word senses: ``(q_word, q_sense, word, sense, score, rank)``, each
    query's best hit dropped."""
    if n <= 0:
        raise ValueError("n must be positive")
    top = top_scores(queries, vectors, ["word", "sense"], ["word", "sense"], n + 1)
    return top.filter(F.col("rank") > 1).withColumn("rank", F.col("rank") - 1)


def find_synonyms(vectors: DataFrame, word: str, n: int) -> DataFrame:
    """One list per sense of ``word``, columns as of ``find_synonyms_batch``.

    The word's few vectors (one per sense) become literals, so the table is scanned in place
    and only each task's best rows are shuffled.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    own = lookup_vector(vectors, word).select("sense", "vec").collect()
    dim, sense_type = len(own[0]["vec"]), vectors.schema["sense"].dataType
    length = norm(F.col("vec"), dim)
    scores = [
        F.struct(F.lit(r["sense"]).cast(sense_type).alias("q_sense"),
                 F.round(dot(F.array(*[F.lit(float(x)) for x in r["vec"]]), F.col("vec"), dim) / length, SCORE_DIGITS).alias("score"))
        for r in own
    ]
    rows = vectors.filter(length > 0).select(F.lit(word).alias("q_word"), "word", "sense", F.explode(F.array(*scores)).alias("_s"))
    order = Window.partitionBy("q_sense").orderBy(F.col("score").desc(), "word", "sense")
    ranked = rows.select("q_word", "_s.q_sense", "word", "sense", "_s.score").withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= n + 1) & (F.col("rank") > 1)).withColumn("rank", F.col("rank") - 1)
