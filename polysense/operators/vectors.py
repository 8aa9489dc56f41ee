"""Jobs on any vector table: norms, means, moments, similarities, affinities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from polysense.functions.vecmath import dot, norm, scaled
from polysense.functions.vecsum import vector_sums
from polysense.operators.similarity import top_scores
from polysense.sources.store import materialize

AFFINITY_FLOOR = 1e-100


def vector_norms(df: DataFrame, key: str, dim: int) -> DataFrame:
    return df.select(key, norm(F.col("vec"), dim).alias("norm"))


def set_length(df: DataFrame, length: float, dim: int) -> DataFrame:
    """Scale every vector to ``length``; a zero vector stays zero."""
    factor = F.when(F.col("_n") == 0.0, F.lit(0.0)).otherwise(F.lit(length) / F.col("_n"))
    return df.withColumn("_n", norm(F.col("vec"), dim)).withColumn("vec", scaled(F.col("vec"), factor)).drop("_n")


def l2_normalize(df: DataFrame, dim: int) -> DataFrame:
    return set_length(df, 1.0, dim)


def limit_length(df: DataFrame, length: float, dim: int) -> DataFrame:
    """Scale down the vectors longer than ``length``."""
    factor = F.when(F.col("_n") > length, F.lit(length) / F.col("_n")).otherwise(F.lit(1.0))
    return df.withColumn("_n", norm(F.col("vec"), dim)).withColumn("vec", scaled(F.col("vec"), factor)).drop("_n")


def vector_sum(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Component sums and number of vectors per group -> ``(by.., n, vec)``."""
    return vector_sums(df, by or [], "vec")


def vector_mean(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return vector_sum(df, by).withColumn("vec", F.transform("vec", lambda x: x / F.col("n")))


def center_vectors(df: DataFrame) -> DataFrame:
    """``x - mean``; the mean is one row and enters as a scalar subquery."""
    mean = vector_mean(df).select("vec").scalar()
    moved = F.zip_with("vec", "_mean", lambda x, m: x.cast("double") - m)
    return df.withColumn("_mean", mean).withColumn("vec", moved).drop("_mean")


def second_moment_matrix(df: DataFrame, dim: int) -> DataFrame:
    """``(i, j, value)`` of the sum of ``x x^T``, neither centred nor divided.

    Each task adds up one dim x dim matrix and only those meet in the shuffle.
    """

    def partial(batches):
        total = np.zeros((dim, dim))
        for rows in batches:
            if len(rows):
                m = np.array(rows["vec"].tolist(), dtype=np.float64)
                total += m.T @ m
        i, j = np.indices((dim, dim))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    parts = df.select("vec").mapInPandas(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def nearest_by_cosine(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """Each row of ``a`` with its ``k`` most similar rows of ``b`` by cosine, itself left
    out -> ``(q_key, key, score, rank)``."""
    return top_scores(a, b, [key], [key], k, unit_query=True, skip_self=True)


def pair_metrics(pairs: DataFrame, dim: int, t: float = 0.5) -> DataFrame:
    """Adds dot product, Euclidean distance, cosine, angle (-1 with a zero vector),
    pointwise product and interpolation to rows holding ``vec_a`` and ``vec_b``."""
    a, b = F.col("vec_a"), F.col("vec_b")
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    cosine = F.when(F.col("_len") == 0.0, F.lit(0.0)).otherwise(F.col("dot") / F.col("_len"))
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine")))
    return (
        pairs.withColumn("dot", dot(a, b, dim))
        .withColumn("_len", norm(a, dim) * norm(b, dim))
        .withColumn("_gap", gap)
        .withColumn("distance", norm(F.col("_gap"), dim))
        .withColumn("cosine", cosine)
        .withColumn("angle", F.when(F.col("_len") == 0.0, F.lit(-1.0)).otherwise(F.acos(bounded)))
        .withColumn("product", F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
        .withColumn("between", F.zip_with(a, b, lambda x, y: x.cast("double") * (1.0 - t) + y.cast("double") * t))
        .drop("_gap", "_len")
    )


def affinity_normalize(edges: DataFrame) -> DataFrame:
    """``(i, j, p)``: no diagonal, symmetrized, summing to one, stored edges floored at 1e-100."""
    both = edges.filter(F.col("i") != F.col("j")).select(
        F.explode(F.array(F.struct("i", "j", "p"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "p"))).alias("e")
    ).select("e.*")
    # written once: the edges may be dear, and both their total and their rows are wanted
    halves = materialize(both.groupBy("i", "j").agg((F.sum("p") / 2.0).alias("_p")), "affinities")
    total = halves.agg(F.sum("_p")).scalar()
    return halves.select("i", "j", F.greatest(F.col("_p") / total, F.lit(AFFINITY_FLOOR)).alias("p"))
