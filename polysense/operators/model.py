"""Embedding model tables: ``(tbl 'in'/'out', word_id, sense, vec array<float>)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polysense.functions.draws import (
    SEED_INIT_IN,
    SEED_INIT_OUT,
    SEED_WARM_IN,
    SEED_WARM_OUT,
    unit_array,
    with_draw,
)
from polysense.functions.vecmath import as_floats, dot, scaled
from polysense.functions.vecsum import vector_sums

SHRINK = 0.99  # a limited row ends at this share of the allowed squared norm


def _per_sense(vocab: DataFrame) -> DataFrame:
    return vocab.select("word_id", F.explode(F.sequence(F.lit(0), F.col("n_senses") - 1)).alias("sense"))


def _noise(state: Column, dim: int, sd: float) -> Column:
    """``dim`` values of ``(U - 0.5) * sd / dim``."""
    return F.transform(unit_array(state, dim), lambda u: (u - 0.5) * F.lit(sd) / F.lit(float(dim)))


def init_random(vocab: DataFrame, dim: int, seed: int, sd_in: float = 1.0, sd_out: float = 0.5) -> DataFrame:
    """Random start model, two vectors per word sense."""
    senses = _per_sense(vocab)
    parts = []
    for table, offset, sd in (("in", SEED_INIT_IN, sd_in), ("out", SEED_INIT_OUT, sd_out)):
        drawn = with_draw(senses, "_d", seed + offset, "word_id", "sense")
        parts.append(
            drawn.select(F.lit(table).alias("tbl"), "word_id", "sense", as_floats(_noise(F.col("_d"), dim, sd)).alias("vec"))
        )
    return parts[0].unionByName(parts[1])


def warm_start(stored: DataFrame, vocab: DataFrame, dim: int, seed: int, sd: float = 0.01) -> DataFrame:
    """Start a multi-sense model from stored vectors ``(tbl, word, sense, vec)``.

    The lowest stored sense of a word, with noise, fills all its senses; every further
    stored sense replaces exactly its own. Words that were not stored stay zero.
    """
    words = vocab.select("word", "word_id", "n_senses")
    known = stored.join(words, "word").filter(F.size("vec") == dim)
    first = known.groupBy("tbl", "word_id").agg(F.min(F.struct("sense", "vec")).alias("_first"))
    base = first.select("tbl", "word_id", F.col("_first.sense").alias("_s0"), F.col("_first.vec").alias("_base"))
    exact = known.filter((F.col("sense") >= 0) & (F.col("sense") < F.col("n_senses"))).select(
        "tbl", "word_id", "sense", F.col("vec").alias("_exact")
    )
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    parts = []
    for table, offset in (("in", SEED_WARM_IN), ("out", SEED_WARM_OUT)):
        target = with_draw(_per_sense(vocab), "_d", seed + offset, "word_id", "sense").withColumn("tbl", F.lit(table))
        parts.append(target.withColumn("_noise", _noise(F.col("_d"), dim, sd)))
    target = parts[0].unionByName(parts[1])
    perturbed = F.zip_with("_base", "_noise", lambda b, e: b.cast("double") + e)
    use_exact = F.col("_exact").isNotNull() & (F.col("sense") != F.col("_s0"))
    vec = F.when(use_exact, F.col("_exact")).when(F.col("_base").isNotNull(), as_floats(perturbed)).otherwise(zero)
    return (
        target.join(base, ["tbl", "word_id"], "left")
        .join(exact, ["tbl", "word_id", "sense"], "left")
        .select("tbl", "word_id", "sense", vec.alias("vec"))
    )


def warm_start_problems(stored: DataFrame, vocab: DataFrame, dim: int) -> DataFrame:
    """How many stored rows break each rule of :func:`warm_start`."""
    words = vocab.select("word", "n_senses")
    checked = stored.join(words, "word", "left")
    return checked.agg(
        F.count_if(F.col("n_senses").isNull()).alias("unknown_word"),
        F.count_if((F.col("sense") < 0) | (F.col("sense") >= F.col("n_senses"))).alias("sense_out_of_range"),
        F.count_if(F.size("vec") != dim).alias("wrong_length"),
    )


def limit_norm(model: DataFrame, max_sq_norm: float, dim: int) -> DataFrame:
    """Scale rows whose squared norm exceeds the limit to 0.99 of it; adds ``limited``."""
    square = dot(F.col("vec"), F.col("vec"), dim)
    factor = F.sqrt(F.lit(max_sq_norm * SHRINK) / F.col("_sq"))
    over = F.col("_sq") > max_sq_norm
    vec = F.when(over, as_floats(scaled(F.col("vec"), factor))).otherwise(F.col("vec"))
    return model.withColumn("_sq", square).select("tbl", "word_id", "sense", vec.alias("vec"), over.alias("limited"))


def average_models(model: DataFrame, deltas: DataFrame, num_models: int) -> DataFrame:
    """Mean of ``num_models`` copies of ``model`` that changed by ``deltas``.

    ``deltas`` ``(tbl, word_id, sense, delta)`` holds only the rows a copy touched; the
    mean is ``base + sum(delta) / num_models``. Sums combine before the shuffle.
    """
    keys = ["tbl", "word_id", "sense"]
    total = vector_sums(deltas, keys, "delta").select(*keys, F.col("delta").alias("_delta"))
    moved = F.zip_with("vec", "_delta", lambda v, d: v.cast("double") + d / F.lit(float(max(1, num_models))))
    vec = F.when(F.col("_delta").isNull(), F.col("vec")).otherwise(as_floats(moved))
    return model.join(total, keys, "left").select(*keys, vec.alias("vec"))


def gradient_step(model: DataFrame, gradient: DataFrame, alpha: float) -> DataFrame:
    """One full-batch step: ``vec - alpha * grad`` for rows that have a gradient."""
    keys = ["tbl", "word_id", "sense"]
    moved = F.zip_with("vec", "grad", lambda v, g: v.cast("double") - F.lit(alpha) * g)
    vec = F.when(F.col("grad").isNull(), F.col("vec")).otherwise(as_floats(moved))
    return model.join(gradient, keys, "left").select(*keys, vec.alias("vec"))


def parameters_long(model: DataFrame) -> DataFrame:
    """Flat listing ``(tbl, word_id, sense, dim, name, value)`` with names like ``syn0(w3,s1,7)``."""
    table = F.when(F.col("tbl") == "in", "syn0").otherwise("syn1")
    name = F.format_string("%s(w%d,s%d,%d)", table, F.col("word_id"), F.col("sense"), F.col("dim"))
    return model.select("tbl", "word_id", "sense", F.posexplode("vec").alias("dim", "value")).withColumn("name", name)


def parameters_wide(params: DataFrame) -> DataFrame:
    """Inverse of :func:`parameters_long`; a row has as many values as a vector has components."""
    items = F.sort_array(F.collect_list(F.struct("dim", "value")))
    vec = as_floats(F.transform(items, lambda x: x["value"]))
    return params.groupBy("tbl", "word_id", "sense").agg(vec.alias("vec"))


def model_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of each model, rows in one only, rows that differ, and the largest difference."""
    keys = ["tbl", "word_id", "sense"]
    both = a.select(*keys, F.col("vec").alias("_a")).join(b.select(*keys, F.col("vec").alias("_b")), keys, "full")
    gaps = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    gap = F.coalesce(F.array_max(gaps), F.lit(0.0))
    return both.agg(
        F.count("_a").alias("rows_a"),
        F.count("_b").alias("rows_b"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        F.count_if(gap > 0).alias("different"),
        F.max(gap).alias("max_diff"),
    )
