"""Sense counts, sense probabilities and the reset of rare senses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from polysense.functions.draws import SEED_DONOR, SEED_RESET_IN, SEED_RESET_OUT, unit_array, with_draw
from polysense.functions.vecmath import as_floats


def sense_counts(occ: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word_id, sense, cnt)``, zero for senses that never occur."""
    slots = vocab.select("word_id", F.explode(F.sequence(F.lit(0), F.col("n_senses") - 1)).alias("sense"))
    counts = occ.groupBy("word_id", "sense").agg(F.count("*").alias("cnt"))
    return slots.join(counts, ["word_id", "sense"], "left").select(
        "word_id", "sense", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt")
    )


def uniform_sense_probs(vocab: DataFrame) -> DataFrame:
    """``(word_id, sense, prob)`` with equal shares."""
    return vocab.select(
        "word_id", F.explode(F.sequence(F.lit(0), F.col("n_senses") - 1)).alias("sense"),
        (F.lit(1.0) / F.col("n_senses")).alias("prob"),
    )


def update_sense_probs(stats: DataFrame, counts: DataFrame, decay: float = 0.99) -> DataFrame:
    """Move probabilities towards observed shares, by ``1 - decay^observations``
    -> ``(word_id, sense, cnt, prob)``. Unseen words keep theirs."""
    if not 0.5 < decay <= 1.0:
        raise ValueError("decay must be in (0.5, 1]")
    seen = F.sum("cnt").over(Window.partitionBy("word_id"))  # at most max_senses rows per word
    keep = F.pow(F.lit(decay), F.col("_seen").cast("double"))
    moved = F.col("prob") * keep + F.col("cnt") / F.col("_seen") * (1.0 - keep)
    return (
        stats.select("word_id", "sense", "prob")
        .join(counts, ["word_id", "sense"])
        .withColumn("_seen", seen)
        .select("word_id", "sense", "cnt", F.when(F.col("_seen") > 0, moved).otherwise(F.col("prob")).alias("prob"))
    )


def normalize_probs(stats: DataFrame) -> DataFrame:
    """Sense probabilities of a word summing to one, and its number of senses."""
    word = Window.partitionBy("word_id")
    return stats.withColumn("n_senses", F.count("*").over(word)).withColumn(
        "prob", F.when(F.col("n_senses") > 1, F.col("prob") / F.sum("prob").over(word)).otherwise(F.col("prob"))
    )


def sense_donors(stats: DataFrame, floor: float, seed: int) -> DataFrame:
    """``(word_id, sense, donor)`` for each sense of an ambiguous word below ``floor``.

    The donor is drawn by probability among the senses at or above the floor; if there
    is none, it is the most probable sense.
    """
    shares = normalize_probs(stats).filter(F.col("n_senses") > 1)
    low = shares.filter(F.col("prob") < floor).select("word_id", "sense")
    options = shares.select("word_id", F.col("sense").alias("donor"), F.col("prob").alias("_p"))
    pairs = low.join(options, "word_id").filter(F.col("sense") != F.col("donor"))
    drawn = with_draw(pairs, "_d", seed + SEED_DONOR, "word_id", "sense", "donor")
    able = F.col("_p") >= floor
    arrival = -F.log((F.col("_d") + 1.0) / float(1 << 31)) / F.col("_p")
    rank = F.struct(
        (~able).alias("late"), F.when(able, arrival).otherwise(-F.col("_p")).alias("t"), F.col("donor").alias("donor")
    )
    return drawn.groupBy("word_id", "sense").agg(F.min(rank)["donor"].alias("donor"))


def _jitter(state: Column, dim: int, sd: float) -> Column:
    return F.transform(unit_array(state, dim), lambda u: (u - 0.5) * F.lit(sd) / F.lit(float(dim)))


def reset_low_prob_senses(
    model: DataFrame, stats: DataFrame, floor: float, dim: int, seed: int, sd: float = 0.01
) -> DataFrame:
    """Both vectors of each rare sense become its donor's plus noise; adds ``was_reset``."""
    donors = sense_donors(stats, floor, seed)
    source = model.select("tbl", "word_id", F.col("sense").alias("donor"), F.col("vec").alias("_from"))
    fresh = donors.join(source, ["word_id", "donor"])
    fresh = with_draw(fresh, "_di", seed + SEED_RESET_IN, "word_id", "sense")
    fresh = with_draw(fresh, "_do", seed + SEED_RESET_OUT, "word_id", "sense")
    state = F.when(F.col("tbl") == "in", F.col("_di")).otherwise(F.col("_do"))
    fresh = fresh.withColumn("_noise", _jitter(state, dim, sd))
    moved = as_floats(F.zip_with("_from", "_noise", lambda a, e: a.cast("double") + e))
    fresh = fresh.select("tbl", "word_id", "sense", moved.alias("_new"))
    return model.join(fresh, ["tbl", "word_id", "sense"], "left").select(
        "tbl", "word_id", "sense", F.coalesce("_new", "vec").alias("vec"), F.col("_new").isNotNull().alias("was_reset")
    )


def reset_summary(stats: DataFrame, floor: float) -> DataFrame:
    """``(multi_senses, resets)``: senses of ambiguous words, and those below the floor."""
    shares = normalize_probs(stats).filter(F.col("n_senses") > 1)
    return shares.agg(F.count("*").alias("multi_senses"), F.count_if(F.col("prob") < floor).alias("resets"))
