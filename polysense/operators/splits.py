"""Random splits and initial senses, drawn per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polysense.functions.draws import SEED_SENSE, SEED_SHARD, SEED_SPLIT, below, unit, with_draw


def effective_ratio(lines: DataFrame, ratio: float, max_lines: int) -> Column:
    """``min(ratio, max_lines / number of lines)`` as a scalar subquery."""
    share = F.coalesce(F.try_divide(F.lit(float(max_lines)), F.count("*")), F.lit(ratio))
    return lines.agg(F.least(F.lit(ratio), share)).scalar()


def is_validation(rows: DataFrame, ratio: Column, seed: int, name: str = "held_out") -> DataFrame:
    """Add a boolean per line; rows of a line agree, whatever table they are in."""
    drawn = with_draw(rows, "_draw", seed + SEED_SPLIT, "line_id")
    return drawn.withColumn(name, unit(F.col("_draw")) < ratio).drop("_draw")


def train_validation_split(lines: DataFrame, ratio: float, max_lines: int, seed: int) -> DataFrame:
    """Add ``part``: each line is 'validation' or 'train'."""
    marked = is_validation(lines, effective_ratio(lines, ratio, max_lines), seed)
    return marked.withColumn("part", F.when(F.col("held_out"), "validation").otherwise("train")).drop("held_out")


def validation_subset(lines: DataFrame, ratio: float, max_lines: int, seed: int) -> DataFrame:
    """Validation lines as a sample; training keeps every line."""
    split = train_validation_split(lines, ratio, max_lines, seed)
    return split.filter(F.col("part") == "validation").drop("part")


def training_shards(rows: DataFrame, num_shards: int, seed: int) -> DataFrame:
    """Add ``shard`` in [0, num_shards), one per line."""
    return with_draw(rows, "shard", seed + SEED_SHARD, "line_id").withColumn(
        "shard", below(F.col("shard"), num_shards)
    )


def init_senses(occ: DataFrame, seed: int) -> DataFrame:
    """Add ``sense``, uniform over the word's senses per occurrence."""
    return with_draw(occ, "sense", seed + SEED_SENSE, "line_id", "pos").withColumn(
        "sense", below(F.col("sense"), F.col("n_senses"))
    )
