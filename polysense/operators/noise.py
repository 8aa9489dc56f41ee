"""Noise distribution, negative samples and weighted choice."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from polysense.functions import kernels
from polysense.functions.draws import P, SEED_CHOICE, SEED_NEG_SENSE, SEED_NEG_WORD, below, fine_unit, present, start, with_draw, with_second_draw
from polysense.operators.joins import head_size, rank_lookup
from polysense.operators.tokens import decode_ws, encode_ws
from polysense.sources.store import materialize

cloudpickle.register_pickle_by_value(kernels)  # tasks need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POWER = 0.75
WEIGHT_SCALE = 1000.0
BLOCK = 65_536  # word ids per block of the two-level running sum
TABLE_BYTES = 64 << 20  # bound of the intervals every task may hold, at 16 bytes a word


def noise_distribution(vocab: DataFrame) -> DataFrame:
    """``(word_id, n_senses, wt, lo, hi, total, width)``: integer weights ~ cn^0.75 and
    their running sum by word id.

    The running sum has two levels, so that no task sees the whole vocabulary: blocks
    of ids are summed, and each block's start is added to the sum inside it.
    ``width`` is the mean weight, used to bucket the range lookup of a draw.
    """
    weight = F.greatest(F.lit(1.0), F.floor(F.pow(F.col("cn").cast("double"), F.lit(POWER)) * WEIGHT_SCALE + 0.5))
    weighted = vocab.select("word_id", "n_senses", weight.cast("bigint").alias("wt")).withColumn(
        "_block", (F.col("word_id") / BLOCK).cast("int")
    )
    blocks = weighted.groupBy("_block").agg(F.sum("wt").alias("_sum"), F.count("*").alias("_n"))
    everything = Window.partitionBy()
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(  # one row per 65,536 words
        "_block",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
        F.sum("_sum").over(everything).alias("total"),
        F.ceil(F.sum("_sum").over(everything) / F.sum("_n").over(everything)).cast("bigint").alias("width"),
    )
    inside = Window.partitionBy("_block").orderBy("word_id").rowsBetween(Window.unboundedPreceding, 0)
    noise = (
        weighted.withColumn("_run", F.sum("wt").over(inside))
        .join(F.broadcast(starts), "_block")
        .withColumn("hi", F.col("_start") + F.col("_run"))
        .select("word_id", "n_senses", "wt", (F.col("hi") - F.col("wt")).alias("lo"), "hi", "total", "width")
    )
    return materialize(noise, "noise")


def with_noise_words(occ: DataFrame, noise: DataFrame, k: int, seed: int, turn: int = 0) -> DataFrame:
    """``occ`` with ``noise``, the codes ``word_id * 100 + sense`` of ``k`` noise words per position.

    Noise words are drawn as in :func:`negative_samples`. While the intervals of all words fit
    ``TABLE_BYTES``, every task holds them and searches its draws in them, and no row moves;
    a larger vocabulary goes through the bucketed join.
    """
    run = in_place(noise, k, seed, turn, dict(occ.dtypes)["line_id"] == "bigint")
    if run is None:
        return with_words(occ, _bucketed_samples(occ, noise, k, seed, turn))
    return occ.mapInArrow(run, with_noise_field(occ.schema))


def with_noise_field(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("noise", ArrayType(LongType()))])


def in_place(noise: DataFrame, k: int, seed: int, turn: int = 0, wide: bool = True) -> Callable | None:
    """The draws as a function that adds ``noise`` to Arrow batches of tokens, so that they can be made in the task
    that uses them and are neither written nor shuffled; None if the intervals of all words exceed ``TABLE_BYTES``.

    ``wide`` says that ``line_id`` is a bigint.
    """
    if noise.count() * 16 > TABLE_BYTES:
        return None
    table = noise.orderBy("word_id").select("hi", "n_senses").toArrow()
    hi, n_senses = (table.column(c).to_numpy() for c in ("hi", "n_senses"))
    seed = seed + 101 * turn
    states = start(seed + SEED_NEG_WORD), start(seed + SEED_NEG_SENSE)

    def run(batches):
        for batch in batches:
            line, pos, word = (batch.column(c).to_numpy().astype(np.int64) for c in ("line_id", "pos", "word_id"))
            keys = [line >> 31, line & P, pos] if wide else [line, pos]
            many = k if len(hi) > 1 else 0  # a one-word vocabulary has no negatives
            codes = kernels.noise_words(keys, word, hi, n_senses, many, *states) if many else np.empty((len(word), 0), np.int64)
            ends = np.arange(len(word) + 1, dtype=np.int32) * many
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], [*batch.schema.names, "noise"])

    run.table = {"hi": hi, "n_senses": n_senses, "k": k if len(hi) > 1 else 0, "states": states, "wide": wide}  # for ``compiled``
    return run


def with_words(occ: DataFrame, negatives: DataFrame | None) -> DataFrame:
    """``occ`` with a column ``noise``: its own, or packed from rows of :func:`negative_samples`, or empty."""
    if "noise" in occ.columns:
        return occ
    if negatives is None:
        return occ.withColumn("noise", F.array().cast("array<bigint>"))
    code = encode_ws(F.col("neg_word_id"), F.col("neg_sense"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("k", code.alias("code")))), lambda x: x["code"])
    drawn = negatives.groupBy("line_id", "pos").agg(words.alias("noise"))
    joined = occ.join(drawn, ["line_id", "pos"], "left")
    return joined.withColumn("noise", F.coalesce("noise", F.array().cast("array<bigint>")))


def negative_samples(occ: DataFrame, noise: DataFrame, k: int, seed: int, turn: int = 0) -> DataFrame:
    """``k`` noise words per position, never the position's own word
    -> ``(line_id, pos, k, neg_word_id, neg_sense)``.

    The draw runs over the total weight without the own word and steps over its
    interval, which equals drawing again on a hit.
    """
    if noise.count() * 16 > TABLE_BYTES:
        return _bucketed_samples(occ, noise, k, seed, turn)
    rows = with_noise_words(occ.select("line_id", "pos", "word_id"), noise, k, seed, turn)
    word, sense = decode_ws(F.col("_code"))
    return rows.select("line_id", "pos", F.posexplode("noise").alias("k", "_code")).select(
        "line_id", "pos", "k", word.alias("neg_word_id"), sense.alias("neg_sense"))


def _bucketed_samples(occ: DataFrame, noise: DataFrame, k: int, seed: int, turn: int) -> DataFrame:
    """:func:`negative_samples` for vocabularies of any size.

    A draw finds its word by a bucketed equi-join: buckets have equal weight, so they
    get equal shares of the draws, and a frequent word simply spans many of them.
    """
    seed = seed + 101 * turn
    own = noise.select("word_id", "wt", "lo", "total", "width")
    rows = rank_lookup(occ.select("line_id", "pos", "word_id"), own, ["word_id"], "word_id", head_size(64))
    rows = rows.filter(F.col("total") > F.col("wt"))  # a one-word vocabulary has no negatives
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if k > 0 else rows.withColumn(
        "k", F.lit(0)).filter(F.lit(False))
    rows = with_draw(rows, "_dw", seed + SEED_NEG_WORD, "line_id", "pos", "k")
    rows = with_draw(rows, "_ds", seed + SEED_NEG_SENSE, "line_id", "pos", "k")
    rows = with_second_draw(rows, "_dx", "_dw")  # one draw alone could not reach light words of a large total
    rows = rows.withColumn("_r", F.floor(fine_unit(F.col("_dw"), F.col("_dx")) * (F.col("total") - F.col("wt"))).cast("bigint"))
    stepped = F.when(F.col("_r") >= F.col("lo"), F.col("_r") + F.col("wt")).otherwise(F.col("_r"))
    rows = rows.withColumn("_r", present(stepped))
    bucket = present(F.floor(F.col("_r") / F.col("width")).cast("bigint"))
    rows = rows.select("line_id", "pos", "k", "_ds", "_r", bucket.alias("_bucket"))
    first = F.floor(F.col("lo") / F.col("width")).cast("bigint")
    last = F.floor((F.col("hi") - 1) / F.col("width")).cast("bigint")
    ranges = noise.select(
        F.col("word_id").alias("neg_word_id"), "n_senses", "lo", "hi", F.explode(F.sequence(first, last)).alias("_bucket")
    )
    return (
        rows.join(ranges, "_bucket")
        .filter((F.col("lo") <= F.col("_r")) & (F.col("_r") < F.col("hi")))
        .select("line_id", "pos", "k", "neg_word_id", below(F.col("_ds"), F.col("n_senses")).alias("neg_sense"))
    )


def weighted_choice(rows: DataFrame, keys: list[str], item: str, weight: str, seed: int) -> DataFrame:
    """One row per key, item ``i`` chosen with probability ``weight_i / sum``.

    Each item gets the arrival time ``-ln(u) / weight`` of its own exponential clock
    and the earliest wins. That is a plain minimum: it combines before the shuffle and
    needs no running sum over a key's rows, however many there are.
    """
    drawn = with_draw(rows.filter(F.col(weight) > 0), "_draw", seed + SEED_CHOICE, *keys, item)
    arrival = -F.log((F.col("_draw") + 1.0) / float(1 << 31)) / F.col(weight)
    return (
        drawn.withColumn("_t", arrival)
        .groupBy(*keys)
        .agg(F.min(F.struct("_t", item, weight)).alias("_first"))
        .select(*keys, F.col(f"_first.{item}").alias(item), F.col(f"_first.{weight}").alias(weight))
    )
