"""Word counts, the count spectrum, and the ranked vocabulary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from polysense.sources.store import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def word_count(tokens: DataFrame) -> DataFrame:
    """``(word, cn)``; counts are combined before the shuffle, so hot words cost one row per task."""
    return tokens.groupBy("word").agg(F.count("*").alias("cn"))


def min_count(word_counts: DataFrame, n: int) -> DataFrame:
    return word_counts.filter(F.col("cn") >= n)


def count_spectrum(word_counts: DataFrame) -> DataFrame:
    """``(cn, n_words, n_words_ge)``: words per count, and words with at least that count.

    The unpartitioned window runs over distinct counts only: N tokens have at most
    sqrt(2N) of them.
    """
    spectrum = word_counts.groupBy("cn").agg(F.count("*").alias("n_words"))
    return spectrum.withColumn("n_words_ge", F.sum("n_words").over(Window.orderBy(F.col("cn").desc())))


def count_spectrum_thinned(word_counts: DataFrame, parts: int = 200) -> DataFrame:
    """The spectrum rows of the printed report: the first one, then each row at which
    the words since the last kept row reach a ``parts``-th of all words.

    The resetting sum is sequential; it streams over the sorted spectrum (at most
    sqrt(2N) rows) holding two numbers.
    """

    def keep_rows(batches):
        gap, since = None, 0
        for rows in batches:
            kept = []
            for words, words_ge in zip(rows["n_words"], rows["n_words_ge"], strict=True):
                first = gap is None
                if first:
                    gap = words_ge // parts
                since += words
                kept.append(first or since >= gap)
                if kept[-1]:
                    since = 0
            yield rows[pd.Series(kept, index=rows.index, dtype=bool)]

    ordered = count_spectrum(word_counts).repartition(1).sortWithinPartitions("cn")
    return ordered.mapInPandas(keep_rows, ordered.schema)


def corpus_totals(word_counts: DataFrame, n: int) -> DataFrame:
    kept = F.col("cn") >= n
    return word_counts.agg(
        F.count("*").alias("raw_vocab"),
        F.count_if(kept).alias("vocab_size"),
        F.coalesce(F.sum(F.when(kept, F.col("cn"))), F.lit(0).cast("bigint")).alias("total_words"),
    )


def senses_per_word(cn: Column, thresholds: list[int]) -> Column:
    """1, or i+2 for the last threshold i that the count reaches (list order decides)."""
    senses = F.lit(1)
    for i, threshold in enumerate(thresholds):
        senses = F.when(cn >= threshold, F.lit(i + 2)).otherwise(senses)
    return senses


def build_vocab(word_counts: DataFrame, n: int, thresholds: list[int]) -> DataFrame:
    """``(word_id, word, cn, n_senses)``, ids dense from 0 by count desc, then word.

    The rank is global yet distributed: a range-partitioned sort written once, then
    each row's number in its partition plus the size of the partitions before it
    (one offset row per partition).
    """
    order = [F.col("cn").desc(), F.col("word").asc()]
    numbered = min_count(word_counts, n).orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered = materialize(numbered, "ranked")
    part, row = F.shiftright("_id", ROW_BITS), F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    vocab = (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per sort partition
        .select(
            (row + F.col("_offset")).cast("int").alias("word_id"),
            "word",
            "cn",
            senses_per_word(F.col("cn"), thresholds).alias("n_senses"),
        )
    )
    return materialize(vocab, "vocab")


def sense_histogram(vocab: DataFrame, max_senses: int) -> DataFrame:
    """``(n_senses, n_words)`` for 1..max_senses, zero where no word has that many."""
    spark = vocab.sparkSession
    slots = spark.range(1, max_senses + 1).select(F.col("id").cast("int").alias("n_senses"))
    counts = vocab.groupBy("n_senses").agg(F.count("*").alias("n_words"))
    return slots.join(counts, "n_senses", "left").select(
        "n_senses", F.coalesce("n_words", F.lit(0).cast("bigint")).alias("n_words")
    )


def param_count(vocab: DataFrame, dim: int) -> DataFrame:
    """Number of trained parameters: two vectors per word sense."""
    return vocab.agg((F.coalesce(F.sum("n_senses"), F.lit(0)) * F.lit(2 * dim)).cast("bigint").alias("n_params"))
