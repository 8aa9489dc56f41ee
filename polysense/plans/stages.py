"""The derived tables of a corpus, each built from the one before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.config import TrainConfig
from polysense.operators import chunks, loss, model, noise, splits, tokens, vocabulary
from polysense.sources.corpus import corpus_lines, read_table
from polysense.sources.store import materialize


@dataclass
class Corpus:
    """Lazy DataFrames over the ``documents`` table; vocabulary, occurrences, noise and start model are written once."""

    spark: SparkSession
    sf_dir: str
    cfg: TrainConfig
    init_sd: tuple[float, float] = (1.0, 0.5)

    @cached_property
    def docs(self) -> DataFrame:
        return read_table(self.spark, self.sf_dir, "documents")

    @cached_property
    def lines(self) -> DataFrame:
        return corpus_lines(self.docs)

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens.tokenize(self.lines)

    @cached_property
    def word_counts(self) -> DataFrame:
        return vocabulary.word_count(self.tokens)

    @cached_property
    def vocab(self) -> DataFrame:
        return vocabulary.build_vocab(self.word_counts, self.cfg.min_count, self.cfg.thresholds)

    def encoded(self, lines: DataFrame) -> DataFrame:
        """Tokens of lines of the corpus with their start senses, not written; a line gives the same tokens whatever others there are."""
        return splits.init_senses(tokens.filter_vocab(tokens.tokenize(lines), self.vocab, lines=lines), self.cfg.seed)

    @cached_property
    def chunks(self) -> DataFrame:
        """The encoded corpus by chunks of lines, written once: lookups take it apart by rank and would tokenize it again for each part."""
        return materialize(chunks.line_chunks(self.encoded(self.lines), self.cfg.window, loss.GROUP_TOKENS), "occurrences")

    @cached_property
    def occurrences(self) -> DataFrame:
        return chunks.chunk_tokens(self.chunks)

    @cached_property
    def size(self) -> int:
        """The number of tokens."""
        return self.chunks.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]

    @cached_property
    def noise(self) -> DataFrame:
        return noise.noise_distribution(self.vocab)

    def negatives(self, occ: DataFrame | None = None) -> DataFrame:
        occ = self.occurrences if occ is None else occ
        return noise.negative_samples(occ, self.noise, self.cfg.num_negative, self.cfg.seed)

    @cached_property
    def model(self) -> DataFrame:
        return materialize(model.init_random(self.vocab, self.cfg.dim, self.cfg.seed, *self.init_sd), "model")

    @cached_property
    def draw(self) -> Callable | None:
        """Draws noise words in the task that uses them, while it can hold the intervals of all words."""
        return noise.in_place(self.noise, self.cfg.num_negative, self.cfg.seed)

    def drawable(self, occ: DataFrame | None = None) -> DataFrame:
        """Tokens for steps that take ``draw``; without it they come with their noise words, written once."""
        occ = self.occurrences if occ is None else occ
        if self.draw:
            return occ
        return materialize(noise.with_noise_words(occ, self.noise, self.cfg.num_negative, self.cfg.seed), "drawn")

    def windowed(self) -> DataFrame:
        """The corpus for steps that take ``draw`` and look no further than the window: chunks, or tokens with their noise words."""
        return self.chunks if self.draw else self.drawable()

    def scored(self, occ: DataFrame | None = None) -> loss.Scored:
        return loss.scored_pairs(self.windowed() if occ is None else self.drawable(occ), None, self.model, self.cfg.dim, self.cfg.window, draw=self.draw)


def hardest_words(corpus: Corpus, n: int) -> DataFrame:
    """The ``n`` words with the highest mean loss per prediction as a centre."""
    losses = loss.centre_loss(corpus.scored(), corpus.cfg.softmax)
    by_word = losses.groupBy("word_id").agg(F.sum("loss").alias("_loss"), F.sum("n").alias("n"))
    ranked = by_word.join(corpus.vocab.select("word_id", "word", "cn"), "word_id")
    return (
        ranked.select("word", "cn", "n", F.round(F.col("_loss") / F.col("n"), 6).alias("mean_loss"))
        .orderBy(F.col("mean_loss").desc(), "word")
        .limit(n)
    )
