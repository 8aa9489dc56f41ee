"""Toxic passages by maximum-scoring segments.

Words get log-odds of toxic against other labelled texts, smoothed by Dirichlet priors:
a word's prior is its stem's rate, a stem's prior the overall rate, so unseen endings
of a known stem still count. Words that say little all pull a segment down by the same
small drift. A linear scan over a text finds every maximal segment of positive total. The
best total is calibrated as an extreme value: ``lambda * S - ln(K n)`` of the Gumbel law
fitted to the best segments of texts labelled clean.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polysense.llm.common import batch_of, rows_of
from polysense.sources.store import materialize

STEM = 5
#: Dirichlet prior strengths, in texts: of a stem's rate on its words, of the overall rate on stems
WORD_PRIOR, STEM_PRIOR = 8.0, 8.0
#: a word or stem enters the model if its log-odds are this many standard deviations above zero
MIN_Z = 3.0
#: every other word pulls a segment down by this much
DRIFT = 0.05
#: a segment is significant from this calibrated value on (E-value of e^-3)
SIGNIFICANT = 3.0
#: bounds of the samples: labelled ids that teach, and those of them that calibration is fitted on
LABELLED_ROWS, CALIBRATION_ROWS = 60_000, 20_000
_STRIP = string.punctuation + "…“”„«»¿¡’‘"


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(_STRIP) for x in (text or "").lower().split()) if w]


_COUNT = pa.schema([("stem", pa.string()), ("word", pa.string()), ("toxic", pa.int64()), ("total", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have a word, by label; flushed before the table grows large."""
    def out():
        words = list(total)
        return batch_of(_COUNT, [w[:STEM] for w in words], words, [toxic[w] for w in words], [total[w] for w in words])
    toxic, total = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set(words_of(text))
            total.update(found)
            if label:
                toxic.update(found)
        if len(total) > 400_000:
            yield out()
            toxic, total = Counter(), Counter()
    yield out()


@dataclass
class ToxicityModel:
    """Weights by stem and word, the Gumbel law of clean texts and the logistic link."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    scale: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = -4.0

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        return self.stems.get(word[:STEM], -self.drift) if found is None else found

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal-scoring segments ``(first word, end, total)``, all disjoint, in linear time.

        Open segments lie on a stack; each knows the nearest one before it that starts lower, so
        the search for it skips what cannot be it. If none starts lower, all open ones are final.
        """
        stems, total, last = self.stems, 0.0, 0
        done: list[tuple[int, int, float, float, int]] = []
        stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest lower start
        for i, word in enumerate(words):
            if word[:STEM] not in stems:
                continue
            w = self.weight(word)
            total -= self.drift * (i - last)
            last = i + 1
            if w <= 0:
                total += w
                continue
            start, low, total = i, total, total + w
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            while j >= 0 and stack[j][3] < total:
                start, _, low, _, before = stack[j]
                del stack[j:]
                j = before
            if j < 0:
                done += stack
                stack.clear()
            stack.append((start, i + 1, low, total, j))
        return [(a, b, after - before) for a, b, before, after, _ in done + stack]

    def value(self, best: float, n: int) -> float:
        """Calibrated value of a best total among ``n`` words: minus the log of its expected count in clean text."""
        return self.scale * best - self.log_k - math.log(max(n, 1))

    def score(self, best: float, n: int) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * self.value(best, n) + self.intercept))))


def _weights(counts: DataFrame, n_toxic: int, n_total: int) -> tuple[dict[str, float], dict[str, float]]:
    """Significant stems, their words, and significant words, of at most ``LABELLED_ROWS`` ids; only these reach the driver."""
    rate = (n_toxic + 0.5) / (n_total + 1.0)
    base = math.log(rate / (1 - rate))

    def odds(df: DataFrame, prior, strength: float) -> DataFrame:
        t, n = F.col("toxic") + prior * strength, F.col("total") + F.lit(strength)
        return df.withColumn("w", F.log(t / (n - t)) - base).withColumn("z", F.col("w") / F.sqrt(1 / t + 1 / (n - t)))

    words = counts.groupBy("stem", "word").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    words = materialize(words, "toxicwords")
    stems = odds(words.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total")), F.lit(rate), STEM_PRIOR)
    stems = stems.withColumn("rate", (F.col("toxic") + rate * STEM_PRIOR) / (F.col("total") + STEM_PRIOR))
    joined = odds(words.join(stems.select("stem", "rate", F.col("w").alias("stem_w"), F.col("z").alias("stem_z")), "stem"), F.col("rate"), WORD_PRIOR)
    strong = joined.filter(((F.col("z") >= MIN_Z) & (F.col("w") > 1.0)) | ((F.col("stem_z") >= MIN_Z) & (F.col("stem_w") > 1.0) & (F.col("total") >= 3)))
    rows = strong.select("word", "w").collect()
    top = stems.filter((F.col("z") >= MIN_Z) & (F.col("w") > 1.0)).select("stem", "w").collect()
    found = {r["word"]: r["w"] for r in rows}
    # a stem of a strong word must be looked at, even if the stem alone says nothing
    return {w[:STEM]: -DRIFT for w in found} | {r["stem"]: r["w"] for r in top}, found


_BEST = pa.schema([("best", pa.float64()), ("n", pa.int64()), ("label", pa.int32())])


def taught_ids(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """``(id, label)`` of at most ``bound`` labelled ids, drawn by a hash; an id that is labelled both ways is 1."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) AND id IS NOT NULL")
    n = known.count()
    share = 1.0 if n <= bound else 0.95 * bound / n  # the limit then cuts nothing, but is sure
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return materialize(drawn.groupBy("id").agg(F.max("label").alias("label")).limit(bound), "taughtids")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
        bound: int = LABELLED_ROWS) -> ToxicityModel:
    """Learn from the documents of at most ``bound`` labelled ids; calibration uses a part of them.

    The ids are broadcast, so no text is shuffled: each task picks its labelled texts, and only
    counts of words travel. Null labels, ids or texts teach nothing, nor do labels other
    than 0 and 1. Without labelled rows of both kinds, the model knows no words and every
    text scores low.
    """
    known = taught_ids(labels, id_col, label_col, bound)
    rows = rows_of(docs, id=id_col, text=text_col).filter(F.col("text").isNotNull())
    taught = materialize(rows.join(F.broadcast(known), "id").select("id", "text", "label"), "taught")
    size = taught.agg(F.count("*").alias("n"), F.sum("label").alias("t")).first()
    if not size["t"] or size["t"] == size["n"]:
        return ToxicityModel()
    counts = taught.select("text", "label").mapInArrow(_count_words, "stem string, word string, toxic long, total long")
    model = ToxicityModel(*_weights(counts, size["t"], size["n"]))

    def best(batches):
        for batch in batches:
            found = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                found.append((max((s for _, _, s in model.segments(words)), default=0.0), len(words), label))
            yield batch_of(_BEST, *zip(*found)) if found else batch_of(_BEST, [], [], [])

    share = min(1.0, CALIBRATION_ROWS / size["n"])
    sample = taught.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "label")
    rows = sample.mapInArrow(best, "best double, n long, label int").limit(2 * CALIBRATION_ROWS).toPandas()
    return calibrated(model, rows["best"].to_numpy(float), rows["n"].to_numpy(float), rows["label"].to_numpy(int))


def calibrated(model: ToxicityModel, best: np.ndarray, n: np.ndarray, label: np.ndarray) -> ToxicityModel:
    """Fit the Gumbel law by moments on clean texts, then a logistic link on all; both with weak priors."""
    clean = best[label == 0]
    spread = max(float(clean.std()), 0.25) if len(clean) else 0.25
    model.scale = math.pi / (spread * math.sqrt(6))
    shift = model.scale * clean - np.log(np.maximum(n[label == 0], 1))
    model.log_k = float(np.mean(shift)) - 0.5772156649 if len(clean) else 0.0
    x = np.array([model.value(b, int(m)) for b, m in zip(best, n)])
    mean, deviation = float(x.mean()), max(float(x.std()), 1e-6)
    u = (x - mean) / deviation
    a, b = 1.0, float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((label - p) * u).sum() - 0.1 * a, (label - p).sum()])
        h = np.array([[(w * u * u).sum() + 0.1, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.intercept = a / deviation, b - a * mean / deviation
    return model


SEGMENT = "doc_id long, score double, value double, n_words long, segments array<struct<first:int,end:int,total:double>>"
_SEGMENT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("value", pa.float64()), ("n_words", pa.int64()), ("segments", pa.list_(
    pa.struct([("first", pa.int32()), ("end", pa.int32()), ("total", pa.float64())])))])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, value, n_words, segments)`` per row, scanning the whole text.

    ``segments`` are the significant passages, in words. Null and empty texts have none and
    get the score of a text without a finding. Repeated rows and null ids stay.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                found = model.segments(words)
                best = max((s for _, _, s in found), default=0.0)
                rows.append((doc, model.score(best, len(words)), model.value(best, len(words)), len(words),
                             [{"first": a, "end": b, "total": s} for a, b, s in found if model.value(s, len(words)) >= SIGNIFICANT]))
            if rows:
                yield batch_of(_SEGMENT, *zip(*rows))
    return rows_of(docs, doc_id=id_col, text=text_col).mapInArrow(run, SEGMENT)


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; null texts are kept."""
    def run(batches):
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index("__text")).to_pylist():
                words = words_of(text)
                keep.append(model.score(max((s for _, _, s in model.segments(words)), default=0.0), len(words)) < threshold)
            yield batch.select(docs_columns).filter(pa.array(keep, pa.bool_()))
    docs_columns = docs.columns
    return docs.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
