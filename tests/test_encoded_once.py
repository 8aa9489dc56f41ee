"""Queries that need few tokens, or only their counts, do not write the encoded corpus."""

import pytest

from polysense.operators import senses, splits
from polysense.plans import registry


@pytest.fixture
def corpus(spark, sf_dir, monkeypatch):
    c = registry.check_corpus(spark, sf_dir)
    monkeypatch.setattr(registry, "check_corpus", lambda *_: c)
    return c


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def test_only_held_out_lines_are_encoded(corpus, spark, sf_dir):
    found = [registry.registered()[name](spark, sf_dir).first() for name in ("validation_loss", "validation_loss_by_group")]
    assert "chunks" not in vars(corpus)
    held = splits.train_validation_split(corpus.lines, registry.RATIO, registry.MAX_LINES, registry.CHECK.seed).filter("part = 'validation'")
    want = corpus.occurrences.join(held.select("line_id"), "line_id", "left_semi")
    assert _rows(registry._held_out(corpus)) == _rows(want)
    assert found[0]["n"] == found[1]["n"] > 0 and found[0]["loss"] == pytest.approx(found[1]["loss"], abs=2e-3)


def test_senses_are_counted_once_as_tokens_are_made(corpus, spark, sf_dir):
    stats = registry._sense_stats(corpus)
    done = registry.registered()["reset_low_prob_senses"](spark, sf_dir)
    assert "chunks" not in vars(corpus)
    for df in (stats, done):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()  # no text is read again
    counts = senses.sense_counts(corpus.occurrences, corpus.vocab)
    assert _rows(stats.select("word_id", "sense", "cnt")) == _rows(counts)
