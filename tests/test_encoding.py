"""A vocabulary beyond the head that still fits a broadcast."""

import random

import pytest

from polysense.operators import tokens


@pytest.fixture(scope="module")
def many(spark):
    n = tokens.HEAD_WORDS + 2000
    vocab = spark.range(n).selectExpr("concat('w', id) AS word", "int(id) AS word_id", "1 AS n_senses")
    rows = spark.range(500).selectExpr("id % 7 AS line_id", "int(id) AS raw_pos", f"concat('w', id * {n // 450}) AS word")
    return vocab.localCheckpoint(), rows


def test_tokens_are_made_once(many):
    vocab, rows = many
    plan = tokens.filter_vocab(rows, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Range") == 1


def test_whole_and_head_agree(many, monkeypatch):
    vocab, rows = many
    whole = sorted(tokens.filter_vocab(rows, vocab).collect())
    assert 440 < len(whole) < 500
    assert whole == sorted(tokens.filter_vocab(rows, vocab, head=1000).collect())
    monkeypatch.setattr(tokens, "VOCAB_BYTES", 1)
    assert whole == sorted(tokens.filter_vocab(rows, vocab).collect())


def _lines(spark, ids):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 30, 400]))) for _ in ids]
    return spark.createDataFrame(list(zip(ids, texts)), "line_id bigint, line string").repartition(5).localCheckpoint()


def _encoded(spark, lines):
    toks = tokens.tokenize(lines)
    vocab = spark.createDataFrame([(w, i, 1) for i, w in enumerate("abcdef")], "word string, word_id int, n_senses int")
    return tokens.filter_vocab(toks, vocab), tokens.filter_vocab(toks, vocab, lines=lines)


def test_lines_are_numbered_where_they_stand(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # lines go on in the next batch
    try:
        moved, stay = _encoded(spark, _lines(spark, list(range(300))))
        plan = stay._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and stay.schema.simpleString() == moved.schema.simpleString()
        assert sorted(stay.collect()) == sorted(moved.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_of_one_id_are_numbered_as_one(spark):
    moved, stay = _encoded(spark, _lines(spark, [i % 200 for i in range(300)]))
    places = lambda df: sorted(df.select("line_id", "pos").collect())
    assert places(stay) == places(moved) and len(set(places(stay))) == len(places(stay))
