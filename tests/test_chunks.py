"""Chunks of lines that are packed where their tokens stand."""

import random

import pytest
from pyspark.sql import functions as F

from polysense.operators import chunks, gradients, loss, training
from polysense.plans import registry

COLUMNS = ["line_id", "pos", "word_id", "n_senses", "sense"]


@pytest.mark.parametrize("size,window,at_once", [(4, 2, 5), (4, 4, 1), (3, 5, 7), (16, 2, 1 << 16)])
def test_chunks_hold_the_tokens_and_neighbours_that_a_cut_gives(spark, monkeypatch, size, window, at_once):
    monkeypatch.setattr(chunks, "PACK_TOKENS", at_once)
    monkeypatch.setattr(chunks, "OPEN_TOKENS", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rng = random.Random(size)
        rows = [(line, pos, rng.randrange(9), 1 + pos % 3, pos % 2) for line in range(9) for pos in range(rng.choice([1, 2, 4, 8, 9, 33, 70]))]
        occ = spark.createDataFrame(rows, "line_id bigint, pos int, word_id int, n_senses int, sense int").coalesce(1).sortWithinPartitions("line_id", "pos")
        found = chunks.line_chunks(occ, window, size)
        assert sorted(map(tuple, chunks.chunk_tokens(found).select(COLUMNS).collect())) == sorted(rows)
        cut = training.window_chunks(occ, None, window, size, draw=lambda batches: batches)
        some = cut.filter("own").select("line_id", "chunk").distinct()  # a cut also names chunks that no token is at home in
        names = [*COLUMNS, "chunk", "own"]
        want = sorted(map(tuple, cut.join(some, ["line_id", "chunk"], "left_semi").select(names).collect()))
        assert sorted(map(tuple, chunks.chunk_tokens(found, halo=True).select(names).collect())) == want
        arrow = found.mapInArrow(chunks.opened, "line_id bigint, chunk int, pos int, word_id int, sense int, n_senses int, own boolean")
        assert sorted(map(tuple, arrow.select(names).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunks_are_opened_a_few_at_a_time(spark):
    rows = [(line, pos, 1, 1, 0) for line in range(50) for pos in range(700)]
    occ = spark.createDataFrame(rows, "line_id bigint, pos int, word_id int, n_senses int, sense int").coalesce(1).sortWithinPartitions("line_id", "pos")
    packed = chunks.line_chunks(occ, 2, 8192).toArrow().combine_chunks().to_batches()
    sizes = [b.num_rows for b in chunks.opened(packed)]
    assert sum(sizes) == 35_000 and max(sizes) <= chunks.OPEN_TOKENS and len(sizes) == 3


def test_lines_without_id_are_kept(spark):
    rows = [(None, 0, 1, 1, 0), (None, 1, 2, 1, 0), (7, 0, 3, 1, 0)]
    occ = spark.createDataFrame(rows, "line_id bigint, pos int, word_id int, n_senses int, sense int").coalesce(1)
    found = chunks.chunk_tokens(chunks.line_chunks(occ, 2, 8)).select(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)


def test_losses_and_gradients_of_a_corpus_move_no_token(spark, sf_dir):
    c = registry.check_corpus(spark, sf_dir)
    scored = c.scored()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for moved in (loss.centre_loss(scored), loss.candidate_sense_loss(c.windowed(), None, c.model, registry.CHECK.dim, registry.CHECK.window, draw=c.draw)):
        assert "Repartition" not in plan(moved)
    plain = loss.scored_pairs(c.drawable(), None, c.model, registry.CHECK.dim, registry.CHECK.window, draw=c.draw)
    for step in (lambda s: loss.sentence_loss(s), lambda s: gradients.batch_gradient_softmax(s, registry.CHECK.dim)):
        rounded = [{n: F.round(n, 9) if t == "double" else F.transform(n, lambda x: F.round(x, 6)) if t == "array<double>" else F.col(n)
                    for n, t in step(s).dtypes} for s in (scored, plain)]
        got, want = (sorted(map(repr, step(s).select(*[v.alias(n) for n, v in r.items()]).collect())) for s, r in zip((scored, plain), rounded))
        assert got == want


def test_what_tasks_hand_on_does_not_grow_with_the_corpus(spark, sf_dir, monkeypatch):
    c = registry.check_corpus(spark, sf_dir)
    scored = c.scored()
    many = spark.sparkContext.defaultParallelism
    scored = loss.scored_pairs(scored.rows.repartition(5 * many).localCheckpoint(), None, c.model, registry.CHECK.dim, registry.CHECK.window, draw=c.draw)
    found = training.per_block(scored.rows, training.held_model(c.model, registry.CHECK.dim), False, lambda g, state: None, "n int",
                               scored.tokens, scored.block, c.draw, finish=lambda state: iter(()))
    assert found.rdd.getNumPartitions() <= many
