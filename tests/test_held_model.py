"""Steps over a corpus whose tasks hold the model, against those that bring its rows to groups of tokens."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from polysense.config import TrainConfig
from polysense.functions import kernels
from polysense.operators import gradients, loss, noise, training

DIM, WINDOW = 4, 2
CFG = TrainConfig(dim=DIM, window=WINDOW, num_negative=3, chunk_tokens=16)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    n_senses = [rng.randint(1, 3) for _ in range(12)]
    occ = [(line, pos, w, rng.randrange(n_senses[w]), n_senses[w])
           for line, size in enumerate([1, 2, 7, 40, 15]) for pos in range(size) for w in [rng.randrange(12)]]
    model = [(t, w, s, [rng.uniform(-1, 1) for _ in range(DIM)]) for t in ("in", "out") for w in range(12) for s in range(n_senses[w])]
    vocab = spark.createDataFrame([(w, f"w{w}", 100 - w, n_senses[w]) for w in range(12)], "word_id int, word string, cn bigint, n_senses int")
    return (spark.createDataFrame(occ, "line_id bigint, pos int, word_id int, sense int, n_senses int").repartition(5).localCheckpoint(),
            spark.createDataFrame(model, "tbl string, word_id int, sense int, vec array<float>").localCheckpoint(), noise.noise_distribution(vocab))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df, digits=9):
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, digits)).alias(c) if t == "array<double>" else F.col(c)
               for c, t in df.dtypes]
    return sorted(map(repr, df.select(*rounded).collect()))


def _steps(occ, model, table):
    draw = noise.in_place(table, 3, 42)
    scored = loss.scored_pairs(occ, None, model, DIM, WINDOW, group_tokens=8, draw=draw)
    sample = training.grouped_sample(occ, None, 3, CFG, draw)
    return {"pairs": loss.pair_loss_softmax(scored), "lines": loss.sentence_loss(scored), "gradient": gradients.batch_gradient_sigmoid(scored, DIM),
            "candidates": loss.candidate_sense_loss(occ, None, model, DIM, WINDOW, draw=draw),
            "sync": loss.assign_senses_sync(occ, None, model, DIM, WINDOW, draw=draw),
            "senses": training.assign_senses(sample, model, CFG, with_loss=True, draw=draw),
            "learned": training.learn_shard(sample, model, 0.05, CFG, 3, draw)}


def test_held_model_gives_the_same_and_moves_no_model_rows(tables, monkeypatch):
    occ, model, table = tables
    held = _steps(occ, model, table)
    for name in ("pairs", "lines", "gradient", "candidates", "sync", "learned"):
        assert "Join" not in _plan(held[name]) and "CoGroup" not in _plan(held[name]), name
    got = {name: _rows(df) for name, df in held.items()}
    monkeypatch.setattr(training, "MODEL_BYTES", 0)
    brought = _steps(occ, model, table)
    assert "CoGroup" in _plan(brought["pairs"])
    assert got == {name: _rows(df) for name, df in brought.items()}


def test_draws_in_the_task_are_those_of_the_rows(tables):
    occ, model, table = tables
    drawn = noise.with_noise_words(occ, table, 3, 42)
    late = loss.scored_pairs(occ, None, model, DIM, WINDOW, group_tokens=8, draw=noise.in_place(table, 3, 42))
    early = loss.scored_pairs(drawn, None, model, DIM, WINDOW, group_tokens=8)
    assert _rows(loss.pair_loss_sigmoid(late)) == _rows(loss.pair_loss_sigmoid(early))


def test_blocks_end_between_chunks():
    import pyarrow as pa

    rows = [(0, 0)] * 3 + [(0, 1)] * 4 + [(1, 0)] * 9 + [(2, 0)]
    table = pa.table({"line_id": [a for a, _ in rows], "chunk": [b for _, b in rows]})
    blocks = [list(zip(*t.to_pydict().values())) for t in training._blocks(table.to_batches(max_chunksize=2), 4)]
    assert sum(blocks, []) == rows
    assert not any(set(a) & set(b) for i, a in enumerate(blocks) for b in blocks[i + 1 :])


def test_part_of_rows():
    import numpy as np

    rows = kernels.Rows(np.array([7, 3, 5]), np.array([[7.0], [3.0], [5.0]]))
    part = rows.part(np.array([5, 7, 5, 9]))
    assert part.code.tolist() == [5, 7] and part.vec.ravel().tolist() == [5.0, 7.0] and part.place.tolist() == [1, 2]
    with pytest.raises(KeyError):
        part.of(np.array([9]))


@pytest.mark.parametrize("softmax,lockstep,room", [(False, 1, None), (True, 1, None), (False, 4, None), (True, 4, 1), (False, 1, 1)])
def test_groups_side_by_side_learn_as_each_alone(tables, monkeypatch, softmax, lockstep, room):
    """Forty groups in eight tasks, all of a task at once or one at a time, against a task per group."""
    occ, model, table = tables
    more = occ.crossJoin(occ.sparkSession.range(12).select(F.col("id").alias("_i"))).withColumn("line_id", F.col("line_id") + 7 * F.col("_i")).drop("_i")
    cfg, draw = replace(CFG, softmax=softmax, lockstep=lockstep), noise.in_place(table, 3, 42)
    if room:
        monkeypatch.setattr(training, "SIDE_BYTES", room)
    sample = training.grouped_sample(more, None, 40, cfg, draw)
    beside = training.learn_shard(sample, model, 0.05, cfg, 40, draw)
    assert "FlatMapGroups" not in _plan(beside)
    got = _rows(beside)
    monkeypatch.setattr(training, "MODEL_BYTES", 0)
    assert got == _rows(training.learn_shard(sample, model, 0.05, cfg, 40, draw))
