"""Steps compiled in the JVM against their numpy forms."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from polysense.config import TrainConfig
from polysense.functions import compiled
from polysense.operators import noise, training
from polysense.operators.chunks import chunk_tokens, line_chunks

DIM, WINDOW = 5, 2
CFG = TrainConfig(dim=DIM, window=WINDOW, num_negative=3, chunk_tokens=64)


@pytest.fixture(scope="module")
def tables(spark):
    """Lines of one token and of several chunks; frequent words, so that rows repeat in a visit."""
    rng = random.Random(7)
    n_senses = [rng.randint(1, 3) for _ in range(9)]
    occ = [(line * ((1 << 31) + 3), pos, w, n_senses[w], rng.randrange(n_senses[w]))
           for line, size in enumerate([1, 2, 7, 45, 15, 33, 20] * 3) for pos in range(size) for w in [rng.randrange(9)]]
    model = [(t, w, s, [rng.uniform(-1, 1) for _ in range(DIM)]) for t in ("in", "out") for w in range(9) for s in range(n_senses[w])]
    vocab = spark.createDataFrame([(w, f"w{w}", 100 - w, n_senses[w]) for w in range(9)], "word_id int, word string, cn bigint, n_senses int")
    tokens = spark.createDataFrame(occ, "line_id bigint, pos int, word_id int, n_senses int, sense int").coalesce(1).sortWithinPartitions("line_id", "pos")
    chunks = line_chunks(tokens, WINDOW, 10).localCheckpoint()
    # chunks of a line do not stand together
    return (chunks.repartition(5).localCheckpoint(), spark.createDataFrame(model, "tbl string, word_id int, sense int, vec array<float>").localCheckpoint(),
            noise.noise_distribution(vocab))


def _rows(df, digits=5):
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, digits) + 0.0).alias(c) if t == "array<double>" else F.col(c)
               for c, t in df.dtypes]
    return sorted(map(repr, df.select(*rounded).collect()))


def _close(got, want):
    """Rows with the same keys and the same numbers up to the rounding of single precision."""
    keys = lambda r: (r["tbl"], r["word_id"], r["sense"])
    groups = lambda rows: sorted((r["loss"], r["n"], r["words"]) for r in rows if r["tbl"] == "group")
    for a, b in zip(groups(got), groups(want), strict=True):
        assert a == pytest.approx(b, rel=1e-5)
    got, want = (sorted((keys(r), r["delta"]) for r in rows if r["tbl"] != "group") for rows in (got, want))
    assert [k for k, _ in got] == [k for k, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6)


@pytest.mark.parametrize("softmax,one_sense", [(False, False), (True, False), (False, True)])
def test_senses(tables, softmax, one_sense):
    rows, model, table = tables
    cfg, draw = replace(CFG, softmax=softmax, one_sense=one_sense), noise.in_place(table, 3, 42)
    sample = training.grouped_sample(rows, None, 3, cfg, draw)
    found = training.assign_senses(sample, model, cfg, with_loss=True, draw=draw)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapPartitions" in plan and "Arrow" not in plan
    want = training.assign_senses(training._tokens(sample), model, cfg, with_loss=True, draw=draw)
    assert _rows(found) == _rows(want)
    # the same senses as chunks, also in what a chunk repeats of its neighbours
    packed = training.assign_senses(sample, model, cfg, draw=draw, as_chunks=True)
    sense = {(r["line_id"], r["pos"]): r["sense"] for r in found.collect()}
    halo = chunk_tokens(packed, halo=True).collect()
    assert len(halo) > len(sense) and all(sense[r["line_id"], r["pos"]] == r["sense"] for r in halo)
    assert _rows(chunk_tokens(packed).select("line_id", "pos", "word_id", "n_senses", "sense")) == _rows(found.select("line_id", "pos", "word_id", "n_senses", "sense"))


def test_lines_that_no_task_takes_whole(tables, monkeypatch):
    rows, model, table = tables
    draw = noise.in_place(table, 3, 42)
    want = _rows(training.assign_senses(rows, model, CFG, with_loss=True, draw=draw))
    packed = _rows(training.assign_senses(rows, model, CFG, draw=draw, as_chunks=True).select("line_id", "chunk", "lead"))
    monkeypatch.setattr(training, "LINE_TOKENS", 20)
    monkeypatch.setattr(training, "GROUP_TOKENS", 10)
    assert _rows(training.assign_senses(rows, model, replace(CFG, chunk_tokens=16), with_loss=True, draw=draw)) == want
    assert _rows(training.assign_senses(rows, model, replace(CFG, chunk_tokens=16), draw=draw, as_chunks=True).select("line_id", "chunk", "lead")) == packed


@pytest.mark.parametrize("softmax,lockstep", [(False, 1), (True, 1), (False, 4), (True, 4)])
def test_descent(tables, softmax, lockstep):
    rows, model, table = tables
    cfg, draw = replace(CFG, softmax=softmax, lockstep=lockstep), noise.in_place(table, 3, 42)
    sample = training.grouped_sample(rows, None, 4, cfg, draw)
    found = training.learn_shard(sample, model, 0.05, cfg, 4, draw)
    assert "MapPartitions" in found._jdf.queryExecution().optimizedPlan().toString()
    want = training.learn_shard(training._tokens(sample), model, 0.05, cfg, 4, draw).collect()
    _close(found.collect(), want)
    summed = training.learn_shard(sample, model, 0.05, cfg, 4, draw, summed=True).collect()
    total = {}
    for r in [r for r in want if r["tbl"] != "group"]:
        total.setdefault((r["tbl"], r["word_id"], r["sense"]), [0.0] * DIM)
        total[r["tbl"], r["word_id"], r["sense"]] = [a + b for a, b in zip(total[r["tbl"], r["word_id"], r["sense"]], r["delta"])]
    got = {}
    for r in [r for r in summed if r["tbl"] != "group"]:
        key = r["tbl"], r["word_id"], r["sense"]
        got[key] = [a + b for a, b in zip(got.get(key, [0.0] * DIM), r["delta"])]
    assert got.keys() == total.keys() and all(got[k] == pytest.approx(total[k], abs=1e-5) for k in got)
    assert sorted(r["n"] for r in summed if r["tbl"] == "group") == sorted(r["n"] for r in want if r["tbl"] == "group")


def test_without_the_compiler_numpy_runs(tables, monkeypatch):
    rows, model, table = tables
    draw = noise.in_place(table, 3, 42)
    sample = training.grouped_sample(rows, None, 4, CFG, draw)
    want = training.learn_shard(sample, model, 0.05, CFG, 4, draw).collect()
    senses = _rows(training.assign_senses(sample, model, CFG, draw=draw))
    monkeypatch.setattr(compiled, "_loader", lambda spark: None)
    found = training.learn_shard(sample, model, 0.05, CFG, 4, draw)
    assert "MapPartitions" not in found._jdf.queryExecution().optimizedPlan().toString()
    _close(found.collect(), want)
    assert _rows(training.assign_senses(sample, model, CFG, draw=draw)) == senses
