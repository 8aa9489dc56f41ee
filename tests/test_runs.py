"""Runs that outlive their driver: one-step commits, recovery, and training that goes on."""

import pytest
from pyspark.sql import functions as F

from polysense.config import TrainConfig
from polysense.operators import training
from polysense.plans import registry
from polysense.plans.train import train
from polysense.sources import models, runs, store

CFG = TrainConfig(num_shards=2, num_epochs=2, min_count=40, num_negative=2, window=2, dim=4, sense_thresholds="60_120",
                  learn_rate=0.05, group_tokens=20_000, lockstep=16, save_every=2)


def test_a_name_is_taken_once(spark, tmp_path):
    assert store.write_text_once(spark, f"{tmp_path}/a/b.json", "ä") and not store.write_text_once(spark, f"{tmp_path}/a/b.json", "other")
    assert (tmp_path / "a" / "b.json").read_text() == "ä" and store.names_in(spark, f"{tmp_path}/a") == ["b.json"]
    for n in (3, 4):
        spark.range(n).write.parquet(f"{tmp_path}/part{n}")
    assert store.move_once(spark, f"{tmp_path}/part3", f"{tmp_path}/whole")
    assert not store.move_once(spark, f"{tmp_path}/part4", f"{tmp_path}/whole")  # nor into the folder
    assert spark.read.parquet(f"{tmp_path}/whole").count() == 3 and store.exists(spark, f"{tmp_path}/part4")
    assert store.names_in(spark, f"{tmp_path}/nothing") == []


def test_a_step_is_done_or_was_never_begun(spark, tmp_path):
    path = str(tmp_path / "run")
    run = runs.Run(spark, path, {"corpus": "x"})
    assert run.recover() is None
    run.put("a", spark.range(2))
    run.put("b", spark.range(5))
    run.commit({"next": 0})
    run.put("a", run.get("a").union(spark.range(1)))  # an unfinished step: its table is there, the manifest names the old one
    again = runs.Run(spark, path, {"corpus": "x"})
    assert again.recover() == {"next": 0} and again.get("a").count() == 2 and again.get("b").count() == 5
    assert len(store.names_in(spark, f"{path}/state")) == 2
    again.put("a", again.get("a").union(spark.range(4)))
    again.commit({"next": 1}, passing=("b",))
    assert len(store.names_in(spark, f"{path}/state")) == 1 and store.names_in(spark, f"{path}/steps") == ["1.json"]
    late = runs.Run(spark, path, {"corpus": "x"})
    late.step = 0
    with pytest.raises(RuntimeError, match="another driver"):
        late.commit({"next": 9})
    assert runs.Run(spark, path, {"corpus": "y"}).recover() is None
    assert store.names_in(spark, f"{path}/state") == [] == store.names_in(spark, f"{path}/steps")


def test_digest_tells_rows_apart_in_any_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    assert runs.digest(df, "k", "v") == runs.digest(df.orderBy(F.desc("k")).repartition(3), "k", "v")
    assert runs.digest(df, "k", "v") != runs.digest(df.distinct(), "k", "v")
    assert runs.digest(df.limit(0), "k", "v") == "0:0"


def facts_of(done):
    history = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in done.history.orderBy("it").collect()]
    vectors = {(r["tbl"], r["word_id"], r["sense"]): r["vec"] for r in done.model.collect()}
    return history, vectors


def test_training_goes_on_after_a_kill(spark, sf_dir, tmp_path, monkeypatch):
    lines = registry.check_corpus(spark, sf_dir).lines
    whole = facts_of(train(spark, lines, CFG, f"{tmp_path}/whole"))
    assert [r[0] for r in whole[0]] == list(range(4))
    learn, calls = training.learn_shard, []

    def killed(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return learn(*args, **kwargs)
    monkeypatch.setattr(training, "learn_shard", killed)
    with pytest.raises(KeyboardInterrupt):
        train(spark, lines, CFG, f"{tmp_path}/broken")
    path = f"{tmp_path}/broken/{CFG.run_name}"
    assert [r["it"] for r in models.load_history(spark, f"{path}/history").orderBy("it").collect()] == [0, 1]
    done = train(spark, lines, CFG, f"{tmp_path}/broken")
    assert len(calls) == 3 + 2  # iterations 2 and 3, none of the first two again
    history, vectors = facts_of(done)
    assert history == whole[0] and vectors.keys() == whole[1].keys()
    assert max(abs(a - b) for k, v in vectors.items() for a, b in zip(v, whole[1][k])) < 1e-6
    assert store.names_in(spark, f"{path}/state") == [] and store.names_in(spark, f"{path}/steps") == ["4.json"]
    assert facts_of(train(spark, lines, CFG, f"{tmp_path}/broken")) == (history, vectors) and len(calls) == 5  # read back
