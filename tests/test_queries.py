"""Similarity queries, vector jobs, the model store, the training loop and the registry."""

import os
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from polysense.plans import oracle, registry
from polysense.config import TrainConfig
from polysense.operators import similarity, vectors
from polysense.plans import registry
from polysense.plans.train import learning_rate, train
from polysense.sources import models, store
from tools.check import compare

WORDS = "word string, sense int, vec array<float>"


def table(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def test_synonyms_drop_the_best_hit_and_ignore_zero_vectors(spark):
    df = table(spark, [("a", 0, [1.0, 0.0]), ("b", 0, [2.0, 0.2]), ("c", 0, [0.0, 1.0]), ("z", 0, [0.0, 0.0])])
    got = [(r["word"], round(r["score"], 4)) for r in similarity.find_synonyms_vector(df, [2.0, 0.0], 5).collect()]
    assert got == [("b", 1.9901), ("c", 0.0)]
    with pytest.raises(ValueError):
        similarity.find_synonyms_vector(df, [1.0, 0.0], 0)
    with pytest.raises(KeyError):
        similarity.lookup_vector(df, "nope")


@pytest.mark.parametrize("block_rows", [7, 10_000])
def test_batch_synonyms_match_brute_force_with_many_copies(spark, monkeypatch, block_rows):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(1)
    rows = [(f"w{i:02d}", i % 2, (rng.normal(size=3) if i % 3 else np.array([1.0, 2.0, 3.0])).tolist()) for i in range(40)]
    df = table(spark, rows)
    got = {}
    for r in similarity.find_synonyms_batch(df, df, 4).collect():
        got.setdefault((r["q_word"], r["q_sense"]), {})[r["rank"]] = (r["word"], r["sense"])
    mat = np.array([r[2] for r in rows], dtype=np.float32).astype(float)
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    for i, r in enumerate(rows):
        score = np.round(mat[i] @ unit.T, 9)
        order = sorted(range(len(rows)), key=lambda j: (-score[j], rows[j][0], rows[j][1]))[1:5]
        assert [got[r[0], r[1]][k + 1] for k in range(4)] == [(rows[j][0], rows[j][1]) for j in order]


def test_cosine_neighbours_leave_out_the_row_itself(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id bigint, vec array<float>")
    got = {(r["q_vec_id"], r["vec_id"]): r["score"] for r in vectors.nearest_by_cosine(df, df, "vec_id", 3).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (3, 1): 0.0, (3, 2): 0.0}


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id bigint, vec array<float>")
    got = {r["vec_id"]: r["vec"] for r in vectors.l2_normalize(df, 2).collect()}
    assert got[1] == [0.0, 0.0] and np.allclose(got[2], [0.6, 0.8])
    pair = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "vec_a array<float>, vec_b array<float>")
    row = vectors.pair_metrics(pair, 2).first()
    assert (row["cosine"], row["angle"], row["between"]) == (0.0, -1.0, [0.5, 0.0])


def test_affinities_sum_to_one(spark):
    edges = spark.createDataFrame([(1, 1, 9.0), (1, 2, 3.0), (2, 1, 1.0), (2, 3, 4.0)], "i bigint, j bigint, p double")
    got = {(r["i"], r["j"]): r["p"] for r in vectors.affinity_normalize(edges).collect()}
    assert got == {(1, 2): 0.25, (2, 1): 0.25, (2, 3): 0.25, (3, 2): 0.25}


def test_text_export_round_trip(spark, tmp_path):
    df = table(spark, [("don't", 0, [0.1, -2.5e-7]), ("ß", 1, [3.0, 4.0])])
    models.save_vectors_text(df, str(tmp_path / "v"))
    key = lambda d: sorted((r["word"], r["sense"], tuple(r["vec"])) for r in d.collect())
    assert key(models.load_vectors_text(spark, str(tmp_path / "v"))) == key(df)


def test_word2vec_text_is_one_file_with_a_header(spark, tmp_path):
    df = table(spark, [("don't", 1, [9.0, 9.0]), ("don't", 0, [0.1, -2.5e-7]), ("ß", 1, [3.0, 4.0])])
    models.save_word2vec_text(df, str(tmp_path / "v"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    assert lines[0] == "2 2" and sorted(x.split()[0] for x in lines[1:]) == ["don't", "ß"]
    got = {r["word"]: r["vec"] for r in models.load_word2vec_text(spark, str(tmp_path / "v")).collect()}
    assert got["ß"] == [3.0, 4.0] and np.allclose(got["don't"], [0.1, -2.5e-7])


def test_saved_runs_become_warm_starts(spark, tmp_path):
    vocab = spark.createDataFrame([(0, "a", 9, 1), (1, "b_2", 5, 1)], "word_id int, word string, cn bigint, n_senses int")
    vectors_ = [("in", 0, 0, [1.0]), ("in", 1, 0, [2.0]), ("out", 1, 0, [3.0])]
    models.save_model(spark.createDataFrame(vectors_, "tbl string, word_id int, sense int, vec array<float>"), vocab, str(tmp_path / "m"))
    stored = {(r["tbl"], r["word"], r["sense"]): r["vec"] for r in models.stored_vectors(spark, str(tmp_path / "m")).collect()}
    assert stored == {("in", "a", 0): [1.0], ("in", "b_2", 0): [2.0], ("out", "b_2", 0): [3.0]}
    models.index_lines(vocab).write.text(str(tmp_path / "i"))
    index = models.load_word_index(spark, str(tmp_path / "i")).collect()
    assert sorted(tuple(r) for r in index) == [("a", 0, 1), ("b_2", 1, 1)]


def test_superseded_versions_are_deleted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "scratch_root", lambda _: str(tmp_path))
    versions = store.Versions(spark)
    first = versions.put("t", spark.range(3))
    second = versions.put("t", first.withColumn("id", F.col("id") + 1))
    assert len(os.listdir(tmp_path / "polysense")) == 1
    assert sorted(r["id"] for r in second.collect()) == [1, 2, 3]
    versions.drop_all()
    assert os.listdir(tmp_path / "polysense") == []


def test_scratch_root_is_the_session_folder(spark):
    wanted = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert wanted is None or store.scratch_root(spark) == wanted


def test_learning_rate_decays_to_its_floor():
    cfg = TrainConfig(learn_rate=0.1)
    assert learning_rate(cfg, 0, 100) == 0.1 and learning_rate(cfg, 50, 100) == pytest.approx(0.05)
    assert learning_rate(cfg, 100, 100) == pytest.approx(1e-5)


def test_training_lowers_the_held_out_loss_and_warm_starts(spark, sf_dir, tmp_path):
    lines = registry.check_corpus(spark, sf_dir).lines
    cfg = TrainConfig(num_shards=2, num_epochs=1, min_count=30, num_negative=3, window=2, dim=8, learn_rate=0.1,
                      one_sense=True, validate_every=1, group_tokens=8000, lockstep=16, save_every=1)
    one = train(spark, lines, cfg, str(tmp_path))
    history = [r.asDict() for r in one.history.orderBy("it").collect()]
    assert [h["shard"] for h in history] == [0, 1] and history[0]["lr"] > history[1]["lr"]
    stored = models.stored_vectors(spark, f"{one.path}/it=1")
    many = train(spark, lines, replace(cfg, one_sense=False, sense_thresholds="60_120", validation_is_subset=True),
                 str(tmp_path), one_sense=stored)
    later = [r.asDict() for r in many.history.orderBy("it").collect()]
    # an untrained model scores ln 2 per prediction
    assert later[1]["vali_loss"] < history[1]["vali_loss"] < 0.6931
    assert many.model.filter("sense > 0").count() > 0 and later[0]["vali_adjust"] > 0


def test_every_query_has_its_twin_or_is_sequential():
    sequential = {"assign_senses", "learn_shard_sigmoid", "learn_shard_softmax", "train_history", "train_vectors"}
    assert set(registry.registered()) - set(oracle.statements()) == sequential
    assert set(registry.registered()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["text_lines", "corpus_summary", "count_spectrum_thinned", "build_vocab", "negative_samples",
                                  "sentence_loss", "assign_senses_sync", "reset_low_prob_senses", "gradient_step",
                                  "warm_start", "find_synonyms", "affinity_normalize", "word_index_round_trip",
                                  "word2vec_text_round_trip"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0]["mean_loss"] >= rows[-1]["mean_loss"]
