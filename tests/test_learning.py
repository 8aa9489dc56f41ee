"""Loss, gradients, senses and descent against plain numpy on small data."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polysense.config import TrainConfig
from polysense.functions import kernels, vecsum
from polysense.operators import gradients, loss, model as models, pairs, senses, training

CFG = TrainConfig(dim=4, window=2, num_negative=2, sense_thresholds="2_3", max_passes=10)
V, SENSES = 12, [3, 2, 2, 1, 1, 2, 1, 1, 3, 1, 1, 1]


def world(spark, seed=0, lines=6, length=9):
    rng = np.random.default_rng(seed)
    occ, neg = [], []
    for line in range(lines):
        for pos in range(length):
            w = int(rng.integers(V))
            occ.append((line, pos, w, SENSES[w], int(rng.integers(SENSES[w]))))
            for k in range(CFG.num_negative):
                n = int(rng.integers(V))
                neg.append((line, pos, k, n, int(rng.integers(SENSES[n]))))
    vec = {(t, w, s): rng.normal(size=CFG.dim).astype(np.float32) for t in ("in", "out") for w in range(V) for s in range(SENSES[w])}
    return (
        spark.createDataFrame(occ, "line_id bigint, pos int, word_id int, n_senses int, sense int"),
        spark.createDataFrame(neg, "line_id bigint, pos int, k int, neg_word_id int, neg_sense int"),
        spark.createDataFrame([(*k, v.tolist()) for k, v in vec.items()], "tbl string, word_id int, sense int, vec array<float>"),
        occ, neg, vec,
    )


def sigma(x):
    if x > 6:
        i = 99999
    else:
        i = 0 if x < -6 else int((x + 6) * 8333.0)
    t = (2 * i / 100000 - 1) * 6
    return np.exp(t) / (np.exp(t) + 1)


def centre_loss(vec, line, noise, pos, word, sense, softmax=False):
    u, total = vec["in", word, sense].astype(float), 0.0
    for p in range(max(0, pos - CFG.window), min(len(line), pos + CFG.window + 1)):
        if p == pos:
            continue
        x = u @ vec["out", line[p][0], line[p][1]].astype(float)
        ys = [u @ vec["out", w, s].astype(float) for w, s in noise[p]]
        if softmax:
            total += np.log(np.exp(x) + np.exp(ys).sum()) - x
        else:
            total += -np.log(sigma(x)) - sum(np.log(1 - sigma(y)) for y in ys)
    return total


def as_lines(occ, neg):
    lines, noise = {}, {}
    for line, _, w, _, s in occ:
        lines.setdefault(line, []).append((w, s))
    for line, pos, _, w, s in neg:
        noise.setdefault(line, {}).setdefault(pos, []).append((w, s))
    return lines, noise


@pytest.mark.parametrize("softmax", [False, True])
def test_sentence_loss(spark, softmax):
    occ, neg, model, o, n, vec = world(spark)
    lines, noise = as_lines(o, n)
    got = {r["line_id"]: r["loss"] for r in loss.sentence_loss(loss.scored_pairs(occ, neg, model, 4, 2), softmax).collect()}
    for line, toks in lines.items():
        want = sum(centre_loss(vec, toks, noise[line], p, w, s, softmax) for p, (w, s) in enumerate(toks))
        assert got[line] == pytest.approx(want, abs=1e-6)


def test_loss_without_negatives(spark):
    occ, _, model, o, n, vec = world(spark)
    lines, _ = as_lines(o, n)
    empty = {line: {p: [] for p in range(len(t))} for line, t in lines.items()}
    total = loss.loss_summary(loss.sentence_loss(loss.scored_pairs(occ, None, model, 4, 2))).first()
    want = sum(centre_loss(vec, t, empty[i], p, w, s) for i, t in lines.items() for p, (w, s) in enumerate(t))
    assert total["loss"] == pytest.approx(want, abs=1e-6)


def test_loss_summary_of_nothing(spark):
    none = spark.createDataFrame([], "line_id bigint, loss double, n bigint")
    row = loss.loss_summary(none).first()
    assert (row["loss"], row["n"], row["loss_per_prediction"]) == (0.0, 0, None)


@pytest.mark.parametrize("length,window,count", [(4, 1, 6), (4, 5, 12), (1, 3, 0)])
def test_pair_counts(spark, length, window, count):
    occ = spark.createDataFrame([(0, p, p, 1, 0) for p in range(length)], "line_id bigint, pos int, word_id int, n_senses int, sense int")
    got = pairs.skipgram_pairs(occ, window).collect()
    assert len(got) == count and all(0 < abs(r["pos"] - r["ctx_pos"]) <= window for r in got)
    assert all(r["word_id"] == r["pos"] and r["ctx_word_id"] == r["ctx_pos"] for r in got)


@pytest.mark.parametrize("softmax", [False, True])
def test_gradient_by_finite_differences(spark, softmax):
    occ, neg, model, *_ , vec = world(spark, lines=2, length=5)
    scored = loss.scored_pairs(occ, neg, model, 4, 2)
    grad = gradients.batch_gradient_softmax(scored, 4) if softmax else gradients.batch_gradient_sigmoid(scored, 4)
    rows = {(r["tbl"], r["word_id"], r["sense"]): r["grad"] for r in grad.collect()}

    def total(key, i, h):
        moved = {k: v.astype(float) for k, v in vec.items()}
        moved[key] = moved[key].copy()
        moved[key][i] += h
        df = spark.createDataFrame([(*k, v.tolist()) for k, v in moved.items()], "tbl string, word_id int, sense int, vec array<double>")
        s = loss.scored_pairs(occ, neg, df, 4, 2)
        each = loss.pair_loss_softmax(s) if softmax else loss.pair_loss_sigmoid(s, exact=True)
        return each.agg(F.sum("loss")).first()[0]

    for key in [next(k for k in rows if k[0] == "in"), next(k for k in rows if k[0] == "out")]:
        slope = (total(key, 1, 1e-4) - total(key, 1, -1e-4)) / 2e-4
        assert rows[key][1] == pytest.approx(slope, abs=1e-5)


def sequential_senses(vec, toks, noise, softmax, passes=10, free=None):
    toks, changing = list(toks), 0
    for _ in range(passes):
        before = list(toks)
        for pos, (w, _) in enumerate(toks):
            if SENSES[w] > 1 and (free is None or pos in free):
                costs = [centre_loss(vec, toks, noise, pos, w, s, softmax) for s in range(SENSES[w])]
                toks[pos] = (w, int(np.argmin(costs)))
        if toks == before:
            break
        changing += 1
    return toks, changing


@pytest.mark.parametrize("softmax", [False, True])
def test_sequential_assignment_matches_brute_force(spark, softmax):
    occ, neg, model, o, n, vec = world(spark, seed=3, lines=12)
    cfg = replace(CFG, softmax=softmax)
    sample = training.grouped_sample(occ, neg, 3, cfg)
    rows = training.assign_senses(sample, model, cfg, with_loss=True).collect()
    got = {(r["line_id"], r["pos"]): (r["word_id"], r["sense"]) for r in rows}
    passes = {r["line_id"]: r["passes"] for r in rows if r["pos"] == 0}
    losses = {(r["line_id"], r["pos"]): r["loss"] for r in rows}
    lines, noise = as_lines(o, n)
    for line, toks in lines.items():
        want, changing = sequential_senses(vec, toks, noise[line], softmax)
        assert [got[line, p] for p in range(len(toks))] == want
        assert passes[line] == changing
        for p, (w, s) in enumerate(want):
            assert losses[line, p] == pytest.approx(centre_loss(vec, want, noise[line], p, w, s, softmax), abs=1e-6)


@pytest.mark.parametrize("softmax,size", [(False, 3), (True, 2), (False, 7)])
def test_chunks_of_long_lines_match_brute_force(spark, softmax, size):
    """Chunks hardly longer than the window, so that changes run through many of them; short lines beside."""
    occ, neg, model, o, n, vec = world(spark, seed=8, lines=5, length=24)
    cfg = replace(CFG, softmax=softmax, chunk_tokens=size, group_tokens=30, max_passes=4)
    cut = occ.filter("line_id < 3 OR pos < 2")
    noise_rows = neg.filter("line_id < 3 OR pos < 2")
    rows = training.assign_senses(training.grouped_sample(cut, noise_rows, 3, cfg), model, cfg, with_loss=True).collect()
    got = {(r["line_id"], r["pos"]): r for r in rows}
    lines, noise = as_lines([x for x in o if x[0] < 3 or x[1] < 2], [x for x in n if x[0] < 3 or x[1] < 2])
    assert len(rows) == sum(map(len, lines.values()))
    for line, toks in lines.items():
        want, changing = sequential_senses(vec, toks, noise[line], softmax, passes=4)
        assert [(got[line, p]["word_id"], got[line, p]["sense"]) for p in range(len(toks))] == want
        assert [got[line, p]["passes"] for p in range(len(toks))] == [changing] + [0] * (len(toks) - 1)
        for p, (w, s) in enumerate(want):
            assert got[line, p]["loss"] == pytest.approx(centre_loss(vec, want, noise[line], p, w, s, softmax), abs=1e-6)


def test_a_line_of_100_000_tokens_in_20_chunks(spark):
    rng = np.random.default_rng(21)
    n, words = 100_000, 400
    model_rows = [(t, w, s, rng.normal(size=4).tolist()) for t in ("in", "out") for w in range(words) for s in range(3)]
    model = spark.createDataFrame(model_rows, "tbl string, word_id int, sense int, vec array<float>").cache()
    word, sense = rng.integers(0, words, n), rng.integers(0, 3, n)
    place = np.arange(n) % 5_000  # words with several senses: around all cuts, and here and there
    several = (place < 25) | (place >= 4_975) | (place % 50 < 3)
    occ = spark.createDataFrame(pd.DataFrame({"line_id": 1, "pos": np.arange(n, dtype=np.int32), "word_id": word.astype(np.int32),
                                              "n_senses": np.where(several, 3, 1).astype(np.int32), "sense": sense.astype(np.int32)}))
    neg = occ.select("line_id", "pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "line_id", "pos", "k", f"cast((pos * 7919L + k * 104729) % {words} AS int) AS neg_word_id", "cast((pos + k) % 3 AS int) AS neg_sense")
    found = []
    for size in (1_000_000, 5_000):
        cfg = replace(CFG, chunk_tokens=size)
        found.append(training.assign_senses(training.grouped_sample(occ, neg, 1, cfg), model, cfg).toPandas().sort_values("pos", ignore_index=True))
    whole, cut = found
    assert (whole["sense"] == cut["sense"]).all() and (whole["passes"] == cut["passes"]).all() and whole["passes"][0] > 2
    assert (whole["sense"].to_numpy() != sense)[several].mean() > 0.3


def test_converged_senses_do_not_move_again(spark):
    occ, neg, model, *_ = world(spark, seed=4)
    first = training.assign_senses(training.grouped_sample(occ, neg, 2, CFG), model, CFG)
    again = training.assign_senses(training.grouped_sample(first.drop("passes", "loss", "n"), neg, 2, CFG), model, CFG)
    settled = [r["line_id"] for r in first.filter("pos = 0 AND passes < 10").collect()]
    assert settled and again.filter(F.col("line_id").isin(settled)).agg(F.sum("passes")).first()[0] == 0


def test_synchronous_pass_equals_sequential_with_one_ambiguous_token(spark):
    occ, neg, model, *_ = world(spark, seed=5)
    occ = occ.withColumn("n_senses", F.when(F.col("pos") == 4, F.col("n_senses")).otherwise(1))
    sync = loss.assign_senses_sync(occ, neg, model, 4, 2).select("line_id", "pos", "sense").collect()
    seq = training.assign_senses(training.grouped_sample(occ, neg, 2, CFG), model, CFG).select("line_id", "pos", "sense").collect()
    assert sorted(map(tuple, sync)) == sorted(map(tuple, seq))


def descend(vec, lines, noise, alpha, softmax):
    """Strictly sequential descent, row by row."""
    vec = {k: v.astype(np.float64) for k, v in vec.items()}
    for line in sorted(lines):
        toks = lines[line]
        for pos, (w, s) in enumerate(toks):
            for p in range(max(0, pos - CFG.window), min(len(toks), pos + CFG.window + 1)):
                if p == pos:
                    continue
                u, keys = vec["in", w, s].copy(), [("out", *toks[p])] + [("out", *x) for x in noise[line][p]]
                if not softmax:  # each item in order: a word drawn twice has moved when it is scored again
                    change = np.zeros_like(u)
                    for i, k in enumerate(keys):
                        g = (i == 0) - sigma(u @ vec[k])
                        change += g * vec[k]
                        vec[k] = vec[k] + alpha * g * u
                    vec["in", w, s] = u + alpha * change
                    continue
                x = np.array([u @ vec[k] for k in keys])
                pull = -np.exp(x) / np.exp(x).sum()
                pull[0] += 1
                change = sum(g * vec[k] for g, k in zip(pull, keys))
                for g, k in zip(pull, keys):
                    vec[k] = vec[k] + alpha * g * u
                vec["in", w, s] = u + alpha * change
    return vec


@pytest.mark.parametrize("softmax", [False, True])
def test_descent_matches_brute_force(spark, softmax):
    occ, neg, model, o, n, vec = world(spark, seed=6)
    cfg = replace(CFG, softmax=softmax)
    learned = training.learn_shard(training.grouped_sample(occ, neg, 1, cfg), model, 0.05, cfg)
    got = models.average_models(model, learned.filter("tbl <> 'group'").select("tbl", "word_id", "sense", "delta"), 1)
    want = descend(vec, *as_lines(o, n), 0.05, softmax)
    for r in got.collect():
        assert np.allclose(r["vec"], want[r["tbl"], r["word_id"], r["sense"]], atol=2e-5)
    info = learned.filter("tbl = 'group'").first()
    assert info["words"] == len(o) and info["loss"] > 0


def test_one_visit_moves_against_the_gradient(spark):
    occ, neg, model, *_ = world(spark, lines=1, length=2)
    neg = spark.createDataFrame([(0, 0, 0, 10, 0), (0, 0, 1, 11, 0), (0, 1, 0, 10, 0), (0, 1, 1, 11, 0)], neg.schema)
    occ = spark.createDataFrame([(0, 0, 3, 1, 0), (0, 1, 4, 1, 0)], occ.schema)
    sample = training.grouped_sample(occ, neg, 1, CFG).withColumn("own", F.col("pos") == 0)
    moved = {(r["tbl"], r["word_id"]): r["delta"] for r in training.learn_shard(sample, model, 0.01, CFG).collect()}
    scored = loss.scored_pairs(occ.withColumn("own", F.col("pos") == 0), neg, model, 4, 2)
    for r in gradients.batch_gradient_sigmoid(scored, 4, exact=False).collect():
        assert np.allclose(moved[r["tbl"], r["word_id"]], -0.01 * np.array(r["grad"]), atol=1e-6)


def test_lockstep_keeps_the_predictions_and_lowers_the_loss(spark):
    occ, neg, model, *_ = world(spark, seed=8, lines=20)
    sample = training.grouped_sample(occ, neg, 1, CFG)
    info = {}
    for lockstep in (1, 8):
        cfg = replace(CFG, lockstep=lockstep)
        learned = training.learn_shard(sample, model, 0.02, cfg)
        after = models.average_models(model, learned.filter("tbl <> 'group'"), 1)
        info[lockstep] = learned.filter("tbl = 'group'").first()["n"]
        before = loss.loss_summary(loss.sentence_loss(loss.scored_pairs(occ, neg, model, 4, 2))).first()["loss"]
        now = loss.loss_summary(loss.sentence_loss(loss.scored_pairs(occ, neg, after, 4, 2))).first()["loss"]
        assert now < before
    assert info[1] == info[8]


def test_long_lines_stay_whole(spark):
    occ, neg, model, o, n, vec = world(spark, seed=9, lines=1, length=9000)
    free = {p for p in range(9000) if p % 50 == 0 or 8185 <= p <= 8200}
    is_free = (F.col("pos") % 50 == 0) | F.col("pos").between(8185, 8200)
    occ = occ.withColumn("n_senses", F.when(is_free, F.col("n_senses")).otherwise(1))
    rows = training.assign_senses(training.grouped_sample(occ, neg, 3, CFG), model, CFG).collect()
    lines, noise = as_lines(o, n)
    want, changing = sequential_senses(vec, lines[0], noise[0], False, free=free)
    got = {r["pos"]: (r["word_id"], r["sense"]) for r in rows}
    assert [got[p] for p in range(9000)] == want and max(r["passes"] for r in rows) == changing


@pytest.mark.parametrize("dim,size", [(8, 1 << 20), (8, 700), (300, 30_000)])
def test_vector_sums_of_any_dimension(spark, monkeypatch, dim, size):
    monkeypatch.setattr(vecsum, "TABLE_BYTES", size)  # tasks hand their sums on many times
    rng = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else f"k{min(i % 40, 20)}", i % 3, None if i % 50 == 0 else rng.normal(size=dim).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b int, v array<float>").repartition(6)
    want = {}
    for a, b, v in rows:
        if v is not None:
            n, total = want.get((a, b), (0, 0))
            want[a, b] = n + 1, total + np.array(v, np.float32).astype(float)
    found = vecsum.vector_sums(df, ["a", "b"], "v").collect()
    assert {(r["a"], r["b"]): r["n"] for r in found} == {k: n for k, (n, _) in want.items()} and len(found) == len(want)
    assert all(np.allclose(r["v"], want[r["a"], r["b"]][1]) for r in found)
    whole = vecsum.vector_sums(df, [], "v").collect()
    assert len(whole) == 1 and whole[0]["n"] == 588 and np.allclose(whole[0]["v"], sum(t for _, t in want.values()))
    assert vecsum.vector_sums(df.limit(0), ["a"], "v").count() == 0


def test_turns_of_repeated_rows():
    assert [t.tolist() for t in kernels.turns(np.array([4, 2, 4, 4, 2, 1]))] == [[0, 1, 5], [2, 4], [3]]


def test_sigmoid_bins_at_the_edges():
    assert list(kernels.bins(np.array([-7.0, -6.0, 0.0, 6.0, 6.00001, 50.0]))) == [0, 0, 49998, 99996, 99999, 99999]


def test_norm_limit(spark):
    df = spark.createDataFrame([("in", 0, 0, [2.0, 0.0]), ("in", 1, 0, [3.0, 0.0])], "tbl string, word_id int, sense int, vec array<float>")
    rows = {r["word_id"]: r for r in models.limit_norm(df, 4.0, 2).collect()}
    assert not rows[0]["limited"] and rows[0]["vec"] == [2.0, 0.0]
    assert rows[1]["limited"] and rows[1]["vec"][0] ** 2 == pytest.approx(3.96, abs=1e-5)


def test_sense_probability_update(spark):
    stats = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5)], "word_id int, sense int, prob double")
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 0, 0), (1, 1, 0)], "word_id int, sense int, cnt bigint")
    got = {(r["word_id"], r["sense"]): r["prob"] for r in senses.update_sense_probs(stats, counts).collect()}
    f = 0.99**4
    assert got[0, 0] == pytest.approx(0.5 * f + 0.75 * (1 - f)) and got[1, 0] == 0.5
    with pytest.raises(ValueError):
        senses.update_sense_probs(stats, counts, 0.4)


def test_reset_copies_the_donor(spark):
    stats = spark.createDataFrame([(0, 0, 0.99), (0, 1, 0.01), (1, 0, 0.0), (1, 1, 0.0), (2, 0, 0.001)], "word_id int, sense int, prob double")
    stats = stats.withColumn("prob", F.when(F.col("word_id") == 1, 0.5).otherwise(F.col("prob")))
    vec = [(t, w, s, [float(w), float(s)]) for t in ("in", "out") for w, s in ((0, 0), (0, 1), (1, 0), (1, 1), (2, 0))]
    model = spark.createDataFrame(vec, "tbl string, word_id int, sense int, vec array<float>")
    rows = senses.reset_low_prob_senses(model, stats, 0.02, 2, 1).collect()
    reset = [r for r in rows if r["was_reset"]]
    assert {(r["tbl"], r["word_id"], r["sense"]) for r in reset} == {("in", 0, 1), ("out", 0, 1)}
    assert all(np.allclose(r["vec"], [0.0, 0.0], atol=0.0026) and any(r["vec"]) for r in reset)
    assert senses.reset_summary(stats, 0.02).first()[:] == (4, 1)


def test_without_able_donors_the_likeliest_sense_gives(spark):
    stats = spark.createDataFrame([(0, s, p) for s, p in enumerate([0.3, 0.4, 0.3])], "word_id int, sense int, prob double")
    got = {r["sense"]: r["donor"] for r in senses.sense_donors(stats, 0.9, 1).collect()}
    assert got[0] == 1 and got[2] == 1


def test_warm_start(spark):
    vocab = spark.createDataFrame([(0, "a", 9, 2), (1, "b", 5, 1)], "word_id int, word string, cn bigint, n_senses int")
    stored = spark.createDataFrame(
        [(t, "a", s, [float(s + 1)] * 2) for t in ("in", "out") for s in (0, 1)] + [("in", "zz", 0, [1.0, 1.0]), ("in", "b", 5, [1.0])],
        "tbl string, word string, sense int, vec array<float>")
    got = {(r["tbl"], r["word_id"], r["sense"]): r["vec"] for r in models.warm_start(stored, vocab, 2, 1).collect()}
    assert len(got) == 6 and got["in", 0, 1] == [2.0, 2.0] and got["in", 1, 0] == [0.0, 0.0]
    assert np.allclose(got["in", 0, 0], [1.0, 1.0], atol=0.0026) and got["in", 0, 0] != [1.0, 1.0]
    assert models.warm_start_problems(stored, vocab, 2).first().asDict() == {"unknown_word": 1, "sense_out_of_range": 1, "wrong_length": 1}


def test_model_diff(spark):
    schema = "tbl string, word_id int, sense int, vec array<float>"
    a = spark.createDataFrame([("in", 0, 0, [1.0, 2.0]), ("in", 1, 0, [0.0, 0.0])], schema)
    b = spark.createDataFrame([("in", 0, 0, [1.0, 2.5])], schema)
    assert models.model_diff(a, a).first()["different"] == 0
    assert models.model_diff(a, b).first().asDict() == {"rows_a": 2, "rows_b": 1, "unmatched": 1, "different": 1, "max_diff": 0.5}

