"""The training loop over shards and epochs."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.config import TrainConfig
from polysense.operators import model as models
from polysense.operators import noise, senses, splits, tokens, training, vocabulary
from polysense.operators.chunks import chunk_tokens, is_chunked, line_chunks
from polysense.sources import models as store
from polysense.sources.runs import Run, digest
from polysense.sources.store import Versions

VALIDATION = -1  # shard number of the held-out lines


@dataclass
class Trained:
    vocab: DataFrame
    model: DataFrame
    history: DataFrame
    path: str


def learning_rate(cfg: TrainConfig, words_seen: int, total_words: int) -> float:
    """Linear decay over the training words, never below a 10,000th."""
    share = words_seen / total_words if total_words else 0.0
    return max(cfg.learn_rate * (1.0 - share), cfg.learn_rate * 1e-4)


def encode_corpus(lines: DataFrame, vocab: DataFrame, cfg: TrainConfig) -> DataFrame:
    """Chunks of lines with start senses and ``shard``; held-out lines have shard -1."""
    occ = splits.init_senses(tokens.filter_vocab(tokens.tokenize(lines), vocab, lines=lines), cfg.seed)
    occ = line_chunks(occ, cfg.window, training.GROUP_TOKENS)
    ratio = splits.effective_ratio(lines, cfg.validation_ratio, cfg.max_validation_lines)
    occ = splits.is_validation(splits.training_shards(occ, cfg.num_shards, cfg.seed), ratio, cfg.seed)
    if cfg.validation_is_subset:
        both = F.when(F.col("held_out"), F.array(F.col("shard"), F.lit(VALIDATION))).otherwise(F.array("shard"))
        return occ.withColumn("shard", F.explode(both)).drop("held_out")
    return occ.withColumn("shard", F.when(F.col("held_out"), VALIDATION).otherwise(F.col("shard"))).drop("held_out")


def num_groups(words: int, cfg: TrainConfig) -> int:
    return max(1, math.ceil(words / cfg.group_tokens))


def validate(
    sample: DataFrame, model: DataFrame, cfg: TrainConfig, tables: Versions, groups: int, draw: Callable | None = None
) -> tuple[float | None, float | None]:
    """Loss per prediction and changed passes per line of the held-out lines, whose noise
    words stay fixed and whose senses go on from the last validation."""
    scored = tables.put("validated", training.assign_senses(sample, model, cfg, with_loss=True, groups=groups, draw=draw))
    row = scored.agg(F.sum("loss"), F.sum("n"), F.sum("passes"), F.count_if(F.col("pos") == 0)).first()
    return (row[0] / row[1] if row[1] else None), (row[2] / row[3] if row[3] else None)


def with_senses(sample: DataFrame, scored: DataFrame) -> DataFrame:
    """The chunks or tokens of the sample with the tokens' newest senses."""
    if is_chunked(sample):
        places = F.transform("word_id", lambda _, i: F.col("start") + i)
        found = sample.select("line_id", "chunk", F.posexplode(places).alias("_i", "pos")).join(scored.select("line_id", "pos", "sense"), ["line_id", "pos"])
        newest = found.groupBy("line_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("_i", "sense"))).alias("_new"))
        joined = sample.join(newest, ["line_id", "chunk"])
        return joined.withColumn("sense", F.transform("_new", lambda x: x["sense"])).select(*sample.columns)
    newest = scored.select("line_id", "pos", F.col("sense").alias("_new"))
    joined = sample.join(newest, ["line_id", "pos"], "left")
    return joined.withColumn("sense", F.coalesce("_new", "sense")).select(*sample.columns)


#: between the seeds of two iterations' resets, far above the distance of the seeds of one
RESET_STRIDE = 1_000_003


#: tables that are made anew in each iteration
PASSING = ("assign-sample", "learn-sample", "learned", "validated")


def _identity(lines: DataFrame, cfg: TrainConfig, one_sense: DataFrame | None, iterations: int) -> dict:
    """What must be equal for a run to be the same run: corpus, start vectors, parameters, length."""
    start = None if one_sense is None else digest(one_sense, "tbl", "word", "sense", "vec")
    return {"corpus": digest(lines, "line_id", "line"), "start": start, "config": repr(cfg), "iterations": iterations, "tables": "chunks"}


def _prepare(run: Run, lines: DataFrame, cfg: TrainConfig, one_sense: DataFrame | None) -> dict:
    """The tables a run starts from, and the tokens of each shard."""
    vocab = run.put("vocab", vocabulary.build_vocab(vocabulary.word_count(tokens.tokenize(lines)), cfg.min_count, cfg.thresholds))
    noise_table = run.put("noise", noise.noise_distribution(vocab))
    occ = run.put("occurrences", encode_corpus(lines, vocab, cfg), partition_by="shard")
    sizes = {r["shard"]: r["n"] for r in occ.groupBy("shard").agg(F.sum("own").alias("n")).collect()}  # one row per shard
    start = models.init_random(vocab, cfg.dim, cfg.seed) if one_sense is None else models.warm_start(
        one_sense, vocab, cfg.dim, cfg.seed, cfg.sense_init_sd)
    run.put("model", start)
    run.put("stats", senses.uniform_sense_probs(vocab))
    if sizes.get(VALIDATION):
        rows, draw = occ.filter(F.col("shard") == VALIDATION).drop("shard"), noise.in_place(noise_table, cfg.num_negative, cfg.seed)
        rows = rows if draw else noise.with_noise_words(chunk_tokens(rows), noise_table, cfg.num_negative, cfg.seed)
        run.put("held-out", training.grouped_sample(rows, None, num_groups(sizes[VALIDATION], cfg), cfg, draw))
    return {"sizes": sorted(sizes.items()), "next": 0, "words_seen": 0}


def _iterate(run: Run, cfg: TrainConfig, facts: dict, iterations: int) -> tuple:
    """One iteration on the run's tables; returns its row of the history."""
    it, sizes = facts["next"], dict(map(tuple, facts["sizes"]))
    shard, last = it % cfg.num_shards, it == iterations - 1
    groups = num_groups(sizes.get(shard, 0), cfg)
    total_words = sum(n for s, n in sizes.items() if s >= 0) * cfg.num_epochs
    vocab, noise_table, model, stats = (run.get(name) for name in ("vocab", "noise", "model", "stats"))
    mine = f"shard-{shard}"

    def rows() -> DataFrame:
        """The shard's chunks with the senses of its last turn, or of the start."""
        return run.get(mine) if mine in run.paths else run.get("occurrences").filter(F.col("shard") == shard).drop("shard")

    def sample(turn: int, name: str) -> tuple[DataFrame, Callable | None]:
        """The shard's groups, and how their noise words are drawn in the tasks; where those cannot, words are written with the tokens."""
        draw = noise.in_place(noise_table, cfg.num_negative, cfg.seed, turn)
        if draw:
            return training.grouped_sample(rows(), None, groups, cfg, draw), draw
        drawn = noise.with_noise_words(chunk_tokens(rows()), noise_table, cfg.num_negative, cfg.seed, turn)
        return run.put(name, training.grouped_sample(drawn, None, groups, cfg)), None

    resets = 0
    if not cfg.one_sense:
        tokens_of, draw = sample(2 * it + 1, "assign-sample")
        run.put(mine, training.assign_senses(tokens_of, model, cfg, groups=groups, draw=draw, as_chunks=True))
        counts = senses.sense_counts(chunk_tokens(rows()), vocab)
        updated = senses.normalize_probs(senses.update_sense_probs(stats, counts, cfg.decay))
        stats = run.put("stats", updated.select("word_id", "sense", "cnt", "prob"))
        reset = senses.reset_low_prob_senses(model, stats, cfg.sense_prob_floor, cfg.dim, cfg.seed + RESET_STRIDE * (it + 1), cfg.sense_init_sd)
        model = run.put("model", reset)
        resets = model.filter("was_reset AND tbl = 'in'").count()
    alpha = learning_rate(cfg, facts["words_seen"], total_words)
    tokens_of, draw = sample(2 * it + 2, "learn-sample")
    learned = run.put("learned", training.learn_shard(tokens_of, model, alpha, cfg, groups, draw, summed=True))
    done = learned.filter("tbl = 'group'").agg(F.count("*"), F.sum("loss"), F.sum("n"), F.sum("words")).first()
    deltas = learned.filter("tbl <> 'group'").select("tbl", "word_id", "sense", "delta")
    averaged = models.average_models(model, deltas, done[0] or 0)
    model = run.put("model", models.limit_norm(averaged, cfg.max_sq_norm, cfg.dim))
    limited = model.filter("limited").count()
    facts["words_seen"] += done[3] or 0

    vali_loss = vali_adjust = None
    if "held-out" in run.paths and (it % cfg.validate_every == 0 or last):
        held_out, fixed = run.get("held-out"), noise.in_place(noise_table, cfg.num_negative, cfg.seed)
        vali_loss, vali_adjust = validate(held_out, model, cfg, run, num_groups(sizes[VALIDATION], cfg), fixed)
        if not cfg.one_sense:
            run.put("held-out", with_senses(held_out, run.get("validated")))
    train_loss = done[1] / done[2] if done[2] else None
    return it, it // cfg.num_shards, shard, vali_loss, vali_adjust, train_loss, alpha, done[3] or 0, limited, resets


def train(spark: SparkSession, lines: DataFrame, cfg: TrainConfig, out_dir: str,
          one_sense: DataFrame | None = None, iterations: int | None = None, resume: bool = True) -> Trained:
    """Learn vectors for all word senses; ``one_sense`` ``(tbl, word, sense, vec)`` warm-starts.

    Each iteration is committed whole. With ``resume``, a run of the same corpus, start
    vectors, parameters and length goes on after its last committed iteration, and a complete
    one is read back; any other run of that name, or one without ``resume``, starts over.
    """
    path = f"{out_dir}/{cfg.run_name}"
    iterations = cfg.iterations if iterations is None else iterations
    run = Run(spark, path, _identity(lines, cfg, one_sense, iterations))
    facts = run.recover() if resume else run.clear()
    if facts is None:
        facts = _prepare(run, lines, cfg, one_sense)
        run.commit(facts)
    while facts["next"] < iterations:
        row = _iterate(run, cfg, facts, iterations)
        it, last = row[0], row[0] == iterations - 1
        store.write_history(spark, f"{path}/history", row)
        if last or (it > 0 and it % cfg.snapshot_every == 0):
            store.save_model(run.get("model"), run.get("vocab"), f"{path}/it={it}")
        facts["next"] += 1
        run.commit(facts, tuple(run.paths) if last else PASSING)
    final = f"{path}/it={iterations - 1}"
    return Trained(store.load_vocab(spark, final), store.load_model(spark, final),
                   store.load_history(spark, f"{path}/history"), path)
