"""Headline timings as one JSON line.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. Each query is computed in full and
written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from polysense.config import TrainConfig  # noqa: E402
from polysense.operators import gradients, loss, noise, pairs, similarity, splits, training, vectors  # noqa: E402
from polysense.plans.registry import EMBEDDING_DIM, embeddings  # noqa: E402
from polysense.plans.stages import Corpus  # noqa: E402
from polysense.sources.models import named_vectors  # noqa: E402
from polysense.sources.store import materialize  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# an everyday parameter set
CFG = TrainConfig(num_shards=10, min_count=10, num_negative=5, window=5, dim=50, sense_thresholds="20_30",
                  learn_rate=0.025, group_tokens=12_000, lockstep=128)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    facts: dict[str, float] = {}

    def timed(name: str, work):
        start = time.time()
        result = work()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        return result

    c = Corpus(spark, SF_DIR, CFG)
    timed("tokenize_word_count", lambda: run(c.word_counts))
    timed("build_vocab", lambda: c.vocab)
    occ = timed("encode_corpus", lambda: materialize(
        splits.training_shards(c.occurrences, CFG.num_shards, CFG.seed), "bench-occ", partition_by="shard"))
    words = occ.count()
    timed("noise_distribution", lambda: c.noise)
    timed("skipgram_pairs", lambda: run(pairs.skipgram_pairs(occ, CFG.window)))
    shard = occ.filter("shard = 0").drop("shard")
    shard_words = shard.count()
    timed("negative_samples", lambda: materialize(
        noise.negative_samples(shard, c.noise, CFG.num_negative, CFG.seed), "bench-neg"))
    drawn = timed("noise_words_packed", lambda: materialize(
        noise.with_noise_words(shard, c.noise, CFG.num_negative, CFG.seed), "bench-drawn"))
    timed("init_model", lambda: c.model)
    scored = loss.scored_pairs(drawn, None, c.model, CFG.dim, CFG.window)
    timed("shard_loss_relational", lambda: run(loss.sentence_loss(scored)))
    timed("shard_gradient_relational", lambda: run(gradients.batch_gradient_sigmoid(scored, CFG.dim)))
    groups = max(1, -(-shard_words // CFG.group_tokens))
    sample = timed("group_sample", lambda: materialize(training.grouped_sample(drawn, None, groups, CFG), "bench-sample"))
    one = replace(CFG, one_sense=True)
    timed("shard_loss_grouped", lambda: run(training.assign_senses(sample, c.model, one, with_loss=True, groups=groups)))
    timed("shard_gradient_grouped", lambda: run(training.batch_gradient_by_group(sample, c.model, CFG, groups)))
    timed("assign_senses_shard", lambda: run(training.assign_senses(sample, c.model, CFG, groups=groups)))
    timed("learn_shard", lambda: run(training.learn_shard(sample, c.model, CFG.learn_rate, CFG, groups)))
    timed("learn_shard_sequential", lambda: run(training.learn_shard(sample, c.model, CFG.learn_rate, replace(CFG, lockstep=1), groups)))
    words_table = named_vectors(c.model, c.vocab).cache()
    queries = words_table.filter(F.col("sense") == 1)
    timed("synonyms_batch_top10", lambda: run(similarity.find_synonyms_batch(queries, words_table, 10)))
    emb = embeddings(spark, SF_DIR)
    timed("embedding_neighbours_top10", lambda: run(vectors.nearest_by_cosine(emb, emb, "vec_id", 10)))
    timed("second_moment_matrix", lambda: run(vectors.second_moment_matrix(emb, EMBEDDING_DIM)))
    facts["corpus_tokens"], facts["shard_tokens"] = words, shard_words
    facts["learn_words_per_sec"] = round(shard_words / times["learn_shard"], 1)
    facts["learn_words_per_sec_sequential"] = round(shard_words / times["learn_shard_sequential"], 1)
    facts["assign_words_per_sec"] = round(shard_words / times["assign_senses_shard"], 1)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "facts": facts}))
    spark.stop()


if __name__ == "__main__":
    main()
