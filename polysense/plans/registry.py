"""The registered queries: every operator over whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.config import TrainConfig
from polysense.functions.vecmath import dot, scaled
from polysense.operators import (
    gradients,
    loss,
    model,
    noise,
    pairs,
    senses,
    similarity,
    splits,
    tokens,
    training,
    vectors,
    vocabulary,
)
from polysense.plans.stages import Corpus, hardest_words
from polysense.plans.train import num_groups, train
from polysense.sources import corpus as source, models
from polysense.sources.store import materialize, scratch_path

# start vectors in +-1, so that losses differ far above rounding noise
CHECK = TrainConfig(min_count=20, num_negative=2, window=2, dim=8, sense_thresholds="100_400")
CHECK_SD = (16.0, 16.0)
RUN = replace(CHECK, num_shards=2, num_epochs=1, validate_every=1, lockstep=32)
EMBEDDING_DIM = 64
RATIO, MAX_LINES, SHARDS, FLOOR, STEP = 0.1, 500, 4, 0.33, 0.001
TOP_K, LIMIT_SQ, LIMIT_LEN, MIX = 5, 3.0, 0.9, 0.25
SYNONYM_WORD = "the"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _register(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def check_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(spark, sf_dir, CHECK, CHECK_SD)


def long_vectors(df: DataFrame, keys: list[str], vec: str = "vec", digits: int = 6) -> DataFrame:
    """One row per component, for comparing."""
    rows = df.select(*keys, F.posexplode_outer(vec).alias("dim", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), digits))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source.read_table(spark, sf_dir, "embeddings")
    return df.select("vec_id", "label", F.col("embedding").alias("vec"))


# ---- corpus and vocabulary


@_register
def corpus_lines(spark, sf_dir):
    return check_corpus(spark, sf_dir).lines


@_register
def text_lines(spark, sf_dir):
    """The documents written as text files and read back as lines."""
    path = scratch_path(spark, "text")
    source.read_table(spark, sf_dir, "documents").select("text").write.text(path)
    lines = source.text_lines(spark, path)
    return lines.groupBy("line").agg(F.count("*").alias("n_lines"), F.count_distinct("line_id").alias("n_ids"))


@_register
def corpus_summary(spark, sf_dir):
    return source.corpus_summary(check_corpus(spark, sf_dir).lines)


@_register
def first_lines(spark, sf_dir):
    return source.first_lines(check_corpus(spark, sf_dir).lines)


@_register
def tokenize(spark, sf_dir):
    return check_corpus(spark, sf_dir).tokens


@_register
def word_count(spark, sf_dir):
    return check_corpus(spark, sf_dir).word_counts


@_register
def min_count(spark, sf_dir):
    return vocabulary.min_count(check_corpus(spark, sf_dir).word_counts, CHECK.min_count)


@_register
def count_spectrum(spark, sf_dir):
    return vocabulary.count_spectrum(check_corpus(spark, sf_dir).word_counts)


@_register
def count_spectrum_thinned(spark, sf_dir):
    return vocabulary.count_spectrum_thinned(check_corpus(spark, sf_dir).word_counts)


@_register
def corpus_totals(spark, sf_dir):
    return vocabulary.corpus_totals(check_corpus(spark, sf_dir).word_counts, CHECK.min_count)


@_register
def build_vocab(spark, sf_dir):
    return check_corpus(spark, sf_dir).vocab.drop("n_senses")


@_register
def senses_per_word(spark, sf_dir):
    return check_corpus(spark, sf_dir).vocab.select("word", "cn", "n_senses")


@_register
def sense_histogram(spark, sf_dir):
    return vocabulary.sense_histogram(check_corpus(spark, sf_dir).vocab, CHECK.max_senses)


@_register
def param_count(spark, sf_dir):
    return vocabulary.param_count(check_corpus(spark, sf_dir).vocab, CHECK.dim)


@_register
def filter_vocab(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    return tokens.filter_vocab(c.tokens, c.vocab, lines=c.lines)


@_register
def encode_decode_ws(spark, sf_dir):
    occ = check_corpus(spark, sf_dir).occurrences
    coded = occ.groupBy(tokens.encode_ws(F.col("word_id"), F.col("sense")).alias("ws")).agg(F.count("*").alias("n"))
    word, sense = tokens.decode_ws(F.col("ws"))
    return coded.select("ws", word.alias("word_id"), sense.alias("sense"), "n")


# ---- splits, senses, noise


@_register
def train_validation_split(spark, sf_dir):
    lines = check_corpus(spark, sf_dir).lines
    return splits.train_validation_split(lines, RATIO, MAX_LINES, CHECK.seed).drop("line")


@_register
def validation_subset(spark, sf_dir):
    return splits.validation_subset(check_corpus(spark, sf_dir).lines, RATIO, MAX_LINES, CHECK.seed)


@_register
def training_shards(spark, sf_dir):
    return splits.training_shards(check_corpus(spark, sf_dir).lines, SHARDS, CHECK.seed).drop("line")


@_register
def init_senses(spark, sf_dir):
    return check_corpus(spark, sf_dir).occurrences


@_register
def noise_distribution(spark, sf_dir):
    return check_corpus(spark, sf_dir).noise.drop("width")


@_register
def negative_samples(spark, sf_dir):
    return check_corpus(spark, sf_dir).negatives()


@_register
def weighted_choice(spark, sf_dir):
    """One line per document, drawn by its length."""
    docs = check_corpus(spark, sf_dir).docs
    items = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    weighted = items.select("doc_id", "line_no", F.length("line").cast("bigint").alias("weight"))
    return noise.weighted_choice(weighted, ["doc_id"], "line_no", "weight", CHECK.seed)


# ---- pairs and loss


@_register
def skipgram_pairs(spark, sf_dir):
    """Counts by centre, context and side. A pair and its mirror image are counted in one group of the earlier and the later word."""
    found = pairs.skipgram_pairs(check_corpus(spark, sf_dir).chunks, CHECK.window)
    after = F.col("ctx_pos") > F.col("pos")
    place = F.col("line_id") % 1000003 + F.col("pos")
    centre, ctx = tokens.encode_ws(F.col("word_id"), F.col("sense")), tokens.encode_ws(F.col("ctx_word_id"), F.col("ctx_sense"))
    keyed = found.select(F.when(after, centre).otherwise(ctx).alias("a"), F.when(after, ctx).otherwise(centre).alias("b"), after.alias("_after"), place.alias("_place"))
    # a pair has one mirror image, so one count serves both sides; codes and few sums keep the rows of the shuffle narrow
    sums = [F.sum(F.when(on, F.col("_place"))).alias(f"sum_{side}") for side, on in (("after", F.col("_after")), ("before", ~F.col("_after")))]
    both = keyed.groupBy("a", "b").agg(F.count_if(F.col("_after")).alias("n"), *sums)

    def row(centre: str, ctx: str, side: str):
        names = [("word_id", "sense"), ("ctx_word_id", "ctx_sense")]
        parts = [x.alias(n) for code, pair in zip((centre, ctx), names) for x, n in zip(tokens.decode_ws(F.col(code)), pair)]
        return F.struct(*parts, F.lit(side).alias("side"), F.col("n"), F.col(f"sum_{side}").alias("check_sum"))

    return both.select(F.explode(F.array(row("a", "b", "after"), row("b", "a", "before"))).alias("_r")).select("_r.*")


@_register
def pair_vectors(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    found = pairs.pair_vectors(pairs.skipgram_pairs(c.occurrences, CHECK.window), c.model, CHECK.dim)
    total = F.sum(dot(F.col("in_vec"), F.col("out_vec"), CHECK.dim))
    return found.groupBy("word_id", "sense").agg(F.count("*").alias("n"), F.round(total, 4).alias("sum_dot"))


def _by_word(losses: DataFrame) -> DataFrame:
    return losses.groupBy("word_id", "sense").agg(
        F.count("*").alias("n_pairs"), F.sum("n").alias("n"), F.round(F.sum("loss"), 4).alias("loss"),
        F.round(F.max("loss"), 6).alias("max_loss"),
    )


@_register
def pair_loss_sigmoid(spark, sf_dir):
    return _by_word(loss.pair_loss_sigmoid(check_corpus(spark, sf_dir).scored()))


@_register
def pair_loss_softmax(spark, sf_dir):
    return _by_word(loss.pair_loss_softmax(check_corpus(spark, sf_dir).scored()))


@_register
def sentence_loss(spark, sf_dir):
    found = loss.sentence_loss(check_corpus(spark, sf_dir).scored())
    return found.withColumn("loss", F.round("loss", 6))


@_register
def loss_summary(spark, sf_dir):
    found = loss.loss_summary(loss.sentence_loss(check_corpus(spark, sf_dir).scored()))
    return found.withColumn("loss", F.round("loss", 3)).withColumn(
        "loss_per_prediction", F.round("loss_per_prediction", 6)
    )


def _held_out(c: Corpus) -> DataFrame:
    """Tokens of the held-out lines. Lines and tokens are written, so the corpus is split once and only they are encoded."""
    held = splits.train_validation_split(c.lines, RATIO, MAX_LINES, CHECK.seed)
    held = materialize(held.filter(F.col("part") == "validation").drop("part"), "held-out-lines")
    return materialize(c.encoded(held), "held-out")


@_register
def validation_loss(spark, sf_dir):
    """Loss of the held-out lines with their fixed noise words."""
    c = check_corpus(spark, sf_dir)
    occ = _held_out(c)
    found = loss.loss_summary(loss.sentence_loss(c.scored(occ)))
    return found.withColumn("loss", F.round("loss", 3)).withColumn(
        "loss_per_prediction", F.round("loss_per_prediction", 6)
    )


@_register
def validation_loss_by_group(spark, sf_dir):
    """The same loss from the grouped tasks that validation in training uses."""
    c = check_corpus(spark, sf_dir)
    occ = _held_out(c)
    one = replace(CHECK, one_sense=True)
    groups = num_groups(occ.count(), CHECK)
    sample = training.grouped_sample(c.drawable(occ), None, groups, one, c.draw)
    found = training.assign_senses(sample, c.model, one, with_loss=True, groups=groups, draw=c.draw).filter(F.col("n") > 0)
    by_line = found.groupBy("line_id").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    return loss.loss_summary(by_line).withColumn("loss", F.round("loss", 3)).withColumn(
        "loss_per_prediction", F.round("loss_per_prediction", 6)
    )


@_register
def candidate_sense_loss(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    found = loss.candidate_sense_loss(c.windowed(), None, c.model, CHECK.dim, CHECK.window, draw=c.draw)
    return found.withColumn("loss", F.round("loss", 6))


def _assigned(c: Corpus) -> DataFrame:
    return loss.assign_senses_sync(c.windowed(), None, c.model, CHECK.dim, CHECK.window, draw=c.draw)


@_register
def assign_senses_sync(spark, sf_dir):
    return _assigned(check_corpus(spark, sf_dir))


@_register
def adjust_rate(spark, sf_dir):
    found = loss.adjust_rate(_assigned(check_corpus(spark, sf_dir)))
    return found.withColumn("rate", F.round("rate", 6))


def _sample(c: Corpus, cfg: TrainConfig = CHECK) -> tuple[DataFrame, int]:
    """The corpus dealt to groups of about ``group_tokens``, as chunks where tasks draw, and their number."""
    groups = num_groups(c.size, cfg)
    return training.grouped_sample(c.windowed(), None, groups, cfg, c.draw), groups


@_register
def assign_senses(spark, sf_dir):
    """The sequential assignment; it has no SQL form."""
    c = check_corpus(spark, sf_dir)
    sample, groups = _sample(c)
    return training.assign_senses(sample, c.model, CHECK, groups=groups, draw=c.draw).drop("loss", "n")


# ---- sense statistics


@_register
def assign_senses_single(spark, sf_dir):
    """Sequential assignment of lines in which only the first ambiguous token may change."""
    c = check_corpus(spark, sf_dir)
    first = c.occurrences.filter("n_senses > 1").groupBy("line_id").agg(F.min("pos").alias("_first"))
    free = c.drawable().join(first, "line_id", "left")
    free = free.withColumn("n_senses", F.when(F.col("pos") == F.col("_first"), F.col("n_senses")).otherwise(1)).drop("_first")
    groups = num_groups(c.occurrences.count(), CHECK)
    sample = materialize(training.grouped_sample(free, None, groups, CHECK, c.draw), "sample")
    return training.assign_senses(sample, c.model, CHECK, groups=groups, draw=c.draw).select("line_id", "pos", "word_id", "sense")


@_register
def sense_counts(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    return senses.sense_counts(c.occurrences, c.vocab)


def _sense_stats(c: Corpus) -> DataFrame:
    # counted once, as the tokens are made; several steps read the counts
    counts = materialize(senses.sense_counts(c.encoded(c.lines), c.vocab), "sense-counts")
    return senses.update_sense_probs(senses.uniform_sense_probs(c.vocab), counts, CHECK.decay)


@_register
def update_sense_probs(spark, sf_dir):
    return _sense_stats(check_corpus(spark, sf_dir)).withColumn("prob", F.round("prob", 6))


@_register
def sense_donors(spark, sf_dir):
    return senses.sense_donors(_sense_stats(check_corpus(spark, sf_dir)), FLOOR, CHECK.seed)


@_register
def reset_low_prob_senses(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    done = senses.reset_low_prob_senses(c.model, _sense_stats(c), FLOOR, CHECK.dim, CHECK.seed)
    return long_vectors(done, ["tbl", "word_id", "sense", "was_reset"])


@_register
def reset_summary(spark, sf_dir):
    return senses.reset_summary(_sense_stats(check_corpus(spark, sf_dir)), FLOOR)


# ---- gradients and models


@_register
def batch_gradient_sigmoid(spark, sf_dir):
    grad = gradients.batch_gradient_sigmoid(check_corpus(spark, sf_dir).scored(), CHECK.dim)
    return long_vectors(grad, ["tbl", "word_id", "sense"], "grad", 4)


@_register
def batch_gradient_sigmoid_table(spark, sf_dir):
    grad = gradients.batch_gradient_sigmoid(check_corpus(spark, sf_dir).scored(), CHECK.dim, exact=False)
    return long_vectors(grad, ["tbl", "word_id", "sense"], "grad", 4)


@_register
def batch_gradient_softmax(spark, sf_dir):
    grad = gradients.batch_gradient_softmax(check_corpus(spark, sf_dir).scored(), CHECK.dim)
    return long_vectors(grad, ["tbl", "word_id", "sense"], "grad", 4)


def _by_group(spark, sf_dir, cfg: TrainConfig) -> DataFrame:
    c = check_corpus(spark, sf_dir)
    groups = num_groups(c.occurrences.count(), cfg)
    sample = training.grouped_sample(c.windowed(), None, groups, cfg, c.draw)
    grad = training.batch_gradient_by_group(sample, c.model, cfg, groups, c.draw)
    return long_vectors(grad, ["tbl", "word_id", "sense"], "grad", 4)


@_register
def batch_gradient_by_group(spark, sf_dir):
    return _by_group(spark, sf_dir, CHECK)


@_register
def batch_gradient_softmax_by_group(spark, sf_dir):
    return _by_group(spark, sf_dir, replace(CHECK, softmax=True))


def _stepped(c: Corpus) -> DataFrame:
    return model.gradient_step(c.model, gradients.batch_gradient_sigmoid(c.scored(), CHECK.dim), STEP)


@_register
def gradient_step(spark, sf_dir):
    return long_vectors(_stepped(check_corpus(spark, sf_dir)), ["tbl", "word_id", "sense"], digits=4)


@_register
def average_models(spark, sf_dir):
    """Mean of one model copy per shard, each moved by its shard's word counts."""
    c = check_corpus(spark, sf_dir)
    counts = splits.training_shards(c.occurrences, SHARDS, CHECK.seed).groupBy("shard", "word_id", "sense").agg(
        F.count("*").alias("n")
    )
    deltas = c.model.join(counts, ["word_id", "sense"]).select(
        "tbl", "word_id", "sense", scaled(F.col("vec"), F.col("n") * STEP).alias("delta")
    )
    done = model.average_models(c.model, deltas, SHARDS)
    return long_vectors(done, ["tbl", "word_id", "sense"], digits=4)


@_register
def init_random(spark, sf_dir):
    return long_vectors(check_corpus(spark, sf_dir).model, ["tbl", "word_id", "sense"])


@_register
def limit_norm(spark, sf_dir):
    done = model.limit_norm(check_corpus(spark, sf_dir).model, LIMIT_SQ, CHECK.dim)
    return long_vectors(done, ["tbl", "word_id", "sense", "limited"])


def _stored(c: Corpus) -> DataFrame:
    """A stored model that lacks the rarest words and has second senses of some."""
    named = c.model.join(c.vocab, "word_id").filter((F.col("cn") > CHECK.min_count) & (F.col("sense") < 2))
    return named.select("tbl", "word", "sense", "vec")


@_register
def warm_start(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    return long_vectors(model.warm_start(_stored(c), c.vocab, CHECK.dim, CHECK.seed), ["tbl", "word_id", "sense"])


@_register
def warm_start_problems(spark, sf_dir):
    """A model of all raw words checked against the vocabulary."""
    c = check_corpus(spark, sf_dir)
    raw = c.word_counts.select("word", F.lit(1).alias("sense"), F.array_repeat(F.lit(0.0), 8).alias("vec"))
    return model.warm_start_problems(raw, c.vocab, CHECK.dim)


@_register
def parameters_long(spark, sf_dir):
    found = model.parameters_long(check_corpus(spark, sf_dir).model)
    return found.select("name", F.round(F.col("value").cast("double"), 6).alias("value"))


@_register
def parameters_wide(spark, sf_dir):
    found = model.parameters_wide(model.parameters_long(check_corpus(spark, sf_dir).model))
    return long_vectors(found, ["tbl", "word_id", "sense"])


@_register
def model_diff(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    limited = model.limit_norm(c.model, LIMIT_SQ, CHECK.dim)
    found = model.model_diff(c.model, limited)
    return found.withColumn("max_diff", F.round("max_diff", 6))


@_register
def save_load_model(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    path = scratch_path(spark, "saved")
    models.save_model(c.model, c.vocab, path)
    return long_vectors(models.load_vectors(spark, path, "out"), ["word", "sense"])


@_register
def vectors_text_round_trip(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    path = scratch_path(spark, "vectors-text")
    models.save_vectors_text(models.named_vectors(c.model, c.vocab), path)
    return long_vectors(models.load_vectors_text(spark, path), ["word", "sense"])


@_register
def word_index_lines(spark, sf_dir):
    return models.index_lines(check_corpus(spark, sf_dir).vocab)


@_register
def word_index_round_trip(spark, sf_dir):
    path = scratch_path(spark, "word-index")
    models.index_lines(check_corpus(spark, sf_dir).vocab).write.text(path)
    return models.load_word_index(spark, path)


@_register
def word2vec_text_round_trip(spark, sf_dir):
    c = check_corpus(spark, sf_dir)
    path = scratch_path(spark, "word2vec-text")
    models.save_word2vec_text(models.named_vectors(c.model, c.vocab), path)
    return long_vectors(models.load_word2vec_text(spark, path), ["word"])


# ---- training; sequential inside a group, so without SQL form


def _learned(spark, sf_dir, cfg: TrainConfig) -> DataFrame:
    c = check_corpus(spark, sf_dir)
    sample, groups = _sample(c, cfg)
    return training.learn_shard(sample, c.model, cfg.learn_rate, cfg, groups, c.draw)


@_register
def learn_shard_sigmoid(spark, sf_dir):
    return _learned(spark, sf_dir, CHECK)


@_register
def learn_shard_softmax(spark, sf_dir):
    return _learned(spark, sf_dir, replace(CHECK, softmax=True, lockstep=32))


def _trained(spark, sf_dir):
    return train(spark, check_corpus(spark, sf_dir).lines, RUN, scratch_path(spark, "run"))


@_register
def train_schedule(spark, sf_dir):
    """What the history of a run owes to the corpus and the parameters alone."""
    cfg = replace(RUN, one_sense=True)
    done = train(spark, check_corpus(spark, sf_dir).lines, cfg, scratch_path(spark, "run"))
    return done.history.select("it", "epoch", "shard", "words", F.round("lr", 12).alias("lr"), F.col("vali_loss").isNotNull().alias("validated"))


@_register
def train_history(spark, sf_dir):
    return _trained(spark, sf_dir).history


@_register
def train_vectors(spark, sf_dir):
    done = _trained(spark, sf_dir)
    return long_vectors(models.named_vectors(done.model, done.vocab), ["word", "sense"])


# ---- similarity queries


def _word_vectors(c: Corpus) -> DataFrame:
    return models.named_vectors(c.model, c.vocab)


@_register
def get_vectors(spark, sf_dir):
    return long_vectors(similarity.get_vectors(_word_vectors(check_corpus(spark, sf_dir))), ["word", "sense"])


@_register
def lookup_vector(spark, sf_dir):
    found = similarity.lookup_vector(_word_vectors(check_corpus(spark, sf_dir)), SYNONYM_WORD)
    return long_vectors(found, ["word", "sense"])


@_register
def find_synonyms_vector(spark, sf_dir):
    query = [1.0 / (i + 1) for i in range(CHECK.dim)]
    found = similarity.find_synonyms_vector(_word_vectors(check_corpus(spark, sf_dir)), query, 10)
    return found.withColumn("score", F.round("score", 6))


@_register
def find_synonyms(spark, sf_dir):
    found = similarity.find_synonyms(_word_vectors(check_corpus(spark, sf_dir)), SYNONYM_WORD, 10)
    return found.withColumn("score", F.round("score", 6))


@_register
def find_synonyms_batch(spark, sf_dir):
    words = _word_vectors(check_corpus(spark, sf_dir))
    found = similarity.find_synonyms_batch(words, words, TOP_K)
    return found.withColumn("score", F.round("score", 6))


# ---- vector-table jobs


@_register
def vector_norms(spark, sf_dir):
    found = vectors.vector_norms(embeddings(spark, sf_dir), "vec_id", EMBEDDING_DIM)
    return found.withColumn("norm", F.round("norm", 6))


@_register
def l2_normalize(spark, sf_dir):
    return long_vectors(vectors.l2_normalize(embeddings(spark, sf_dir), EMBEDDING_DIM), ["vec_id"])


@_register
def limit_length(spark, sf_dir):
    return long_vectors(vectors.limit_length(embeddings(spark, sf_dir), LIMIT_LEN, EMBEDDING_DIM), ["vec_id"])


@_register
def vector_sum(spark, sf_dir):
    return long_vectors(vectors.vector_sum(embeddings(spark, sf_dir)), ["n"])


@_register
def vector_mean_by_label(spark, sf_dir):
    return long_vectors(vectors.vector_mean(embeddings(spark, sf_dir), ["label"]), ["label", "n"])


@_register
def center_vectors(spark, sf_dir):
    return long_vectors(vectors.center_vectors(embeddings(spark, sf_dir)), ["vec_id"])


@_register
def second_moment_matrix(spark, sf_dir):
    found = vectors.second_moment_matrix(embeddings(spark, sf_dir), EMBEDDING_DIM)
    return found.withColumn("value", F.round("value", 6))


@_register
def pairwise_cosine_top(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    found = vectors.nearest_by_cosine(rows, rows, "vec_id", TOP_K)
    return found.withColumn("score", F.round("score", 6))


def _neighbour_pairs(spark, sf_dir) -> DataFrame:
    """Each vector with the one of the next id."""
    rows = embeddings(spark, sf_dir)
    left = rows.select(F.col("vec_id").alias("id_a"), F.col("vec").alias("vec_a"), (F.col("vec_id") + 1).alias("id_b"))
    return left.join(rows.select(F.col("vec_id").alias("id_b"), F.col("vec").alias("vec_b")), "id_b")


@_register
def pair_metrics(spark, sf_dir):
    found = vectors.pair_metrics(_neighbour_pairs(spark, sf_dir), EMBEDDING_DIM, MIX)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    measures = {"dot": F.col("dot"), "distance": F.col("distance"), "cosine": F.col("cosine"),
                "angle": F.col("angle"), "product_sum": total("product"), "between_sum": total("between")}
    return found.select("id_a", "id_b", *[F.round(v, 6).alias(k) for k, v in measures.items()])


@_register
def affinity_normalize(spark, sf_dir):
    """Edges from each vector to its most similar ones, weighted by similarity."""
    rows = embeddings(spark, sf_dir)
    near = vectors.nearest_by_cosine(rows, rows, "vec_id", TOP_K)
    edges = near.select(F.col("q_vec_id").alias("i"), F.col("vec_id").alias("j"), F.exp("score").alias("p"))
    return vectors.affinity_normalize(edges).withColumn("p", F.round("p", 9))


# ---- flagship


@_register
def hardest_centre_words(spark, sf_dir):
    return hardest_words(check_corpus(spark, sf_dir), 20)
