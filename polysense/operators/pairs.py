"""Skip-gram pairs and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from polysense.operators.chunks import is_chunked
from polysense.operators.joins import head_size, rank_lookup

TABLE_BYTES = 64 << 20  # bound of the vectors every task may hold


def offsets(window: int) -> list[int]:
    return [d for d in range(-window, window + 1) if d]


def skipgram_pairs(occ: DataFrame, window: int) -> DataFrame:
    """Every (centre, context) within ``window`` of each other in a line
    -> ``(line_id, pos, ctx_pos, word_id, sense, ctx_word_id, ctx_sense)``.

    Neighbours come from lag/lead in one sorted pass per line: one shuffle, no self-join. Rows of ``chunks.line_chunks``, cut
    with this ``window`` or a wider one, hold all neighbours of their tokens and are read where they stand.
    """
    if is_chunked(occ):
        return _pairs_of_chunks(occ, window)
    order = Window.partitionBy("line_id").orderBy("pos")
    # plain columns are taken from the neighbours, since a struct of them would be built before the shuffle and travel too
    at = [F.lag("pos", -d).over(order).alias(f"_p{i}") for i, d in enumerate(offsets(window))]
    words = [F.lag("word_id", -d).over(order).alias(f"_w{i}") for i, d in enumerate(offsets(window))]
    chosen = [F.lag("sense", -d).over(order).alias(f"_s{i}") for i, d in enumerate(offsets(window))]
    near = [F.when(F.col(f"_p{i}").isNotNull(), F.struct(F.col(f"_p{i}").alias("p"), F.col(f"_w{i}").alias("w"), F.col(f"_s{i}").alias("s")))
            for i in range(len(at))]
    return (
        occ.select("line_id", "pos", "word_id", "sense", *at, *words, *chosen)
        .select("line_id", "pos", "word_id", "sense", F.array(*near).alias("_near"))
        .select("line_id", "pos", "word_id", "sense", F.explode("_near").alias("_c"))
        .filter(F.col("_c").isNotNull())
        .select(
            "line_id",
            "pos",
            F.col("_c.p").alias("ctx_pos"),
            "word_id",
            "sense",
            F.col("_c.w").alias("ctx_word_id"),
            F.col("_c.s").alias("ctx_sense"),
        )
    )


def _pairs_of_chunks(chunks: DataFrame, window: int) -> DataFrame:
    at, pos = F.col("_i"), F.col("start") + F.col("_i")
    tokens = chunks.select("line_id", "start", "lead", F.col("own").alias("_own"), F.col("word_id").alias("_w"), F.col("sense").alias("_s"),
                           F.posexplode("word_id").alias("_i", "word_id")).filter((at >= F.col("lead")) & (at < F.col("lead") + F.col("_own")))
    near = [F.when(F.get("_w", at + d).isNotNull(), F.struct((pos + d).alias("p"), F.get("_w", at + d).alias("w"), F.get("_s", at + d).alias("s")))
            for d in offsets(window)]
    found = tokens.select("line_id", pos.alias("pos"), "word_id", F.get("_s", at).alias("sense"), F.explode(F.array(*near)).alias("_c"))
    return found.filter(F.col("_c").isNotNull()).select(
        "line_id", "pos", F.col("_c.p").alias("ctx_pos"), "word_id", "sense", F.col("_c.w").alias("ctx_word_id"), F.col("_c.s").alias("ctx_sense"))


def attach_vectors(
    rows: DataFrame, model: DataFrame, table: str, dim: int, word: str = "word_id", sense: str = "sense", name: str = "vec"
) -> DataFrame:
    """Add the input ('in') or output ('out') vector of a word sense as ``name``.

    Vectors of at most ``TABLE_BYTES`` are all broadcast, so ``rows`` are made once; of more
    the frequent words are, and the others join by shuffle.
    """
    vectors = model.filter(F.col("tbl") == table).select(
        F.col("word_id").alias(word), F.col("sense").alias(sense), F.col("vec").alias(name)
    )
    senses, many, top = vectors.agg(F.max(sense), F.count("*"), F.max(word)).first()  # one row
    if many * (4 * dim + 32) <= TABLE_BYTES:
        return rank_lookup(rows, vectors, [word, sense], word, (top or 0) + 1)
    return rank_lookup(rows, vectors, [word, sense], word, head_size(4 * dim + 32, senses + 1))


def pair_vectors(pairs: DataFrame, model: DataFrame, dim: int) -> DataFrame:
    """Pairs with the centre's input vector and the context's output vector."""
    with_in = attach_vectors(pairs, model, "in", dim, name="in_vec")
    return attach_vectors(with_in, model, "out", dim, "ctx_word_id", "ctx_sense", "out_vec")
