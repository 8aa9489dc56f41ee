import numpy as np
from pyspark.sql import functions as F

from polysense.functions import draws
from polysense.operators import noise, splits
from polysense.sources.corpus import corpus_lines, text_lines


def vocab_of(spark, rows):
    return spark.createDataFrame(rows, "word_id int, word string, cn bigint, n_senses int")


def test_draws_match_plain_integers(spark):
    def mix(x):
        return pow(x, 5, draws.P)

    keys = ["id", "k", "id", "n"]  # more keys than multipliers, bigint keys above 2^31 among them
    rows = draws.with_draw(spark.range(50).selectExpr("id * 5000000000 AS id", "cast(id * 7 AS int) AS k", "cast(id AS int) AS n"), "d", 42, *keys).collect()
    for r in rows:
        state, parts = draws.start(42), [r["id"] >> 31, r["id"] & draws.P, r["k"], r["id"] >> 31, r["id"] & draws.P, r["n"]]
        for i, part in enumerate(parts):
            state = mix((state + part % draws.P * draws.MULTIPLIERS[i % 3]) % draws.P)
        assert r["d"] == state


def test_lines_of_documents_and_files_have_their_own_draws(spark, tmp_path):
    docs = spark.range(600).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 12), i -> concat('l', i)), '\n') AS text")
    lines = corpus_lines(docs)
    assert draws.with_draw(lines, "d", 3, "line_id").select("d").distinct().count() >= 7200 - 2
    spark.range(20_000).selectExpr("cast(id AS string)").repartition(40).write.text(str(tmp_path / "t"))
    lines = text_lines(spark, str(tmp_path / "t"))
    assert draws.with_draw(lines, "d", 3, "line_id").select("d").distinct().count() >= 20_000 - 2


def test_every_key_counts(spark):
    rows = draws.with_draw(spark.range(2000).selectExpr("1 AS a", "2 AS b", "3 AS c", "cast(id AS int) AS item"), "d", 1, "a", "b", "c", "item")
    assert rows.select("d").distinct().count() == 2000


def test_light_words_of_a_large_total_are_drawn(spark):
    wide = spark.range(40_000).selectExpr("id AS line_id", "0 AS pos")
    drawn = draws.with_second_draw(draws.with_draw(wide, "a", 1, "line_id", "pos"), "b", "a")
    at = drawn.select(F.floor(draws.fine_unit(F.col("a"), F.col("b")) * float(1 << 44)).cast("bigint").alias("r"))
    assert at.select("r").distinct().count() == 40_000
    assert 12_500 < at.filter("r % 3 = 1").count() < 14_200  # a lattice of 2^31 places would miss most remainders or favour some
    assert at.select((F.col("r") % 8192).alias("m")).distinct().count() > 8000


def test_draws_are_uniform(spark):
    got = draws.with_draw(spark.range(20000), "d", 1, "id").select(draws.unit(F.col("d")).alias("u")).toPandas()["u"]
    counts = np.histogram(got, bins=50, range=(0, 1))[0]
    assert ((counts - 400) ** 2 / 400).sum() / 49 < 2


def test_split_is_disjoint_and_near_its_ratio(spark):
    lines = spark.range(5000).select(F.col("id").alias("line_id"))
    parts = {r["part"]: r["count"] for r in splits.train_validation_split(lines, 0.1, 10**6, 7).groupBy("part").count().collect()}
    assert sum(parts.values()) == 5000 and 400 < parts["validation"] < 600
    capped = splits.train_validation_split(lines, 0.1, 50, 7).filter("part = 'validation'").count()
    assert 20 < capped < 90


def test_noise_intervals_cover_the_total(spark):
    table = noise.noise_distribution(vocab_of(spark, [(0, "a", 100, 2), (1, "b", 16, 1), (2, "c", 1, 1)]))
    rows = table.orderBy("word_id").collect()
    assert [r["wt"] for r in rows] == [31623, 8000, 1000]
    assert rows[0]["lo"] == 0 and all(a["hi"] == b["lo"] for a, b in zip(rows, rows[1:])) and rows[-1]["hi"] == rows[0]["total"]


def test_noise_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(noise, "BLOCK", 4)
    vocab = spark.range(30).select(F.col("id").cast("int").alias("word_id"), (30 - F.col("id")).alias("cn"), F.lit(1).alias("n_senses"))
    got = noise.noise_distribution(vocab).orderBy("word_id").toPandas()
    assert list(got["hi"]) == list(got["wt"].cumsum()) and (got["total"] == got["wt"].sum()).all()


def test_negatives_avoid_the_own_word_and_follow_the_weights(spark):
    vocab = vocab_of(spark, [(0, "a", 1000, 3), (1, "b", 100, 1), (2, "c", 10, 1)])
    occ = spark.range(6000).select(
        F.col("id").alias("line_id"), F.lit(0).alias("pos"), (F.col("id") % 3).cast("int").alias("word_id"),
        F.lit(1).alias("n_senses"), F.lit(0).alias("sense"))
    neg = noise.negative_samples(occ, noise.noise_distribution(vocab), 3, 42).join(occ.select("line_id", "word_id"), "line_id")
    got = neg.toPandas()
    assert len(got) == 18000 and (got["word_id"] != got["neg_word_id"]).all()
    assert set(got.loc[got["neg_word_id"] == 0, "neg_sense"]) == {0, 1, 2}
    share = (got.loc[got["word_id"] == 2, "neg_word_id"] == 0).mean()
    want = 1000**0.75 / (1000**0.75 + 100**0.75)
    assert abs(share - want) < 0.02


def test_searched_and_bucketed_noise_words_agree(spark, monkeypatch):
    vocab = spark.range(300).select(F.col("id").cast("int").alias("word_id"), F.lit("w").alias("word"), (100_000 / (F.col("id") + 1)).cast("bigint").alias("cn"),
                                    (F.col("id") % 3 + 1).cast("int").alias("n_senses"))
    table = noise.noise_distribution(vocab)
    occ = spark.range(3000).select((F.col("id") * 7_000_000_000).alias("line_id"), (F.col("id") % 50).cast("int").alias("pos"), (F.col("id") % 300).cast("int").alias("word_id"),
                                   F.lit(1).alias("n_senses"), F.lit(0).alias("sense"))
    for turn in (0, 3):
        rows = noise.negative_samples(occ, table, 4, 42, turn)
        packed = noise.with_noise_words(occ, table, 4, 42, turn)
        monkeypatch.setattr(noise, "TABLE_BYTES", 0)
        bucketed, joined = noise.negative_samples(occ, table, 4, 42, turn), noise.with_noise_words(occ, table, 4, 42, turn)
        monkeypatch.undo()
        assert rows.dtypes == bucketed.dtypes and packed.dtypes[-1] == joined.dtypes[-1] == ("noise", "array<bigint>")
        found = set(map(tuple, rows.collect()))
        assert len(found) == 12_000 and found == set(map(tuple, bucketed.collect()))
        lists = {(r["line_id"], r["pos"]): r["noise"] for r in packed.collect()}
        assert lists == {(r["line_id"], r["pos"]): r["noise"] for r in joined.collect()}
        assert {(i, p, k, c // 100, c % 100) for (i, p), codes in lists.items() for k, c in enumerate(codes)} == found


def test_one_word_vocabulary_has_no_negatives(spark):
    occ = spark.createDataFrame([(0, 0, 0, 1, 0)], "line_id bigint, pos int, word_id int, n_senses int, sense int")
    table = noise.noise_distribution(vocab_of(spark, [(0, "a", 5, 1)]))
    assert noise.negative_samples(occ, table, 5, 1).count() == 0
    assert noise.with_noise_words(occ, table, 5, 1).first()["noise"] == []


def test_weighted_choice_follows_the_weights(spark):
    rows = spark.range(4000).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("item"))
    rows = rows.withColumn("weight", F.when(F.col("item") == 0, 6.0).when(F.col("item") == 1, 3.0).otherwise(0.0))
    got = noise.weighted_choice(rows, ["id"], "item", "weight", 5).toPandas()["item"].value_counts()
    assert got.sum() == 4000 and 2 not in got and abs(got[0] / 4000 - 2 / 3) < 0.03


def test_shards_and_senses_stay_in_range(spark):
    occ = spark.range(1000).select(F.col("id").alias("line_id"), F.lit(0).alias("pos"), (F.col("id") % 3 + 1).cast("int").alias("n_senses"))
    rows = splits.training_shards(splits.init_senses(occ, 1), 4, 1).collect()
    assert {r["shard"] for r in rows} == {0, 1, 2, 3}
    assert all(0 <= r["sense"] < r["n_senses"] for r in rows) and any(r["sense"] == 2 for r in rows)
