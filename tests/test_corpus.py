import pytest
from pyspark.sql import functions as F

from polysense.operators import tokens, vocabulary
from polysense.sources import corpus


def tokenized(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    return tokens.tokenize(df)


def words(df):
    return [r["word"] for r in df.orderBy("line_id", "raw_pos").collect()]


def test_tokenizer_strips_ends_and_keeps_inner_marks(spark):
    got = words(tokenized(spark, "Hello, DON'T 42nd 3.5 -x- Straße. a\tb  "))
    assert got == ["hello", "don't", "nd", "x", "straße", "a\tb"]


def test_tokenizer_of_empty_lines(spark):
    assert words(tokenized(spark, "", "   ", "1 2 3 --")) == []


def test_trim_comes_before_lowercase(spark):
    assert words(tokenized(spark, "İstanbul.")) == ["i̇stanbul"]


def test_lines_keep_blank_ones_and_order(spark):
    docs = spark.createDataFrame([(3, "a\n\nb"), (4, "c")], "doc_id bigint, text string")
    rows = corpus.corpus_lines(docs).orderBy("line_id").collect()
    base = corpus.LINES_PER_DOC
    assert [(r["line_id"], r["line"]) for r in rows] == [(3 * base, "a"), (3 * base + 1, ""), (3 * base + 2, "b"), (4 * base, "c")]


def test_line_key_refuses_to_collide(spark):
    rows = spark.range(1).select(corpus.line_key(F.lit(1), F.lit(corpus.LINES_PER_DOC)).alias("k"))
    with pytest.raises(Exception, match="too many lines"):
        rows.collect()


def test_text_lines_reads_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("one two\nthree\n")
    df = corpus.text_lines(spark, str(tmp_path / "c.txt"))
    assert sorted(r["line"] for r in df.collect()) == ["one two", "three"]
    assert df.select("line_id").distinct().count() == 2


def test_vocab_ranks_by_count_then_word(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("z", 9), ("q", 1)], "word string, cn bigint")
    got = [tuple(r) for r in vocabulary.build_vocab(counts, 2, [5, 9]).orderBy("word_id").collect()]
    assert got == [(0, "z", 9, 3), (1, "a", 5, 2), (2, "b", 5, 2)]


def test_vocab_ids_are_dense_over_many_sort_partitions(spark):
    counts = spark.range(20000).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") % 7 + 1).alias("cn"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        vocab = vocabulary.build_vocab(counts, 1, [])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = vocab.toPandas().sort_values(["cn", "word"], ascending=[False, True])
    assert list(got["word_id"]) == list(range(20000))


def test_sense_thresholds(spark):
    counts = spark.createDataFrame([(19,), (20,), (29,), (30,)], "cn bigint")
    got = counts.select("cn", vocabulary.senses_per_word(F.col("cn"), [20, 30]).alias("s")).orderBy("cn").collect()
    assert [r["s"] for r in got] == [1, 2, 2, 3]


def test_the_last_satisfied_threshold_wins_in_any_order(spark):
    one = spark.createDataFrame([(25,)], "cn bigint").select(vocabulary.senses_per_word(F.col("cn"), [30, 20]).alias("s"))
    assert one.first()["s"] == 3


def test_thinned_spectrum_resets_its_sum(spark):
    counts = spark.range(1000).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") % 400 + 1).alias("cn"))
    full = vocabulary.count_spectrum(counts).orderBy("cn").collect()
    gap, since, want = 1000 // 200, 0, []
    for i, r in enumerate(full):
        since += r["n_words"]
        if i == 0 or since >= gap:
            want.append(r["cn"])
            since = 0
    assert [r["cn"] for r in vocabulary.count_spectrum_thinned(counts).orderBy("cn").collect()] == want


@pytest.mark.parametrize("head", [0, 2, 100])
def test_encoding_is_the_same_for_any_split_into_head_and_tail(spark, head):
    toks = tokenized(spark, "a b a x c", "x x", "c a")
    vocab = vocabulary.build_vocab(vocabulary.word_count(toks).filter("word <> 'x'"), 1, [3])
    got = {(r["line_id"], r["pos"]): (r["word_id"], r["n_senses"]) for r in tokens.filter_vocab(toks, vocab, head).collect()}
    a, c, b = (0, 2), (1, 1), (2, 1)
    assert got == {(0, 0): a, (0, 1): b, (0, 2): a, (0, 3): c, (2, 0): c, (2, 1): a}


def test_word_sense_code_round_trip(spark):
    df = spark.createDataFrame([(7, 3), (0, 99)], "w int, s int").withColumn("ws", tokens.encode_ws(F.col("w"), F.col("s")))
    w, s = tokens.decode_ws(F.col("ws"))
    assert all((r["w"], r["s"]) == (r["a"], r["b"]) for r in df.withColumn("a", w).withColumn("b", s).collect())


def test_empty_corpus(spark):
    toks = tokenized(spark, "1 2")
    assert vocabulary.build_vocab(vocabulary.word_count(toks), 1, []).count() == 0
    assert vocabulary.count_spectrum_thinned(vocabulary.word_count(toks)).count() == 0


def test_ids_of_text_lines_do_not_depend_on_splits(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    docs.repartition(3).write.text(str(tmp_path / "t"))
    (tmp_path / "t" / "empty.txt").write_text("")
    (tmp_path / "t" / "last.txt").write_text("\n\ra\r\nno newline at the end")
    found = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        lines = corpus.text_lines(spark, str(tmp_path / "t"))
        found.append({(r["line_id"], r["line"]) for r in lines.collect()})
        parts = spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 20 and found[0] == found[1]
    by_file = {}
    for line_id, line in sorted(found[0]):
        by_file.setdefault(line_id >> 40, []).append(line)
    want = sorted((p.name, p.read_bytes().decode().removesuffix("\n").split("\n")) for p in (tmp_path / "t").glob("*.txt") if p.stat().st_size)
    assert list(by_file.values()) == [lines for _, lines in want]
    assert len({i for i, _ in found[0]}) == sum(len(lines) for _, lines in want)
