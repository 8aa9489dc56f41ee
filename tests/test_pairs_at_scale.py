"""What pairs carry through a shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from polysense.operators import pairs
from polysense.operators.chunks import line_chunks
from polysense.plans import registry


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_are_not_built_before_the_shuffle(spark):
    occ = spark.range(20).selectExpr("id div 8 AS line_id", "int(id % 8) AS pos", "int(id % 3) AS word_id", "0 AS sense")
    found = pairs.skipgram_pairs(occ, 2)
    below = _plan(found).split("Window", 1)[1].split("\n", 1)[1]
    assert "struct" not in below
    tokens = {(r["line_id"], r["pos"]): r["word_id"] for r in occ.collect()}
    want = [(line, p, q, w, tokens[line, q]) for (line, p), w in tokens.items() for q in range(p - 2, p + 3) if q != p and (line, q) in tokens]
    assert sorted(tuple(r) for r in found.select("line_id", "pos", "ctx_pos", "word_id", "ctx_word_id").collect()) == sorted(want)


def test_a_pair_and_its_mirror_image_are_one_group(spark, sf_dir):
    found = registry.skipgram_pairs(spark, sf_dir)
    grouped = [x for x in _plan(found).splitlines() if "Aggregate" in x]
    assert len(grouped) == 1 and "side" not in grouped[0].split("]")[0]
    every = pairs.skipgram_pairs(registry.check_corpus(spark, sf_dir).occurrences, registry.CHECK.window)
    side = F.when(F.col("ctx_pos") < F.col("pos"), "before").otherwise("after")
    rows = every.select("word_id", "sense", "ctx_word_id", "ctx_sense", side.alias("side"), (F.col("line_id") % 1000003 + F.col("pos")).alias("v")).toPandas()
    n, total = Counter(), Counter()
    for *key, v in rows.itertuples(index=False, name=None):
        n[tuple(key)] += 1
        total[tuple(key)] += v
    got = {tuple(r)[:5]: tuple(r)[5:] for r in found.collect()}
    assert got == {k: (n[k], total[k]) for k in n}


def test_pairs_of_chunks_are_found_where_they_stand(spark, sf_dir):
    sizes = [1, 2, 9, 31]
    tokens = [(line, pos, (7 * line + pos) % 11, 2, (line + pos) % 2) for line, size in enumerate(sizes) for pos in range(size)]
    occ = spark.createDataFrame(tokens, "line_id bigint, pos int, word_id int, n_senses int, sense int").coalesce(1).sortWithinPartitions("line_id", "pos")
    chunks = line_chunks(occ, 3, 4)  # most chunks have neighbours on both sides
    for window in (2, 3):
        found = pairs.skipgram_pairs(chunks, window)
        assert "Window" not in _plan(found)
        want = pairs.skipgram_pairs(occ, window)
        assert found.dtypes == want.dtypes and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in _plan(registry.skipgram_pairs(spark, sf_dir))
