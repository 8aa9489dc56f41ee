"""Lookups of vectors in a model that a broadcast holds."""

from polysense.operators import joins, pairs


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_small_model_is_looked_up_whole(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAD_BYTES", 1)  # many words lie beyond the head
    rows = spark.range(200).selectExpr("id AS line_id", "int(id % 50) AS word_id", "int(id % 2) AS sense")
    model = spark.range(100).selectExpr("'in' AS tbl", "int(id % 50) AS word_id", "int(id div 50) AS sense", "array(float(id), float(-id)) AS vec")
    found = pairs.attach_vectors(rows, model, "in", 2)
    assert "Union" not in _plan(found) and _plan(found).count("Join") == 1
    got = found.collect()
    assert len(got) == 200 and all(r["vec"][0] == r["word_id"] + 50 * r["sense"] for r in got)
    monkeypatch.setattr(pairs, "TABLE_BYTES", 1)
    assert sorted(pairs.attach_vectors(rows, model, "in", 2).select(*found.columns).collect()) == sorted(got)
