"""License scans, centroid clustering and the divergence audit against brute force, on whole small tables and hard cases."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from polysense.llm import centroid, divergence, license_scan, oracle, queries

from test_operators import DOCS, hard_cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_cases(), DOCS)


# ---- licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_base(text):
    words = words_of(text)
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()]
             for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def least_edits(pattern, text):
    """Fewest edits of ``pattern`` against any stretch of ``text`` (Sellers)."""
    column = np.arange(len(pattern) + 1)
    codes = np.array([ord(c) for c in pattern])
    best = column[-1]
    for c in text:
        step = np.minimum(column[:-1] + (codes != ord(c)), column[1:] + 1)
        after = np.concatenate(([0], step))
        # insertions of pattern characters run down the column
        after = np.minimum.accumulate(after - np.arange(len(after))) + np.arange(len(after))
        column = after
        best = min(best, column[-1])
    return int(best)


def mutated(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(1, len(text) - 1)
        text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("qxz") + text[i + 1:], text[:i] + rng.choice("qxz") + text[i:]])
    return text


def brute_notices(norm):
    found = {}
    for i, (label, text) in enumerate(license_scan.NOTICES):
        edits = least_edits(text, norm)
        if edits <= license_scan.max_edits(text):
            found[i] = edits
    return found


def test_notices_with_edits_against_all_alignments():
    rng = random.Random(5)
    search = license_scan.NoticeSearch(license_scan.NOTICES)
    for i, (label, text) in enumerate(license_scan.NOTICES):
        for edits in range(license_scan.max_edits(text) + 3):
            norm = "some words before " + mutated(rng, text, edits) + " and words after the license " + mutated(rng, text, edits // 2)
            found = search.search(norm)
            least = {}
            for f in found:
                least[f.notice] = min(least.get(f.notice, 99), f.edits)
                assert least_edits(license_scan.NOTICES[f.notice][1], norm[f.start:f.end]) <= f.edits
            assert least == brute_notices(norm), (text, edits)


def test_notices_do_not_name_each_other():
    for label, text in license_scan.NOTICES:
        others = {license_scan.NOTICES[i][0] for i in brute_notices(text)} - {label}
        assert all(any(t in text for x, t in license_scan.NOTICES if x == o) for o in others), (text, others)


def test_licenses_of_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op11_licenses(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
        norm = " ".join(words_of(text))
        if len(norm) < 1500:
            found = brute_notices(norm)
            assert set(r["labels"].split(",")) - {""} == {license_scan.NOTICES[i][0] for i in found} | set(r["base_labels"].split(",")) - {""}
            best = max((1 - e / len(license_scan.NOTICES[i][1]) for i, e in found.items()), default=0.0)
            assert r["score"] == (1.0 if r["n_base"] else best)


def test_licenses_of_hard_cases(spark, hard):
    long = "word " * 200_000 + "GNU  General\nPublic-License, then " + "x" * 300_000 + " Licenced under the Apache Licence! é"
    texts = [None, "", "cc by cc by cc by", "MIT License\x00mit license", "CC-BY-NC 4.0", "Lisensed under CC BY", long, "ＧＮＵ general public license"]
    rows = [(i, t, None, None, None, "clash", 1, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[2:3] + hard_cases(), DOCS)
    got = license_scan.scan(docs.withColumnRenamed("fp", "labels"), text_col="text").collect()
    want = [brute_base(r["text"]) for r in docs.collect()]
    assert sorted(map(str, [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got])) == sorted(map(str, want))
    by = {r["doc_id"]: r for r in got if r["labels"]}
    assert by[5]["n_base"] == 1 and by[5]["score"] == 1.0 and by[5]["spans"][0]["edits"] == 1
    assert by[6]["labels"] == "apache,gpl" and by[6]["n_base"] == 1
    for r in by.values():
        for s in r["spans"]:
            whole = texts[r["doc_id"]][s["start"]:s["end"]]
            assert words_of(whole) == words_of(texts[r["doc_id"]])[s["first_word"]:s["end_word"]]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_many_notices_in_one_text():
    search = license_scan.NoticeSearch(license_scan.NOTICES)
    norm = " ".join(["gnu general public license and"] * 5_000)
    found = search.search(norm)
    assert len(found) == 5_000 and all(f.edits == 0 for f in found)


# ---- centroids

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()),
                        T.StructField("dots", T.IntegerType())])


def brute_clusters(rows, dim, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres)) for _, q in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            own = [q for (_, q), (_, at) in zip(kept, near) if at == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    own = collections.Counter()
    for d, n in near:
        own[n] += d
    return table((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                 for (i, _), (d, n) in zip(kept, near))


def test_centroids_of_hard_cases(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], "c", 1) for i in range(80)]
    rows += rows[3:6] * 4 + [(None, [1.0, -2.0, 3.0, 0.5], "c", 1), (None, [0.0] * 4, "c", 1), (900, None, "c", 1), (901, [], "c", 1), (902, [1.0] * 5, "c", 1),
             (903, [1.0, None, 2.0, 3.0], "c", 1), (904, [1.0, float("nan"), 2.0, 3.0], "c", 1), (905, [float("inf"), 1.0, 2.0, 3.0], "c", 1),
             (906, [-1e6, 1e6, 0.0, -0.0], "c", 1)] + [(1000 + i, [0.5, 0.5, -0.5, 0.01], "c", 1) for i in range(60)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    for k, rounds in ((1, 2), (7, 0), (16, 3), (500, 2)):
        got = centroid.clusters(vectors, dim=4, k=k, rounds=rounds).collect()
        assert table(got) == brute_clusters([r[:2] for r in rows], 4, k, rounds)
    for none in (vectors.limit(0), vectors.filter("vec_id = 900")):
        assert centroid.clusters(none, dim=4).count() == 0
        assert centroid.clusters(none, dim=4).columns == centroid.clusters(vectors, dim=4).columns
    with pytest.raises(PySparkException, match="exact long distances"):
        centroid.clusters(spark.createDataFrame([(1, [1e30] * 4, "c", 1)], VECTORS), dim=4).collect()


def test_centroids_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    result = con.execute(oracle.statements()["op12_centroids"])
    columns = [c[0] for c in result.description]
    assert table(queries.op12_centroids(spark, sf_dir).select(columns).collect()) == table(result.fetchall())


def test_only_changed_components_are_multiplied():
    before = np.array([[1, 2, 3], [4, 5, 6]])
    after = np.array([[1, 2, 3], [4, 0, 7]])
    (c, at, delta), = centroid.changes(before, after)
    assert c == 1 and at.tolist() == [1, 2] and delta.tolist() == [-5, 1]


# ---- divergence


def test_transducer_numbers_terms_and_is_minimal():
    rng = random.Random(9)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))).encode() for _ in range(900)} | {b"zoo", b"zoos", b"z" * 400})
    made = divergence.Transducer(terms)
    keys, targets, outputs, final = made.arrays()
    # right languages of states, from the terms themselves: a minimal automaton has one state for each
    rest = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for t in terms for p in (t[:i] for i in range(len(t) + 1))}
    assert len(final) == len(rest)
    block = {"lang": "x", "base": 100, "root": made.root, "keys": keys.tobytes(), "targets": targets.tobytes(), "outputs": outputs.tobytes(), "final": final.tobytes()}
    machine = divergence.Machine([block, block | {"lang": "y", "base": 0}])
    words = terms + [t + b"a" for t in terms] + [t[:-1] for t in terms] + [b"q", b"zo"]
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    length = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    word, ordinal = machine.ordinals(data, start, length, np.full(len(words), machine.starts["x"][0][0]), np.full(len(words), 100))
    rank = {t: i + 100 for i, t in enumerate(terms)}
    assert dict(zip(word.tolist(), ordinal.tolist())) == {i: rank[w] for i, w in enumerate(words) if w in rank}


def brute_audit(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        holds = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted((t for t, n in holds.items() if n >= least), key=lambda t: t.encode())
        counts = collections.defaultdict(collections.Counter)
        for at, source, terms in docs:
            if at == lang:
                counts[source].update(t for t in terms if holds[t] >= least)
        total = sum(counts.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(total)
        for s in counts:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(shares[s][t] - q[t], t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found, bound in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:bound])]
    return table(out)


def test_audit_of_hard_cases(spark):
    rng = random.Random(1)
    words = ["Alpha", "beta", "gamma", "Straße", "日本", "don't", "x", "É", "délta", "beta2beta", "\x00null", "a" * 3000]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, "ß"]), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(150)]
    rows += rows[:5] * 3 + [("en", "wordless", None), ("en", "wordless", ""), ("fr", "only", "unique words here"), ("fr", "other", None), ("it", "one", "ciao"),
             ("en", "long", "alpha beta " * 30_000 + "q" * 200_000), ("en", "ties", "gamma beta x")]
    shape = T.StructType([T.StructField(n, T.StringType()) for n in ("lang", "source", "text")])
    docs = spark.createDataFrame(rows, shape).selectExpr("*", "7 AS n", "'clash' AS term", "1 AS ordinal").repartition(6)
    for least, block, size in ((3, 1 << 16, 64 << 20), (1, 4, 1), (30, 2, 300), (10_000, 5, 1 << 20)):
        got = divergence.audit(docs, least, 4, block_terms=block, pass_bytes=size).collect()
        assert table(got) == brute_audit(rows, least, 4), (least, block, size)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_audit_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "SLICE", 4)
    rng = random.Random(2)
    rows = [("en", f"s{i % 11}", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert table(divergence.audit(docs, 2, 5).collect()) == brute_audit(rows, 2, 5)


def test_audit_flushes_and_cuts_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_CHUNK", 64)
    monkeypatch.setattr(divergence, "_CELLS", 8)
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "straße", "w" * 90]
    rows = [("en", f"s{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(2)
    assert table(divergence.audit(docs, 2, 5).collect()) == brute_audit(rows, 2, 5)


def test_audit_of_whole_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()]
    assert table(queries.op13_divergence(spark, sf_dir).collect()) == brute_audit(rows, 30, 50)
