"""SQL forms of the queries that SQL expresses, for DuckDB, written from the contracts.

SimHash, tokenized packing and rollups, toxicity, embeddings, boosted spans and fuzzy notices have
no SQL form; tests hold them against brute force.
"""

from __future__ import annotations

from polysense.llm import centroid, divergence, mixing, quality, warc

# white space that separates words, and one word
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _warc() -> str:
    digit = lambda i: f"(('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT)"
    letters = " || ".join(f"substr('{warc.BASE32}', (({digit(i)} >> {shift}) & 31)::INTEGER + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
      WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
      d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS head FROM p)
      SELECT page_id, payload_bytes, {letters} AS payload_digest,
             CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
             CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""


def _substring() -> str:
    return rf"""
      WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
      grams AS (SELECT doc_id, i::BIGINT AS i, md5(array_to_string(ws[i:i+19], ' ')) AS g
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
      first AS (SELECT g, min({{'d': doc_id, 'i': i}}) AS f FROM grams GROUP BY g),
      hit AS (SELECT doc_id, i FROM grams JOIN first USING (g) WHERE {{'d': doc_id, 'i': i}} <> f),
      gone AS (SELECT DISTINCT doc_id, i + k AS at FROM hit, (SELECT unnest(range(0, 20)) AS k)),
      kept AS (SELECT t.doc_id, count(gone.at) AS n_removed,
                      coalesce(string_agg(word, ' ' ORDER BY t.at) FILTER (WHERE gone.at IS NULL), '') AS text
               FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w) t
               LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.at = t.at GROUP BY t.doc_id)
      SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
      FROM w LEFT JOIN kept USING (doc_id)"""


def _quality() -> str:
    end = quality.SENTENCE_END.replace("'", "''")
    # what is common to lines: a word, its size, its letters
    return rf"""
      WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
      g AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3)),
      twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
      rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
      l AS (SELECT doc_id, line, no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS no FROM t) WHERE regexp_matches(line, '{_WORD}')),
      r AS (SELECT doc_id, line, no, row_number() OVER (PARTITION BY doc_id, line ORDER BY no) AS nth,
                   len(regexp_extract_all(line, '{_WORD}')) AS n, length(line) AS size,
                   length(line) - length(translate(line, '{quality.SYMBOLS}', '')) AS symbols,
                   len(regexp_extract_all(line, '{quality.SEPARATORS}')) AS steps,
                   length(regexp_replace(line, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(line, '\P{{Lu}}+', '', 'g')) AS capitals
            FROM l),
      v AS (SELECT doc_id, n, nth > 1 AS dup, nth > 1
                OR (NOT regexp_matches(line, '{end}') AND (n <= 1 OR (n <= {quality.NAVIGATION_WORDS} AND steps >= 1) OR (n <= {quality.MENU_WORDS} AND steps >= 2)))
                OR (n <= 30 AND regexp_matches(lower(line), '{quality.BOILERPLATE}'))
                OR symbols * 10 > size OR (letters >= 20 AND capitals * 10 > letters * 8) OR letters * 3 < size - n AS fails FROM r),
      s AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS dup, count(*) FILTER (WHERE fails) AS removed,
                   coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS "left" FROM v GROUP BY doc_id),
      m AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
                   coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(removed, 0)::BIGINT AS n_lines_removed, coalesce("left", 0)::BIGINT AS n_words_left
            FROM t LEFT JOIN s ON s.doc_id = t.doc_id LEFT JOIN rep ON rep.doc_id = t.doc_id),
      b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM m)
      SELECT *, NOT base_failed AND n_words_left * 100 >= {quality.MIN_KEPT} * n_words AS kept FROM b"""


def _mixing() -> str:
    keys = ", ".join(mixing.DIMENSIONS)
    sql = rf"""
      WITH m AS (
        SELECT doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang, coalesce(text, '') AS text FROM documents),
      f AS (SELECT doc_id, source, lang, md5(coalesce(doc_id::VARCHAR, '{mixing.NONE}') || ':' || md5(text)) AS digest, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS n_tokens, length(text) AS size,
                   length(text) - length(replace(text, chr(10), '')) AS lines,
                   length(text) - length(translate(text, '{mixing.SYMBOLS}', '')) AS symbols FROM m),
      rows AS (SELECT doc_id, source, lang, n_tokens, digest,
                 CASE WHEN n_tokens < 50 THEN 'short' WHEN symbols * 50 > size THEN 'markup' WHEN lines * 25 > n_tokens THEN 'lines' ELSE 'prose' END AS topic FROM f),
      cells AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY {keys})"""
    for d in mixing.DIMENSIONS:
        sql += f""",
      by_{d} AS (SELECT {d}, pow(t, {mixing.TEMPER}) / sum(pow(t, {mixing.TEMPER})) OVER () * (SELECT sum(tokens) FROM cells) * {mixing.KEEP} AS target_{d}
                 FROM (SELECT {d}, sum(tokens) AS t FROM cells GROUP BY {d}))"""
    sql += """,
      w0 AS MATERIALIZED (SELECT *, tokens AS weight FROM cells""" + "".join(f" JOIN by_{d} USING ({d})" for d in mixing.DIMENSIONS) + ")"
    step = 0
    for _ in range(mixing.ROUNDS):
        for d in reversed(mixing.DIMENSIONS):
            sql += f""",
      w{step + 1} AS MATERIALIZED (SELECT * REPLACE (least(CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0
        THEN weight * target_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0 END, tokens) AS weight) FROM w{step})"""
            step += 1
    return sql + f"""
      SELECT doc_id, {keys}, n_tokens, round(weight, 3) AS weight, round(p, 9) AS probability,
             ('0x' || substr(digest, 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE < p AS kept
      FROM rows JOIN (SELECT {keys}, weight, CASE WHEN tokens > 0 THEN weight / tokens ELSE {mixing.KEEP} END AS p FROM w{step}) USING ({keys})"""


def _centroids() -> str:
    dim, k = centroid.DIM, centroid.CLUSTERS
    sql = f"""
      WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE len(embedding) = {dim}),
      kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda y: floor({centroid.SCALE} * y)::BIGINT) AS q FROM t
        WHERE len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = {dim}),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q AS m
        FROM kept ORDER BY c LIMIT {k})"""
    for i in range(centroid.ROUNDS + 1):
        sql += f""",
      a{i} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(range(1, {dim + 1}), lambda j: (q[j] - m[j]) * (q[j] - m[j]))), 'c': c}}) AS best
        FROM kept, c{i} GROUP BY r)"""
        if i < centroid.ROUNDS:
            sql += f""",
      s{i} AS (SELECT best.c AS c, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, {dim + 1}) AS u(j) GROUP BY ALL),
      f{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS moved FROM s{i} GROUP BY c),
      c{i + 1} AS MATERIALIZED (SELECT c, coalesce(moved, m) AS m FROM c{i} LEFT JOIN f{i} USING (c))"""
    last = centroid.ROUNDS
    return sql + f"""
      SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
             (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
      FROM a{last} JOIN kept USING (r) JOIN c{last} ON c = best.c"""


def _divergence() -> str:
    unit, prior = divergence.UNIT, divergence.PRIOR
    p = lambda n, total: f"1 + ({unit} * ({n} + {prior})::HUGEINT) // ({total} + {prior} * v)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
      WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
      w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
      kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCUMENTS}),
      langs AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
      g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
      n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
      cells AS (SELECT lang, source, term, v, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN n USING (lang, source, term)),
      p AS MATERIALIZED (SELECT lang, source, term, n, {p("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p FROM cells),
      l AS (SELECT lang, term, {p("n", "sum(n) OVER (PARTITION BY lang)")} AS q FROM (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM cells GROUP BY lang, term)),
      pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
      term AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
      found AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM term)
      SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
      WHERE part = 'pair' OR rank <= {divergence.TOP}"""


def statements() -> dict[str, str]:
    return {"op4_warc": _warc(), "op5_substring": _substring(), "op7_quality": _quality(), "op10_mixing": _mixing(),
            "op12_centroids": _centroids(), "op13_divergence": _divergence()}
