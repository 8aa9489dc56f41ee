"""SQL twins of the registered queries, for an independent engine (DuckDB dialect).

Each statement starts from the raw tables and is written from the definition of its
operator, as range joins, windows and list functions rather than the plan Spark runs.
"""

from __future__ import annotations

import re
from itertools import cycle

from polysense.functions import draws
from polysense.plans.registry import (
    CHECK,
    CHECK_SD,
    EMBEDDING_DIM,
    FLOOR,
    LIMIT_LEN,
    LIMIT_SQ,
    MAX_LINES,
    MIX,
    RATIO,
    RUN,
    SHARDS,
    STEP,
    SYNONYM_WORD,
    TOP_K,
)
from polysense.sources.corpus import LINES_PER_DOC

P = draws.P
BIGINT_KEYS = ("line_id", "doc_id")  # keys that enter a draw in two parts
SEED, DIM, K, W = CHECK.seed, CHECK.dim, CHECK.num_negative, CHECK.window


def draw(source: str, name: str, seed: int, *keys: str) -> str:
    """``source`` with a column ``name``: the portable draw of the keys."""
    state = str(draws.start(seed))
    sql = f"(FROM {source})"
    parts = [part for k in keys for part in ((f"(({k})::BIGINT >> 31)", f"(({k})::BIGINT & {P})") if k in BIGINT_KEYS else (k,))]
    for i, (key, m) in enumerate(zip(parts, cycle(draws.MULTIPLIERS))):
        a, b, c, d = (f"{name}_{i}{x}" for x in "abcd")
        sql = f"(SELECT *, ({state} + (({key})::BIGINT % {P}) * {m}) % {P} AS {a} FROM {sql})"
        sql = f"(SELECT *, {a} * {a} % {P} AS {b} FROM {sql})"
        sql = f"(SELECT *, {b} * {b} % {P} AS {c} FROM {sql})"
        sql = f"(SELECT *, {c} * {a} % {P} AS {d} FROM {sql})"
        state = d
    return f"(SELECT *, {state} AS {name} FROM {sql})"


def second_draw(source: str, name: str, first: str) -> str:
    """``source`` with the draw that follows draw ``first``."""
    sql = f"(SELECT *, ({first} + {draws.MULTIPLIERS[0]}) % {P} AS {name}_a FROM {source})"
    sql = f"(SELECT *, {name}_a * {name}_a % {P} AS {name}_b FROM {sql})"
    sql = f"(SELECT *, {name}_b * {name}_b % {P} AS {name}_c FROM {sql})"
    return f"(SELECT *, {name}_c * {name}_a % {P} AS {name} FROM {sql})"


def u(col: str) -> str:
    return f"({col}::DOUBLE / {float(P)}::DOUBLE)"


def dot(a: str, b: str, dim: int = DIM) -> str:
    return "(" + " + ".join(f"{a}[{i}]::DOUBLE * {b}[{i}]::DOUBLE" for i in range(1, dim + 1)) + ")"


def long(source: str, keys: str, vec: str = "vec", digits: int = 6) -> str:
    return (f"SELECT {keys}, (i - 1)::INTEGER AS dim, round({vec}[i]::DOUBLE, {digits}) AS value "
            f"FROM {source}, (SELECT unnest(range(1, 1025)) AS i) WHERE i <= len({vec})")


LINES = f"""lines AS (
  SELECT doc_id * {LINES_PER_DOC} + (no - 1) AS line_id, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents))"""
TOKENS = LINES + """, tokens AS (
  SELECT line_id, (row_number() OVER (PARTITION BY line_id ORDER BY no) - 1)::INTEGER AS raw_pos, word FROM (
    SELECT line_id, no, lower(regexp_replace(piece, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g')) AS word FROM (
      SELECT line_id, unnest(string_split(line, ' ')) AS piece,
             generate_subscripts(string_split(line, ' '), 1) AS no FROM lines)) WHERE word <> '')"""
COUNTS = TOKENS + ", word_counts AS (SELECT word, count(*) AS cn FROM tokens GROUP BY word)"
T0, T1 = CHECK.thresholds
VOCAB = COUNTS + f""", vocab AS (
  SELECT (row_number() OVER (ORDER BY cn DESC, word) - 1)::INTEGER AS word_id, word, cn,
         CASE WHEN cn >= {T1} THEN 3 WHEN cn >= {T0} THEN 2 ELSE 1 END::INTEGER AS n_senses
  FROM word_counts WHERE cn >= {CHECK.min_count})"""
KEPT = VOCAB + """, kept AS (
  SELECT line_id, (row_number() OVER (PARTITION BY line_id ORDER BY raw_pos) - 1)::INTEGER AS pos, word_id, n_senses
  FROM tokens JOIN vocab USING (word))"""
OCC = KEPT + f""", occ AS (
  SELECT line_id, pos, word_id, n_senses, (d % n_senses)::INTEGER AS sense
  FROM {draw('kept', 'd', SEED + draws.SEED_SENSE, 'line_id', 'pos')})"""
NOISE_CTE = """, noise AS (
  SELECT word_id, n_senses, wt, (hi - wt)::BIGINT AS lo, hi, (max(hi) OVER ())::BIGINT AS total FROM (
    SELECT word_id, n_senses, wt, (sum(wt) OVER (ORDER BY word_id))::BIGINT AS hi FROM (
      SELECT word_id, n_senses, greatest(1, round(power(cn, 0.75) * 1000)::BIGINT) AS wt FROM vocab)))"""
NOISE = VOCAB + NOISE_CTE
_NEG_ROWS = "(SELECT o.line_id, o.pos, k, wt, lo, total FROM occ o JOIN noise USING (word_id), " \
            f"(SELECT unnest(range({K}))::INTEGER AS k))"
NEG_CTE = f""", neg AS (
  SELECT line_id, pos, k, n.word_id AS neg_word_id, (ds % n.n_senses)::INTEGER AS neg_sense FROM (
    SELECT *, CASE WHEN r >= lo THEN r + wt ELSE r END AS hit FROM (
      SELECT line_id, pos, k, wt, lo, ds, floor((dw::DOUBLE + {u('dx')}) / {float(P)}::DOUBLE * (total - wt))::BIGINT AS r FROM
        {second_draw(draw(draw(_NEG_ROWS, 'dw', SEED + draws.SEED_NEG_WORD, 'line_id', 'pos', 'k'), 'ds',
              SEED + draws.SEED_NEG_SENSE, 'line_id', 'pos', 'k'), 'dx', 'dw')} WHERE total > wt)) d
  ASOF JOIN noise n ON d.hit >= n.lo)"""
NEG = OCC + NOISE_CTE + NEG_CTE
SLOTS = ", slots AS (SELECT word_id, unnest(range(n_senses))::INTEGER AS sense FROM vocab)"


def _noise_vectors(source: str, seed: int, sd: float) -> str:
    """``(word_id, sense, i, e)``: component noise ``(U - 0.5) * sd / dim``."""
    state = draw(source, "s", seed, "word_id", "sense")
    m = draws.MULTIPLIERS[2]
    sql = f"(SELECT word_id, sense, i, (s + i * {m}) % {P} AS a FROM {state}, (SELECT unnest(range({DIM})) AS i))"
    sql = f"(SELECT *, a * a % {P} AS b FROM {sql})"
    sql = f"(SELECT *, b * b % {P} AS c FROM {sql})"
    return (f"(SELECT word_id, sense, i, ({u(f'(c * a % {P})')} - 0.5::DOUBLE) * {float(sd)}::DOUBLE "
            f"/ {float(DIM)}::DOUBLE AS e FROM {sql})")


def _model_part(table: str, seed: int, sd: float) -> str:
    return (f"SELECT '{table}' AS tbl, word_id, sense, list(e::FLOAT ORDER BY i) AS vec "
            f"FROM {_noise_vectors('slots', seed, sd)} GROUP BY word_id, sense")


MODEL_CTE = SLOTS + f""", model AS (
  {_model_part('in', SEED + draws.SEED_INIT_IN, CHECK_SD[0])} UNION ALL
  {_model_part('out', SEED + draws.SEED_INIT_OUT, CHECK_SD[1])})"""
MODEL = VOCAB + MODEL_CTE
NEAR = f"(SELECT unnest([{', '.join(str(d) for d in range(-W, W + 1) if d)}]) AS off)"
PAIRS_CTE = f""", pairs AS (
  SELECT a.line_id, a.pos, b.pos AS ctx_pos, a.word_id, a.sense, b.word_id AS ctx_word_id, b.sense AS ctx_sense
  FROM (SELECT *, pos + off AS at FROM occ, {NEAR}) a JOIN occ b ON a.line_id = b.line_id AND a.at = b.pos)"""


def scored_cte(occ: str = "occ") -> str:
    """Every (centre, context, item) with its dot product ``x``."""
    return f""", vecs AS (SELECT tbl, word_id, sense, vec::DOUBLE[{DIM}] AS vec FROM model),
targets AS (
  SELECT t.*, m.vec AS t_vec FROM (
    SELECT line_id, pos AS ctx_pos, 0 AS item, word_id AS t_word, sense AS t_sense FROM {occ} UNION ALL
    SELECT n.line_id, n.pos, n.k + 1, n.neg_word_id, n.neg_sense FROM neg n
      SEMI JOIN {occ} o ON n.line_id = o.line_id) t
  JOIN vecs m ON m.tbl = 'out' AND m.word_id = t.t_word AND m.sense = t.t_sense),
centres AS (
  SELECT c.line_id, c.pos, c.word_id, c.sense, m.vec, c.pos + off AS ctx_pos
  FROM {occ} c JOIN vecs m ON m.tbl = 'in' AND m.word_id = c.word_id AND m.sense = c.sense, {NEAR}),
scored AS (
  SELECT c.line_id, c.pos, c.ctx_pos, c.word_id, c.sense, c.vec, t.item, t.t_word, t.t_sense, t.t_vec,
         array_inner_product(c.vec, t.t_vec) AS x
  FROM centres c JOIN targets t ON c.line_id = t.line_id AND c.ctx_pos = t.ctx_pos),
bins AS (
  SELECT *, CASE WHEN x > 6 THEN 99999.0 WHEN x < -6 THEN 0.0
                 ELSE floor((x + 6.0::DOUBLE) * 8333.0::DOUBLE) END::DOUBLE AS bin FROM scored),
levels AS (SELECT *, exp((bin * 2.0::DOUBLE / 100000 - 1.0::DOUBLE) * 6.0::DOUBLE) AS e FROM bins),
losses AS (
  SELECT *, e / (e + 1.0::DOUBLE) AS p,
         -ln(CASE WHEN item = 0 THEN e / (e + 1.0::DOUBLE) ELSE 1.0::DOUBLE - e / (e + 1.0::DOUBLE) END) AS item_loss
  FROM levels)"""


SCORED = NEG + MODEL_CTE + scored_cte()
SOFT_CTE = """, tops AS (SELECT *, max(x) OVER (PARTITION BY line_id, pos, ctx_pos) AS top FROM scored),
soft AS (SELECT *, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY line_id, pos, ctx_pos) AS p FROM tops)"""


def _table_loss(x: str, true: bool) -> str:
    """Loss of one score by the sigmoid table."""
    at = f"CASE WHEN {x} > 6 THEN 99999.0 WHEN {x} < -6 THEN 0.0 ELSE floor(({x} + 6.0::DOUBLE) * 8333.0::DOUBLE) END::DOUBLE"
    e = f"exp(({at} * 2.0::DOUBLE / 100000 - 1.0::DOUBLE) * 6.0::DOUBLE)"
    p = f"({e} / ({e} + 1.0::DOUBLE))"
    return f"-ln({p if true else f'1.0::DOUBLE - {p}'})"


_WIDE = ", ".join(f"n{k}.vec AS t{k + 1}" for k in range(K))
_WIDE_JOINS = "".join(f"""
  LEFT JOIN (SELECT n.line_id, n.pos, m.vec FROM neg n JOIN vecs m ON m.tbl = 'out' AND m.word_id = n.neg_word_id AND m.sense = n.neg_sense
             WHERE n.k = {k}) n{k} ON n{k}.line_id = o.line_id AND n{k}.pos = o.pos""" for k in range(K))
_SCORES = ", ".join(f"array_inner_product(c.vec, t.t{k}) AS x{k}" for k in range(K + 1))
# one row per (candidate, context), all targets of a context side by side
CANDIDATES = NEG + MODEL_CTE + f""", vecs AS (SELECT tbl, word_id, sense, vec::DOUBLE[{DIM}] AS vec FROM model),
wide AS (
  SELECT o.line_id, o.pos AS ctx_pos, v.vec AS t0, {_WIDE}
  FROM occ o JOIN vecs v ON v.tbl = 'out' AND v.word_id = o.word_id AND v.sense = o.sense{_WIDE_JOINS}),
centres AS (
  SELECT c.line_id, c.pos, c.word_id, c.sense, m.vec
  FROM (SELECT line_id, pos, word_id, unnest(range(n_senses))::INTEGER AS sense FROM occ WHERE n_senses > 1) c
  JOIN vecs m ON m.tbl = 'in' AND m.word_id = c.word_id AND m.sense = c.sense),
scores AS (
  SELECT c.line_id, c.pos, c.word_id, c.sense, {_SCORES}
  FROM (SELECT *, pos + off AS ctx_pos FROM centres, {NEAR}) c JOIN wide t ON c.line_id = t.line_id AND c.ctx_pos = t.ctx_pos),
candidates AS (
  SELECT line_id, pos, word_id, sense, sum({' + '.join(f"coalesce({_table_loss(f'x{k}', k == 0)}, 0)" for k in range(K + 1))}) AS loss,
         {' + '.join(f'count(x{k})' for k in range(K + 1))} AS n FROM scores
  GROUP BY line_id, pos, word_id, sense)"""
ASSIGNED = CANDIDATES + """, best AS (
  SELECT line_id, pos, sense FROM candidates
  QUALIFY row_number() OVER (PARTITION BY line_id, pos ORDER BY loss, sense) = 1),
assigned AS (
  SELECT o.line_id, o.pos, o.word_id, o.sense AS old_sense, coalesce(b.sense, o.sense) AS sense
  FROM occ o LEFT JOIN best b ON o.line_id = b.line_id AND o.pos = b.pos)"""
_FREE = "(SELECT * FROM occ WHERE n_senses > 1 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY pos) = 1)"
# without a context every sense costs nothing, and the lowest is taken
SINGLE = CANDIDATES.replace("FROM occ WHERE n_senses > 1)", f"FROM {_FREE})") + f""", best AS (
  SELECT line_id, pos, sense FROM candidates QUALIFY row_number() OVER (PARTITION BY line_id, pos ORDER BY loss, sense) = 1)
  SELECT o.line_id, o.pos, o.word_id, CASE WHEN f.pos IS NULL THEN o.sense ELSE coalesce(b.sense, 0) END AS sense
  FROM occ o LEFT JOIN {_FREE} f ON o.line_id = f.line_id AND o.pos = f.pos LEFT JOIN best b ON o.line_id = b.line_id AND o.pos = b.pos"""
SCHEDULE = f"""{OCC}, ratio AS (SELECT least({RUN.validation_ratio}::DOUBLE, {float(RUN.max_validation_lines)}::DOUBLE / count(*)) AS ratio FROM lines),
  sizes AS (SELECT (s % {RUN.num_shards})::INTEGER AS shard, count(*) AS words
    FROM {draw(draw('occ', 'v', SEED + draws.SEED_SPLIT, 'line_id'), 's', SEED + draws.SEED_SHARD, 'line_id')}, ratio
    WHERE {u('v')} >= ratio GROUP BY ALL),
  its AS (SELECT i::INTEGER AS it, (i // {RUN.num_shards})::INTEGER AS epoch, (i % {RUN.num_shards})::INTEGER AS shard FROM (SELECT unnest(range({RUN.iterations})) AS i)),
  seen AS (SELECT it, epoch, shard, words, coalesce(sum(words) OVER (ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
                  (SELECT sum(words) FROM sizes)::DOUBLE * {RUN.num_epochs} AS total FROM its JOIN sizes USING (shard))
  SELECT it, epoch, shard, words, round(greatest({RUN.learn_rate}::DOUBLE * (1.0::DOUBLE - before / total), {RUN.learn_rate}::DOUBLE * 1e-4::DOUBLE), 12) AS lr,
         it % {RUN.validate_every} = 0 OR it = {RUN.iterations - 1} AS validated FROM seen"""
SENSE_COUNTS_CTE = """, cnts AS (
  SELECT s.word_id, s.sense, count(o.pos) AS cnt FROM slots s
  LEFT JOIN occ o ON o.word_id = s.word_id AND o.sense = s.sense GROUP BY s.word_id, s.sense)"""
STATS_CTE = SENSE_COUNTS_CTE + f""", stats AS (
  SELECT word_id, sense, cnt,
         CASE WHEN seen > 0 THEN p0 * power({CHECK.decay}::DOUBLE, seen)
                               + cnt / seen * (1 - power({CHECK.decay}::DOUBLE, seen)) ELSE p0 END AS prob
  FROM (SELECT word_id, sense, cnt, (sum(cnt) OVER (PARTITION BY word_id))::DOUBLE AS seen,
               1.0::DOUBLE / n_senses AS p0 FROM cnts JOIN vocab USING (word_id)))"""
SHARES_CTE = """, shares AS (
  SELECT word_id, sense, prob / sum(prob) OVER (PARTITION BY word_id) AS prob FROM stats
  QUALIFY count(*) OVER (PARTITION BY word_id) > 1)"""
_DONOR_ROWS = f"""(SELECT l.word_id, l.sense, d.sense AS donor, d.prob AS dp FROM shares l JOIN shares d
  ON l.word_id = d.word_id AND l.sense <> d.sense WHERE l.prob < {FLOOR})"""
DONORS_CTE = SHARES_CTE + f""", donors AS (
  SELECT word_id, sense, donor FROM {draw(_DONOR_ROWS, 'd', SEED + draws.SEED_DONOR, 'word_id', 'sense', 'donor')}
  QUALIFY row_number() OVER (PARTITION BY word_id, sense ORDER BY dp < {FLOOR},
    CASE WHEN dp >= {FLOOR} THEN -ln((d + 1.0::DOUBLE) / 2147483648.0::DOUBLE) / dp ELSE -dp END, donor) = 1)"""
STATS = OCC + SLOTS + STATS_CTE
GRAD_SIDES = "SELECT 'in' AS tbl, word_id, sense, g, t_vec AS v FROM weighted UNION ALL " \
             "SELECT 'out', t_word, t_sense, g, vec FROM weighted"
GRAD_CTE = f""", grads AS (
  SELECT tbl, word_id, sense, [{', '.join(f'sum(g * v[{i}]::DOUBLE)' for i in range(1, DIM + 1))}] AS grad
  FROM ({GRAD_SIDES}) GROUP BY tbl, word_id, sense)"""


def gradient(weight: str, source: str = "losses") -> str:
    return f", weighted AS (SELECT *, ({weight}) AS g FROM {source})" + GRAD_CTE


LABEL = "CASE WHEN item = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
EXACT_P = "1.0::DOUBLE / (1.0::DOUBLE + exp(-x))"
BY_WORD = "SELECT word_id, sense, count(*) AS n_pairs, sum(n)::BIGINT AS n, round(sum(loss), 4) AS loss, " \
          "round(max(loss), 6) AS max_loss FROM pair_losses GROUP BY word_id, sense"
SUMMARY = """SELECT round(coalesce(sum(loss), 0), 3) AS loss, coalesce(sum(n), 0)::BIGINT AS n,
  round(sum(loss) / nullif(sum(n), 0)::DOUBLE, 6) AS loss_per_prediction, count(*) AS sentences FROM sentences"""
SENTENCES = ", sentences AS (SELECT line_id, sum(item_loss) AS loss, count(*) AS n FROM losses GROUP BY line_id)"
SPLIT_CTE = f""", split AS (
  SELECT line_id, line, CASE WHEN {u('d')} < (SELECT least({RATIO}::DOUBLE, {float(MAX_LINES)}::DOUBLE / count(*)) FROM lines)
         THEN 'validation' ELSE 'train' END AS part
  FROM {draw('lines', 'd', SEED + draws.SEED_SPLIT, 'line_id')})"""
NORM_SQ = dot("vec", "vec")
LIMITED_CTE = f""", limited AS (
  SELECT tbl, word_id, sense, sq > {LIMIT_SQ} AS limited,
         CASE WHEN sq > {LIMIT_SQ} THEN list_transform(vec, lambda x: (x::DOUBLE * sqrt({LIMIT_SQ * 0.99}::DOUBLE / sq))::FLOAT)
              ELSE vec END AS vec
  FROM (SELECT *, {NORM_SQ} AS sq FROM model))"""
NAMED_CTE = ", named AS (SELECT word, sense, vec FROM model JOIN vocab USING (word_id) WHERE tbl = 'in')"
STORED_CTE = f""", stored AS (SELECT tbl, word_id, sense, vec FROM model JOIN vocab USING (word_id)
  WHERE cn > {CHECK.min_count} AND sense < 2)"""


def _warm_part(table: str, seed: int) -> str:
    return f"""SELECT '{table}' AS tbl, n.word_id, n.sense, n.i::INTEGER AS dim,
      CASE WHEN n.sense > 0 AND x.vec IS NOT NULL THEN x.vec[n.i + 1]
           WHEN b.vec IS NOT NULL THEN (b.vec[n.i + 1]::DOUBLE + n.e)::FLOAT ELSE 0 END::FLOAT AS value
    FROM {_noise_vectors('slots', seed, CHECK.sense_init_sd)} n
    LEFT JOIN stored b ON b.tbl = '{table}' AND b.word_id = n.word_id AND b.sense = 0
    LEFT JOIN stored x ON x.tbl = '{table}' AND x.word_id = n.word_id AND x.sense = n.sense"""


def _reset_part(table: str, seed: int) -> str:
    return f"""SELECT m.tbl, m.word_id, m.sense, d.donor IS NOT NULL AS was_reset, n.i::INTEGER AS dim,
      round(CASE WHEN d.donor IS NULL THEN m.vec[n.i + 1]
                 ELSE (s.vec[n.i + 1]::DOUBLE + n.e)::FLOAT END::DOUBLE, 6) AS value
    FROM model m JOIN {_noise_vectors('slots', seed, CHECK.sense_init_sd)} n
      ON m.word_id = n.word_id AND m.sense = n.sense
    LEFT JOIN donors d ON d.word_id = m.word_id AND d.sense = m.sense
    LEFT JOIN model s ON s.tbl = m.tbl AND s.word_id = d.word_id AND s.sense = d.donor WHERE m.tbl = '{table}'"""


def _top(queries: str, where: str, first: int, n: int) -> str:
    """Ranks first+1 .. first+n of every query row against all named vectors."""
    score = f"round({dot('q.vec', 'v.vec')} / sqrt({dot('v.vec', 'v.vec')}), 9)"
    return f"""SELECT q_word, q_sense, word, sense, round(score, 6) AS score, (rank - {first})::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY q_word, q_sense ORDER BY score DESC, word, sense) AS rank FROM (
        SELECT q.word AS q_word, q.sense AS q_sense, v.word, v.sense, {score} AS score
        FROM {queries} q, named v {where})) WHERE rank > {first} AND rank <= {first + n}"""


EMB = "emb AS (SELECT vec_id, label, embedding AS vec FROM embeddings)"
ED = EMBEDDING_DIM
ELEN = f"sqrt({dot('vec', 'vec', ED)})"
NEAR_CTE = f""", near AS (
  SELECT q_vec_id, vec_id, score, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY q_vec_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT a.vec_id AS q_vec_id, b.vec_id,
             round({dot('a.vec', 'b.vec', ED)} / (sqrt({dot('a.vec', 'a.vec', ED)}) * sqrt({dot('b.vec', 'b.vec', ED)})), 9) AS score
      FROM emb a, emb b WHERE a.vec_id <> b.vec_id)) WHERE rank <= {TOP_K})"""
QUERY_LIST = "[" + ", ".join(repr(1.0 / (i + 1)) + "::DOUBLE" for i in range(DIM)) + "]"
PAIR_DOT = dot("i.vec", "o.vec")


HELD_OUT_LOSS = f"""WITH {NEG} {MODEL_CTE} {SPLIT_CTE}, held AS (
    SELECT occ.* FROM occ SEMI JOIN (FROM split WHERE part = 'validation') v ON occ.line_id = v.line_id)
    {scored_cte('held')} {SENTENCES} {SUMMARY}"""


# rounded columns that can come out as negative zero, which Spark's round never returns
SIGNED = {
    "value": ("reset_low_prob_senses", "batch_gradient_sigmoid", "batch_gradient_sigmoid_table", "batch_gradient_by_group",
              "batch_gradient_softmax", "batch_gradient_softmax_by_group", "gradient_step", "average_models", "init_random",
              "limit_norm", "warm_start", "parameters_long", "parameters_wide", "save_load_model", "vectors_text_round_trip",
              "get_vectors", "lookup_vector", "l2_normalize", "limit_length", "vector_sum", "vector_mean_by_label",
              "center_vectors", "second_moment_matrix"),
    "score": ("find_synonyms_vector", "find_synonyms", "find_synonyms_batch", "pairwise_cosine_top"),
    "sum_dot": ("pair_vectors",),
}


#: tables that a statement uses several times are computed once
REUSED = re.compile(r"\b(vocab|occ|noise|neg|vecs|candidates) AS \(")


def statements() -> dict[str, str]:
    found = {name: REUSED.sub(r"\1 AS MATERIALIZED (", sql) for name, sql in _statements().items()}
    for column, names in SIGNED.items():
        for name in names:
            zero = f"CASE WHEN {column} = 0 THEN 0.0::DOUBLE ELSE {column} END AS {column}"
            found[name] = f"SELECT * REPLACE ({zero}) FROM ({found[name]})"
    return found


def _statements() -> dict[str, str]:
    keys = "tbl, word_id, sense"
    table_gradient = f"WITH {SCORED} {gradient(f'p - {LABEL}')} {long('grads', keys, 'grad', 4)}"
    soft_gradient = f"""WITH {SCORED} {SOFT_CTE} {gradient(f'p - {LABEL}', 'soft')} {long('grads', keys, 'grad', 4)}"""
    return {
        "corpus_lines": f"WITH {LINES} SELECT line_id, line FROM lines",
        "text_lines": f"WITH {LINES} SELECT line, count(*) AS n_lines, count(DISTINCT line_id) AS n_ids FROM lines GROUP BY line",
        "corpus_summary": f"""WITH {LINES} SELECT count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars,
            min(line_id) AS first_line_id, arg_min(line, line_id) AS first_line FROM lines""",
        "first_lines": f"WITH {LINES} SELECT line_id, line FROM lines ORDER BY line_id LIMIT 2",
        "tokenize": f"WITH {TOKENS} SELECT line_id, raw_pos, word FROM tokens",
        "word_count": f"WITH {COUNTS} SELECT word, cn FROM word_counts",
        "min_count": f"WITH {COUNTS} SELECT word, cn FROM word_counts WHERE cn >= {CHECK.min_count}",
        "count_spectrum": f"""WITH {COUNTS} SELECT cn, n_words, (sum(n_words) OVER (ORDER BY cn DESC))::BIGINT AS n_words_ge
            FROM (SELECT cn, count(*) AS n_words FROM word_counts GROUP BY cn)""",
        "count_spectrum_thinned": "WITH RECURSIVE " + COUNTS + """,
            spectrum AS (SELECT cn, n_words, (sum(n_words) OVER (ORDER BY cn DESC))::BIGINT AS n_words_ge,
                                (sum(n_words) OVER (ORDER BY cn))::BIGINT AS upto
                         FROM (SELECT cn, count(*) AS n_words FROM word_counts GROUP BY cn)),
            kept AS (SELECT min(cn) AS cn FROM spectrum UNION ALL
                     SELECT (SELECT min(s.cn) FROM spectrum s
                             WHERE s.cn > k.cn AND s.upto - (SELECT t.upto FROM spectrum t WHERE t.cn = k.cn)
                                   >= (SELECT max(n_words_ge) // 200 FROM spectrum))
                     FROM kept k WHERE k.cn IS NOT NULL)
            SELECT cn, n_words, n_words_ge FROM spectrum JOIN kept USING (cn)""",
        "corpus_totals": f"""WITH {COUNTS} SELECT count(*) AS raw_vocab,
            count(*) FILTER (cn >= {CHECK.min_count}) AS vocab_size,
            coalesce(sum(cn) FILTER (cn >= {CHECK.min_count}), 0)::BIGINT AS total_words FROM word_counts""",
        "build_vocab": f"WITH {VOCAB} SELECT word_id, word, cn FROM vocab",
        "senses_per_word": f"WITH {VOCAB} SELECT word, cn, n_senses FROM vocab",
        "sense_histogram": f"""WITH {VOCAB} SELECT s::INTEGER AS n_senses, count(word_id) AS n_words
            FROM (SELECT unnest(range(1, {CHECK.max_senses + 1})) AS s) LEFT JOIN vocab ON n_senses = s GROUP BY s""",
        "param_count": f"WITH {VOCAB} SELECT (sum(n_senses) * {2 * DIM})::BIGINT AS n_params FROM vocab",
        "filter_vocab": f"WITH {KEPT} SELECT line_id, pos, word_id, n_senses FROM kept",
        "encode_decode_ws": f"""WITH {OCC} SELECT word_id::BIGINT * 100 + sense AS ws, word_id, sense, count(*) AS n
            FROM occ GROUP BY word_id, sense""",
        "train_validation_split": f"WITH {LINES} {SPLIT_CTE} SELECT line_id, part FROM split",
        "validation_subset": f"WITH {LINES} {SPLIT_CTE} SELECT line_id, line FROM split WHERE part = 'validation'",
        "training_shards": f"""WITH {LINES} SELECT line_id, (d % {SHARDS})::INTEGER AS shard
            FROM {draw('lines', 'd', SEED + draws.SEED_SHARD, 'line_id')}""",
        "init_senses": f"WITH {OCC} SELECT line_id, pos, word_id, n_senses, sense FROM occ",
        "noise_distribution": f"WITH {NOISE} SELECT word_id, n_senses, wt, lo, hi, total FROM noise",
        "negative_samples": f"WITH {NEG} SELECT line_id, pos, k, neg_word_id, neg_sense FROM neg",
        "weighted_choice": f"""WITH items AS (
              SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
            weighted AS (SELECT doc_id, no::INTEGER AS line_no, length(line)::BIGINT AS weight FROM items WHERE line <> '')
            SELECT doc_id, line_no, weight FROM {draw('weighted', 'd', SEED + draws.SEED_CHOICE, 'doc_id', 'line_no')}
            QUALIFY row_number() OVER (PARTITION BY doc_id
              ORDER BY -ln((d + 1.0::DOUBLE) / 2147483648.0::DOUBLE) / weight, line_no) = 1""",
        "skipgram_pairs": f"""WITH {OCC} {PAIRS_CTE} SELECT word_id, sense, ctx_word_id, ctx_sense,
            CASE WHEN ctx_pos < pos THEN 'before' ELSE 'after' END AS side, count(*) AS n,
            sum(line_id % 1000003 + pos)::BIGINT AS check_sum FROM pairs GROUP BY ALL""",
        "pair_vectors": f"""WITH {OCC} {PAIRS_CTE} {MODEL_CTE}
            SELECT p.word_id, p.sense, count(*) AS n, round(sum({PAIR_DOT}), 4) AS sum_dot FROM pairs p
            JOIN model i ON i.tbl = 'in' AND i.word_id = p.word_id AND i.sense = p.sense
            JOIN model o ON o.tbl = 'out' AND o.word_id = p.ctx_word_id AND o.sense = p.ctx_sense
            GROUP BY p.word_id, p.sense""",
        "pair_loss_sigmoid": f"""WITH {SCORED}, pair_losses AS (
            SELECT line_id, pos, ctx_pos, word_id, sense, sum(item_loss) AS loss, count(*) AS n FROM losses
            GROUP BY line_id, pos, ctx_pos, word_id, sense) {BY_WORD}""",
        "pair_loss_softmax": f"""WITH {SCORED} {SOFT_CTE}, pair_losses AS (
            SELECT word_id, sense, -ln(p) AS loss, 1 AS n FROM soft WHERE item = 0) {BY_WORD}""",
        "sentence_loss": f"WITH {SCORED} {SENTENCES} SELECT line_id, round(loss, 6) AS loss, n FROM sentences",
        "loss_summary": f"WITH {SCORED} {SENTENCES} {SUMMARY}",
        "validation_loss": HELD_OUT_LOSS,
        "validation_loss_by_group": HELD_OUT_LOSS,
        "assign_senses_single": f"WITH {SINGLE}",
        "train_schedule": f"WITH {SCHEDULE}",
        "candidate_sense_loss": f"""WITH {CANDIDATES}
            SELECT line_id, pos, word_id, sense, round(loss, 6) AS loss, n FROM candidates""",
        "assign_senses_sync": f"WITH {ASSIGNED} SELECT line_id, pos, word_id, old_sense, sense FROM assigned",
        "adjust_rate": f"""WITH {ASSIGNED}, changed AS (
            SELECT line_id, max(CASE WHEN sense <> old_sense THEN 1 ELSE 0 END) AS c FROM assigned GROUP BY line_id)
            SELECT sum(c)::BIGINT AS adjusted, count(*) AS sentences, round(sum(c)::DOUBLE / count(*), 6) AS rate
            FROM changed""",
        "sense_counts": f"WITH {OCC} {SLOTS} {SENSE_COUNTS_CTE} SELECT word_id, sense, cnt FROM cnts",
        "update_sense_probs": f"WITH {STATS} SELECT word_id, sense, cnt, round(prob, 6) AS prob FROM stats",
        "sense_donors": f"WITH {STATS} {DONORS_CTE} SELECT word_id, sense, donor FROM donors",
        "reset_low_prob_senses": f"""WITH {OCC} {MODEL_CTE} {STATS_CTE} {DONORS_CTE}
            {_reset_part('in', SEED + draws.SEED_RESET_IN)} UNION ALL {_reset_part('out', SEED + draws.SEED_RESET_OUT)}""",
        "reset_summary": f"""WITH {STATS} {SHARES_CTE} SELECT count(*) AS multi_senses,
            count(*) FILTER (prob < {FLOOR}) AS resets FROM shares""",
        "batch_gradient_sigmoid": f"WITH {SCORED} {gradient(f'{EXACT_P} - {LABEL}')} {long('grads', keys, 'grad', 4)}",
        "batch_gradient_sigmoid_table": table_gradient,
        "batch_gradient_by_group": table_gradient,
        "batch_gradient_softmax": soft_gradient,
        "batch_gradient_softmax_by_group": soft_gradient,
        "gradient_step": f"""WITH {SCORED} {gradient(f'{EXACT_P} - {LABEL}')}, stepped AS (
            SELECT m.tbl, m.word_id, m.sense, i - 1 AS dim,
                   coalesce((m.vec[i]::DOUBLE - {STEP}::DOUBLE * g.grad[i])::FLOAT, m.vec[i]) AS value
            FROM model m LEFT JOIN grads g ON m.tbl = g.tbl AND m.word_id = g.word_id AND m.sense = g.sense,
                 (SELECT unnest(range(1, {DIM + 1})) AS i))
            SELECT tbl, word_id, sense, dim::INTEGER AS dim, round(value::DOUBLE, 4) AS value FROM stepped""",
        "average_models": f"""WITH {OCC} {MODEL_CTE}, shares AS (
            SELECT word_id, sense, count(*) AS n FROM occ GROUP BY word_id, sense)
            SELECT tbl, m.word_id, m.sense, (i - 1)::INTEGER AS dim,
                   round((vec[i]::DOUBLE + vec[i]::DOUBLE * coalesce(n, 0) * {STEP}::DOUBLE / {SHARDS})::FLOAT::DOUBLE, 4) AS value
            FROM model m LEFT JOIN shares s ON m.word_id = s.word_id AND m.sense = s.sense,
                 (SELECT unnest(range(1, {DIM + 1})) AS i)""",
        "init_random": f"WITH {MODEL} {long('model', keys)}",
        "limit_norm": f"WITH {MODEL} {LIMITED_CTE} {long('limited', keys + ', limited')}",
        "warm_start": f"""WITH {MODEL} {STORED_CTE} SELECT tbl, word_id, sense, dim, round(value::DOUBLE, 6) AS value FROM (
            {_warm_part('in', SEED + draws.SEED_WARM_IN)} UNION ALL {_warm_part('out', SEED + draws.SEED_WARM_OUT)})""",
        "warm_start_problems": f"""WITH {VOCAB} SELECT count(*) FILTER (n_senses IS NULL) AS unknown_word,
            count(*) FILTER (n_senses <= 1) AS sense_out_of_range, 0::BIGINT AS wrong_length
            FROM word_counts w LEFT JOIN vocab v ON w.word = v.word""",
        "parameters_long": f"""WITH {MODEL} SELECT
            CASE WHEN tbl = 'in' THEN 'syn0' ELSE 'syn1' END || '(w' || word_id || ',s' || sense || ',' || (i - 1) || ')' AS name,
            round(vec[i]::DOUBLE, 6) AS value FROM model, (SELECT unnest(range(1, {DIM + 1})) AS i)""",
        "parameters_wide": f"WITH {MODEL} {long('model', keys)}",
        "model_diff": f"""WITH {MODEL} {LIMITED_CTE} SELECT count(*) AS rows_a, count(*) AS rows_b, 0::BIGINT AS unmatched,
            count(*) FILTER (gap > 0) AS different, round(max(gap), 6) AS max_diff FROM (
              SELECT list_max(list_transform(range(1, {DIM + 1}), lambda i: abs(m.vec[i]::DOUBLE - l.vec[i]::DOUBLE))) AS gap
              FROM model m JOIN limited l ON m.tbl = l.tbl AND m.word_id = l.word_id AND m.sense = l.sense)""",
        "save_load_model": f"""WITH {MODEL}, saved AS (
            SELECT word, sense, vec FROM model JOIN vocab USING (word_id) WHERE tbl = 'out') {long('saved', 'word, sense')}""",
        "vectors_text_round_trip": f"WITH {MODEL} {NAMED_CTE} {long('named', 'word, sense')}",
        "word_index_lines": f"WITH {VOCAB} SELECT word || '_' || word_id || '_' || n_senses AS value FROM vocab",
        "word_index_round_trip": f"WITH {VOCAB} SELECT word, word_id, n_senses FROM vocab",
        "word2vec_text_round_trip": f"""WITH {MODEL} {NAMED_CTE}, plain AS (FROM named WHERE sense = 0)
            {long('plain', 'word')}""",
        "get_vectors": f"WITH {MODEL} {NAMED_CTE} {long('named', 'word, sense')}",
        "lookup_vector": f"""WITH {MODEL} {NAMED_CTE}, found AS (FROM named WHERE word = '{SYNONYM_WORD}')
            {long('found', 'word, sense')}""",
        "find_synonyms_vector": f"""WITH {MODEL} {NAMED_CTE}, ranked AS (
            SELECT word, sense, round({dot(QUERY_LIST, 'vec')} / sqrt({dot('vec', 'vec')}), 9) AS score FROM named)
            SELECT word, sense, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, word, sense LIMIT 10 OFFSET 1""",
        "find_synonyms": f"WITH {MODEL} {NAMED_CTE} " + _top("named", f"WHERE q.word = '{SYNONYM_WORD}'", 1, 10),
        "find_synonyms_batch": f"WITH {MODEL} {NAMED_CTE} " + _top("named", "", 1, TOP_K),
        "vector_norms": f"WITH {EMB} SELECT vec_id, round({ELEN}, 6) AS norm FROM emb",
        "l2_normalize": f"""WITH {EMB}, unit AS (SELECT vec_id, list_transform(vec, lambda x: x::DOUBLE / len) AS vec
            FROM (SELECT *, nullif({ELEN}, 0) AS len FROM emb)) {long('unit', 'vec_id')}""",
        "limit_length": f"""WITH {EMB}, cut AS (SELECT vec_id,
            list_transform(vec, lambda x: x::DOUBLE * least(1.0::DOUBLE, {LIMIT_LEN}::DOUBLE / len)) AS vec
            FROM (SELECT *, {ELEN} AS len FROM emb)) {long('cut', 'vec_id')}""",
        "vector_sum": f"""WITH {EMB} SELECT (SELECT count(*) FROM emb) AS n, (i - 1)::INTEGER AS dim,
            round(sum(vec[i]::DOUBLE), 6) AS value FROM emb, (SELECT unnest(range(1, {ED + 1})) AS i) GROUP BY i""",
        "vector_mean_by_label": f"""WITH {EMB} SELECT label, count(*) AS n, (i - 1)::INTEGER AS dim,
            round(avg(vec[i]::DOUBLE), 6) AS value FROM emb, (SELECT unnest(range(1, {ED + 1})) AS i) GROUP BY label, i""",
        "center_vectors": f"""WITH {EMB}, flat AS (SELECT vec_id, i, vec[i]::DOUBLE AS x
            FROM emb, (SELECT unnest(range(1, {ED + 1})) AS i))
            SELECT vec_id, (i - 1)::INTEGER AS dim, round(x - avg(x) OVER (PARTITION BY i), 6) AS value FROM flat""",
        "second_moment_matrix": f"""WITH {EMB}, dims AS (SELECT unnest(range(1, {ED + 1})) AS i)
            SELECT (a.i - 1)::INTEGER AS i, (b.i - 1)::INTEGER AS j, round(sum(vec[a.i]::DOUBLE * vec[b.i]::DOUBLE), 6) AS value
            FROM emb, dims a, dims b GROUP BY a.i, b.i""",
        "pairwise_cosine_top": f"WITH {EMB} {NEAR_CTE} SELECT q_vec_id, vec_id, round(score, 6) AS score, rank FROM near",
        "pair_metrics": f"""WITH {EMB}, m AS (
              SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.vec AS va, b.vec AS vb,
                     {dot('a.vec', 'b.vec', ED)} AS d, sqrt({dot('a.vec', 'a.vec', ED)}) * sqrt({dot('b.vec', 'b.vec', ED)}) AS len
              FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1)
            SELECT id_a, id_b, round(d, 6) AS dot,
              round(sqrt(list_sum(list_transform(range(1, {ED + 1}), lambda i: (va[i]::DOUBLE - vb[i]::DOUBLE) ** 2))), 6) AS distance,
              round(coalesce(d / nullif(len, 0), 0), 6) AS cosine,
              round(coalesce(acos(greatest(-1, least(1, d / nullif(len, 0)))), -1), 6) AS angle,
              round(d, 6) AS product_sum,
              round(list_sum(list_transform(range(1, {ED + 1}), lambda i: va[i]::DOUBLE * {1 - MIX}::DOUBLE + vb[i]::DOUBLE * {MIX}::DOUBLE)), 6)
                AS between_sum FROM m""",
        "affinity_normalize": f"""WITH {EMB} {NEAR_CTE}, edges AS (SELECT q_vec_id AS i, vec_id AS j, exp(score) AS p FROM near),
            both_ways AS (SELECT i, j, p FROM edges UNION ALL SELECT j, i, p FROM edges)
            SELECT i, j, round(greatest(sum(p) / 2 / (SELECT sum(p) FROM edges), 1e-100), 9) AS p FROM both_ways GROUP BY i, j""",
        "hardest_centre_words": f"""WITH {SCORED}, ranked AS (
              SELECT word, cn, count(*) AS n, round(sum(item_loss) / count(*), 6) AS mean_loss
              FROM losses JOIN vocab USING (word_id) GROUP BY word, cn)
            SELECT word, cn, n, mean_loss FROM ranked ORDER BY mean_loss DESC, word LIMIT 20""",
    }
