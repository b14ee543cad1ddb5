"""The SQL of ``op3_quality_rules``: measures by word lists, expectation-maximisation unrolled."""

from __future__ import annotations

from ctxloom.llm.quality import FIRST, FUNCTION_WORDS, KEEP, LEAST, MOST, ROUNDS, RULES, WINDOW

_MEASURES = rf"""
t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: {{'i': i, 'g': array_to_string(ws[i:i + {WINDOW - 1}], ' ')}})) AS x FROM w WHERE len(ws) >= {WINDOW}),
k AS (SELECT id, x.i AS i, count(*) OVER (PARTITION BY id, x.g) AS n FROM g),
p AS (SELECT id, count(*) AS n_repeat_words FROM (SELECT DISTINCT id, i + j AS at FROM k, range({WINDOW}) r(j) WHERE n > 1) GROUP BY id),
m AS (SELECT w.id, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words,
  len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;"'')][\x20\x09-\x0D]*$'))) AS n_ended,
  len(list_filter(ws, lambda x: regexp_matches(x, '[^\pL\pN\pM.,;:!?)\]}}"''’”»…。，！？、」』）-]$'))) AS n_marked,
  len(list_filter(ws, lambda x: regexp_matches(x, '^[^\pL\pN]+$'))) AS n_bare,
  len(list_distinct(list_transform(list_filter(ws, lambda x: regexp_matches(x, '(?is)^({FUNCTION_WORDS.replace(" ", "|")})([,.].*)?$')), lambda x: lower(regexp_extract(x, '^[A-Za-z]+'))))) AS n_function_words
  FROM w LEFT JOIN p ON w.id = p.id)"""

_VOTES = {
    "length": ("n_words >= 50", "n_words < 20"),
    "word_size": ("word_chars >= 3 * n_words AND word_chars <= 12 * n_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "marks": ("50 * n_marked <= n_words", "10 * n_marked > n_words"),
    "bare_words": ("50 * n_bare <= n_words", "10 * n_bare > n_words"),
    "same_lines": ("n_lines >= 3 AND 10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("100 * n_repeat_words <= 2 * n_words", "10 * n_repeat_words > n_words"),
    "endings": ("2 * n_ended >= n_lines", "10 * n_ended < n_lines"),
    "function_words": ("n_function_words >= 3", "n_function_words = 0 AND n_words >= 20"),
}


def _odds(names: list[str]) -> str:
    terms = (f"CASE WHEN v_{x} > 0 THEN ln(g_{x} / (1 - b_{x})) WHEN v_{x} < 0 THEN ln((1 - g_{x}) / b_{x}) ELSE 0 END" for x in names)
    return "ln(prior / (1 - prior)) + " + " + ".join(terms)


def _round(k: int, names: list[str]) -> str:
    clip = lambda x: f"least({MOST}, greatest({LEAST}, {x}))"
    hits = ", ".join(
        f"1 + coalesce(sum({share}) FILTER (v_{x} {sign} 0), 0) AS {name}_{x}" for x in names for name, share, sign in (("gr", "n * p", ">"), ("gw", "n * p", "<"), ("br", "n * (1 - p)", "<"), ("bw", "n * (1 - p)", ">"))
    )
    rates = ", ".join(f"{clip(f'gr_{x} / (gr_{x} + gw_{x})')} AS g_{x}, {clip(f'br_{x} / (br_{x} + bw_{x})')} AS b_{x}, {clip(f'(gr_{x} + bw_{x}) / (gr_{x} + gw_{x} + br_{x} + bw_{x})')} AS u_{x}" for x in names)
    useful = ", ".join(f"CASE WHEN g_{x} + b_{x} < 1 THEN u_{x} ELSE g_{x} END AS g_{x}, CASE WHEN g_{x} + b_{x} < 1 THEN 1 - u_{x} ELSE b_{x} END AS b_{x}" for x in names)
    return f"""
e{k} AS MATERIALIZED (SELECT sum(n) AS total, sum(n * p) AS good, {hits} FROM (SELECT c.*, 1 / (1 + exp(-({_odds(names)}))) AS p FROM c, r{k - 1}) s),
f{k} AS MATERIALIZED (SELECT least(0.99, greatest(0.01, (good + 1) / (total + 2))) AS prior, {rates} FROM e{k}),
r{k} AS MATERIALIZED (SELECT prior, {useful} FROM f{k})"""


def _sql() -> str:
    votes = ", ".join(f"CASE WHEN {_VOTES[x][0]} THEN 1 WHEN {_VOTES[x][1]} THEN -1 ELSE 0 END AS v_{x}" for x in RULES)
    first = ", ".join(f"{FIRST}::DOUBLE AS g_{x}, {FIRST}::DOUBLE AS b_{x}" for x in RULES)
    rounds = ",".join(_round(k, RULES) for k in range(1, ROUNDS + 1))
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return f"""WITH {_MEASURES},
v AS MATERIALIZED (SELECT {names}, {votes} FROM m),
c AS MATERIALIZED (SELECT {", ".join(f"v_{x}" for x in RULES)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
r0 AS MATERIALIZED (SELECT {FIRST}::DOUBLE AS prior, {first}),{rounds}
SELECT {names}, {failed} AS base_failed, NOT {failed} AND 1 / (1 + exp(-({_odds(RULES)}))) >= {KEEP} AS kept FROM v, r{ROUNDS}"""


OP3_SQL = _sql()
