"""Queries over text: fingerprints, duplicates, lexical lanes, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import patterns as P
from ctxloom.functions import text as T
from ctxloom.operators.duplicates import marked_repeats
from ctxloom.operators.scoring import with_duplication
from ctxloom.operators.spread import spread_texts
from ctxloom.plans.registry import query, read
from ctxloom.sources import capabilities as K

#: SQL of the fingerprint text, volatile parts in the same order.
NORMAL = "lower(text)"
for _p in (r"(?i)\b\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(?:\.\d+)?z?", r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", r"(?i)\b0x[0-9a-f]+\b", r"(?i)\bat line \d+", r"(?i)\breq(?:uest)?[ _-]?id[:=] ?[^\s,]+", r"(?i)\btemp(?:orary)?[ _-]?(?:file|path)[:=] ?[^\s,]+"):
    NORMAL = f"regexp_replace({NORMAL}, '{_p}', ' ', 'g')"
NORMAL = f"regexp_replace(regexp_replace({NORMAL}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
FP = f"substr(sha1({NORMAL}), 1, 16)"
LINES = r"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, {FP} AS fp FROM documents")
def fingerprint_documents(spark, sf_dir):
    """X1 X2."""
    return read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))


@query(f"WITH f AS (SELECT doc_id, {FP} AS fp FROM documents) SELECT doc_id, row_number() OVER (PARTITION BY fp ORDER BY doc_id) > 1 AS is_repeat FROM f")
def exact_duplicates(spark, sf_dir):
    """The first of a fingerprint stays."""
    return marked_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), T.fingerprint(F.col("text")), "doc_id")


@query(f"WITH f AS (SELECT doc_id, {FP} AS fp FROM documents) SELECT fp, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM f GROUP BY fp HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """W3 U3."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))
    return docs.groupBy("fp").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n_docs > 1")


@query(
    f"""WITH f AS (SELECT doc_id, source, {FP} AS fp, list_distinct({LINES}) AS ls FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY doc_id) AS nth FROM f),
p AS (SELECT *, lag(ls) OVER (PARTITION BY source, nth > 1 ORDER BY doc_id) AS prev FROM r)
SELECT doc_id, CASE WHEN nth > 1 THEN 1.0 WHEN prev IS NULL THEN 0.0
  WHEN len(ls) = 0 AND len(prev) = 0 THEN 0.5
  ELSE floor(0.5 * len(list_intersect(ls, prev)) / (len(ls) + len(prev) - len(list_intersect(ls, prev))) * 1e6 + 0.5) / 1e6 END::DOUBLE AS duplication FROM p"""
)
def near_duplicates_line_jaccard(spark, sf_dir):
    """Documents as tool outputs, a source as a session and tool."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("session"), F.lit("tool-pair").alias("kind"))
    return with_duplication(docs, F.col("session"), "doc_id").select("doc_id", T.half_up(F.col("duplication"), 6).alias("duplication"))


@query("""SELECT event_id, event_type || ':' || substr(sha1(event_type || chr(0) || substr(regexp_replace(regexp_replace(lower(props), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 200)), 1, 8) AS group_key FROM events""")
def tool_group_key(spark, sf_dir):
    """X3 (event properties have no volatile parts)."""
    return read(spark, sf_dir, "events").select("event_id", T.tool_group_key(F.col("event_type"), F.col("props")).alias("group_key"))


def _texts(spark, sf_dir):
    return spread_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _lane(pattern: str, name: str, text: str = "text"):
    def run(spark, sf_dir):
        got = F.array_join(F.array_sort(T.found(F.expr(text), pattern)), "|")
        return _texts(spark, sf_dir).select("doc_id", F.explode(F.filter(F.array(got), lambda x: x != "")).alias("found"))

    run.__name__, run.__doc__ = name, "X6: sorted distinct matches."
    return run


#: The documents name no models and ports, so these lanes read text that does.
NAMED = "concat('model gpt-', doc_id % 10, 'o or llama-3-', doc_id % 7, 'b, host:', 8000 + doc_id % 100, ' ', text)"


def _lane_sql(pattern: str, text: str = "text") -> str:
    return f"WITH x AS (SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({text}, '{pattern}'))), '|') AS found FROM documents) SELECT * FROM x WHERE found <> ''"


query(_lane_sql(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"))(_lane(P.IP, "extract_ips"))
query(_lane_sql(r"\bv?\d+\.\d+(?:\.\d+)*(?:-[0-9A-Za-z.-]+)?\b"))(_lane(P.VERSION, "extract_versions"))
query(_lane_sql(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|\b[A-Z][A-Z0-9]{4,}\b"))(_lane(P.ERROR_CODE, "extract_error_codes"))
query(_lane_sql(r":\d{2,5}\b", NAMED))(_lane(P.PORT, "extract_ports", NAMED))
query(_lane_sql(r"\b[45]\d{2}\b"))(_lane(P.STATUS_CODE, "extract_status_codes"))
query(_lane_sql(r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+)+\b", NAMED))(_lane(P.MODEL_NAME, "extract_model_names", NAMED))
query(_lane_sql(r"\b[0-9a-f]{8,40}\b"))(_lane(P.HASH, "extract_hashes"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\b[A-Za-z_$][A-Za-z0-9_$]{2,}(?:[.-][A-Za-z0-9_$]+)*\b'), lambda s: regexp_replace(s, '^[.-]+|[.-]+$', '', 'g')))) AS s FROM documents)
SELECT doc_id, count(*) AS n_symbols, max(s) AS last_symbol FROM t WHERE length(s) >= 3 AND NOT list_contains(string_split('"""
    + P.KEYWORD_STOP
    + r"""', ' '), lower(s)) AND (regexp_matches(s, '[A-Z0-9_-]') OR (regexp_matches(s, '^[a-z][a-z0-9]*$') AND length(s) >= 5)) GROUP BY doc_id"""
)
def extract_symbols(spark, sf_dir):
    """X6e."""
    counted = lambda s: F.struct(F.size(s).cast("long").alias("n_symbols"), F.array_max(s).alias("last_symbol"))
    got = F.transform(F.array(T.symbols(F.col("text"))), counted)
    return _texts(spark, sf_dir).select("doc_id", F.inline(F.filter(got, lambda s: s["n_symbols"] > 0)))  # a filter on its own would find the symbols twice


@query(
    "WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z]{4,}'), lambda s: lower(s)))) AS s FROM documents) SELECT s AS keyword, count(*) AS n_docs FROM t WHERE NOT list_contains(string_split('"
    + P.KEYWORD_STOP
    + "', ' '), s) GROUP BY s"
)
def extract_keywords(spark, sf_dir):
    """X6k: documents by keyword."""
    got = read(spark, sf_dir, "documents").select(F.explode(T.keywords(F.col("text"))).alias("keyword"))
    return got.groupBy("keyword").agg(F.count("*").alias("n_docs"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url || ' ' || html, '\bhttps?://[^\s"''`<>]+'))), '|') AS urls, array_to_string(list_sort(list_distinct(regexp_extract_all(url || ' ' || html, '(?:/[A-Za-z0-9_.@-]+){2,}'))), '|') AS paths FROM pages""")
def extract_urls_paths(spark, sf_dir):
    """X6b X6c."""
    joined = lambda p: F.array_join(F.array_sort(T.found(F.concat("url", F.lit(" "), "html"), p)), "|")
    return read(spark, sf_dir, "pages").select("page_id", joined(P.URL).alias("urls"), joined(P.PATH_UNIX).alias("paths"))


FACT_SQL = " || ".join(
    f"regexp_extract_all(text, '{p}', {g})"
    for p, g in (
        (r"\d+(?:\.\d+)?\s?(?:ms|s|min|h|hours?|toks?/s|tokens?|chars?|characters?|lines?|files?|tests?|cases?|gb|mb|kb|percent|%|k\b|m\b)", 0),
        (r"[A-Za-z]:\\[^\s\"''`|<>]+", 0),
        (r"(?:/[A-Za-z0-9_.@-]+){2,}", 0),
        (r"\bhttps?://[^\s\"''`<>]+", 0),
        (r"\bv?\d+\.\d+(?:\.\d+)*(?:-[0-9A-Za-z.-]+)?\b", 0),
        (r"\b[0-9a-f]{8,40}\b", 0),
        (r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|\b[A-Z][A-Z0-9]{4,}\b", 0),
        (r"\b[45]\d{2}\b", 0),
        (r":\d{2,5}\b", 0),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0),
        (r"\b(?:REQ|DEC|TECH|BENCH|TASK|BLOCK|CMP|CONFLICT|STATE)-\d+\b", 0),
        (r"`([^`\n]{2,160})`", 1),
        (r"(?i)\bexit\s*code\s*:?\s*\d+", 0),
    )
)
# Relative paths need a look-behind, which this SQL lacks; the documents have none.


@query(f"WITH x AS (SELECT doc_id, list_distinct({FACT_SQL}) AS f FROM documents) SELECT doc_id, len(f) AS n_facts, array_to_string(list_sort(f), '|') AS facts FROM x WHERE len(f) > 0")
def exact_facts_per_document(spark, sf_dir):
    """X7."""
    told = lambda f: F.struct(F.size(f).cast("long").alias("n_facts"), F.array_join(F.array_sort(f), "|").alias("facts"))
    got = F.transform(F.array(T.exact_facts(F.col("text"))), told)
    return _texts(spark, sf_dir).select("doc_id", F.inline(F.filter(got, lambda f: f["n_facts"] > 0)))


@query(f"WITH x AS (SELECT DISTINCT source, unnest({FACT_SQL}) AS fact FROM documents) SELECT source, count(*) AS n_facts, min(fact) AS first_fact, max(fact) AS last_fact FROM x GROUP BY source")
def facts_by_source(spark, sf_dir):
    """Distinct facts of a group of texts."""
    got = read(spark, sf_dir, "documents").select("source", F.explode(T.exact_facts(F.col("text"))).alias("fact")).distinct()
    return got.groupBy("source").agg(F.count("*").alias("n_facts"), F.min("fact").alias("first_fact"), F.max("fact").alias("last_fact"))


@query(r"""WITH a AS (SELECT item_id, lower('error 404 in ' || text || ' at 52.31 tok/s via `npm run x` on qwen' || item_id || '-agent, see /srv/data/' || item_id || '/x.json v1.' || item_id || '.0') AS t FROM benchmark)
SELECT item_id, array_to_string(list_sort(list_distinct(
 regexp_extract_all(t, '\b\d+(?:\.\d+)?\s*(?:tok/s|tokens?/s|ms|us|gb|mb|tb|kb|ghz|mhz|hz|watts?|k|%)\b') || regexp_extract_all(t, '\bv?\d+(?:\.\d+)+(?:[-.][a-z0-9]+)*\b') ||
 regexp_extract_all(t, '\b[a-z]+\d+(?:-[a-z0-9]+)*\b') || regexp_extract_all(t, '\b[a-z]+-\d+[a-z]*(?:-\d+[a-z]*)*\b') || regexp_extract_all(t, '\b\d+(?:\.\d+)?\b') ||
 regexp_extract_all(t, '\b(?:error|err|exit\s*code|errno|code)[:\s=#-]*\d{1,6}\b') || regexp_extract_all(t, '`[^`\n]{3,}`') || regexp_extract_all(t, '(?:^|[\s"''`=:(<])((?:\.\.?/|/)[^\s"''`),;]+)', 1) ||
 regexp_extract_all(t, '\b(?:npm|pnpm|node|npx|git|docker|kubectl|cargo|make|pytest|python3?|go|bash|sh)\s+[a-z@][^\s"''`)]+'))), '|') AS atoms FROM a""")
def exact_atoms(spark, sf_dir):
    """X8, on text that holds atoms of most kinds."""
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("error 404 in "), F.col("text"), F.lit(" at 52.31 tok/s via `npm run x` on qwen"), i, F.lit("-agent, see /srv/data/"), i, F.lit("/x.json v1."), i, F.lit(".0"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.exact_atoms(text)), "|").alias("atoms"))


@query(r"""WITH x AS (SELECT conv_id, turn, length(text) AS n, length(regexp_replace(text, '[㐀-鿿぀-ヿ가-힯]', '', 'g')) AS o FROM conversations)
SELECT conv_id, turn, CAST(n - o + ceil(o / 4.0) AS BIGINT) AS tokens FROM x""")
def estimate_tokens(spark, sf_dir):
    """X13."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT conv_id, CAST(sum(ceil(length(text) / (CASE WHEN role = 'assistant' THEN 1.8 ELSE 4.0 END)) + 4 + 4) AS BIGINT) AS tokens, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS flat_tokens FROM conversations GROUP BY conv_id")
def calibrated_tokens(spark, sf_dir):
    """An assistant's text priced as code, four a block and four a message."""
    price = T.calibrated_tokens(F.col("text"), F.col("role") == "assistant") + 4
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(price).cast("long").alias("tokens"), F.sum(T.flat_tokens(F.col("text"))).alias("flat_tokens"))


_SAID = "CASE (conv_id + turn) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN ' Thanks! ' WHEN 2 THEN 'hello v2' WHEN 3 THEN '继续' WHEN 4 THEN text ELSE 'go ahead/now' END"


@query(f"WITH x AS (SELECT conv_id, turn, regexp_replace({_SAID}, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) SELECT conv_id, turn, length(t) <= 60 AND NOT regexp_matches(t, '\\d|`|/|\\\\') AND regexp_matches(t, '{P.GREETING}') AS greets FROM x")
def greeting_flags(spark, sf_dir):
    """X10."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_greeting(F.expr(_SAID)).alias("greets"))


_CJK = "'sk-' || doc_id || substr('记忆账本上下文窗口压缩决策', 1 + doc_id % 6, 2 + doc_id % 5) || ' and ' || substr('安全兼容目标', 1 + doc_id % 3, 1 + doc_id % 4) || text"


@query(f"WITH x AS (SELECT doc_id, list_distinct(flatten(list_transform(regexp_extract_all({_CJK}, '[㐀-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))) AS g FROM documents) SELECT doc_id, array_to_string(list_sort(g), '|') AS bigrams FROM x")
def cjk_bigrams(spark, sf_dir):
    """X6l: bigrams of CJK runs, in texts that have some."""
    got = T.cjk_bigrams(F.expr(_CJK))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(got), "|").alias("bigrams"))


_INFO = """CASE event_id % 7 WHEN 0 THEN '{"contextWindow": ' || (event_id * 8) || ', "maxTokens": 4096}' WHEN 1 THEN '{"context": {"maxContextTokens": ' || event_id || '}, "defaultMaxTokens": -5, "max_tokens": "77"}' WHEN 2 THEN '{"maxTokens": 5, "max_model_len": ' || event_id || '.5}'
 WHEN 3 THEN '{"max_tokens": 12}' WHEN 4 THEN '{"maxInputTokens": "' || (event_id + 9) || '", "output": {"maxOutputTokens": 8000}}' WHEN 5 THEN '{"contextWindow": 0, "maxModelLen": 9' || event_id || '}' ELSE 'broken' END"""


def _first(names: list[str]) -> str:
    number = lambda n: f"CASE WHEN json_valid(j) AND try_cast(json_extract_string(j, '$.{n}') AS DOUBLE) > 0 AND try_cast(json_extract_string(j, '$.{n}') AS DOUBLE) = floor(try_cast(json_extract_string(j, '$.{n}') AS DOUBLE)) THEN CAST(try_cast(json_extract_string(j, '$.{n}') AS DOUBLE) AS BIGINT) END"
    return "coalesce(" + ", ".join(number(n) for n in names) + ")"


@query(f"WITH x AS (SELECT event_id, {_INFO} AS j FROM events), y AS (SELECT event_id, {_first(K.INFO_WINDOW)} AS w, {_first(K.INFO_OUTPUT)} AS o FROM x) SELECT event_id, w AS context_window, CASE WHEN w IS NOT NULL THEN coalesce(o, 0) END AS max_tokens FROM y")
def model_capabilities(spark, sf_dir):
    """What adapters report, under any of their names."""
    return read(spark, sf_dir, "events").select("event_id", K.capability(F.expr(_INFO)).alias("c")).select("event_id", "c.context_window", "c.max_tokens")


_LISTED = """CASE event_id % 3 WHEN 0 THEN '{"data": [{"id": "other", "context_length": 1}, {"id": "m' || (event_id % 9) || '", "context_length": ' || (event_id + 7) || ', "top_provider": {"max_completion_tokens": 55}}]}'
 WHEN 1 THEN '{"models": {"m' || (event_id % 9) || '": {"limit": {"context": ' || (event_id + 3) || ', "output": 44}}}}' ELSE '{"data": [{"name": "m4", "max_input_tokens": ' || event_id || '}]}' END"""


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id + 7 WHEN 1 THEN event_id + 3 ELSE CASE WHEN event_id % 9 = 4 AND event_id > 0 THEN event_id END END AS context_window, CASE event_id % 3 WHEN 0 THEN 55 WHEN 1 THEN 44 ELSE CASE WHEN event_id % 9 = 4 AND event_id > 0 THEN 0 END END::BIGINT AS max_tokens FROM events")
def listed_capabilities(spark, sf_dir):
    """One model of a backend's listing."""
    got = K.listed_capability(F.expr(_LISTED), F.expr("concat('m', event_id % 9)"))
    return read(spark, sf_dir, "events").select("event_id", got.alias("c")).select("event_id", "c.context_window", "c.max_tokens")


_FAILED = "CASE event_id % 8 WHEN 0 THEN 'Context_length exceeded' WHEN 1 THEN 'the maximum supported context window is 8k' WHEN 2 THEN 'request exceeds the limit of this context' WHEN 3 THEN 'context of any length' WHEN 4 THEN 'prompt is too long' WHEN 5 THEN 'messages are too large for its context' WHEN 6 THEN 'context window limit exceeded' ELSE NULL END"


@query(rf"SELECT event_id, coalesce(regexp_matches({_FAILED}, '(?i)context[\s_-](?:length|window)[\s_-](?:exceed(?:ed|s)?|overflow(?:ed)?|limit[\s_-]exceeded)|maximum(?:\s+(?:allowed|supported))?\s+context\s+(?:length|window)|(?:input|prompt|request|messages?)\b.{{0,60}}\b(?:exceed(?:ed|s)?|too\s+(?:large|long))\b.{{0,60}}\bcontext\b'), false) AS overflow FROM events")
def overflow_messages(spark, sf_dir):
    """X23."""
    return read(spark, sf_dir, "events").select("event_id", T.is_overflow_message(F.expr(_FAILED)).alias("overflow"))


@query("SELECT source, count(*) AS n_docs, count(DISTINCT fp) AS n_texts FROM (SELECT source, " + FP + " AS fp FROM documents) GROUP BY source")
def repeat_rate_by_source(spark, sf_dir):
    """Texts and distinct fingerprints by source."""
    docs = read(spark, sf_dir, "documents").select("source", T.fingerprint(F.col("text")).alias("fp"))
    one = docs.groupBy("source", "fp").agg(F.count("*").alias("n"))
    return one.groupBy("source").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"))


@query("SELECT conv_id, substr(arg_max(text, turn) FILTER (role = 'user' AND turn % 5 <> 4 AND text <> ''), 1, 2000) AS said FROM conversations GROUP BY conv_id")
def last_user_messages(spark, sf_dir):
    """The last text that a user wrote; every fifth turn stands for a checkpoint and is passed over."""
    live = F.when((F.col("role") == "user") & (F.col("turn") % 5 != 4) & (F.col("text") != ""), F.col("turn"))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.substring(F.max_by("text", live), 1, 2000).alias("said"))


_SPELLED = "'Error E_ONE e_one ' || text || ' on 10.0.0.' || (doc_id % 9) || ':8' || (doc_id % 10) || '00 ran `make it` in 3' || (doc_id % 7) || ' MS'"


@query(f"WITH x AS (SELECT doc_id, {_SPELLED} AS t FROM documents) SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(t, ':(\\d{{2,5}})\\b', 1)), '|') AS ports, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b'))), '|') AS ips, array_to_string(list_distinct(regexp_extract_all(t, '`[^`\\n]{{2,160}}`')), '|') AS commands, list_contains(list_transform(regexp_extract_all(t, '(?i)\\d+(?:\\.\\d+)?\\s?(?:ms|s|min|h|hours?|toks?/s|tokens?|chars?|characters?|lines?|files?|tests?|cases?|gb|mb|kb|percent|%|k\\b|m\\b)'), lambda s: lower(s)), '3' || (doc_id % 7) || ' ms') AS took FROM x")
def extracted_lanes(spark, sf_dir):
    """X6 X6g X6i X6j X6m: ports, addresses, commands with their quotes, numbers of any case."""
    got = read(spark, sf_dir, "documents").select("doc_id", F.expr(_SPELLED).alias("said"))
    e = T.extracted(F.col("said"))  # as an expression, so that lanes nobody asks for aren't made
    joined = lambda k: F.array_join(F.sort_array(e[k]), "|")
    return got.select("doc_id", joined("ports").alias("ports"), joined("ips").alias("ips"), joined("commands").alias("commands"), F.exists(e["numbers"], lambda n: F.lower(n) == F.concat(F.lit("3"), F.col("doc_id") % 7, F.lit(" ms"))).alias("took"))
