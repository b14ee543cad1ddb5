"""Queries over the ledger: entries, citations, search, operations, provenance, retrieval, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import patterns as P
from ctxloom.functions import text as T
from ctxloom.operators import budget as B
from ctxloom.operators import coverage as C
from ctxloom.operators import ledger as L
from ctxloom.operators import provenance as W
from ctxloom.operators import prune as R
from ctxloom.operators import retrieval as V
from ctxloom.operators.spread import spread, spread_texts, tasks_for
from ctxloom.plans.registry import held, query, read
from ctxloom.plans.text_queries import FP
from ctxloom.sources import adapters as A


@query(f"WITH {A.LEDGER} SELECT file, place, id, title, confidence, status, fact AS facts, source FROM l")
def ledger_entries(spark, sf_dir):
    """L1."""
    got = L.entries(*A.dealt_lines(spark, sf_dir))
    return got.select("file", "place", "id", "title", "confidence", "status", F.array_join("facts", "|").alias("facts"), "source")


@query(f"WITH {A.LEDGER} SELECT id, file, status, title FROM l")
def ledger_index(spark, sf_dir):
    """L2."""
    return L.index(*A.dealt_lines(spark, sf_dir)).select("id", "file", "status", "title")


@query(f"WITH {A.LEDGER} SELECT file, place, id, '## [' || id || '] ' || title || chr(10) || '- confidence: ' || CASE WHEN key % 10 = 0 THEN '0' ELSE '0.' || (key % 10) END || chr(10) || '- status: ' || status || chr(10) || '- ' || fact || chr(10) || '- source: ' || source AS markdown FROM l")
def rendered_entries(spark, sf_dir):
    """L3: canonical Markdown of parsed entries."""
    return L.rendered(L.entries(*A.dealt_lines(spark, sf_dir)))


@query(f"WITH {A.LEDGER}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY place) AS k, count(*) OVER (PARTITION BY file) AS total FROM l) SELECT file, any_value(total) AS n_entries, string_agg(id, ', ' ORDER BY place) FILTER (k <= 8) || CASE WHEN any_value(total) > 8 THEN ' (+' || (any_value(total) - 8) || ' more)' ELSE '' END AS ids FROM n GROUP BY file")
def index_router(spark, sf_dir):
    """A8 K8."""
    return L.router(L.entries(*A.dealt_lines(spark, sf_dir)))


@query(f"WITH {A.LEDGER} SELECT id, 'DEC-' || (key - 1) AS cites FROM l WHERE key - 1 IN (SELECT key FROM l)")
def citations(spark, sf_dir):
    """J10."""
    return L.citations(L.index(*A.dealt_lines(spark, sf_dir)))


@query(f"WITH {A.LEDGER} SELECT 'DEC-' || (key - 1) AS id FROM l WHERE status = 'ACTIVE' AND key - 1 IN (SELECT key FROM l)")
def cited_by_active(spark, sf_dir):
    """J4 L13."""
    return L.cited_by_active(L.index(*A.dealt_lines(spark, sf_dir)))


@query(f"WITH {A.LEDGER}, x AS (SELECT file, place + 4 AS line_no, id AS entry_id, '- source: ' || source AS text FROM l UNION ALL SELECT file, place, id, '## [' || id || '] ' || title FROM l) SELECT * FROM x WHERE contains(lower(text), 'order') AND contains(text, '77') ORDER BY file, line_no LIMIT 50")
def memory_search(spark, sf_dir):
    """All words, in file and line order, at most 50 (the limit is the feature)."""
    return L.search(A.ledger_lines(spark, sf_dir), "ORDER 77", 50)


@query(f"WITH {A.LEDGER} SELECT file, place + 4 AS line_no, '- source: ' || source AS text FROM l WHERE id = 'DEC-42' UNION ALL SELECT file, place, '## [' || id || '] ' || title FROM l WHERE id = 'DEC-42' UNION ALL SELECT file, place + 1, '- confidence: 0.2' FROM l WHERE id = 'DEC-42' UNION ALL SELECT file, place + 2, '- status: ' || status FROM l WHERE id = 'DEC-42' UNION ALL SELECT file, place + 3, '- ' || fact FROM l WHERE id = 'DEC-42'")
def memory_read(spark, sf_dir):
    """L15 X22."""
    return L.section(A.ledger_lines(spark, sf_dir), "DEC-42")


_CHECKED = """q AS (SELECT o_orderkey AS key, o_orderkey // 100 AS batch, 'total ' || CAST(floor(o_totalprice) AS BIGINT) || ' for order ' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '9' ELSE '' END AS quote FROM orders),
g AS (SELECT o_orderkey // 100 AS batch, o_orderkey AS seq, 'we saw total ' || CAST(floor(o_totalprice) AS BIGINT) || ' for order ' || o_orderkey || ' today' AS t FROM orders),
h AS (SELECT q.key, any_value(q.quote) AS quote, count(g.seq) AS hits, min(g.seq) AS seq FROM q LEFT JOIN g ON q.batch = g.batch AND contains(g.t, q.quote) GROUP BY q.key),
e AS (SELECT key, quote, CASE WHEN key % 8 IN (6, 7) THEN NULL WHEN hits = 0 THEN 'EVIDENCE_NOT_FOUND' WHEN hits > 1 THEN 'AMBIGUOUS_EVIDENCE' END AS evidence_reason, CASE WHEN hits = 1 AND key % 8 < 6 THEN seq END AS evidence_seq FROM h)"""


def _proved(spark, sf_dir):
    ops = held(L.normalized(spread(A.ledger_ops(spark, sf_dir), "batch")))  # normalised once, for quotes and verdicts
    refs = spark.sql("SELECT batch, '' AS handle, seq, text FROM VALUES (0L, 0L, '') AS v (batch, seq, text) WHERE false")  # empty to the optimizer too, so nothing meets it
    return L.evidence(ops, A.ledger_log(spark, sf_dir), refs, held)


@query(f"WITH {_CHECKED} SELECT key AS idx, evidence_reason, evidence_seq FROM e")
def evidence_resolution(spark, sf_dir):
    """Quotes without a reference must stand in exactly one row."""
    return _proved(spark, sf_dir).select("idx", "evidence_reason", "evidence_seq")


@query("WITH b AS (SELECT item_id, text FROM benchmark), d AS (SELECT b.item_id, count(d.doc_id) AS n FROM b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id) SELECT item_id, n AS n_hits, CASE WHEN n = 0 THEN 'EVIDENCE_NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS_EVIDENCE' ELSE 'OK' END AS verdict FROM d")
def ambiguous_quotes(spark, sf_dir):
    """Benchmark items as quotes from documents; the quotes are the small, size-checked side."""
    from ctxloom.operators.contains import contained

    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    hits = contained(rows, quotes).groupBy("quote_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return quotes.join(hits, "quote_id", "left").select(F.col("quote_id").alias("item_id"), n.alias("n_hits"), F.when(n == 0, "EVIDENCE_NOT_FOUND").when(n > 1, "AMBIGUOUS_EVIDENCE").otherwise("OK").alias("verdict"))


_ATOMS = r"list_distinct(list_transform(regexp_extract_all({t}, '\b\d+(?:\.\d+)?\s*(?:tok/s|tokens?/s|ms|us|gb|mb|tb|kb|ghz|mhz|hz|watts?|k|%)\b') || regexp_extract_all({t}, '\bv?\d+(?:\.\d+)+(?:[-.][a-z0-9]+)*\b') || regexp_extract_all({t}, '\b\d+(?:\.\d+)?\b'), lambda a: trim(a)))"


@query(f"WITH p AS (SELECT p_partkey, 'limit ' || p_partkey || ' ms' AS old, CASE WHEN p_partkey % 3 = 0 THEN 'limit ' || p_partkey || ' ms' ELSE 'limit ' || p_partkey || '.5 ms' END AS new, CASE WHEN p_partkey % 3 = 2 THEN 'measured ' || p_partkey || '.5 ms today' ELSE 'nothing' END AS proof FROM part), q AS (SELECT p_partkey, list_filter({_ATOMS.format(t='new')}, lambda a: NOT list_contains({_ATOMS.format(t='old')}, a) AND NOT contains(proof, a)) AS lost FROM p) SELECT p_partkey, array_to_string(list_sort(lost), '|') AS missing, len(lost) = 0 AS passes FROM q")
def mutation_guard(spark, sf_dir):
    """A changed number needs evidence."""
    k = F.col("p_partkey").cast("string")
    old = F.concat(F.lit("limit "), k, F.lit(" ms"))
    new = F.when(F.col("p_partkey") % 3 == 0, old).otherwise(F.concat(F.lit("limit "), k, F.lit(".5 ms")))
    proof = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("measured "), k, F.lit(".5 ms today"))).otherwise("nothing")
    lost = L.unbacked(new, old, proof)
    parts = spread(read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", lost.alias("lost"))
    return parts.select("p_partkey", F.array_join(F.array_sort("lost"), "|").alias("missing"), (F.size("lost") == 0).alias("passes"))


_VALID = f"""{_CHECKED}, o AS (SELECT o_orderkey AS key, o_orderkey // 100 AS batch, o_orderkey % 8 AS k, o_orderkey % 5 = 0 AS atoms, CASE WHEN o_orderkey % 3 = 0 THEN 'TX-' || (o_orderkey // 10) END AS grp FROM orders),
t AS (SELECT o_orderkey + 1 AS key, o_orderstatus AS st FROM orders),
r AS (SELECT o.*, e.quote, CASE WHEN k = 6 THEN 'BAD_OPERATION' WHEN k IN (1, 2, 4) AND t.st IS NULL THEN 'TARGET_NOT_FOUND' WHEN k IN (1, 2, 4) AND t.st <> 'F' THEN 'TARGET_NOT_ACTIVE'
  WHEN e.evidence_reason IS NOT NULL THEN e.evidence_reason WHEN k IN (0, 1, 2, 3) AND atoms THEN 'MUTATION_WITHOUT_EVIDENCE' END AS reason FROM o LEFT JOIN t ON o.key = t.key JOIN e ON o.key = e.key),
a AS (SELECT *, coalesce(reason, CASE WHEN grp IS NOT NULL AND bool_or(reason IS NOT NULL) OVER (PARTITION BY batch, grp) THEN 'GROUP_REJECTED' END) AS final FROM r),
p AS (SELECT *, CASE WHEN k = 3 THEN 'CONFLICT' WHEN key % 16 = 1 THEN 'REQ' ELSE 'DEC' END AS prefix FROM a WHERE final IS NULL AND k IN (0, 1, 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY batch, key) AS nth FROM p),
m AS (SELECT *, prefix || '-' || CASE WHEN prefix = 'DEC' THEN CAST(nth + (SELECT max(o_orderkey) FROM orders) AS VARCHAR) WHEN nth < 1000 THEN printf('%03d', nth) ELSE CAST(nth AS VARCHAR) END AS new_id FROM n),
c AS (SELECT key, CASE WHEN key % 5 = 0 THEN 'limit ' || key || '77 ms' WHEN key % 5 = 1 THEN 'about order ' || key ELSE 'no numbers here' END AS body FROM o)"""


def _judged(spark, sf_dir, found=None, only=None):
    """Verdicts on all operations; ``only`` names what is read of them later, so that nothing else is carried and held."""
    found = L.entries(*A.dealt_lines(spark, sf_dir)) if found is None else found
    tasks = tasks_for(read(spark, sf_dir, "orders"))
    judged = L.validated(_proved(spark, sf_dir), found, tasks)
    return held(L.atomic(judged.select(*only) if only else judged, tasks))


@query(f"WITH {_VALID} SELECT key AS idx, final AS reason FROM a")
def group_atomicity(spark, sf_dir):
    """Only ACTIVE targets, evidence of the replacement, exact values in the evidence's row."""
    return _judged(spark, sf_dir, only=["batch", "idx", "grp", "reason"]).select("idx", "reason")


@query(f"WITH {_VALID} SELECT key AS idx, new_id FROM m")
def id_minting(spark, sf_dir):
    """New entries, replacements and conflicts."""
    kind = F.struct("replacement.kind").alias("replacement")
    judged = _judged(spark, sf_dir, only=["batch", "idx", "op", "kind", kind, "grp", "reason"])
    return L.minted(judged, A.ledger_lines(spark, sf_dir)).where("new_id is not null").select("idx", "new_id")


@query(
    f"""WITH {_VALID}, {A.LEDGER}, u AS (SELECT a.key - 1 AS target, a.k, a.key AS op, a.quote, c.body, m.new_id FROM a JOIN c ON a.key = c.key LEFT JOIN m ON a.key = m.key WHERE a.final IS NULL AND a.k IN (1, 2, 4)),
z AS (SELECT max(key) AS key FROM a WHERE final IS NULL AND k = 7),
x AS (SELECT l.id, l.file, CASE WHEN u.k = 2 THEN 'order ' || u.op ELSE l.title END AS title, l.confidence, CASE u.k WHEN 1 THEN 'SUPERSEDED' WHEN 4 THEN 'RESOLVED' ELSE l.status END AS status, CASE WHEN u.k = 2 THEN u.body ELSE l.fact END AS facts,
  CASE WHEN u.k IN (2, 4) THEN u.quote ELSE l.source END AS source, CASE WHEN u.k = 1 THEN u.new_id END AS replacement, CASE WHEN u.k = 4 THEN 'settled ' || u.op END AS resolution, NULL AS verbatim FROM l LEFT JOIN u ON l.key = u.target
 UNION ALL SELECT new_id, CASE prefix WHEN 'DEC' THEN 'DECISIONS.md' WHEN 'REQ' THEN 'PROJECT.md' ELSE 'CONFLICTS.md' END, CASE k WHEN 0 THEN 'order ' WHEN 1 THEN 'instead ' ELSE 'topic ' END || m.key, CASE WHEN k = 1 THEN 0.95 ELSE 0.8 END::DOUBLE, 'ACTIVE', c.body, m.quote, NULL, NULL, NULL FROM m JOIN c ON m.key = c.key
 UNION ALL SELECT 'STATE-CURRENT', 'STATE.md', 'order ' || key, NULL, NULL, '', NULL, NULL, NULL, 'state at ' || key || chr(10) || 'next' FROM z WHERE key IS NOT NULL)
SELECT * FROM x"""
)
def apply_ops(spark, sf_dir):
    """The whole ledger once the accepted operations are applied."""
    found = held(L.entries(*A.dealt_lines(spark, sf_dir)).drop("raw"))  # parsed once for its targets and for what stays
    after = L.applied(found, L.minted(_judged(spark, sf_dir, found), A.ledger_lines(spark, sf_dir)))
    return after.select("id", "file", "title", "confidence", "status", F.array_join("facts", "|").alias("facts"), "source", "replacement", "resolution", "verbatim")


@query(f"WITH {A.LEDGER}, b AS (SELECT *, key % 10 IN (2, 3) AS gone, key % 10 = 4 AS twice, key % 10 = 5 OR status = 'SUPERSEDED' AS marked FROM l) SELECT id, 'SILENT_REMOVAL' AS issue FROM b WHERE gone AND key + 1 NOT IN (SELECT key FROM b WHERE NOT gone) UNION ALL SELECT id, 'DUPLICATE_ID' FROM b WHERE twice UNION ALL SELECT id, 'SUPERSEDED' FROM b WHERE marked AND NOT gone UNION ALL SELECT 'STATE-CURRENT', 'STATE_MISSING'")
def integrity_issues(spark, sf_dir):
    """An altered ledger against the one before; what others still cite was moved, not lost."""
    return L.integrity(*_altered(spark, sf_dir))


def _altered(spark, sf_dir):
    before = held(L.entries(*A.dealt_lines(spark, sf_dir)).drop("raw"))  # parsed once for both sides
    key = F.substring_index("id", "-", -1).cast("long") % 10
    kept = before.where(~key.isin(2, 3)).withColumn("status", F.when(key == 5, "SUPERSEDED").otherwise(F.col("status")))
    return before, kept.unionByName(before.where(key == 4))


@query(f"WITH {A.LEDGER}, b AS (SELECT *, key % 10 IN (2, 3) AS gone, key % 10 = 4 AS twice FROM l), k AS (SELECT id, CASE WHEN key % 10 = 5 THEN 'SUPERSEDED' ELSE status END AS status FROM b WHERE NOT gone UNION ALL SELECT id, status FROM b WHERE twice UNION ALL SELECT id, status FROM b WHERE gone AND key + 1 NOT IN (SELECT key FROM b WHERE NOT gone)) SELECT id, status, count(*) AS n FROM k GROUP BY id, status UNION ALL SELECT 'STATE-CURRENT', NULL, 1")
def restored_entries(spark, sf_dir):
    """Silently removed entries put back, a placeholder for the state."""
    before, after = _altered(spark, sf_dir)
    return spread(L.restored(before, after), "id", tasks=tasks_for(before)).groupBy("id", "status").agg(F.count("*").alias("n"))


_BOUND = "b AS (SELECT o_custkey AS session, o_orderkey AS seq, 'DEC-' || o_orderkey AS entry_id FROM orders WHERE o_orderkey % 5 <> 0)"


@query(f"WITH {A.LEDGER}, {_BOUND}, f AS (SELECT 'DEC-' || o_orderkey AS entry_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ambiguous' END AS reason FROM orders WHERE o_orderkey % 7 = 0) SELECT l.id, coalesce(f.reason, 'unbound') AS reason FROM l LEFT JOIN f ON l.id = f.entry_id WHERE l.status = 'ACTIVE' AND (f.entry_id IS NOT NULL OR l.id NOT IN (SELECT entry_id FROM b))")
def unresolved_active(spark, sf_dir):
    """J16 O8."""
    orders = read(spark, sf_dir, "orders")
    entry = F.concat(F.lit("DEC-"), F.col("o_orderkey")).alias("entry_id")
    bound = orders.where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seq"), entry)
    flagged = orders.where("o_orderkey % 7 = 0").select(entry, F.when(F.col("o_orderkey") % 2 == 0, "ambiguous").alias("reason"))
    return L.unresolved_active(L.entries(*A.dealt_lines(spark, sf_dir)), bound, flagged)


@query(f"WITH {A.LEDGER}, old AS (SELECT doc_id % 50 AS session, doc_id AS seq, 'DEC-' || (doc_id % 400) AS entry_id FROM labels WHERE quality = 1), fresh AS (SELECT doc_id % 50, doc_id, 'DEC-' || (doc_id % 400) FROM labels WHERE toxic = 1), b AS (SELECT * FROM old UNION SELECT * FROM fresh) SELECT session, count(*) AS n_bound, count(DISTINCT entry_id) AS n_entries FROM b GROUP BY session")
def provenance_merge(spark, sf_dir):
    """U4: bindings of labels, old and fresh, merged."""
    labels = read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("session"), F.col("doc_id").alias("seq"), F.concat(F.lit("DEC-"), F.col("doc_id") % 400).alias("entry_id"), "quality", "toxic")
    none = spark.createDataFrame([], "entry_id string, reason string, at string")
    bound, _ = L.provenance_merged(labels.where("quality = 1").drop("quality", "toxic"), labels.where("toxic = 1").drop("quality", "toxic"), none, none, L.entries(*A.dealt_lines(spark, sf_dir)))
    return bound.groupBy("session").agg(F.count("*").alias("n_bound"), F.countDistinct("entry_id").alias("n_entries"))


@query("WITH f AS (SELECT l.doc_id % 20 AS region, CASE WHEN l.quality = 1 THEN 'P0' ELSE 'P1' END AS grade, b.text AS fact FROM labels l JOIN benchmark b ON l.doc_id % 40 = b.item_id), s AS (SELECT doc_id % 20 AS region, string_agg(text, chr(10)) AS summary FROM documents GROUP BY 1), k AS (SELECT f.*, contains(s.summary, f.fact) AS kept FROM f JOIN s ON f.region = s.region) SELECT region, CASE WHEN count(*) FILTER (grade = 'P0') = 0 THEN 1.0::DOUBLE ELSE CAST(floor(count(*) FILTER (grade = 'P0' AND kept) * 1e6 / count(*) FILTER (grade = 'P0') + 0.5) / 1e6 AS DOUBLE) END AS p0_share, count(*) FILTER (NOT kept) AS n_missing FROM k GROUP BY region")
def coverage_check(spark, sf_dir):
    """Benchmark items as facts, the documents of a region as the parts of its summary."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("fact"))
    labels = read(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("region"), F.when(F.col("quality") == 1, "P0").otherwise("P1").alias("grade"), (F.col("doc_id") % 40).alias("item_id"))
    parts = read(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("region"), "text")
    return C.coverage(C.covered_by_parts(labels.join(items, "item_id"), parts)).select("region", T.half_up(F.col("p0_share"), 6).alias("p0_share"), "n_missing")


@query("SELECT o_orderkey, CAST(greatest(0, least(greatest(1, 1000 + o_orderkey), 200016 - CAST(floor(o_totalprice) AS BIGINT) - 2048)) AS BIGINT) AS safe, CAST(floor(o_totalprice) AS BIGINT) + 1000 + o_orderkey + 2048 > 200016 AS compacts FROM orders")
def safe_output_budget(spark, sf_dir):
    """F12 T8."""
    used, asked = F.floor("o_totalprice"), F.col("o_orderkey") + 1000
    return read(spark, sf_dir, "orders").select("o_orderkey", B.safe_output(F.lit(200016), used, asked, F.lit(2048)).alias("safe"), B.needs_compaction(F.lit(200016), used, asked, F.lit(2048)).alias("compacts"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2000 END AS target, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 9000 END AS most, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 200) / 100.0 END AS threshold FROM orders)
SELECT o_orderkey, concat_ws('|', CASE WHEN target < 1024 THEN 'targetContextTokens' END, CASE WHEN most < 1 OR most > 8192 THEN 'maxOutputTokens' END, CASE WHEN 2048 >= least(coalesce(target, 128000), 128000) THEN 'safetyMarginTokens' END,
 CASE WHEN NOT (most < 1 OR most > 8192) AND most > least(coalesce(target, 128000), 128000) - 2048 THEN 'maxOutputTokens' END, CASE WHEN threshold < 0.05 OR threshold > 0.99 THEN 'thresholdRatio' END) AS errors FROM s""")
def route_validation(spark, sf_dir):
    """Every broken field, in the order of the rules."""
    k = F.col("o_orderkey")
    none = F.lit(None)
    s = {"target": F.when(k % 3 == 0, k % 2000), "most": F.when(k % 4 == 0, k % 9000), "margin": none.cast("long"), "threshold": F.when(k % 5 == 0, (k % 200) / 100.0), "retain_ratio": none.cast("double"), "retain": none.cast("long"), "retries": none.cast("long"), "overflow_retries": none.cast("long")}
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(B.route_errors(F.lit(128000), F.lit(8192), s), "|").alias("errors"))


_TOLD = "CASE (conv_id * 7 + turn) % 12 WHEN 0 THEN 'please summarize the project' WHEN 1 THEN 'the goal is speed' WHEN 2 THEN 'redesign the project plan' WHEN 3 THEN 'where are we with this' WHEN 4 THEN 'fix the repo' WHEN 5 THEN 'thanks!' WHEN 6 THEN 'why does TECH-001 say so, see dec-0000' WHEN 7 THEN 'compare DEC-000 and req-002' WHEN 8 THEN 'what is the goal is to know' WHEN 9 THEN 'implement this in the project' ELSE text END"

#: Terms of the ledger's ACTIVE entries, and what messages hold of them.
_VOCAB = f"""{A.ITEMS}, v AS (SELECT id, file, place, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(lower(title || chr(10) || raw), '[a-z0-9][a-z0-9+#._-]{{2,}}'), lambda t: regexp_replace(t, '^[.+_-]+|[.+_-]+$', '', 'g')), lambda t: length(t) >= 3 AND NOT list_contains(string_split('{P.LEDGER_STOP}', ' '), t)))) AS term FROM x WHERE status = 'ACTIVE'),
ids AS (SELECT DISTINCT unnest(regexp_extract_all(raw, '\\b[A-Z]{{2,10}}-\\d{{3}}\\b')) AS id FROM x),
w AS (SELECT conv_id, turn, {_TOLD} AS text, lower({_TOLD}) AS low FROM conversations),
y AS (SELECT w.conv_id, w.turn, t.term FROM w JOIN (SELECT DISTINCT term FROM v) t ON contains(w.low, t.term)),
j AS (SELECT w.conv_id, w.turn, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(upper(text), '\\b[A-Z]{{2,10}}-\\d{{3}}\\b'))) AS id FROM w) w WHERE id IN (SELECT id FROM ids) GROUP BY 1, 2)"""
_WORD_END = "(?![A-Za-z0-9_])"
_ASKS = P.INTENT_QUESTION.replace(_WORD_END, r"\b")
_CLASSED = f"""{_VOCAB}, s AS (SELECT w.*, coalesce(y.n, 0) AS n_terms, coalesce(j.n, 0) AS n_ids FROM w LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM y GROUP BY 1, 2) y ON w.conv_id = y.conv_id AND w.turn = y.turn LEFT JOIN j ON w.conv_id = j.conv_id AND w.turn = j.turn),
d AS (SELECT *, CASE WHEN regexp_matches(low, '{P.INTENT_FULL}') OR n_ids >= 2 OR n_terms >= 6 THEN 'C5' WHEN regexp_matches(low, '{P.INTENT_GOAL}') THEN CASE WHEN regexp_matches(low, '{_ASKS}') THEN 'C3' ELSE 'C4' END
 WHEN regexp_matches(low, '{P.INTENT_DECIDE}') AND (n_terms >= 1 OR n_ids >= 1 OR regexp_matches(low, 'project|项目|ledger|账本')) THEN 'C4' WHEN regexp_matches(low, '{P.INTENT_STATUS}') THEN 'C2' WHEN regexp_matches(low, '{P.INTENT_WORK}') THEN 'C4'
 WHEN n_terms >= 2 OR n_ids >= 1 OR (n_terms >= 1 AND regexp_matches(low, '{_ASKS}')) THEN 'C3' WHEN n_terms = 1 AND length(low) <= 80 THEN 'C2' WHEN n_terms = 0 AND n_ids = 0 AND regexp_matches(trim(low), '{P.INTENT_CHAT}') THEN 'C1' ELSE 'C0' END AS class FROM s)"""


def _told(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "conv_id", "turn", F.expr(_TOLD).alias("text"))


def _classed(spark, sf_dir):
    hit = V.term_hits(_told(spark, sf_dir), V.vocabulary(A.item_entries(spark, sf_dir)))
    return hit.withColumn("class", V.memory_class(F.col("text"), F.col("n_terms"), F.col("n_ids")))


@query(f"WITH {_CLASSED} SELECT conv_id, turn, n_terms, n_ids, class FROM d")
def memory_class(spark, sf_dir):
    """Conversations and built messages against the terms and ids of a ledger of benchmark items."""
    return _classed(spark, sf_dir).select("conv_id", "turn", "n_terms", "n_ids", "class")


_MATCHED = """z AS (SELECT y.conv_id, y.turn, v.id, any_value(v.file) AS file, any_value(v.place) AS place, count(*) AS hits FROM y JOIN v ON y.term = v.term GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY y.conv_id, y.turn, v.id")
_RANK = "CASE file WHEN 'DECISIONS.md' THEN 1 WHEN 'TECH.md' THEN 2 ELSE 3 END"


@query(f"WITH {_VOCAB}, {_MATCHED}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, {_RANK}, place) AS nth FROM z) SELECT conv_id, turn, id, hits, nth FROM k WHERE nth <= 4")
def matched_entries(spark, sf_dir):
    """The four entries that share most terms with a message."""
    got = V.matched_entries(_told(spark, sf_dir), A.item_entries(spark, sf_dir), 4)
    return got.select(F.floor(F.col("message_id") / 1000).alias("conv_id"), (F.col("message_id") % 1000).alias("turn"), "id", "hits", F.col("nth").cast("long").alias("nth"))


#: More than the smallest budget takes, so that it is cut there and leaves little room elsewhere.
_STATE = "\n".join(f"stage {i} of the plan is {'done and checked' if i % 3 else 'open, see the notes of week ' + str(i)}" for i in range(120))


def _tokens_sql(text: str) -> str:
    other = f"length(regexp_replace({text}, '[㐀-鿿぀-ヿ가-힯]', '', 'g'))"
    return f"(length({text}) - {other} + ceil({other} / 4.0))"


_LINES, _LEAD, _GAP = f"string_split('{_STATE}', chr(10))", "'### Current state' || chr(10)", "chr(10) || chr(10)"
_BUDGET = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.CLASS_BUDGETS.items()) + " END"
_MARKER = "'" + V.MARKER + "'"
_SHOWN = f"""{_CLASSED}, {_MATCHED}, b AS (SELECT *, '### ' || id || ' — ' || title || chr(10) || rtrim(raw) AS block, row_number() OVER (PARTITION BY file ORDER BY place) AS front, row_number() OVER (PARTITION BY file ORDER BY place DESC) AS back FROM x WHERE status = 'ACTIVE'),
g AS (SELECT conv_id, turn, class, regexp_matches(low, '{P.INTENT_GOAL}') OR regexp_matches(low, '{P.INTENT_WORK}') AS scoped FROM d),
kf AS (SELECT z.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, {_RANK}, place) AS nth, row_number() OVER (PARTITION BY conv_id, turn, file ORDER BY hits DESC, place) AS in_file FROM z),
f AS (SELECT g.conv_id, g.turn, 10 + b.front AS ord, b.block FROM g JOIN b ON g.scoped AND g.class IN ('C3', 'C4') AND b.file = 'PROJECT.md' AND b.front <= 4
 UNION ALL SELECT g.conv_id, g.turn, 20 + k.nth, b.block FROM g JOIN kf k ON g.conv_id = k.conv_id AND g.turn = k.turn AND g.class = 'C3' AND NOT g.scoped AND k.nth <= 4 JOIN b ON k.id = b.id
 UNION ALL SELECT g.conv_id, g.turn, CASE k.file WHEN 'PROJECT.md' THEN 20 WHEN 'DECISIONS.md' THEN 30 ELSE 40 END + k.in_file, b.block FROM g JOIN kf k ON g.conv_id = k.conv_id AND g.turn = k.turn AND g.class = 'C4' AND (NOT g.scoped OR k.file <> 'PROJECT.md') AND k.in_file <= CASE WHEN k.file = 'TECH.md' THEN 3 ELSE 4 END JOIN b ON k.id = b.id
 UNION ALL SELECT g.conv_id, g.turn, CASE b.file WHEN 'PROJECT.md' THEN 100 WHEN 'DECISIONS.md' THEN 200 ELSE 300 END - b.back, b.block FROM g JOIN b ON g.class = 'C5' AND b.back <= CASE WHEN b.file = 'DECISIONS.md' THEN 12 ELSE 8 END)"""


@query(
    f"""WITH {_SHOWN}, h AS (SELECT conv_id, turn, list(block ORDER BY ord) AS blocks FROM f GROUP BY 1, 2),
pre AS (SELECT k, array_to_string({_LINES}[1:k], chr(10)) || chr(10) AS said FROM (SELECT unnest(range(1, len({_LINES}) + 1)) AS k)),
q AS (SELECT g.*, {_BUDGET} AS budget, replace('{V.HEAD}', '%s', g.class) || CASE WHEN g.class IN ('C4', 'C5') THEN {_GAP} || '### Router' || chr(10) || '(empty ledger)' ELSE '' END AS top, coalesce(h.blocks, []) AS blocks FROM g LEFT JOIN h ON g.conv_id = h.conv_id AND g.turn = h.turn),
r AS (SELECT q.*, (SELECT max(k) FROM pre WHERE {_tokens_sql(f"(q.top || {_GAP} || {_LEAD} || pre.said || {_MARKER})")} <= q.budget) AS k FROM q),
s2 AS (SELECT r.*, CASE WHEN {_tokens_sql("top")} + {_tokens_sql(f"({_LEAD} || '{_STATE}')")} <= budget THEN top || {_GAP} || {_LEAD} || '{_STATE}'
  WHEN k IS NOT NULL THEN top || {_GAP} || {_LEAD} || array_to_string({_LINES}[1:k], chr(10)) || {_MARKER} ELSE top END AS told FROM r)
SELECT conv_id, turn, class, CASE WHEN budget = 0 THEN '' ELSE list_reduce([told] || blocks, lambda t, b: CASE WHEN {_tokens_sql("t")} + {_tokens_sql("b")} <= budget THEN t || {_GAP} || b ELSE t END) END AS context FROM s2"""
)
def render_context(spark, sf_dir):
    """What each class shows of the ledger, its state cut and blocks passed over where its budget ends."""
    got = V.render_context(_classed(spark, sf_dir), A.item_entries(spark, sf_dir), F.lit(_STATE), F.lit(" "))
    return got.select(F.floor(F.col("message_id") / 1000).alias("conv_id"), (F.col("message_id") % 1000).alias("turn"), "class", "context")


_CLEAN = r"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"WITH x AS (SELECT doc_id, len({_CLEAN}) AS n, len(list_distinct(list_transform({_CLEAN}, lambda x: lower(x)))) AS u, length(text) AS chars FROM documents) SELECT doc_id, u AS n_unique, n - u AS n_dropped FROM x WHERE n >= 1")
def search_reducer(spark, sf_dir):
    """Unique matches of a search result, any case."""
    u = R.unique_lines(T.lines(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", u.alias("u")).where(F.size("u.kept") > 0).select("doc_id", F.size("u.kept").cast("long").alias("n_unique"), F.col("u.dropped").alias("n_dropped"))


def _pruned(spark, sf_dir):
    docs = spread_texts(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    docs = docs.select(F.col("source").alias("session"), F.col("doc_id").alias("pos"), F.lit("tool-pair").alias("kind"), F.lit(False).alias("open"), F.lit("grep").alias("tool"), F.lit("").alias("args"), "text", F.lit("NORMAL").alias("protection"), F.when(F.col("doc_id") % 4 == 0, "COLD").otherwise("TRASH").alias("tier"), (F.col("doc_id") % 10 == 0).alias("in_floor"), F.lit(0.9).alias("x"))
    return R.planned(docs, F.lit("Z2"))




@query(f"WITH f AS (SELECT source AS session, doc_id AS pos, {FP} AS fp, doc_id % 10 = 0 AS in_floor FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY session, fp ORDER BY pos) > 1 AS again FROM f) SELECT session, pos FROM n WHERE again AND NOT in_floor")
def prune_drops(spark, sf_dir):
    """Later duplicates within the gated units."""
    return _pruned(spark, sf_dir).where("action = 'drop'").select("session", "pos")


_PRUNED = f"""d AS (SELECT source AS session, doc_id AS pos, text, {FP} AS fp, doc_id % 10 = 0 AS in_floor, doc_id % 4 <> 0 AS inside, len(string_split_regex(text, '\\r?\\n')) AS n_lines, {_CLEAN} AS ls FROM documents),
x AS (SELECT pos, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
y AS (SELECT pos, arg_min(line, i) AS line, min(i) AS i FROM x GROUP BY pos, lower(line)),
z AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS nth FROM y),
l AS (SELECT pos, count(*) AS n, string_agg(chr(10) || '  ' || line, '' ORDER BY i) FILTER (nth <= 200) AS body FROM z GROUP BY pos),
r AS (SELECT d.*, 'Matches (' || coalesce(l.n, 0) || CASE WHEN len(ls) > coalesce(l.n, 0) THEN ', ' || (len(ls) - l.n) || ' duplicates dropped' ELSE '' END || '):' || coalesce(l.body, '') || CASE WHEN l.n > 200 THEN chr(10) || '  … ' || (l.n - 200) || ' more' ELSE '' END
  || chr(10) || 'raw: ' || fp || ' (' || n_lines || ' lines, reconstructible)' AS made FROM d LEFT JOIN l ON d.pos = l.pos),
k AS (SELECT *, CASE WHEN n_lines < 32 AND length(text) < 1600 THEN text ELSE made END AS reduced, inside AND row_number() OVER (PARTITION BY session, fp, inside ORDER BY pos) > 1 AS again FROM r),
w AS (SELECT *, CASE WHEN inside AND again AND NOT in_floor THEN 'drop' WHEN inside AND length(reduced) < length(text) THEN 'reduce' ELSE 'none' END AS action FROM k),
v AS (SELECT *, CASE action WHEN 'drop' THEN ceil(length(text) / 4.0) WHEN 'reduce' THEN greatest(0, ceil(length(text) / 4.0) - ceil(length(reduced) / 4.0)) ELSE 0 END::BIGINT AS reclaim FROM w)"""


@query(f"WITH {_PRUNED} SELECT session, count(*) AS scanned, count(*) FILTER (inside) AS trash, count(*) FILTER (action = 'reduce') AS reduced, count(*) FILTER (action = 'drop') AS dropped, count(*) FILTER (action = 'none') AS untouched, CAST(sum(reclaim) AS BIGINT) AS reclaim FROM v GROUP BY session")
def prune_stats(spark, sf_dir):
    """A5 R5."""
    return R.stats(_pruned(spark, sf_dir))


@query(f"WITH {_PRUNED} SELECT session, pos, action, reclaim FROM v WHERE action <> 'none'")
def prune_actions(spark, sf_dir):
    """Drops and reductions, each with what it gives back."""
    return _pruned(spark, sf_dir).where("action <> 'none'").select("session", "pos", "action", "reclaim")


_CITES = "CASE o_orderkey % 4 WHEN 0 THEN '- source_ref: E' || (o_orderkey % 90 + 1) || chr(10) ELSE '' END"
_QUOTED = "CASE o_orderkey % 5 WHEN 0 THEN 'no such words anywhere' WHEN 1 THEN 'we saw total' WHEN 2 THEN 'short' ELSE 'total ' || CAST(floor(o_totalprice) AS BIGINT) || ' for order ' || o_orderkey || ' today' END"
_SOURCED = f"""n AS (SELECT o_orderkey // 100 AS batch, 'DEC-' || o_orderkey AS entry_id, o_orderkey AS key, o_orderkey % 3 = 0 AS old, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 END AS h, {_QUOTED} AS quote, o_orderstatus = 'F' AS act FROM orders),
g AS (SELECT o_orderkey // 100 AS batch, o_orderkey AS seq, 'we saw total ' || CAST(floor(o_totalprice) AS BIGINT) || ' for order ' || o_orderkey || ' today' AS t FROM orders),
q AS (SELECT n.key, any_value(n.batch) AS batch, any_value(entry_id) AS entry_id, any_value(old) AS old, any_value(h) AS h, any_value(quote) AS quote, any_value(act) AS act, count(g.seq) AS hits, min(g.seq) AS hit FROM n LEFT JOIN g ON n.batch = g.batch AND contains(g.t, n.quote) GROUP BY n.key),
w AS (SELECT q.*, g.seq AS ref_seq, contains(g.t, q.quote) AS holds FROM q LEFT JOIN g ON q.batch = g.batch AND g.seq = q.batch * 100 + q.h),
x AS (SELECT *, CASE WHEN h IS NOT NULL THEN CASE WHEN ref_seq IS NULL THEN 'unknown-ref' WHEN NOT holds THEN 'quote-mismatch' END WHEN length(quote) < 12 THEN 'no-ref' WHEN hits = 0 THEN 'not-found' WHEN hits > 1 THEN 'ambiguous' END AS reason FROM w)"""


def _sourced(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    raw = F.expr(f"concat('## [DEC-', o_orderkey, '] x', chr(10), {_CITES}, '- source: ', {_QUOTED})".replace("//", "div"))
    e = o.select(F.expr("o_orderkey div 100").alias("batch"), F.lit("DECISIONS.md").alias("file"), F.concat(F.lit("DEC-"), "o_orderkey").alias("id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("STALE").alias("status"), raw.alias("raw"))
    rows = A.ledger_log(spark, sf_dir)
    refs = rows.select("batch", F.concat(F.lit("E"), F.col("seq") % 100 + 1).alias("handle"), "seq", "text")
    return e, e.where("o_orderkey % 3 = 0"), rows, refs


@query(f"WITH {_SOURCED} SELECT entry_id, CASE WHEN reason IS NULL THEN coalesce(ref_seq, hit) END AS seq, reason FROM x WHERE NOT old")
def provenance_resolution(spark, sf_dir):
    """Sources of the entries that changed, with and without handles."""
    bound, failed = W.resolved(*_sourced(spark, sf_dir))
    return bound.select("entry_id", "seq", F.lit(None).cast("string").alias("reason")).union(failed.select("entry_id", F.lit(None).cast("long"), "reason"))


@query(f"WITH {_SOURCED} SELECT entry_id, hit AS seq FROM x WHERE old AND act AND length(quote) >= 12 AND hits = 1")
def provenance_repair(spark, sf_dir):
    """Lost sources of unchanged ACTIVE entries, found again by their quotes."""
    after, before, rows, refs = _sourced(spark, sf_dir)
    bound, failed = W.resolved(spread(after, "batch"), before, rows, refs, held)
    return W.repaired(spread(after, "batch"), bound, failed, rows, held).select("entry_id", "seq")


@query(f"WITH {A.LEDGER} SELECT id, CAST(len(list_distinct(regexp_extract_all(lower(source), '[a-z0-9]{{3,}}'))) AS BIGINT) AS n FROM l WHERE status = 'ACTIVE'".replace("lower(source)", "replace(lower(source), ' for ', ' ')"))
def evidence_term_counts(spark, sf_dir):
    """X11: distinct terms of three letters or more in a source."""
    got = L.entries(*A.dealt_lines(spark, sf_dir)).where("status = 'ACTIVE'")
    return got.select("id", F.size(T.evidence_terms(F.lit(""), F.col("source"))).cast("long").alias("n"))

