"""The Markdown ledger: parsing, rendering, validated operations, evidence, integrity, search.

Ledger lines are (file, line_no, text); a ledger of many projects carries ``project`` in the
file name. Entries are (file, place, id, title, confidence, status, facts, source,
replacement, resolution, verbatim, raw); ``verbatim`` is the free text of the state entry, which
has no bullets of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.functions.text import collapsed, exact_atoms, let, trim
from ctxloom.operators import contains
from ctxloom.operators.spread import spread, tasks_for

#: Entry heads as operations, the index and sections read them.
OPS_HEAD = r"^##\s+\[([A-Z]+-\d+|STATE-CURRENT)\]"
INDEX_HEAD = r"^## \[([A-Z]+-[A-Z0-9]+)\]"
SECTION_HEAD = r"^##\s+\[([^\]]+)\]"
#: A line that is found belongs to the nearest entry above it in its chapter.
NEAREST = r"^#\s"
FILES = ["PROJECT.md", "STATE.md", "DECISIONS.md", "TECH.md", "CONFLICTS.md"]
KIND_FILE = {"REQ": "PROJECT.md", "DEC": "DECISIONS.md", "TECH": "TECH.md", "CONFLICT": "CONFLICTS.md"}
KIND_ALIASES = {"REQUIREMENT": "REQ", "DECISION": "DEC", "TECHNICAL": "TECH"}
OPS = ["ADD", "UPDATE_STATE", "AMEND", "SUPERSEDE", "CONFLICT", "RESOLVE_CONFLICT", "NOOP"]
STATE = "STATE-CURRENT"
NEED_EVIDENCE = ["ADD", "AMEND", "CONFLICT", "RESOLVE_CONFLICT"]
NEED_TARGET = ["SUPERSEDE", "AMEND", "RESOLVE_CONFLICT"]


def owned(lines: DataFrame, head: str = OPS_HEAD, ends: str = r"^##\s") -> DataFrame:
    """Each line with the entry it belongs to: that of the last head above it in its file.

    A second-level heading that is no entry ends the one before it; ``ends`` may say otherwise. Both
    patterns begin with a #, so other lines are tried by neither.
    """
    id_here = F.when(F.col("text").startswith("#"), F.regexp_extract("text", head, 1))
    mark = F.when(F.col("_id") != "", F.col("_id")).when((F.col("_id") == "") & F.col("text").rlike(ends), "")
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines.withColumn("_id", id_here).withColumn("_mark", mark).drop("_id")
    out = out.withColumn("entry_id", F.last("_mark", ignorenulls=True).over(so_far)).withColumn("entry_line", F.last(F.when(F.col("_mark").isNotNull(), F.col("line_no")), ignorenulls=True).over(so_far))
    return out.where("entry_id <> ''").drop("_mark")


def _status_bullet(text: Column) -> Column:
    """What the index takes for a status: it is less strict than operations are."""
    pattern = r"^[-*] (?:status|状态)\s*[:：]\s*(.*)"
    return F.when(text.rlike(pattern), trim(F.regexp_extract(text, pattern, 1)))


#: Named bullets of an entry and what they may hold; other lines are facts.
BULLETS = {"confidence": r"[0-9.]+", "status": "[A-Za-z]+", "source": ".*?", "replacement": r"\S+", "resolution": ".*?"}


def entries(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Entries as operations see them: named bullets apart (the last of a name holds), all other lines as facts.

    A bullet's name is read once, then only its own pattern is tried on what follows. An entry's
    lines are gathered in one list, and all its fields are read from that. Lines that are dealt by
    file already, to ``tasks``, stay there.
    """
    body, free = F.col("line_no") > F.col("entry_line"), F.col("entry_id") == STATE
    rows = owned(lines if tasks else spread(lines, "file")).withColumn("_line", F.when(body & ~free, trim("text")))
    dashed = F.col("_line").startswith("- ")
    rows = rows.withColumn("_name", F.when(dashed, F.lower(F.regexp_extract("_line", rf"(?i)^- ({'|'.join(BULLETS)}):", 1))))
    rows = rows.withColumn("_value", F.when(F.col("_name") != "", trim(F.substr("_line", F.length("_name") + 4))))  # after "- ", the name and a colon
    holds = lambda k, v: (F.col("_name") == k) & F.col("_value").rlike(rf"(?i)^{v}\z")
    rows = rows.withColumn("_is", F.coalesce(*(F.when(holds(k, v), F.lit(k)) for k, v in BULLETS.items())))
    said = F.when(F.col("_is").isNotNull(), F.col("_value")).when(dashed, F.substr("_line", F.lit(3))).when(F.col("_line") != "", F.col("_line"))
    one = F.struct("line_no", "text", "_is", said.alias("said"))
    got = rows.groupBy("file", F.col("entry_line").alias("place"), F.col("entry_id").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("_of"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), "\n")
    of = lambda k: F.try_element_at(F.filter("_of", lambda x: x["_is"] == k), F.lit(-1))["said"]
    last = {k: of(k) for k in BULLETS}
    return got.select(
        "file",
        "place",
        "id",
        trim(F.regexp_replace(F.get("_of", F.lit(0))["text"], OPS_HEAD, "")).alias("title"),
        last["confidence"].try_cast("double").alias("confidence"),
        F.upper(last["status"]).alias("status"),
        last["source"].alias("source"),
        F.upper(last["replacement"]).alias("replacement"),
        last["resolution"].alias("resolution"),
        F.transform(F.filter("_of", lambda x: x["_is"].isNull() & x["said"].isNotNull()), lambda x: x["said"]).alias("facts"),
        F.when(F.col("id") == STATE, trim(joined(F.slice("_of", F.lit(2), F.size("_of"))))).alias("verbatim"),
        joined("_of").alias("raw"),
    )


def headers(lines: DataFrame) -> DataFrame:
    """(file, header): what stands above a file's first entry."""
    first = F.min(F.when(F.col("text").rlike(OPS_HEAD), F.col("line_no"))).over(Window.partitionBy("file"))
    above = lines.withColumn("_first", first).where("_first is null or line_no < _first")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return above.groupBy("file").agg(F.regexp_replace(text, r"\s+\z", "").alias("header"))


def index(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Entries as the index sees them: ACTIVE by default, the last of an id holds. Lines dealt by file to ``tasks`` stay there."""
    dealt = tasks is not None
    tasks = tasks or tasks_for(lines)
    rows = owned(lines if dealt else spread(lines, "file", tasks=tasks), INDEX_HEAD).withColumn("status", _status_bullet(F.col("text")))
    one = rows.groupBy("file", "entry_line", "entry_id").agg(
        F.coalesce(F.upper(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("line_no")))), F.lit("ACTIVE")).alias("status"),
        trim(F.regexp_replace(F.min_by("text", "line_no"), INDEX_HEAD, "")).alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("raw"),
    )
    last = Window.partitionBy("entry_id").orderBy(F.desc("file"), F.desc("entry_line"))
    return spread(one, "entry_id", tasks=tasks).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").select("file", F.col("entry_id").alias("id"), "status", "title", "raw")


def citations(found: DataFrame) -> DataFrame:
    """(id, cites): entries whose text names another known entry; ids are extracted, then joined."""
    named = found.select("id", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"(?<![A-Za-z0-9_])([A-Z]+-[A-Z0-9]+)(?![A-Za-z0-9_])"), 1))).alias("cites")).where("id <> cites")
    return named.join(found.select(F.col("id").alias("cites")).distinct(), "cites", "left_semi").select("id", "cites")


def cited_by_active(found: DataFrame) -> DataFrame:
    return citations(found).join(found.where("status = 'ACTIVE'").select("id"), "id", "left_semi").select(F.col("cites").alias("id")).distinct()


def rendered(found: DataFrame) -> DataFrame:
    """Entries as Markdown, in the one canonical order of bullets."""
    line = lambda name, value=None: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"- {name}: "), F.col(name) if value is None else value))
    head = F.concat(F.lit("## ["), F.col("id"), F.lit("] "), F.coalesce("title", F.lit("")))
    facts = F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n")
    sure = F.regexp_replace(F.col("confidence").cast("string"), r"\.0\z", "")
    body = F.concat_ws("\n", head, line("confidence", sure), line("status"), F.when(facts != "", facts), line("source"), line("replacement"), line("resolution"))
    free = F.concat_ws("\n", head, F.coalesce("verbatim", F.lit("")))
    return found.select("file", "place", "id", F.when(F.col("id") == STATE, free).otherwise(body).alias("markdown"))


def files(parts: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Whole files from rendered entries, by place, under the headers they had."""
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "markdown"))), lambda x: F.concat(x["markdown"], F.lit("\n"))), "\n")
    made = parts.groupBy("file").agg(one.alias("content"))
    if above is None:
        return made
    return made.join(above, "file", "left").select("file", F.concat(F.coalesce("header", F.lit("")), F.lit("\n\n"), "content").alias("content"))


def router(found: DataFrame, shown: int = 8) -> DataFrame:
    """By file, the number of entries and the first ids, as the router page lists them."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    got = found.groupBy("file").agg(F.count("*").alias("n_entries"), ids.alias("_ids"))
    more = F.when(F.col("n_entries") > shown, F.concat(F.lit(" (+"), F.col("n_entries") - shown, F.lit(" more)"))).otherwise("")
    return got.select("file", "n_entries", F.concat(F.array_join(F.slice("_ids", 1, shown), ", "), more).alias("ids"))


#: Files of the router page in its order, what each is for, and the prefix of its entries.
PAGE = (("PROJECT.md", "Scope and requirements", "REQ"), ("STATE.md", "What holds now", "STATE-CURRENT"), ("DECISIONS.md", "Decisions and why", "DEC"), ("TECH.md", "Technical facts", "TECH"), ("HISTORY.md", "Log of syncs, append-only", None), ("CONFLICTS.md", "Open contradictions", "CONFLICT"))


def router_page(found: DataFrame, history: DataFrame, projects: DataFrame, shown: int = 8) -> DataFrame:
    """(project, page): the router page of each ledger, one ordered text.

    ``found`` are entries (project, file, place, id, status), ``history`` lines (project, text) and
    ``projects`` (project, note), the note on the last sync. A file's row tells its entries of its own prefix
    and the first ids, the history's row the number of its lines that begin ``- [``, the state's 0 or 1; then
    come the ACTIVE conflicts by number.
    """
    prefix = F.create_map(*(F.lit(x) for f, _, p in PAGE if p for x in (f, p)))
    own = found.withColumn("_p", F.try_element_at(prefix, F.col("file")))
    own = own.where((F.col("id") == F.col("_p")) | F.col("id").startswith(F.concat("_p", F.lit("-"))))
    nth = F.row_number().over(Window.partitionBy("project", "file").orderBy("place", "id"))
    ids = F.sort_array(F.collect_list(F.when(F.col("_nth") <= shown, F.struct("_nth", "id"))))
    rows = own.withColumn("_nth", nth).groupBy("project", "file").agg(F.count("*").alias("n"), F.array_join(F.transform(ids, lambda x: x["id"]), ", ").alias("ids"))
    told = history.where(F.col("text").startswith("- [")).groupBy("project").agg(F.count("*").alias("n")).select("project", F.lit("HISTORY.md").alias("file"), "n", F.lit(None).cast("string").alias("ids"))
    cell = F.map_from_entries(F.collect_list(F.struct("file", F.struct("n", "ids"))))
    open_ = found.where((F.col("file") == "CONFLICTS.md") & (F.coalesce("status", F.lit("ACTIVE")) == "ACTIVE") & F.col("id").startswith("CONFLICT-")).groupBy("project").agg(F.count("*").alias("_open"))
    pages = projects.join(rows.unionByName(told).groupBy("project").agg(cell.alias("c")), "project", "left").join(open_, "project", "left")
    lines = [F.lit("# INDEX — memory router"), F.lit("| File | Purpose | Entries |"), F.lit("|---|---|---|")]
    for name, purpose, p in PAGE:
        c = F.try_element_at("c", F.lit(name))
        n = F.coalesce(c["n"], F.lit(0))
        said = F.least(n, F.lit(1)) if p == "STATE-CURRENT" else n
        more = F.when(n > shown, F.concat(F.lit(" (+"), n - shown, F.lit(" more)"))).otherwise("")
        listed = F.concat(F.lit(" ("), F.coalesce(c["ids"], F.lit("")), more, F.lit(")")) if p else F.lit("")
        lines.append(F.concat(F.lit(f"| {name} | {purpose} | "), said, listed, F.lit(" |")))
    lines += [F.concat(F.lit("- Last sync: "), F.coalesce("note", F.lit(""))), F.concat(F.lit("- Active conflicts: "), F.coalesce("_open", F.lit(0)))]
    return pages.select("project", F.concat_ws("\n", *lines).alias("page"))


def search(lines: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Lines that hold all words of the query, with the entry they stand in, in file order."""
    words = [w for w in query.lower().split() if w]
    limit = max(1, min(50, limit))
    if not words:
        return owned(lines.where("false"), SECTION_HEAD, NEAREST).select("file", "line_no", F.col("entry_id"), "text")
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(F.lower("text"), F.lit(w))
    near = owned(lines, SECTION_HEAD, NEAREST).select("file", "line_no", "entry_id")
    return lines.where(hit).join(near, ["file", "line_no"], "left").select("file", "line_no", "entry_id", "text").orderBy("file", "line_no").limit(limit)


def section(lines: DataFrame, entry_id: str) -> DataFrame:
    """The lines of one entry."""
    return owned(lines, SECTION_HEAD).where(F.col("entry_id") == entry_id).select("file", "line_no", "text")


# Operations


REPLACEMENT = "struct<kind:string,title:string,body:string,confidence:double,source_ref:string,source_quote:string>"
#: Columns that a table of operations may lack.
OPTIONAL = {"topic": "string", "resolution": "string", "replacement": REPLACEMENT}


def _kind(raw: Column) -> Column:
    """REQ, DEC, TECH or CONFLICT under any of their names, else null."""
    known = KIND_ALIASES | {k: k for k in KIND_FILE}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.regexp_replace(F.upper(trim(F.coalesce(raw, F.lit("")))), r"[\s-]+", ""))


def normalized(ops: DataFrame) -> DataFrame:
    """Operations with folded names and clamped confidence; what is malformed gets a reason.

    ``ops`` holds (batch, idx, op, kind, title, body, target_id, confidence, source_ref,
    source_quote, grp) and may hold topic, resolution and replacement.
    """
    for name, kind in OPTIONAL.items():
        if name not in ops.columns:
            ops = ops.withColumn(name, F.lit(None).cast(kind))
    said = lambda c: trim(F.coalesce(c, F.lit("")))
    given = lambda c: F.nullif(said(c), F.lit(""))
    sure = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.8).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    r = F.col("replacement")
    again = F.struct(_kind(r["kind"]).alias("kind"), said(r["title"]).alias("title"), said(r["body"]).alias("body"), sure(r["confidence"]).alias("confidence"), F.upper(given(r["source_ref"])).alias("source_ref"), given(r["source_quote"]).alias("source_quote"))
    out = ops.select(
        "batch",
        "idx",
        F.regexp_replace(F.upper(said(F.col("op"))), r"[\s-]+", "_").alias("op"),
        _kind(F.col("kind")).alias("kind"),
        *(said(F.col(k)).alias(k) for k in ("title", "body", "target_id", "topic", "resolution")),
        sure(F.col("confidence")).alias("confidence"),
        F.upper(given(F.col("source_ref"))).alias("source_ref"),
        given(F.col("source_quote")).alias("source_quote"),
        given(F.col("grp")).alias("grp"),
        F.when(r.isNotNull(), again).alias("replacement"),
    )
    is_op, blank = (lambda *names: F.col("op").isin(*names)), (lambda c: F.col(c) == "")
    fact = lambda kind: kind.isNull() | (kind == "CONFLICT")
    bad = (
        ~is_op(*OPS)
        | (is_op("ADD") & (fact(F.col("kind")) | blank("title") | blank("body")))
        | (is_op("UPDATE_STATE", "AMEND", "CONFLICT") & blank("body"))
        | (is_op(*NEED_TARGET) & blank("target_id"))
        | (is_op("SUPERSEDE") & (r.isNull() | fact(r["kind"]) | blank("replacement.title") | blank("replacement.body")))
        | (is_op("CONFLICT") & blank("topic"))
        | (is_op("RESOLVE_CONFLICT") & blank("resolution"))
    )
    return out.withColumn("reason", F.when(F.coalesce(bad, F.lit(True)), "BAD_OPERATION"))


def evidence(ops: DataFrame, rows: DataFrame, refs: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Adds evidence_seq and evidence_text, or evidence_reason why there is none.

    ``refs`` are (batch, handle, seq, text); ``rows`` (batch, seq, text) is the whole log, read
    only for quotes without a reference. A quote is first met by its handle; a quote without
    one must stand in exactly one row. What an operation offers must hold even where it needs
    none; a SUPERSEDE needs evidence of its replacement, which is then what it is bound to. ``hold`` keeps
    what is asked for, which is read several times.
    """
    claim = lambda which, ref, quote: F.struct(F.lit(which).alias("which"), F.col(ref).alias("ref"), F.col(quote).alias("quote"))
    offered = F.col("op").isin(*NEED_EVIDENCE) | F.col("source_ref").isNotNull() | F.col("source_quote").isNotNull()
    made = F.array_compact(F.array(F.when(offered, claim("own", "source_ref", "source_quote")), F.when(F.col("op") == "SUPERSEDE", claim("new", "replacement.source_ref", "replacement.source_quote"))))
    asked = ops.where("reason is null").select("batch", "idx", F.explode(made).alias("c")).select("batch", "idx", "c.which", "c.ref", F.col("c.quote").alias("said"), F.coalesce(collapsed(F.col("c.quote")), F.lit("")).alias("quote"))
    asked = hold(asked)
    known = refs.select("batch", F.col("handle").alias("ref"), F.col("seq").alias("ref_seq"), F.col("text").alias("ref_text"))
    out = asked.join(known, ["batch", "ref"], "left")
    loose = asked.where(F.col("ref").isNull() & (F.length("quote") >= 12)).select("batch", "quote").distinct()
    hits = held_once(rows, loose)
    out = out.join(hits, ["batch", "quote"], "left")
    with_ref = (
        F.when(~F.col("ref").rlike(r"^E\d+\z"), "BAD_REF").when(F.col("ref_seq").isNull(), "UNKNOWN_REF").when(F.col("said").isNull(), "NO_EVIDENCE").when(~F.contains(collapsed(F.col("ref_text")), F.col("quote")), "QUOTE_MISMATCH")
    )
    hit = F.coalesce("hits", F.lit(0))
    without = F.when(F.col("said").isNull(), "NO_EVIDENCE").when((F.length("quote") < 12) | (hit == 0), "EVIDENCE_NOT_FOUND").when(hit > 1, "AMBIGUOUS_EVIDENCE")
    why = F.when(F.col("ref").isNotNull(), with_ref).otherwise(without)
    found = F.struct(why.alias("reason"), F.coalesce("ref_seq", "hit_seq").alias("seq"), F.coalesce("ref_text", "hit_text").alias("text"))
    each = out.groupBy("batch", "idx").agg(*(F.first(F.when(F.col("which") == w, found), ignorenulls=True).alias(w) for w in ("own", "new")))
    reason = F.coalesce("own.reason", "new.reason")
    got = each.select("batch", "idx", reason.alias("evidence_reason"), *(F.when(reason.isNull(), F.coalesce(f"new.{k}", f"own.{k}")).alias(f"evidence_{k}") for k in ("seq", "text")))
    return ops.join(got, ["batch", "idx"], "left")


def held_once(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """(batch, quote, hits, hit_seq, hit_text): rows of a batch that hold a collapsed quote, and the first."""
    log = rows.select(F.col("batch").alias("scope"), "seq", "text", collapsed(F.col("text")).alias("low"))
    hits = contains.held_once(log, quotes.select(F.col("batch").alias("scope"), F.col("quote").alias("string")))
    return hits.select(F.col("scope").alias("batch"), F.col("string").alias("quote"), "hits", "hit_seq", "hit_text")


def unbacked(new: Column, old: Column, backing: Column) -> Column:
    """Atoms that a change brings in and its evidence doesn't hold; the old text and the evidence are read only where there are such."""
    missing = lambda fresh: let(collapsed(backing), lambda b: F.filter(fresh, lambda a: ~F.coalesce(F.contains(b, a), F.lit(False))))
    fresh = lambda atoms: let(F.array_except(atoms, exact_atoms(old)), lambda f: F.when(F.size(f) == 0, f).otherwise(missing(f)))
    return let(exact_atoms(new), lambda atoms: F.when((F.size(atoms) == 0) & old.isNotNull(), atoms).otherwise(fresh(atoms)))


def entry_text() -> Column:
    """An entry's title, facts and source, as the guard compares them."""
    return F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif(F.array_join("facts", "\n"), F.lit("")), "source")


def validated(ops: DataFrame, found: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds the first reason against each operation (its form, target, evidence, then mutation) and the detail.

    ``ops`` comes from ``normalized`` and ``evidence``. Only ACTIVE entries can be targets. Of
    an id that stands twice the last holds. Exact values that a body brings in must stand in the
    row that the evidence was found in; titles aren't looked at. Targets are met in ``tasks``, if given.
    """
    if tasks:
        ops, found = spread(ops, "target_id", tasks=tasks), spread(found, "id", tasks=tasks)
    targets = found.groupBy(F.col("id").alias("target_id")).agg(F.max_by(F.struct(F.coalesce("status", F.lit("ACTIVE")).alias("status"), entry_text().alias("text")), F.struct("file", "place")).alias("t"))
    out = ops.join(targets, "target_id", "left")
    needs = F.col("op").isin(*NEED_TARGET)
    target = F.when(needs & F.col("t").isNull(), "TARGET_NOT_FOUND").when(needs & (F.col("t.status") != "ACTIVE"), "TARGET_NOT_ACTIVE")
    body = F.when(F.col("op") == "SUPERSEDE", F.col("replacement.body")).otherwise(F.col("body"))
    old = F.when(F.col("op").isin("AMEND", "SUPERSEDE"), F.col("t.text")).otherwise("")
    lost = F.when(F.col("op").isin("ADD", "AMEND", "CONFLICT", "SUPERSEDE"), unbacked(F.coalesce(body, F.lit("")), F.coalesce(old, F.lit("")), F.coalesce("evidence_text", F.lit(""))))
    out = out.withColumn("_lost", lost)
    reason = F.coalesce("reason", target, "evidence_reason", F.when(F.size("_lost") > 0, "MUTATION_WITHOUT_EVIDENCE"))
    out = out.withColumn("reason", reason)
    detail = F.when(F.col("reason") == "MUTATION_WITHOUT_EVIDENCE", F.concat(F.lit("atoms absent from the cited evidence: "), F.array_join(F.slice("_lost", 1, 5), ", "))).when(
        F.col("reason").isin("TARGET_NOT_FOUND", "TARGET_NOT_ACTIVE"), F.concat_ws(" is ", "target_id", F.coalesce("t.status", F.lit("not in the ledger")))
    )
    return out.withColumn("detail", detail).drop("t", "_lost")


def atomic(ops: DataFrame, tasks: int | None = None) -> DataFrame:
    """A rejected member rejects its whole group; batches are dealt to ``tasks``, if given.

    A window, since a join would judge all operations twice; what has no group is alone in its own.
    """
    ops = spread(ops, "batch", tasks=tasks) if tasks else ops
    group = Window.partitionBy("batch", "grp", F.when(F.col("grp").isNull(), F.col("idx")))
    lost = F.col("batch").isNotNull() & F.col("grp").isNotNull() & F.max(F.col("reason").isNotNull()).over(group)
    return ops.withColumn("reason", F.coalesce("reason", F.when(lost, F.lit("GROUP_REJECTED"))))


#: Batches that one window of prefix sums spans.
BATCHES = 4096


def minted(ops: DataFrame, lines: DataFrame) -> DataFrame:
    """New ids for accepted ADD, SUPERSEDE and CONFLICT operations: on from the highest number named anywhere.

    Ids are numbered by batch and place in it. Operations are counted by batch, the counts
    summed up inside a block of batches and over blocks, so no task holds all of a prefix.
    """
    named = lines.select(F.explode(F.regexp_extract_all("text", F.lit(r"([RDTC](?<![A-Za-z0-9_][RDTC])(?:(?<=R)EQ|(?<=D)EC|(?<=T)ECH|(?<=C)ONFLICT)-\d+)(?![A-Za-z0-9_])"), 1)).alias("id"))
    highest = named.groupBy(F.substring_index("id", "-", 1).alias("prefix")).agg(F.max(F.substring_index("id", "-", -1).try_cast("long")).alias("_top"))
    prefix = F.when(F.col("reason").isNull(), F.when(F.col("op") == "ADD", F.col("kind")).when(F.col("op") == "SUPERSEDE", F.col("replacement.kind")).when(F.col("op") == "CONFLICT", "CONFLICT"))
    out = ops.withColumn("prefix", prefix)
    counted = out.where("prefix is not null").groupBy("prefix", "batch").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("batch") / BATCHES))
    earlier = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    blocks = counted.groupBy("prefix", "block").agg(F.sum("n").alias("n")).select("prefix", "block", earlier(Window.partitionBy("prefix").orderBy("block")).alias("_by_block"))
    batches = counted.select("prefix", "block", "batch", earlier(Window.partitionBy("prefix", "block").orderBy("batch")).alias("_by_batch")).join(blocks, ["prefix", "block"]).drop("block")
    nth = F.row_number().over(Window.partitionBy("prefix", "batch").orderBy("idx"))
    out = out.join(batches, ["prefix", "batch"], "left").join(F.broadcast(highest), "prefix", "left")  # at most one row by prefix
    number = (F.coalesce("_top", F.lit(0)) + F.col("_by_block") + F.col("_by_batch") + nth).cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return out.withColumn("new_id", F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit("-"), padded))).drop("_top", "_by_block", "_by_batch", "prefix")


def applied(found: DataFrame, ops: DataFrame) -> DataFrame:
    """Entries after the accepted operations of ``minted``, in their order: inserts, updates, the state.

    Several operations on one entry all count, for each field the last that sets it.
    """
    done = ops.where("reason is null")
    at, facts = F.struct("batch", "idx"), lambda body: F.filter(F.transform(F.split(body, "\n"), trim), lambda x: x != "")
    last = lambda value, when: F.max_by(value, F.when(when, at))
    is_op = lambda *names: F.col("op").isin(*names)
    update = done.where(is_op(*NEED_TARGET)).groupBy(F.col("target_id").alias("id")).agg(
        last("body", is_op("AMEND")).alias("_body"),
        last("title", is_op("AMEND") & (F.col("title") != "")).alias("_title"),
        last("source_quote", is_op("AMEND", "RESOLVE_CONFLICT") & F.col("source_quote").isNotNull()).alias("_source"),
        last("op", is_op("SUPERSEDE", "RESOLVE_CONFLICT")).alias("_end"),
        last("new_id", is_op("SUPERSEDE")).alias("_new"),
        last("resolution", is_op("RESOLVE_CONFLICT")).alias("_resolution"),
    )
    state = done.where(is_op("UPDATE_STATE")).groupBy(F.lit(STATE).alias("id")).agg(F.max_by("body", at).alias("_free"), last("title", F.col("title") != "").alias("_name"))
    status = F.when(F.col("_end") == "SUPERSEDE", "SUPERSEDED").when(F.col("_end") == "RESOLVE_CONFLICT", "RESOLVED").otherwise(F.col("status"))
    kept = found.join(update, "id", "left").join(F.broadcast(state), "id", "left").select(  # at most one row of state
        "file", "place", "id", F.coalesce("_name", "_title", "title").alias("title"), "confidence", status.alias("status"), F.when(F.col("_body").isNotNull(), facts("_body")).otherwise(F.col("facts")).alias("facts"),
        F.coalesce("_source", "source").alias("source"), F.coalesce("_new", "replacement").alias("replacement"), F.coalesce("_resolution", "resolution").alias("resolution"), F.coalesce("_free", "verbatim").alias("verbatim"),
    )
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    empty = F.array().cast("array<string>").alias("facts")
    first = state.join(found.where(F.col("id") == STATE).select("id").distinct(), "id", "left_anti").select(
        F.lit("STATE.md").alias("file"), F.lit(10**12).alias("place"), "id", F.coalesce("_name", F.lit("Current state")).alias("title"), F.lit(None).cast("double").alias("confidence"), *none("status"), empty, *none("source", "replacement", "resolution"), F.col("_free").alias("verbatim")
    )
    files_of = F.create_map(*(F.lit(x) for pair in KIND_FILE.items() for x in pair))
    own = F.struct(F.when(is_op("CONFLICT"), F.col("topic")).otherwise(F.col("title")).alias("title"), "body", "confidence", "source_quote")
    new = F.when(is_op("SUPERSEDE"), F.struct("replacement.title", "replacement.body", "replacement.confidence", "replacement.source_quote")).otherwise(own)
    fresh = done.where("new_id is not null").withColumn("_e", new).select(
        F.try_element_at(files_of, F.substring_index("new_id", "-", 1)).alias("file"), (F.lit(10**12) + F.col("batch") * 10**6 + F.col("idx")).cast("long").alias("place"), F.col("new_id").alias("id"), "_e.title", "_e.confidence", F.lit("ACTIVE").alias("status"),
        facts("_e.body").alias("facts"), F.col("_e.source_quote").alias("source"), *none("replacement", "resolution", "verbatim"),
    )
    return kept.unionByName(fresh).unionByName(first)


def integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, issue): silent removals, marked entries, repeated ids, a missing state.

    An entry that is gone but named anywhere in what is left was moved, not lost.
    """
    tasks = tasks_for(before)
    dealt = lambda rows: spread(rows, "id", tasks=tasks).groupBy("id")
    new = dealt(after).agg(F.count("*").alias("n"), F.max_by("status", F.struct("file", "place")).alias("status"))
    old = dealt(before.where(F.col("id") != STATE)).agg(F.max_by("status", F.struct("file", "place")).alias("was"))
    gone = lost(before, after, tasks).select("id", F.lit("SILENT_REMOVAL").alias("issue"))
    both = old.join(new, "id").where("coalesce(was, 'ACTIVE') <> 'CONFLICT'")
    marked = both.select("id", F.when(F.col("status") == "SUPERSEDED", "SUPERSEDED").when(F.col("status") == "CONFLICT", "CONFLICT_MARKED").alias("issue")).where("issue is not null")
    twice = new.where("n > 1").select("id", F.lit("DUPLICATE_ID").alias("issue"))
    state = after.agg(F.count_if(F.col("id") == STATE).alias("n")).where("n = 0").select(F.lit(STATE).alias("id"), F.lit("STATE_MISSING").alias("issue"))
    return gone.union(marked).union(twice).union(state)


def lost(before: DataFrame, after: DataFrame, tasks: int) -> DataFrame:
    """Entries of ``before`` that ``after`` neither has nor names; both sides are dealt by id to ``tasks``."""
    named = after.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "id", "title", F.array_join("facts", "\n"), "source", "replacement", "resolution", "verbatim"), F.lit(r"(?<![A-Za-z0-9_])([A-Z]+-\d+)(?![A-Za-z0-9_])"), 1))).alias("id"))
    return spread(before.where(F.col("id") != STATE), "id", tasks=tasks).join(spread(named, "id", tasks=tasks).distinct(), "id", "left_anti")


def restored(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with silently removed entries put back, and a placeholder where the state is missing."""
    back = after.unionByName(lost(before, after, tasks_for(before)).select(*after.columns))
    blank = {"file": F.lit("STATE.md"), "place": F.lit(10**12).cast("long"), "id": F.lit(STATE), "title": F.lit("(unknown — sync did not produce a state section)"), "facts": F.array().cast("array<string>")}
    state = after.agg(F.count_if(F.col("id") == STATE).alias("n")).where("n = 0").select(*(blank.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in after.schema.fields))
    return back.unionByName(state)


# Provenance


def provenance_merged(old: DataFrame, fresh: DataFrame, unresolved: DataFrame, newly: DataFrame, active: DataFrame, session: Column | None = None, sessions: int = 100, open_rows: int = 200) -> tuple[DataFrame, DataFrame]:
    """Bindings (session, seq, entry_id) and unresolved (entry_id, reason, at) after a sync.

    A sidecar holds ``sessions`` sessions, the present one and the first of the others, and the
    newest ``open_rows`` unresolved entries: entries bound in this sync or no longer ACTIVE go.
    """
    bound = old.union(fresh).distinct()
    kept = bound.select("session").distinct().orderBy(*([F.desc(F.col("session") == session)] if session is not None else []), "session").limit(sessions)
    bound = bound.join(F.broadcast(kept), "session", "left_semi")  # at most ``sessions`` rows
    open_ = unresolved.unionByName(newly).groupBy("entry_id").agg(F.max_by(F.struct("reason", "at"), "at").alias("last"))
    open_ = open_.join(fresh.select("entry_id").distinct(), "entry_id", "left_anti").join(active.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    return bound, open_.select("entry_id", "last.reason", "last.at").orderBy(F.desc("at"), "entry_id").limit(open_rows)


def unresolved_active(found: DataFrame, bindings: DataFrame, flagged: DataFrame) -> DataFrame:
    """ACTIVE entries that are flagged, or bound to no source."""
    live = found.where("coalesce(status, 'ACTIVE') = 'ACTIVE'").select("id").distinct()
    loose = live.join(bindings.select(F.col("entry_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit("unbound").alias("reason"))
    named = live.join(flagged.select(F.col("entry_id").alias("id"), F.coalesce("reason", F.lit("unbound")).alias("reason")), "id")
    return named.union(loose.join(named.select("id"), "id", "left_anti"))


def active_sources(units: DataFrame, bindings: DataFrame, found: DataFrame) -> DataFrame:
    """(session, pos, ids): ACTIVE entries whose bound sources a unit holds."""
    rows = units.select("session", "pos", F.explode("seqs").alias("seq")).join(bindings, ["session", "seq"])
    live = found.where("coalesce(status, 'ACTIVE') = 'ACTIVE'").select(F.col("id").alias("entry_id"))
    return rows.join(live, "entry_id", "left_semi").groupBy("session", "pos").agg(F.array_sort(F.collect_set("entry_id")).alias("ids"))
