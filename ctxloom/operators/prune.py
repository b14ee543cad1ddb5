"""Fresh pruning of tool results: unique lines, per-tool reducers, drop and reduce actions.

Reducers keep what a later reader needs and a pointer to the whole. They are array
expressions over the body's lines, so they run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.config import Config
from ctxloom.functions.text import fingerprint, flat_tokens, let, spelled_once, trim

#: How many of each kind a reducer keeps, and below what nothing is reduced.
ERRORS, WARNINGS, TAIL, HUNKS, SYMBOLS, PREVIEW, MATCHES = 8, 4, 8, 12, 12, 3, 200
LEAST_LINES, LEAST_CHARS = 32, 1600
CALLS = "\n[tool-calls] "


def unique_lines(lines: Column) -> Column:
    """(kept, dropped): distinct lines whatever their case, the first spelling of each."""
    kept = spelled_once(lines)
    return let(kept, lambda k: F.struct(k.alias("kept"), (F.size(lines) - F.size(k)).cast("long").alias("dropped")))


def _block(title: str, lines: Column, most: int, note: Column | None = None) -> Column:
    """A titled list, or nothing; the title tells how many there were."""
    count = F.concat(F.lit(f"{title} ("), F.size(lines).cast("string"), note if note is not None else F.lit(""), F.lit("):"))
    return F.when(F.size(lines) > 0, F.concat(F.array(count), _indent(F.slice(lines, 1, most)))).otherwise(F.array().cast("array<string>"))


def _indent(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.concat(F.lit("  "), x))


def _plain(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), _indent(lines))).otherwise(F.array().cast("array<string>"))


def _like(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: x.rlike(pattern))


def _tail(lines: Column) -> Column:
    return F.slice(lines, F.greatest(F.size(lines) - TAIL + 1, F.lit(1)), F.lit(TAIL))


def _last(text: Column, pattern: str, label: str) -> Column:
    """The last number of a pattern, under its label."""
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))
    return F.when(found.isNotNull(), F.array(F.concat(F.lit(label), found))).otherwise(F.array().cast("array<string>"))


EXIT = r"(?i)(?<![A-Za-z0-9_])exit\s*code\s*:?\s*(\d+)"


def _shell(body: Column, lines: Column) -> Column:
    errors = unique_lines(_like(lines, r"(?i)error|exception|fatal|panic|traceback|segmentation|cannot |no such "))
    repeated = F.when(errors["dropped"] > 0, F.concat(F.lit(", "), errors["dropped"].cast("string"), F.lit(" duplicated"))).otherwise("")
    warnings = unique_lines(_like(lines, r"(?i)warning|warn:"))
    return F.concat(_last(body, EXIT, "Exit Code: "), _block("Primary Errors", errors["kept"], ERRORS, repeated), _block("Warnings", warnings["kept"], WARNINGS), _plain("Last lines:", _tail(lines)))


def _tests(body: Column, lines: Column) -> Column:
    number = lambda words: F.try_element_at(F.regexp_extract_all(body, F.lit(rf"(?i)(?<![A-Za-z0-9_])(\d+)\s+(?:{words})(?![A-Za-z0-9_])"), 1), F.lit(-1))
    counts = F.array_compact(F.array(*(F.when(number(w).isNotNull(), F.concat(F.lit(f"{n}: "), number(w).cast("long").cast("string"))) for n, w in (("passed", "passing|passed"), ("failed", "failing|failed"), ("skipped", "skipped|pending")))))
    total = r"(?i)(?<![A-Za-z0-9_])\d+\s+(?:passing|passed|skipped|pending|failing|failed)(?![A-Za-z0-9_])"
    fails = F.transform(lines, lambda x: x.rlike(r"(?i)✖|✗|(?<![A-Za-z0-9_])fail(ed|ure)?(?![A-Za-z0-9_])|Error:") & ~x.rlike(total))
    at = F.array_position(fails, True)
    block = F.when(at > 0, F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.lit(6))).otherwise(F.array().cast("array<string>"))
    origin = F.get(_like(block, r"at |Error:|File \"|\.js:\d+:\d+|\.py:\d+|\.ts:\d+"), 0)
    first = F.concat(_plain("First failure:", F.slice(block, 1, 3)), F.when(origin.isNotNull(), F.array(F.concat(F.lit("  stack origin: "), origin))).otherwise(F.array().cast("array<string>")))
    good = unique_lines(F.filter(lines, lambda x: x.rlike(r"(?i)✔|✓|(?<![A-Za-z0-9_])pass(ed|ing)?(?![A-Za-z0-9_])|ok(?![A-Za-z0-9_])") & ~x.rlike(r"(?i)failing|failed")))
    repeated = F.when(good["dropped"] > 0, F.concat(F.lit(", "), good["dropped"].cast("string"), F.lit(" duplicated dropped"))).otherwise("")
    head = F.when(F.size(counts) > 0, F.array(F.concat(F.lit("Results: "), F.array_join(counts, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, _last(body, EXIT, "Exit Code: "), first, _block("Success cases", good["kept"], SYMBOLS, repeated))


def _diff(body: Column, raw: Column) -> Column:
    stat = F.try_element_at(F.regexp_extract_all(body, F.lit(r"(\d+)\s+files? changed"), 1), F.lit(-1))
    heads = F.size(_like(raw, "^diff --git "))
    files = F.coalesce(stat, F.when(heads > 0, heads.cast("string")))
    count = lambda sign: F.size(_like(raw, rf"^[{sign}](?![{sign}]{{2}})")).cast("string")
    hunks = unique_lines(F.transform(_like(raw, "^@@"), trim))
    names = unique_lines(F.transform(_like(raw, r"^[+-]\s*(?:export\s+)?(?:function|class|const|let|def|type|interface|public|private)(?![A-Za-z0-9_])"), lambda x: trim(F.regexp_replace(x, r"^[+-]\s*", ""))))
    repeated = F.when(hunks["dropped"] > 0, F.concat(F.lit(", "), hunks["dropped"].cast("string"), F.lit(" duplicated"))).otherwise("")
    head = F.array_compact(F.array(F.concat(files, F.lit(" files changed")), F.concat(F.lit("line counts: +"), count("+"), F.lit(" -"), count("-"))))
    return F.concat(head, _block("Hunks", hunks["kept"], HUNKS, repeated), _block("Symbols", names["kept"], SYMBOLS))


def _read_file(body: Column, lines: Column, args: Column) -> Column:
    path = F.regexp_extract(args, r"[A-Za-z]:\\[A-Za-z0-9_\\.-]+|/[A-Za-z0-9_./-]+|[A-Za-z0-9_][A-Za-z0-9_./-]*\.[A-Za-z0-9_]{1,8}", 0)
    names = unique_lines(_like(lines, r"export (?:default )?(?:async )?(?:function|class|const|let|type|interface)|^(?:function|class|def|const) [A-Za-z_$]"))
    head = F.array_compact(F.array(F.when(path != "", F.concat(F.lit("path: "), path)), F.concat(F.lit("hash: "), fingerprint(body))))
    reach = F.array(F.concat(F.lit("range: lines 1-"), F.size(lines).cast("string"), F.lit(" (preview)")))
    return F.concat(head, _block("Symbols", names["kept"], SYMBOLS), reach, _indent(F.slice(lines, 1, PREVIEW)))


def _search(lines: Column) -> Column:
    u = unique_lines(lines)
    n = F.size(u["kept"])
    repeated = F.when(u["dropped"] > 0, F.concat(F.lit(", "), u["dropped"].cast("string"), F.lit(" duplicates dropped"))).otherwise("")
    head = F.array(F.concat(F.lit("Matches ("), n.cast("string"), repeated, F.lit("):")))
    more = F.when(n > MATCHES, F.array(F.concat(F.lit("  … "), (n - MATCHES).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, _indent(F.slice(u["kept"], 1, MATCHES)), more)


def _other(body: Column, lines: Column) -> Column:
    errors = unique_lines(_like(lines, r"(?i)error|exception|fatal|traceback"))
    tail = _tail(lines)
    last = F.when(F.size(tail) > PREVIEW, _plain("Last lines:", tail)).otherwise(F.array().cast("array<string>"))
    return F.concat(_last(body, EXIT, "Exit Code: "), _block("Primary Errors", errors["kept"], ERRORS), F.concat(F.array(F.lit("Head:")), _indent(F.slice(lines, 1, PREVIEW))), last)


def reduced(units: DataFrame, raw: Column | None = None) -> DataFrame:
    """Adds reduced, the shorter form of (tool, args, text), and shrank; short results stay. ``raw`` is the text's fingerprint where it is known."""
    n_lines = F.size(F.split("text", r"\r?\n"))
    cut = F.locate(CALLS, F.col("text"))
    name = F.lower(F.coalesce("tool", F.lit("")))
    out = units.withColumn("_header", F.when(cut > 1, F.substr("text", F.lit(1), cut - 1)).otherwise("")).withColumn("_body", F.when(cut > 0, F.substr("text", cut + 1)).otherwise(F.col("text")))
    out = out.withColumn("_raw", F.split("_body", r"\r?\n")).withColumn("_lines", F.filter(F.transform("_raw", trim), lambda x: x != ""))
    body, lines = F.col("_body"), F.col("_lines")
    kept = (
        F.when(name.rlike(r"bash|shell|pwsh|powershell|cmd|sh(?![a-z0-9_])"), _shell(body, lines))
        .when(name.rlike(r"(?<![a-z0-9_])test(?![a-z0-9_])|vitest|jest|pytest|unittest"), _tests(body, lines))
        .when(name.rlike("git") & name.rlike("diff|status|log"), _diff(body, F.col("_raw")))
        .when(name.rlike(r"^read\z|file ?read|cat|head|tail"), _read_file(body, lines, F.coalesce("args", F.lit(""))))
        .when(name.rlike("grep|search|glob|find|rg|web"), _search(lines))
        .otherwise(_other(body, lines))
    )
    pointer = F.concat(F.lit("raw: "), fingerprint(F.col("text")) if raw is None else raw, F.lit(" ("), n_lines.cast("string"), F.lit(" lines, reconstructible)"))
    made = F.array_join(F.filter(F.concat(F.array(F.col("_header")), kept, F.array(pointer)), lambda x: x != ""), "\n")
    small = (n_lines < LEAST_LINES) & (F.length("text") < LEAST_CHARS)
    out = out.withColumn("reduced", F.when(small, F.col("text")).otherwise(made))
    return out.withColumn("shrank", F.length("reduced") < F.length("text")).drop("_header", "_body", "_raw", "_lines")


def planned(units: DataFrame, zone: Column, config: Config = Config()) -> DataFrame:
    """Adds action (drop, reduce, none) and the tokens it gives back.

    Only closed, unprotected TRASH results take part; one in the recent floor only if it can
    be made again, and then it is reduced but never dropped. Later duplicates are dropped
    except in Z0. Gates come before the reducers, which run on what passes them. Reducers and prices
    come before the search for duplicates, so that it needn't carry texts; units may hold ``raw``, the fingerprint of their text.
    """
    tool = F.col("kind").isin("tool-pair", "tool-result") & ~F.col("open") & (F.col("protection") == "NORMAL") & (F.col("tier") == "TRASH")
    gated = units.withColumn("_in", tool & (~F.col("in_floor") | (F.col("x") >= config.recent.bypass_x)))
    fp = F.col("raw") if "raw" in units.columns else fingerprint("text")
    inside = reduced(gated.where("_in").withColumn("_fp", fp), F.col("_fp"))
    inside = inside.withColumns({"_before": flat_tokens(F.col("text")), "_back": F.greatest(F.lit(0), flat_tokens(F.col("text")) - flat_tokens(F.col("reduced")))}).drop("reduced")
    inside = inside.withColumn("_again", F.row_number().over(Window.partitionBy("session", "_fp").orderBy("pos")) > 1)
    other = F.when(F.col("shrank"), "reduce").otherwise("none")  # a branch of its own: who asks for drops only needs no reducer
    action = F.when(F.col("_again") & (zone != "Z0") & ~F.col("in_floor"), "drop").otherwise(other)
    inside = inside.withColumn("action", action).withColumn("reclaim", F.when(F.col("action") == "drop", F.col("_before")).when(F.col("action") == "reduce", F.col("_back")).otherwise(0).cast("long"))
    rest = gated.where("not _in").withColumn("action", F.lit("none")).withColumn("reclaim", F.lit(0).cast("long"))
    return inside.drop("_fp", "_again", "_before", "_back", "shrank", "_in").unionByName(rest.drop("_in"))


def stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("session").agg(
        F.count("*").alias("scanned"), F.count_if(F.col("tier") == "TRASH").alias("trash"), F.count_if(F.col("action") == "reduce").alias("reduced"), F.count_if(F.col("action") == "drop").alias("dropped"), F.count_if(F.col("action") == "none").alias("untouched"), F.sum("reclaim").alias("reclaim")
    )


def shadow_price(meter: Column, fallback: Column, chars: Column) -> Column:
    """What a replaced node was worth: the meter's price, else the fallback's, else a token for four characters."""
    usable = lambda c: F.when(~F.isnan(c.cast("double")) & (c >= 0) & (c < float("inf")), c.cast("double"))
    return F.coalesce(usable(meter), usable(fallback), F.ceil(chars / 4).cast("double"))


def price_events(surface: DataFrame, landed_: DataFrame, meter: Column, fallback: Column) -> DataFrame:
    """(session, seq, shadowed_seqs, shadowed_tokens) of each replaced node, as it is told before the replacement."""
    done = landed_.where("replaced").select("session", "seq")
    old = surface.join(done, ["session", "seq"], "left_semi")
    return old.select("session", "seq", F.array("seq").alias("shadowed_seqs"), shadow_price(meter, fallback, F.length("text")).alias("shadowed_tokens"))


STUB = "[pruned: duplicate tool result — raw: %s (reconstructible)]"


def landed(surface: DataFrame, actions: DataFrame) -> DataFrame:
    """The surface with the nodes of acted-on units replaced, each by its unit's first action.

    ``actions`` hold (session, pos, action, seqs, text, reduced); only shorter texts land.
    """
    new = F.when(F.col("action") == "drop", F.format_string(STUB, fingerprint("text"))).when(F.col("action") == "reduce", F.col("reduced"))
    nodes = actions.where("action <> 'none'").select("session", "pos", F.explode("seqs").alias("seq"), new.alias("_new"), F.length("text").alias("_was")).where(F.length("_new") < F.col("_was"))
    first = nodes.groupBy("session", "seq").agg(F.min_by("_new", "pos").alias("_new"))
    out = surface.join(first, ["session", "seq"], "left").withColumn("replaced", F.col("_new").isNotNull())
    return out.withColumn("source_event_seqs", F.when(F.col("replaced"), F.array("seq"))).withColumn("text", F.coalesce("_new", "text")).drop("_new")


def node_prunes(surface: DataFrame, actions: DataFrame) -> DataFrame:
    """(session, seq, pos, i, action, new, before): what each acted-on result node on a surface becomes.

    ``surface`` are (session, seq, role, text); a node whose content isn't text alone has a null text
    and is left alone. ``actions`` are (session, pos, action, tool, args, raw, result_seqs) of a plan,
    in the order of ``pos``. A node is reduced by its own text, not its unit's, and replaced only
    if that is shorter; of several actions the first that shortens it counts.
    """
    each = actions.where(F.col("action").isin("drop", "reduce")).select("session", "pos", "action", "tool", "args", "raw", F.posexplode("result_seqs").alias("i", "seq"))
    nodes = surface.where((F.col("role") == "tool") & F.col("text").isNotNull()).select("session", "seq", "text")
    met = reduced(each.join(nodes, ["session", "seq"]))
    stub = F.format_string(STUB, "raw")
    new = F.when((F.col("action") == "drop") & (F.length(stub) < F.length("text")), stub).when((F.col("action") == "reduce") & F.col("shrank"), F.col("reduced"))
    good = met.select("session", "seq", F.struct("pos", "i", "action", new.alias("new"), F.length("text").alias("before")).alias("p")).where("p.new is not null")
    return good.groupBy("session", "seq").agg(F.min("p").alias("p")).select("session", "seq", "p.*")


#: Positions that one window of row numbers spans.
BLOCK = 4096


def in_plan_order(prunes: DataFrame) -> DataFrame:
    """(session, seq, _k): the number of each pruned node in its session's plan.

    Nodes are counted by block of positions and the counts summed up, so that no task sorts a session; texts stay behind.
    """
    keys = prunes.select("session", "seq", "pos", "i", F.floor(F.col("pos") / BLOCK).alias("_block"))
    counts = keys.groupBy("session", "_block").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("session").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy("session", "_block").orderBy("pos", "i", "seq"))
    return keys.withColumn("_in", inside).join(counts.select("session", "_block", earlier.alias("_earlier")), ["session", "_block"]).select("session", "seq", (F.col("_earlier") + F.col("_in")).alias("_k"))


def landing(surface: DataFrame, prunes: DataFrame, last: DataFrame, meter: Column) -> tuple[DataFrame, DataFrame]:
    """The events that landing ``prunes`` appends to the log, and the surface after it.

    ``last`` (session, last_seq) ends each log; ``meter`` prices a surface row. For each replaced node, in
    plan order, comes an event with what the node was worth, then the replacement, which points to
    what it replaces and takes its place on the surface.
    """
    old = surface.select("session", "seq", meter.alias("_meter"))
    done = prunes.join(in_plan_order(prunes), ["session", "seq"]).join(last, "session").join(old, ["session", "seq"]).select("session", "seq", "new", "action", (F.col("last_seq") + 2 * F.col("_k")).alias("_new_seq"), shadow_price(F.col("_meter"), F.lit(None).cast("double"), F.col("before")).alias("_price"))
    told = done.select("session", (F.col("_new_seq") - 1).alias("seq"), F.lit("compaction/prune").alias("type"), F.array("seq").alias("shadowed_seqs"), F.col("_price").alias("shadowed_tokens"), F.lit(None).cast("string").alias("text"))
    made = done.select("session", F.col("_new_seq").alias("seq"), F.lit("tool/result").alias("type"), F.array("seq").alias("shadowed_seqs"), F.lit(None).cast("double").alias("shadowed_tokens"), F.col("new").alias("text"))
    after = surface.join(done.select("session", "seq", "_new_seq", "new"), ["session", "seq"], "left")
    replaced = F.col("_new_seq").isNotNull()
    after = after.withColumns({"text": F.coalesce("new", "text"), "source_event_seqs": F.when(replaced, F.array("seq")), "seq": F.coalesce("_new_seq", "seq")}).drop("_new_seq", "new")
    return told.unionByName(made), after
