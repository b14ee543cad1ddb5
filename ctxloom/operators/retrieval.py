"""What of the ledger a message needs, and what of it fits the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.functions import patterns as P
from ctxloom.functions.text import estimated_tokens, ledger_terms, other_letters, trim, wide_letters
from ctxloom.operators.contains import held
from ctxloom.operators.ledger import STATE


def held_terms(messages: DataFrame, terms: DataFrame) -> DataFrame:
    """(message_id, term) of terms that stand anywhere in a message, whatever the case; each text is read once."""
    low = messages.select(F.col("message_id").alias("row_id"), F.lower("text").alias("text"))
    return held(low, terms.select(F.col("term").alias("string"))).select(F.col("row_id").alias("message_id"), F.col("string").alias("term"))


#: Ids that a message can cite: three digits, as the ledger mints them.
CITED = r"(?<![A-Za-z0-9_])([A-Z]{2,10}-\d{3})(?![A-Za-z0-9_])"


def term_hits(messages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Messages with the numbers of vocabulary terms and entry ids that they hold.

    ``vocabulary`` is (term, is_id), see there. A term may stand inside a word, an id may not.
    """
    terms, ids = vocabulary.where("not is_id").select("term"), vocabulary.where("is_id").select(F.upper("term").alias("term")).distinct()
    said = held_terms(messages, terms).groupBy("message_id").agg(F.count("*").alias("n_terms"))
    cited = messages.select("message_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(CITED), 1))).alias("term"))
    cited = cited.join(ids, "term", "left_semi").groupBy("message_id").agg(F.count("*").alias("n_ids"))
    out = messages.join(said, "message_id", "left").join(cited, "message_id", "left")
    return out.withColumn("n_terms", F.coalesce("n_terms", F.lit(0))).withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))


def active(found: DataFrame) -> DataFrame:
    return found.where(f"coalesce(status, 'ACTIVE') = 'ACTIVE' and id <> '{STATE}'")


def entry_terms(found: DataFrame) -> DataFrame:
    """(id, term) of ACTIVE entries, from their titles and raw text."""
    return active(found).select("id", F.explode(ledger_terms(F.concat_ws("\n", "title", "raw"))).alias("term"))


def vocabulary(found: DataFrame) -> DataFrame:
    """(term, is_id): terms of ACTIVE entries, and all ids that any entry names."""
    ids = found.select(F.explode(F.regexp_extract_all("raw", F.lit(CITED), 1)).alias("term"), F.lit(True).alias("is_id"))
    return entry_terms(found).select("term", F.lit(False).alias("is_id")).union(ids).distinct()


def memory_class(text: Column, n_terms: Column, n_ids: Column) -> Column:
    """C0 (nothing) to C5 (everything); the first rule that holds decides."""
    low = F.lower(F.coalesce(text, F.lit("")))
    asks = low.rlike(P.INTENT_QUESTION)
    return (
        F.when(low.rlike(P.INTENT_FULL) | (n_ids >= 2) | (n_terms >= 6), "C5")
        .when(low.rlike(P.INTENT_GOAL), F.when(asks, "C3").otherwise("C4"))
        .when(low.rlike(P.INTENT_DECIDE) & ((n_terms >= 1) | (n_ids >= 1) | low.rlike("project|项目|ledger|账本")), "C4")
        .when(low.rlike(P.INTENT_STATUS), "C2")
        .when(low.rlike(P.INTENT_WORK), "C4")
        .when((n_terms >= 2) | (n_ids >= 1) | ((n_terms >= 1) & asks), "C3")
        .when((n_terms == 1) & (F.length(low) <= 80), "C2")
        .when((n_terms == 0) & (n_ids == 0) & trim(low).rlike(P.INTENT_CHAT), "C1")
        .otherwise("C0")
    )


#: Files in the order in which entries of equal merit are listed.
ORDER = ["DECISIONS.md", "TECH.md", "PROJECT.md", "CONFLICTS.md"]


def entry_hits(messages: DataFrame, found: DataFrame) -> DataFrame:
    """(message_id, id, hits, file, place): ACTIVE entries by the number of their terms that a message holds."""
    terms = entry_terms(found)
    hits = held_terms(messages, terms).join(terms, "term").groupBy("message_id", "id").agg(F.count("*").alias("hits"))
    return hits.join(active(found).select("id", "file", "place"), "id")


def _best_first() -> list[Column]:
    """Most hits first; equal ones in the order of their files and places."""
    return [F.desc("hits"), F.array_position(F.array(*map(F.lit, ORDER)), F.col("file")), F.col("place"), F.col("id")]


def matched_entries(messages: DataFrame, found: DataFrame, top: int = 4, file: str | None = None) -> DataFrame:
    """ACTIVE entries by the number of their terms that a message holds, the best ``top``.

    Equal ones come in the order of their files and places; ``file`` takes one file only.
    """
    found = found.where(F.col("file").isin([file] if file else ORDER))
    nth = F.row_number().over(Window.partitionBy("message_id").orderBy(*_best_first()))
    best = entry_hits(messages, found).withColumn("nth", nth).where(F.col("nth") <= top)
    return best.join(active(found).select("id", "file", "place", "title", "raw"), ["id", "file", "place"])


#: What a class shows of the ledger: entries related to the message by file, or the last of a file.
RELATED = {"C3": ((None, 4),), "C4": (("PROJECT.md", 4), ("DECISIONS.md", 4), ("TECH.md", 3))}
NEWEST = (("PROJECT.md", 8), ("DECISIONS.md", 12), ("TECH.md", 8))
HEAD = "## Project memory (class %s)\nThe ledger holds more: use memory_search for anything beyond this view."
MARKER = "\n…(state cut to the budget of its class; the whole text is in STATE.md)"


def related_blocks(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(message_id, b): entry blocks that a message's class takes, at their places; hits are computed once for all parts."""
    own = found.where(F.col("file").isin(ORDER))
    hits = entry_hits(asked.where(F.col("class").isin(*RELATED)), own).join(asked.select("message_id", "class", "scoped"), "message_id")
    limits = [(name, at, file, top) for name, parts in RELATED.items() for at, (file, top) in enumerate(parts)]
    of = lambda value, other: F.coalesce(*(F.when((F.col("class") == name) & (F.lit(True) if file is None else F.col("file") == file), F.lit(value(at, top))) for name, at, file, top in limits), F.lit(other))
    placed = hits.withColumn("at", of(lambda at, _: at, -1)).withColumn("top", of(lambda _, top: top, 0)).where("at >= 0")
    # A message that asks for its scope gets the first requirements instead of the related ones.
    placed = placed.where(~F.col("scoped") | ((F.col("class") == "C4") & (F.col("file") != "PROJECT.md")))
    nth = F.row_number().over(Window.partitionBy("message_id", "at").orderBy(*_best_first()))
    best = placed.withColumn("nth", nth).where(F.col("nth") <= F.col("top"))
    blocks = active(own).select("id", "file", "place", _entry_block().alias("block"))
    return best.join(blocks, ["id", "file", "place"]).select("message_id", F.struct("at", "nth", "block").alias("b"))


def _entry_block(title: str = "title") -> Column:
    return F.concat(F.lit("### "), "id", F.lit(" — "), title, F.lit("\n"), trim(F.col("raw")))


def views(found: DataFrame, state: Column, router: Column) -> DataFrame:
    """One row of what every message of a class sees alike: bounded numbers of entries, state and router."""
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("place")))
    first = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    live = active(found).select("file", "place", "id", "title", _entry_block().alias("block"), place.alias("back"), first.alias("front"))
    listed = lambda when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("place", "block")))), lambda x: x["block"])
    conflicts = F.transform(F.sort_array(F.collect_list(F.when(F.col("file") == "CONFLICTS.md", F.struct("place", F.concat(F.lit("- ["), "id", F.lit("] "), "title").alias("block"))))), lambda x: x["block"])
    newest = F.concat(*(listed((F.col("file") == f) & (F.col("back") <= n)) for f, n in NEWEST))
    got = live.agg(newest.alias("newest"), listed((F.col("file") == "PROJECT.md") & (F.col("front") <= 4)).alias("scope"), F.array_join(conflicts, "\n").alias("conflicts"))
    blank = lambda c, other: F.coalesce(F.nullif(trim(c), F.lit("")), F.lit(other))
    return got.withColumn("state", blank(state, "(unknown)")).withColumn("router", blank(router, "(empty ledger)"))


def render_context(messages: DataFrame, found: DataFrame, state: Column, router: Column) -> DataFrame:
    """(message_id, class, context) of messages with a class: what fits its budget, in a fixed order.

    Entries are shown whole or not at all; the state alone may be cut, at a line. Messages of
    C0 and C1 get an empty context.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    asked = messages.select("message_id", "class", "text", (low.rlike(P.INTENT_GOAL) | low.rlike(P.INTENT_WORK)).alias("scoped"))
    related = related_blocks(asked, found)
    related = related.groupBy("message_id").agg(F.sort_array(F.collect_list("b")).alias("related"))
    shown = class_views(views(found, state, router))
    out = asked.drop("text").join(F.broadcast(shown), "class", "left").join(related, "message_id", "left")  # a bounded row for each of six classes
    none = F.array().cast("array<string>")
    own = F.coalesce(F.transform("related", lambda b: b["block"]), none)
    scope = F.when(F.col("scoped") & F.col("class").isin("C3", "C4"), F.col("scope")).otherwise(none)
    behind = F.concat(scope, own, F.coalesce("full", none))
    blocks = F.transform(behind, lambda b: F.struct(b.alias("text"), wide_letters(b).cast("long").alias("wide"), other_letters(b).cast("long").alias("other")))
    price = lambda x: x["wide"] + F.ceil(x["other"] / 4)
    more = lambda a, b: F.struct(F.concat(a["text"], F.lit("\n\n"), b["text"]).alias("text"), (a["wide"] + b["wide"]).alias("wide"), (a["other"] + b["other"] + 2).alias("other"))
    start = F.struct("text", wide_letters(F.col("text")).cast("long").alias("wide"), other_letters(F.col("text")).cast("long").alias("other"))
    told = F.aggregate(blocks, start, lambda a, b: F.when(price(a) + price(b) <= F.col("budget"), more(a, b)).otherwise(a))["text"]
    return out.select("message_id", "class", F.when(F.col("budget") > 0, told).otherwise("").alias("context"))


def class_views(view: DataFrame) -> DataFrame:
    """A row for each class, with its budget, what it shows to every message (head, router, state) and its fixed blocks.

    The state may be cut, at a line, where the budget of a class ends; that is worked out once a class.
    """
    budgets = F.create_map(*(F.lit(x) for pair in P.CLASS_BUDGETS.items() for x in pair))
    rows = view.withColumn("class", F.explode(F.array(*map(F.lit, P.CLASS_BUDGETS)))).withColumn("budget", F.try_element_at(budgets, F.col("class")))
    none = F.array().cast("array<string>")
    conflicts = F.when(F.col("conflicts") != "", F.array(F.concat(F.lit("### Open conflicts (need user confirmation)\n"), "conflicts"))).otherwise(none)
    full = F.when(F.col("class") == "C5", F.concat("newest", conflicts)).otherwise(none)
    router_block = F.when(F.col("class").isin("C4", "C5"), F.array(F.concat(F.lit("### Router\n"), "router"))).otherwise(none)
    rows = rows.select("class", "budget", "state", "scope", full.alias("full"), F.concat(F.array(F.format_string(HEAD, "class")), router_block).alias("ahead"))
    joined = lambda text, block: F.when(text == "", block).otherwise(F.concat(text, F.lit("\n\n"), block))
    take = lambda a, b: F.when(estimated_tokens(a) + estimated_tokens(b) <= F.col("budget"), joined(a, b)).otherwise(a)
    rows = rows.withColumn("text", F.aggregate("ahead", F.lit(""), take))
    lead, whole = F.lit("### Current state\n"), F.concat(F.lit("### Current state\n"), F.col("state"))
    start = F.struct(lead.alias("text"), F.lit(False).alias("done"))
    fits = lambda block: estimated_tokens(joined(F.col("text"), F.concat(block, F.lit(MARKER)))) <= F.col("budget")
    step = lambda a, line: F.when(a["done"] | ~fits(F.concat(a["text"], line, F.lit("\n"))), F.struct(a["text"].alias("text"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(a["text"], line, F.lit("\n")).alias("text"), F.lit(False).alias("done")))
    cut = F.concat(F.regexp_replace(F.aggregate(F.split("state", "\n"), start, step)["text"], r"\s+\z", ""), F.lit(MARKER))
    rows = rows.withColumn("cut", cut)
    with_state = F.when(estimated_tokens(F.col("text")) + estimated_tokens(whole) <= F.col("budget"), joined(F.col("text"), whole)).when(estimated_tokens(joined(F.col("text"), F.col("cut"))) <= F.col("budget"), joined(F.col("text"), F.col("cut"))).otherwise(F.col("text"))
    return rows.select("class", "budget", "scope", "full", with_state.alias("text"))


def budgeted(blocks: DataFrame, budget: Column) -> DataFrame:
    """By message, the blocks that fit, in order, whole or not at all.

    A block that doesn't fit is passed over and later ones may still fit. What is taken is
    priced as the joined text, then the new block on its own.
    """
    ordered = F.sort_array(F.collect_list(F.struct("at", "block")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    took = lambda a, b: F.struct(F.when(a["text"] == "", b["block"]).otherwise(F.concat(a["text"], F.lit("\n\n"), b["block"])).alias("text"), (a["n"] + 1).alias("n"))
    fold = F.aggregate("_blocks", start, lambda a, b: F.when(estimated_tokens(a["text"]) + estimated_tokens(b["block"]) <= F.col("_budget"), took(a, b)).otherwise(a))
    gathered = blocks.groupBy("message_id").agg(ordered.alias("_blocks"), F.first(budget).alias("_budget"))
    return gathered.select("message_id", fold.alias("f")).select("message_id", F.col("f.text").alias("context"), F.col("f.n").alias("n_blocks"))
