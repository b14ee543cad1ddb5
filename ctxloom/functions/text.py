"""Scalar text functions, Column to Column, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxloom.functions import patterns as P

CJK = r"[㐀-鿿぀-ヿ가-힯]"


def trim(text: Column) -> Column:
    """Both ends' white space of any ASCII kind."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def collapsed(text: Column) -> Column:
    """Lower case, white space as single spaces, trimmed."""
    return _single_spaced(F.lower(text))


def _single_spaced(text: Column) -> Column:
    """White space as single spaces, trimmed; single spaces match nothing and stay."""
    return F.trim(F.regexp_replace(text, r"[\t-\r]\s*| \s+", " "))


def fingerprint_text(text: Column) -> Column:
    """What two texts share when they differ in volatile parts only."""
    return _single_spaced(reduce(lambda t, p: F.regexp_replace(t, p, " "), P.VOLATILE, F.lower(text)))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha1(fingerprint_text(text)), 1, 16)


def tool_group_key(name: Column, args: Column) -> Column:
    head = F.substring(fingerprint_text(args), 1, 200)
    return F.concat(name, F.lit(":"), F.substring(F.sha1(F.concat(name, F.lit("\0"), head)), 1, 8))


def lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), trim), lambda x: x != "")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group))


def keywords(text: Column) -> Column:
    stop = F.array(*map(F.lit, P.KEYWORD_STOP.split()))
    return F.array_except(F.transform(found(text, "[a-zA-Z]{4,}"), F.lower), stop)


def cjk_bigrams(text: Column) -> Column:
    """Two-letter windows of runs of CJK letters."""
    runs = F.regexp_extract_all(text, F.lit(CJK + "{2,}"), 0)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))


def symbols(text: Column) -> Column:
    """Names in a text, each once, judged once; what the pattern finds has three letters or more and begins and ends within a name."""
    stop = P.KEYWORD_STOP.split()
    return F.filter(found(text, P.SYMBOL), lambda s: s.rlike(r"[A-Z0-9_-]|^[a-z]{5,}\z") & ~F.lower(s).isin(*stop))


def terms(text: Column) -> Column:
    """Lower-case term lanes of a text, as one struct."""
    low = lambda a: F.array_distinct(F.transform(a, F.lower))
    models = F.filter(found(text, P.MODEL_NAME), lambda m: m.rlike(r"\d"))
    ports = F.transform(found(text, P.PORT), lambda p: F.substr(p, F.lit(2)))
    codes = F.concat(found(text, P.ERROR_CODE), found(text, P.STATUS_CODE), ports)
    return F.struct(
        low(found(text, P.MEMORY_ID)).alias("ids"),
        low(F.concat(found(text, P.PATH_WIN), found(text, P.PATH_UNIX), found(text, P.PATH_REL))).alias("paths"),
        low(found(text, P.URL)).alias("urls"),
        low(found(text, P.VERSION)).alias("versions"),
        low(codes).alias("errors"),
        low(F.array_union(models, found(text, P.VERSION))).alias("models"),
        low(symbols(text)).alias("symbols"),
        F.array_union(keywords(text), cjk_bigrams(text)).alias("keywords"),
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def spelled_once(values: Column) -> Column:
    """Distinct values whatever their case, the first spelling of each, in their order; by sorting, twice."""
    marked = F.sort_array(F.transform(values, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    firsts = let(marked, lambda m: F.filter(m, lambda e, i: (i == 0) | ~F.get(m, i - 1)["low"].eqNullSafe(e["low"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def extracted(text: Column) -> Column:
    """All thirteen term lanes of a text in their own spelling, as one struct."""
    lane = lambda p, g=0: spelled_once(found(text, p, g))
    ports = spelled_once(F.transform(found(text, P.PORT), lambda p: F.substr(p, F.lit(2))))
    return F.struct(
        lane(P.MEMORY_ID).alias("ids"),
        spelled_once(F.concat(found(text, P.PATH_WIN), found(text, P.PATH_UNIX), found(text, P.PATH_REL))).alias("paths"),
        lane(P.URL).alias("urls"),
        lane(P.VERSION).alias("versions"),
        spelled_once(F.concat(found(text, P.ERROR_CODE), found(text, P.STATUS_CODE), ports)).alias("errors"),
        ports.alias("ports"),
        lane(P.IP).alias("ips"),
        spelled_once(found(text, P.COMMAND, 0)).alias("commands"),
        spelled_once(F.filter(found(text, P.MODEL_NAME), lambda m: m.rlike(r"\d"))).alias("models"),
        lane(P.NUMBER_UNIT_ANY_CASE).alias("numbers"),
        spelled_once(symbols(text)).alias("symbols"),
        spelled_once(keywords(text)).alias("keywords_en"),
        cjk_bigrams(text).alias("keywords_zh"),
    )


def exact_facts(text: Column) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), g) for p, g in P.FACTS)))


def exact_atoms(text: Column) -> Column:
    """Values that must not change unseen, of the text in lower case, which is worked out once.

    A pattern is tried only where the text holds what each of its matches does.
    """
    none = F.array().cast("array<string>")

    def of(low: Column) -> Column:
        found_ = [F.regexp_extract_all(low, F.lit(p), g) for p, g in P.ATOMS]
        first, last = P.ATOMS_OF_DIGITS
        lanes = [F.when(F.contains(low, F.lit(P.ATOM_SIGNS[i])), a).otherwise(none) if i in P.ATOM_SIGNS else a for i, a in enumerate(found_)]
        lanes[first:last] = [F.when(low.rlike(r"\d"), F.concat(*lanes[first:last])).otherwise(none)]
        return F.when(low.isNotNull(), F.array_distinct(F.transform(F.concat(*lanes), trim)))

    return let(collapsed(text), of)


def is_greeting(text: Column) -> Column:
    bare = trim(F.coalesce(text, F.lit("")))
    return (F.length(bare) <= 60) & ~bare.rlike(r"\d|`|/|\\") & bare.rlike(P.GREETING)


def estimated_tokens(text: Column) -> Column:
    """One for each CJK letter, one for every four other characters."""
    return (wide_letters(text) + F.ceil(other_letters(text) / 4)).cast("long")


def other_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, CJK, ""))


def wide_letters(text: Column) -> Column:
    """Letters of ``CJK``; with the other ones they can be summed up over parts of a text."""
    return F.length(text) - other_letters(text)


#: Wide letters as prices see them, more than the letters of ``CJK``.
WIDE = r"[\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef]"
BLOCK_OVERHEAD, MESSAGE_OVERHEAD = 4, 4


def text_units(text: Column) -> Column:
    """Characters as priced: a wide one counts 8/3."""
    other = F.length(F.regexp_replace(text, WIDE, ""))
    return other + (F.length(text) - other) * (8 / 3)


def calibrated_tokens(text: Column, code: Column) -> Column:
    """Four characters a token in prose, 1.8 in code, and four for the block."""
    return F.ceil(text_units(text) / F.when(code, 1.8).otherwise(4.0)) + 4


def priced_message(blocks: Column) -> Column:
    """Tokens of a message by its blocks (type, text, name, arguments, content): results are code, unknown blocks cost their JSON."""
    said = lambda c, rate: F.ceil(text_units(F.coalesce(c, F.lit(""))) / rate)
    prose, code = 4.0, 1.8
    one = lambda b: (
        F.when(b["type"].isin("text", "reasoning"), said(b["text"], prose))
        .when(b["type"] == "tool-call", said(b["name"], prose) + said(b["arguments"], code))
        .when(b["type"] == "tool-result", F.when(F.coalesce(F.length(b["content"]), F.lit(0)) > 0, said(b["content"], code) + BLOCK_OVERHEAD).otherwise(0))
        .otherwise(said(F.to_json(b), prose))
    )
    total = F.aggregate(F.coalesce(blocks, F.array().cast("array<struct<type:string,text:string,name:string,arguments:string,content:string>>")), F.lit(0).cast("long"), lambda a, b: a + (one(b) + BLOCK_OVERHEAD).cast("long"))
    return total + MESSAGE_OVERHEAD


def priced_structure(json: Column) -> Column:
    """Tokens of a surface event without a message, by its JSON."""
    return (F.ceil(text_units(F.coalesce(json, F.lit('""'))) / 4.0) + BLOCK_OVERHEAD).cast("long")


def priced_header(system: Column, tools: Column) -> Column:
    """Tokens of what every request carries: the system text, and the tools as JSON where there are any."""
    part = lambda c: F.ceil(text_units(c) / 4.0) + 4
    return (F.when(system.isNotNull(), part(system)).otherwise(0) + F.when(~tools.isin("[]", ""), part(tools)).otherwise(0)).cast("long")


def flat_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def evidence_terms(title: Column, quote: Column) -> Column:
    stop = F.array(*map(F.lit, P.EVIDENCE_STOP.split()))
    words = F.split(F.lower(F.concat_ws(" ", title, quote)), r"[^a-z0-9㐀-鿿_.-]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))), 1, 12)


def ledger_terms(text: Column) -> Column:
    stop = F.array(*map(F.lit, P.LEDGER_STOP.split()))
    low = F.lower(text)
    ascii_terms = F.transform(F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9+#._-]{2,}"), 0), lambda t: F.regexp_replace(t, r"^[.+_-]+|[.+_-]+\z", ""))
    kept = F.filter(ascii_terms, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    runs = F.regexp_extract_all(low, F.lit(CJK + "{2,}"), 0)
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 8, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 3, F.lit(1))), lambda i: F.substr(r, i, F.lit(4))))))
    return F.array_distinct(F.concat(kept, grams))


def half_up(x: Column, places: int) -> Column:
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def clamped(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(F.isnan(x) | x.isNull(), lo).otherwise(F.least(F.greatest(x, lo), hi))


def positive_integer(raw: Column) -> Column:
    """A positive whole number out of a string, else null; fractions and unsafe sizes are refused."""
    number = raw.try_cast("double")
    return F.when((number > 0) & (number < 9007199254740992.0) & (number == F.floor(number)), number.cast("long"))


def is_overflow_message(message: Column) -> Column:
    return F.coalesce(message.rlike(P.OVERFLOW), F.lit(False))


def route_key(provider: Column, model: Column, strict_parity: bool = False) -> Column:
    """``provider/model`` where both are one word; strict parity also refuses the letter s."""
    part = r"[^/\\\\s]+" if strict_parity else r"[^/\s]+"  # a class of slash, backslash and s
    key = F.concat_ws("/", F.coalesce(provider, F.lit("")), F.coalesce(model, F.lit("")))
    return F.when(key.rlike(rf"^{part}/{part}\z"), key).otherwise("")


def persistent_pointer(facts: Column) -> Column:
    """The block that names facts kept elsewhere, each once; empty for none."""
    kept = F.array_distinct(F.filter(F.coalesce(facts, F.array().cast("array<string>")), lambda f: F.length(f) > 0))
    return F.when(F.size(kept) > 0, F.concat(F.lit("Persistent details:\n"), F.array_join(kept, "\n"))).otherwise("")


def shown(text: Column, most: int = 40_000) -> Column:
    """A text as a viewer shows it: what is over ``most`` characters is told, not shown."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n… ("), (F.length(text) - most).cast("string"), F.lit(" more characters)"))).otherwise(text)


def share(x: Column) -> Column:
    """0.1234 as 12.3%."""
    return F.format_string("%.1f%%", x * 100.0)


def bytes_shown(n: Column) -> Column:
    """1536 as 1.5 KB."""
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%d B", n.cast("long")))


def short_count(n: Column) -> Column:
    """12345 as 12.3K."""
    return F.when(n >= 1000, F.format_string("%.1fK", n / 1000.0)).otherwise(F.format_string("%d", n.cast("long")))
