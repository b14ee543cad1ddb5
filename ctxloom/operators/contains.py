"""Which texts hold which strings: one pass over each text by an Aho-Corasick automaton.

Strings for all texts alike (``contained``, ``held``) are collected after their size was read, cut
into slices of a bounded size, and each slice is broadcast. More of them than ``SLICES`` slices are
met by an equi-join instead: on the rarest whole word inside a string, or on its first letters where it has
none, and then compared. Strings of a scope (``held_once``) meet the texts of their scope only: both
sides are grouped by scope, a scope with many texts is dealt to several tasks, and one with more strings
than a task should hold is met by the rarest word too. No side is tried against all of the other.
Searches run in Arrow batches; the workers need ``pyahocorasick``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of strings in one automaton (it takes some forty times that), and automata for one set of texts.
SLICE_BYTES, SLICES = 1 << 20, 8
#: Bytes of text that one task takes of a scope.
SCOPE_BYTES = 16 << 20
#: Bytes of texts and strings of small scopes that are searched in one call.
BUCKET_BYTES = 1 << 20
#: Letters by which strings without an inner word are met.
GRAM = 4

_BUILT: dict[str, object] = {}


def automaton(strings: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, s in enumerate(strings):
        made.add_word(s, i)
    made.make_automaton()
    return made


def _search(held):
    """Rows (row_id, text) to (row_id, string); a worker keeps the automaton that it built last."""
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = held.value
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = automaton(strings)
        seek = _BUILT[name].iter
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                if text:
                    found = {k for _, k in seek(text)}
                    rows += [i] * len(found)
                    hits += found
            yield pa.RecordBatch.from_arrays([batch["row_id"].take(pa.array(rows, pa.int64())), pa.array([strings[k] for k in hits], pa.string())], ["row_id", "string"])

    return scan


def held(rows: DataFrame, strings: DataFrame, slice_bytes: int = SLICE_BYTES, slices: int = SLICES) -> DataFrame:
    """(row_id, string) of rows (row_id, text) that hold a string of ``strings`` (string), each pair once.

    Empty strings and nulls are in no text.
    """
    named = strings.select("string").where("string <> ''").distinct()
    size = named.agg(F.sum(F.octet_length("string"))).first()[0] or 0
    kind = T.StructType([rows.schema["row_id"], T.StructField("string", T.StringType())])
    texts = rows.select("row_id", "text")
    if not size:
        return texts.where("false").select("row_id", F.col("text").alias("string"))
    if size > slice_bytes * slices:
        return joined(texts, named)
    cut: list[list[str]] = [[]]
    left = slice_bytes
    for s in sorted(r["string"] for r in named.collect()):  # at most slice_bytes * slices
        left -= len(s.encode())
        if left < 0 and cut[-1]:
            cut.append([])
            left = slice_bytes - len(s.encode())
        cut[-1].append(s)
    out = None
    for some in cut:
        one = texts.mapInArrow(_search(rows.sparkSession.sparkContext.broadcast(some)), kind)
        out = one if out is None else out.unionByName(one)
    return out


def inner_words(string: Column) -> Column:
    """Whole words with white space on both sides, which every text that holds the string has too."""
    parts = F.split(string, r"\s+")
    return F.array_distinct(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))


def rarest(strings: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``word``: of the inner words of ``string`` the one that fewest rows of ``words`` hold, null for none."""
    counts = words.groupBy(*by, "word").agg(F.count("*").alias("_n"))
    each = strings.select(*by, "string", F.explode(inner_words(F.col("string"))).alias("word")).join(counts, [*by, "word"], "left")
    best = each.groupBy(*by, "string").agg(F.min_by("word", F.struct(F.coalesce("_n", F.lit(0)), "word")).alias("word"))
    return strings.join(best, [*by, "string"], "left")


def grams(text: Column, sizes: list[int]) -> Column:
    """Distinct windows of the given numbers of letters."""
    windows = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(windows(n) for n in sizes)))


def joined(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """``held`` by equi-joins, for strings of any size."""
    words = texts.select("row_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    keyed = rarest(strings, words, [])
    met = words.join(keyed.where("word is not null"), "word").select("row_id", "string")
    short = keyed.where("word is null").select("string", F.substring("string", 1, GRAM).alias("gram"))
    sizes = sorted(r[0] for r in short.select(F.length("gram")).distinct().collect())  # numbers from 1 to GRAM
    if sizes:
        near = texts.select("row_id", F.explode(grams(F.col("text"), sizes)).alias("gram"))
        met = met.unionByName(near.join(short, "gram").select("row_id", "string"))
    return met.join(texts, "row_id").where(F.contains("text", "string")).select("row_id", "string").distinct()


def contained(rows: DataFrame, quotes: DataFrame, slice_bytes: int = SLICE_BYTES, slices: int = SLICES) -> DataFrame:
    """(row_id, quote_id) of rows (row_id, text) that hold a quote (quote_id, quote) verbatim."""
    hits = held(rows, quotes.select(F.col("quote").alias("string")), slice_bytes, slices)
    return hits.join(quotes.withColumnRenamed("quote", "string"), "string").select("row_id", "quote_id")


_ONCE = "scope {scope}, string string, hits long, hit_seq {seq}, hit_text string"


def _counted(key: tuple, texts: pa.Table, strings: pa.Table) -> pa.Table:
    """By scope and string, how many of the scope's texts hold it, and the first of them; an automaton for each scope."""
    asked: dict[object, list[str]] = {}
    for scope, string in zip(strings["scope"].to_pylist(), strings["string"].to_pylist()):
        asked.setdefault(scope, []).append(string)
    texts = texts.take(pc.sort_indices(texts, [("seq", "ascending")]))
    held: dict[object, list[int]] = {}
    for i, scope in enumerate(texts["scope"].to_pylist()):
        if scope in asked:
            held.setdefault(scope, []).append(i)
    lows, at, said, counts = texts["low"].to_pylist(), [], [], []
    for scope, rows in held.items():
        names = asked[scope]
        seek, hits, first = automaton(names).iter, [0] * len(names), [0] * len(names)
        for i in rows:
            for k in {k for _, k in seek(lows[i])} if lows[i] else ():
                if not hits[k]:
                    first[k] = i
                hits[k] += 1
        some = [k for k, n in enumerate(hits) if n]
        at += [first[k] for k in some]
        said += [names[k] for k in some]
        counts += [hits[k] for k in some]
    where = pa.array(at, pa.int64())
    return pa.table({"scope": texts["scope"].take(where), "string": pa.array(said, pa.string()), "hits": pa.array(counts, pa.int64()), "hit_seq": texts["seq"].take(where), "hit_text": texts["text"].take(where)})


def held_once(texts: DataFrame, strings: DataFrame, scope_bytes: int = SCOPE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(scope, string, hits, hit_seq, hit_text): how many texts of its scope hold a string, and the first.

    ``texts`` are (scope, seq, text, low), searched in ``low``; ``strings`` (scope, string), distinct and
    not empty. Strings that no text holds have no row. Scopes are searched by the bucket: a call for each
    of many small ones would cost more than their search.
    """
    strings = strings.where("string <> ''")
    sizes = strings.groupBy("scope").agg(F.sum(F.octet_length("string")).alias("_bytes"))
    most = lambda frame: [x or 0 for x in frame.agg(F.max("_bytes"), F.sum("_bytes")).first()]
    largest, asked = most(sizes)
    some_large = largest > slice_bytes
    large = sizes.where(F.col("_bytes") > slice_bytes).select("scope")
    fit = strings.join(large, "scope", "left_anti") if some_large else strings
    spread = texts.groupBy("scope").agg(F.sum(F.octet_length("text")).alias("_bytes"))  # near enough, and ``low`` needn't be made for it
    kind = _ONCE.format(scope=texts.schema["scope"].dataType.simpleString(), seq=texts.schema["seq"].dataType.simpleString())
    longest, read = most(spread)
    if longest <= scope_bytes:
        bucket = F.pmod(F.xxhash64("scope"), F.lit(-(-(2 * read + asked) // BUCKET_BYTES) or 1)).alias("bucket")  # a text comes twice, as it is and as it is searched
        out = texts.select(bucket, "scope", "seq", "text", "low").groupBy("bucket").cogroup(fit.select(bucket, "scope", "string").groupBy("bucket")).applyInArrow(_counted, kind)
        if not some_large:
            return out
    else:
        parts = spread.select("scope", F.greatest(F.lit(1), F.ceil(F.col("_bytes") / scope_bytes)).cast("int").alias("_parts"))
        dealt = texts.join(parts, "scope").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("_parts")).cast("int")).select("scope", "part", "seq", "text", "low")
        wanted = fit.join(parts, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "string")
        out = dealt.groupBy("scope", "part").cogroup(wanted.groupBy("scope", "part")).applyInArrow(_counted, kind)
    if some_large:
        rest, log = strings.join(large, "scope", "left_semi"), texts.join(large, "scope", "left_semi")
        words = log.select("scope", "seq", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("word"))
        keyed = rarest(rest, words, ["scope"])
        met = words.join(keyed.where("word is not null"), ["scope", "word"]).select("scope", "seq", "string")
        short = keyed.where("word is null").select("scope", "string", F.substring("string", 1, GRAM).alias("gram"))
        near = log.select("scope", "seq", F.explode(grams(F.col("low"), list(range(1, GRAM + 1)))).alias("gram"))
        met = met.unionByName(near.join(short, ["scope", "gram"]).select("scope", "seq", "string"))
        pairs = met.join(log, ["scope", "seq"]).where(F.contains("low", "string"))
        out = out.unionByName(pairs.select("scope", "string", F.lit(1).cast("long").alias("hits"), F.col("seq").alias("hit_seq"), F.col("text").alias("hit_text")))
    return out.groupBy("scope", "string").agg(F.sum("hits").alias("hits"), F.min("hit_seq").alias("hit_seq"), F.min_by("hit_text", "hit_seq").alias("hit_text"))


def held_in(texts: DataFrame, strings: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(scope, row_id, string) of texts (scope, row_id, text) that hold a string of their scope (scope, string)."""
    asked = strings.where("string <> ''").distinct()
    kind = T.StructType([texts.schema["scope"], texts.schema["row_id"], T.StructField("string", T.StringType())])
    shares = texts.join(asked.select("scope").distinct(), "scope", "left_semi").groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("text")) / SCOPE_BYTES)).cast("int").alias("_parts"))
    # A scope's strings are dealt too, so that no automaton is larger than a slice.
    sets = asked.groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("string")) / slice_bytes)).cast("int").alias("_sets"))
    grid = shares.join(sets, "scope")
    dealt = texts.join(grid, "scope").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int"))
    dealt = dealt.select("scope", "part", F.explode(F.sequence(F.lit(0), F.col("_sets") - 1)).alias("set"), "row_id", "text")
    wanted = asked.join(grid, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.pmod(F.xxhash64("string"), F.col("_sets")).cast("int").alias("set"), "string")
    key = ["scope", "part", "set"]
    return dealt.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(_pairs(kind), kind)


def _pairs(kind: T.StructType):
    names = kind.names

    def pairs(key: tuple, texts: pa.Table, strings: pa.Table) -> pa.Table:
        known, rows, hits = strings["string"].to_pylist(), [], []
        if known and texts.num_rows:
            seek = automaton(known).iter
            for i, text in enumerate(texts["text"].to_pylist()):
                found = {k for _, k in seek(text)} if text else ()
                rows += [i] * len(found)
                hits += found
        at = pa.array(rows, pa.int64())
        return pa.table({names[0]: texts["scope"].take(at), names[1]: texts["row_id"].take(at), "string": pa.array([known[k] for k in hits], pa.string())})

    return pairs

