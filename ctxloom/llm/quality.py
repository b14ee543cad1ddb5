"""Quality rules as weak supervision, in DataFrame operations only.

Rules vote good (1), bad (-1) or abstain (0) on each document. Documents are counted by
vote pattern, a table of at most ``3 ** len(RULES)`` rows however many documents there are;
expectation-maximisation on those counts estimates how often each rule is right about good
and about bad documents. A rule may turn out to say nothing (it votes good as often on bad
documents as on good ones), never to say the contrary, so its votes weigh nothing then. A
document is kept if the posterior probability of its pattern being good is at least ``KEEP``.
Base rules (too few words, too many repeated ones) reject
whatever the votes say.

Words are ``[^ \\t-\\r]+``. Nulls: a null text has no words and fails the base rules; a null
doc_id is kept as it is. Repeated rows are judged alike, each counted. An empty table gives
no row. Other columns, whatever their names, pass through ``filter_quality`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.shared import table

KEEP, ROUNDS, WINDOW = 0.5, 40, 5
#: First guess at, and bounds of, the chance that a rule that votes is right.
FIRST, LEAST, MOST = 0.8, 0.005, 0.995
#: Common function words of the corpus languages.
FUNCTION_WORDS = "the of and to in is that for der die und das den von ist les des et est une que los las del por una"


def measures(text: Column) -> list[list[Column]]:
    """Layers of columns over ``text``, each reading the ones before it."""
    return [
        [F.trim(F.regexp_replace(text, r"[ \t-\r]+", " ")).alias("_norm"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_lines"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols")],
        [
            F.when(F.col("_norm") == "", 0).otherwise(F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
            F.regexp_extract_all("_norm", F.lit("(?<![^ ])(?=([^ ]++" + " [^ ]++" * (WINDOW - 1) + "))"), 1).alias("_windows"),
        ],
        [
            (F.length("_norm") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))).alias("_sorted"),
        ],
        [F.array_sort(F.transform(F.filter("_sorted", lambda x, k: ((k > 0) & (x["w"] == F.get("_sorted", k - 1)["w"])) | F.coalesce(x["w"] == F.get("_sorted", k + 1)["w"], F.lit(False))), lambda x: x["i"])).alias("_at")],
        [
            F.coalesce(
                F.aggregate(
                    "_at",
                    F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                    lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i.cast("long"))).alias("n"), (i + WINDOW).cast("long").alias("end")),
                    lambda a: a["n"],
                ),
                F.lit(0).cast("long"),
            ).alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;\"')][ \t-\r]*\z"))).cast("long").alias("n_ended"),
            F.regexp_count("_norm", F.lit(r"[^\p{L}\p{N}\p{M} .,;:!?)\]}\"'\u2019\u201d\u00bb\u2026\u3002\uff0c\uff01\uff1f\u3001\u300d\u300f\uff09-](?![^ ])")).cast("long").alias("n_marked"),
            F.regexp_count("_norm", F.lit(r"(?<![^ ])[^\p{L}\p{N} ]++(?![^ ])")).cast("long").alias("n_bare"),
            F.size(F.array_distinct(F.transform(F.regexp_extract_all("_norm", F.lit(r"(?i)(?<![^ ])(" + FUNCTION_WORDS.replace(" ", "|") + r")(?![^ ,.])"), 1), F.lower))).cast("long").alias("n_function_words"),
        ],
    ]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Lines with a word and those that end a sentence, words that end in no letter, digit or usual
#: mark, words without a letter or digit, distinct function words.
EXTRA = ["n_lines", "n_ended", "n_marked", "n_bare", "n_function_words"]


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0).cast("byte")


def rules() -> dict[str, Column]:
    """Votes over the measures; divisions are written as products so none divides by zero."""
    words, chars, c = F.col("n_words"), F.col("word_chars"), F.col
    return {
        "length": _vote(words >= 50, words < 20),
        "word_size": _vote((chars >= 3 * words) & (chars <= 12 * words), (chars < 2 * words) | (chars > 20 * words)),
        "symbols": _vote(100 * c("n_symbols") <= words, 10 * c("n_symbols") > words),
        "marks": _vote(50 * c("n_marked") <= words, 10 * c("n_marked") > words),
        "bare_words": _vote(50 * c("n_bare") <= words, 10 * c("n_bare") > words),
        "same_lines": _vote((c("n_lines") >= 3) & (10 * c("n_dup_lines") <= c("n_lines")), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": _vote(100 * c("n_repeat_words") <= 2 * words, 10 * c("n_repeat_words") > words),
        "endings": _vote(2 * c("n_ended") >= c("n_lines"), 10 * c("n_ended") < c("n_lines")),
        "function_words": _vote(c("n_function_words") >= 3, (c("n_function_words") == 0) & (words >= 20)),
    }


RULES = ["length", "word_size", "symbols", "marks", "bare_words", "same_lines", "repeats", "endings", "function_words"]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measured(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with measures and votes."""
    out = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    for layer in measures(F.col("_text")):
        out = out.select("*", *layer)
    return out.select(*keep, *BASE, *EXTRA).select("*", *(v.alias(f"vote_{k}") for k, v in rules().items()))


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Prior of a good document and, by rule, its chance to be right on good and on bad ones.

    ``counts``: (votes, documents) by pattern, in any order; sums run in sorted order, so the
    result doesn't depend on how the table was partitioned.
    """
    counts = sorted(counts)
    n_rules = len(counts[0][0]) if counts else 0
    prior, right = FIRST, [(FIRST, FIRST)] * n_rules
    clip = lambda x: min(MOST, max(LEAST, x))
    for _ in range(rounds):
        total = good = 0.0
        hits = [[1.0, 1.0, 1.0, 1.0] for _ in range(n_rules)]  # right and wrong on good, on bad
        for votes, n in counts:
            p = posterior(votes, prior, right)
            total, good = total + n, good + n * p
            for h, v in zip(hits, votes, strict=True):
                if v:
                    h[0 if v > 0 else 1] += n * p
                    h[3 if v > 0 else 2] += n * (1 - p)
        prior = min(0.99, max(0.01, (good + 1) / (total + 2)))
        right = []
        for a, b, c, d in hits:
            on_good, on_bad = clip(a / (a + b)), clip(c / (c + d))
            if on_good + on_bad < 1:  # it votes good more often on bad ones: says nothing
                on_good = clip((a + d) / (a + b + c + d))
                on_bad = 1 - on_good
            right.append((on_good, on_bad))
    return prior, right


def weights(prior: float, right: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds: of the prior, and of each rule's good and bad vote."""
    return math.log(prior / (1 - prior)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in right]


def posterior(votes: tuple[int, ...], prior: float, right: list[tuple[float, float]]) -> float:
    start, by_rule = weights(prior, right)
    return 1 / (1 + math.exp(-start - sum(w[0 if v > 0 else 1] for v, w in zip(votes, by_rule, strict=True) if v)))


def judged(scored: DataFrame) -> DataFrame:
    """``scored`` (from ``measured``, written) with base_failed, quality and kept."""
    votes = [f"vote_{k}" for k in RULES]
    counts = [(tuple(r[:-1]), r[-1]) for r in scored.groupBy(*votes).count().collect()]
    start, by_rule = weights(*fit(counts)) if counts else (0.0, [])
    odds = F.lit(start)
    for name, (good, bad) in zip(votes, by_rule, strict=False):
        odds = odds + F.when(F.col(name) > 0, good).when(F.col(name) < 0, bad).otherwise(0.0)
    quality = 1 / (1 + F.exp(-odds))
    return scored.select("*", base_failed().alias("base_failed"), quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def quality_report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, measures, base_failed, kept and the posterior."""
    scored = table(measured(docs, F.col("text"), ["doc_id"]), "quality")
    return judged(scored).select("doc_id", *BASE, "base_failed", "kept", "quality")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    whole = docs.select(F.struct("*").alias("_doc"))
    return judged(table(measured(whole, F.col("_doc.text"), ["_doc"]), "quality")).where("kept").select("_doc.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("quality")
