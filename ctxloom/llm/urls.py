"""URL filters: a temporal list join, in DataFrame operations only.

List entries are dated: from ``listed_at`` on a host pattern (a host and all hosts below it)
has a verdict, until its next entry. ``intervals`` turns entries into validity intervals; an
as-of join then gives each capture the verdict that was active when it was fetched, that of
the longest pattern where several are. Both sides are keyed by pattern and month, so neither
a host with many captures nor one with a long history makes one large group, and the join can
be split where it is skewed. Several entries of a pattern at one moment: the last verdict in
alphabetical order holds.

Nulls: a null or unparsable url, or a null fetch time, is ``unlisted``; entries with a null
pattern or date are ignored; a null verdict lifts the listing. Repeated captures are judged
alike. An empty list leaves all captures unlisted, an empty capture table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]+)", 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"\.+\z", "")))


def suffixes(name: Column) -> Column:
    """A host and the domains above it, the top-level one too; of an address only itself."""
    labels = F.split(name, r"\.")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 1, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.when(name.rlike(r"^(\d+\.){3}\d+\z|^\["), F.array(name)).otherwise(above)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, since, until) from dated entries; until is null for the last."""
    dated = entries.where("pattern is not null and listed_at is not null")
    one = dated.groupBy(F.lower("pattern").alias("pattern"), F.col("listed_at").alias("since")).agg(F.max("verdict").alias("verdict"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return one.select("pattern", "verdict", "since", until.alias("until")).where("verdict is not null")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_at) with pattern, verdict and since.

    The months of an open interval end with that of the last fetch, found by a first pass.
    """
    last = F.timestamp_micros(F.lit(captures.agg(F.max(F.unix_micros(F.col("fetched_at").cast("timestamp")))).first()[0]).cast("long"))
    month = lambda c: F.year(c) * 12 + F.month(c)
    valid = intervals(entries).withColumn("to", F.when(last.isNotNull(), F.least(F.coalesce("until", last), last))).where(F.col("since") <= F.col("to"))
    by_month = valid.select("pattern", "verdict", "since", "until", F.explode(F.sequence(month(F.col("since")), month(F.col("to")))).alias("in_month"))
    named = captures.select("page_id", "url", "fetched_at", host(F.col("url")).alias("host"))
    asked = named.select("host", "fetched_at").where("host is not null and fetched_at is not null").distinct()
    each = asked.select("*", month(F.col("fetched_at")).alias("in_month"), F.explode(suffixes(F.col("host"))).alias("pattern"))
    hit = each.join(by_month, ["pattern", "in_month"]).where("fetched_at >= since and (until is null or fetched_at < until)")
    best = hit.groupBy("host", "fetched_at").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "verdict", "since")).alias("best"))
    out = named.join(best, ["host", "fetched_at"], "left")
    return out.select("page_id", "url", "fetched_at", F.col("best.pattern").alias("pattern"), F.coalesce("best.verdict", F.lit("unlisted")).alias("verdict"), F.col("best.since").alias("since"))


#: Dated entries by host label: the days of 2024 at which they are listed, changed and lifted.
START, DAYS = "2024-01-01", 366
CAPTURED = f"timestampadd(HOUR, cast((page_id * 37) % ({DAYS} * 24) as int), timestamp'{START} 00:00:00')"


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of 2024, against a list made from their hosts.

    Every host is listed twice, on days that its characters give (blocked where it looks like
    spam, else watched; then allowed), and each of the three top domains once.
    """
    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(CAPTURED).alias("fetched_at"))
    names = captures.select(host(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    day = lambda n, plus: F.expr(f"timestampadd(DAY, (length(pattern) * {n} + ascii(pattern) * 7) % {DAYS - 120} + {plus}, timestamp'{START} 00:00:00')")
    first = F.when(F.col("pattern").rlike("spam|casino|win"), "block").otherwise("watch")
    top = spark.createDataFrame([("example.com", "watch"), ("example.net", "allow"), ("example.org", "block")], "pattern string, verdict string")
    entries = names.select("pattern", first.alias("verdict"), day(11, 0).alias("listed_at")).union(names.select("pattern", F.lit("allow"), day(11, 100))).union(top.select("pattern", "verdict", F.expr("timestamp'2024-03-01 00:00:00'")))
    return judged(captures, entries).select("page_id", "pattern", "verdict", F.col("since").cast("string").alias("since"))


OP4_SQL = f"""
WITH c AS (
  SELECT page_id, TIMESTAMP '{START} 00:00:00' + to_hours(CAST((page_id * 37) % ({DAYS} * 24) AS INTEGER)) AS fetched_at,
         nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:@]+)', 1), '\\.+$', '')), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host AS pattern FROM c WHERE host IS NOT NULL),
d AS (SELECT pattern, CAST((length(pattern) * 11 + ascii(pattern) * 7) % {DAYS - 120} AS INTEGER) AS n FROM h),
e AS (
  SELECT pattern, CASE WHEN regexp_matches(pattern, 'spam|casino|win') THEN 'block' ELSE 'watch' END AS verdict, TIMESTAMP '{START} 00:00:00' + to_days(n) AS since FROM d
  UNION ALL SELECT pattern, 'allow', TIMESTAMP '{START} 00:00:00' + to_days(n + 100) FROM d
  UNION ALL SELECT * FROM (VALUES ('example.com', 'watch', TIMESTAMP '2024-03-01 00:00:00'), ('example.net', 'allow', TIMESTAMP '2024-03-01 00:00:00'), ('example.org', 'block', TIMESTAMP '2024-03-01 00:00:00')) t),
m AS (SELECT pattern, max(verdict) AS verdict, since FROM e GROUP BY pattern, since),
v AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM m),
j AS (
  SELECT c.page_id, v.pattern, v.verdict, v.since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC) AS place
  FROM c JOIN v ON (c.host = v.pattern OR (ends_with(c.host, '.' || v.pattern) AND NOT regexp_matches(c.host, '^(\\d+\\.){{3}}\\d+$|^\\['))) AND c.fetched_at >= v.since AND (v.until IS NULL OR c.fetched_at < v.until))
SELECT c.page_id, j.pattern, coalesce(j.verdict, 'unlisted') AS verdict, strftime(j.since, '%Y-%m-%d %H:%M:%S') AS since
FROM c LEFT JOIN (SELECT * FROM j WHERE place = 1) j ON c.page_id = j.page_id
"""
