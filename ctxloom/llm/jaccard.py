"""Exact Jaccard join of documents on word shingles by adaptive multi-match prefixes.

A document is the set of its hashed five-word shingles. All documents agree on one order of
shingles, rare ones first (a fixed-size count sketch over the whole corpus says how rare;
any order gives right results). Of n shingles at least a = ceil(3 n / 4) must be shared, so
the first n - a + l of two linked documents share at least l of them: a document takes the
l in 1..``MOST_MATCHES`` that the sketch says will cost least, and a pair is verified when it
shares as many prefix shingles as two sets of their sizes must, see ``_likely``.

Documents with equal sets are one class from the start. Pairs are sought in passes over the
same prefixes, so that no group is turned into all its pairs: first, in a few rounds, every
class meets the centre of its groups that it shares most with, and links join classes to
components; then only classes of different components that still share prefix shingles are
paired. Links are verified on whole sets, in all passes.

Nulls: a null text has no words and links with nothing; a null doc_id takes part, its rows'
component_id is the least non-null doc_id of the component, null if there is none. Repeated
rows are linked as equal texts. An empty table gives no row. Class ids have 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.llm.components import components
from ctxloom.llm.shared import drop_table, free_shuffles, table
from ctxloom.llm.tokens import steps
from ctxloom.llm.words import mix, shingles

#: Counters of the sketch, in pieces; links at 100 * common >= 75 * union.
SKETCH_BITS, PIECES, FAN_IN = 22, 16, 256
MOST_MATCHES = 4
#: Passes that link classes to centres; what they miss the exact pass finds.
STAR_ROUNDS = 3
#: Cost of a posting, and of verifying a candidate by shingle of its document.
POSTING_COST, VERIFY_COST = 1.0, 0.05
#: Classes by shingle above which pairs are made once, not at every shingle they share.
LARGE = 32
#: Bits of the filter that says whose sets are needed for verification.
FILTER_BITS = 23

_CLASSES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("part", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])


def _class(own: np.ndarray) -> int:
    """One id for equal sets; 0 for the empty set."""
    return int(mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0]) if len(own) else 0


def _slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _scan_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then this partition's part of the sketch."""
    from pyspark import TaskContext

    counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
    for batch in batches:
        for some in steps(batch):
            sets = shingles(some["text"])
            ids = [_class(x) for x in sets]
            for own, one in zip(sets, ids, strict=True):
                if one not in seen:
                    seen.add(one)
                    np.add.at(counts, _slots(own), 1)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays([some["doc_id"], some["mark"], pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=_CLASSES)
    if seen:
        yield _pieces(counts, TaskContext.get().partitionId(), _CLASSES)


def _pieces(counts: np.ndarray, part: int, schema: pa.Schema) -> pa.RecordBatch:
    cut = counts.reshape(PIECES, -1)
    rows = [{"part": part, "piece": i, "counts": zlib.compress(x.tobytes(), 1)} for i, x in enumerate(cut)]
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _add_up(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in rows["counts"].to_pylist())
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.table({"part": [key[1].as_py()], "piece": pa.array([key[0].as_py()], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]})


def rarity(classes: DataFrame) -> np.ndarray:
    """The sketch of the corpus, counts on a scale of bytes (eight steps to a doubling)."""
    parts = classes.where("piece is not null").select("part", "piece", "counts")
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    while most:
        most //= FAN_IN
        parts = parts.groupBy("piece", F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(_add_up, "part long, piece int, counts binary")
    total = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.uint32)
    for row in parts.groupBy("piece", F.lit(0).cast("long").alias("group")).applyInArrow(_add_up, "part long, piece int, counts binary").collect():
        total[row["piece"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return np.minimum(255, 8 * np.log2(1 + total.reshape(-1))).astype(np.uint8)


def prefix(own: np.ndarray, rare: np.ndarray, usual: float) -> tuple[np.ndarray, int]:
    """The prefix of a set, and how many of its shingles a partner must share."""
    n = len(own)
    needed = (3 * n + 3) // 4
    levels = rare[_slots(own)]
    order = np.lexsort((own, levels))
    most = min(MOST_MATCHES, needed)
    ahead = order[: n - needed + most]
    partners = np.cumsum(np.maximum(np.exp2(levels[ahead] / 8.0) - usual, 0))[n - needed :]
    matches = np.arange(1, most + 1)
    cost = POSTING_COST * (n - needed + matches + partners) + VERIFY_COST * n * partners / matches**2
    take = int(np.argmin(cost)) + 1
    return own[ahead[: n - needed + take]], take


def end_of(own_prefix: np.ndarray, rare: np.ndarray) -> int:
    """Where a prefix ends in the common order, in 31 bits: level and first hash bits of its last shingle."""
    last = own_prefix[-1:]
    return (int(rare[_slots(last)][0]) << 23) | (int(last[0]) >> 41)


def _postings(rare, usual: float):
    schema = pa.schema([("token", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("l", pa.int8()), ("early", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = np.frombuffer(rare.value, np.uint8), set()
        for batch in batches:
            for some in steps(batch):
                tokens, ids, sizes, takes, ends = [np.zeros(0, np.uint64)], [], [], [], []
                for own in shingles(some["text"]):
                    one = _class(own)
                    if one in seen or not len(own):
                        continue
                    seen.add(one)
                    own_prefix, take = prefix(own, levels, usual)
                    tokens.append(own_prefix)
                    ids.append(one), sizes.append(len(own)), takes.append(take), ends.append(end_of(own_prefix, levels))
                lens = np.array([len(x) for x in tokens[1:]], np.int64)
                place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                few = np.array(sizes, np.int64) - (6 * np.array(sizes, np.int64) + 6) // 7 + 1
                # Behind the postings a row for each class tells where its prefix ends, in place of a shingle.
                alike = lambda x, kind: np.concatenate([np.repeat(np.array(x, kind), lens), np.array(x, kind)])  # noqa: E731, B023
                marks = np.concatenate([np.zeros(len(place), bool), np.ones(len(ids), bool)])
                early = pa.array(np.concatenate([place < np.repeat(few, lens), np.zeros(len(ids), bool)]), mask=marks)
                told = np.concatenate([np.concatenate(tokens).view(np.int64), np.array(ends, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(alike(ids, np.int64)), pa.array(alike(sizes, np.int32)), pa.array(alike(takes, np.int8)), early], schema=schema)

    return scan


def _needed_sets(wanted):
    schema = pa.schema([("class", pa.int64()), ("own", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(wanted.value, np.uint8), set()
        for batch in batches:
            for some in steps(batch):
                found = {}
                for own in shingles(some["text"]):
                    one = _class(own)
                    at = one & ((1 << FILTER_BITS) - 1)
                    if len(own) and one not in seen and bits[at >> 3] >> (at & 7) & 1:
                        found[one] = own
                        seen.add(one)
                if found:
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])]).astype(np.int32)
                    flat = np.concatenate(list(found.values())).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], schema=schema)

    return scan


def _filter(classes: DataFrame) -> bytes:
    """A bit for each class, folded to FILTER_BITS: at most 2 ** (FILTER_BITS - 6) rows reach the driver."""
    slot = F.col("class").bitwiseAND((1 << FILTER_BITS) - 1)
    words = classes.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((class & {(1 << FILTER_BITS) - 1}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = words.toArrow()
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = spark.sparkContext.broadcast(_filter(ids))
    sets = texts.select("text").mapInArrow(_needed_sets(wanted), "class long, own array<long>").join(ids, "class", "left_semi").dropDuplicates(["class"])
    sets = table(sets, "sets")
    left = pairs.join(sets.select(F.col("class").alias("a"), F.col("own").alias("x")), "a")
    both = left.join(sets.select(F.col("class").alias("b"), F.col("own").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = table(both.where(175 * common >= 75 * (F.size("x") + F.size("y"))).select("a", "b"), "links")
    drop_table(sets)
    return out


#: What two sets of n and m shingles must share, and that the one whose prefix ends first may share it.
_NEEDED = "(3 * (n + m) + 6) div 7"
_MOST = f"case when end < end_b then most when end > end_b then most_b else greatest(most, most_b) end >= {_NEEDED}"


def _likely() -> F.Column:
    """Whether two classes of n and m shingles that share ``common`` prefix shingles may link.

    Of the two, the one whose prefix ends first in the common order shares no prefix shingle
    with the other but in both prefixes. So what they share is at most its ``most``, and all but
    its last a - l shingles of that lie in both prefixes. Where both seem to end at one place the weaker bound holds.
    """
    rest, rest_b = "((3 * n + 3) div 4 - l)", "((3 * m + 3) div 4 - k)"
    return F.expr(f"4 * least(n, m) >= 3 * greatest(n, m) and {_MOST} and common >= {_NEEDED} - case when end < end_b then {rest} when end > end_b then {rest_b} else greatest({rest}, {rest_b}) end and common >= case when end < end_b then l when end > end_b then k else least(l, k) end")


def linked(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, mark (hash of its text), n_shingles, component_id, first.

    ``first`` is true for the documents that stand for their component.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    scan = "doc_id long, mark long, n long, class long, part long, piece int, counts binary"
    classes = table(marked.mapInArrow(_scan_classes, scan), "classes")
    counts = rarity(classes)
    usual = float(np.exp2(np.median(counts) / 8.0))
    rare = spark.sparkContext.broadcast(counts.tobytes())

    postings = texts.select("text").mapInArrow(_postings(rare, usual), "token long, class long, n int, l byte, early boolean")
    by_token = Window.partitionBy("token")
    met = postings.select("*", F.min("class").over(by_token).alias("lo"), F.max("class").over(by_token).alias("hi"))
    told = table(met.where("lo <> hi or early is null").select("token", "class", "n", "l", "early").distinct(), "shared")
    shared = told.where("early is not null")
    ends = told.where("early is null").groupBy("class").agg(F.first(F.col("token").cast("int")).alias("end"))
    # Of a group's classes the one that shares most is likeliest to link with the others.
    shares = shared.groupBy("class").agg(F.count("*").alias("shares"))
    # Prefix shingles in no other prefix can't be common with a class whose prefix ends later: ``most`` bounds what may be.
    weighed = table(shared.join(shares, "class").join(ends, "class").withColumn("most", F.expr("(3 * n + 3) div 4 - l + shares")), "weighed")
    drop_table(told)
    free_shuffles(spark)
    tried = links = roots = None
    for _ in range(STAR_ROUNDS):
        rooted = weighed if roots is None else weighed.join(roots.withColumnRenamed("node", "class"), "class", "left")
        rooted = rooted.withColumn("root", F.col("class") if roots is None else F.coalesce("root", "class"))
        split = rooted.select("*", F.min("root").over(by_token).alias("lo"), F.max("root").over(by_token).alias("hi")).where("lo <> hi").drop("lo", "hi")
        centred = split.select("*", F.max(F.struct("shares", "class", "n", "l", "most", "end", "root")).over(by_token).alias("centre")).where("root <> centre.root")
        seen = centred.groupBy("class", "n", "l", "most", "end", "centre").agg(F.count("*").alias("common"))
        likely = seen.select("class", "n", "l", "most", "end", "common", F.col("centre.class").alias("b"), F.col("centre.n").alias("m"), F.col("centre.l").alias("k"), F.col("centre.most").alias("most_b"), F.col("centre.end").alias("end_b")).where(_likely())
        likely = likely if tried is None else likely.join(tried.withColumnRenamed("a", "class"), ["class", "b"], "left_anti")
        stars = table(likely.groupBy("class").agg(F.max_by("b", F.struct("common", "b")).alias("b")).select(F.col("class").alias("a"), "b"), "stars")
        new = _verified(stars, texts)
        links, tried = (new, stars) if links is None else (links.unionByName(new), tried.unionByName(stars))
        roots = components(links)
        if not new.take(1):
            break
    rooted = weighed.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    split = rooted.select("*", F.min("root").over(by_token).alias("lo"), F.max("root").over(by_token).alias("hi"), F.count("*").over(by_token).alias("size")).where("lo <> hi").drop("lo", "hi")
    split = table(split, "split")
    free_shuffles(spark)
    # The smaller of two linked classes shares one of its first n - ceil(6 n / 7) + 1 shingles.
    fits = f"root <> other and (n < m or (n = m and class < b)) and 4 * n >= 3 * m and {_MOST}"
    other = lambda rows, *more: rows.select("token", F.col("class").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("most").alias("most_b"), F.col("end").alias("end_b"), *more)
    held = split.groupBy("class").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.first("most").alias("most"), F.first("end").alias("end"), F.collect_list("token").alias("held"), F.collect_list(F.when(F.col("early"), F.col("token"))).alias("firsts"))
    few = split.where(F.col("size") <= LARGE)
    across = few.where("early").join(other(few), "token").where(fits).select("class", "b")
    # In large groups a pair is made at the least of its shared first shingles only.
    many = split.where(F.col("size") > LARGE).join(held.select("class", "held", "firsts"), "class")
    ahead = many.where("early").withColumn("ahead", F.filter("firsts", lambda t: t < F.col("token"))).drop("held", "firsts")
    across = across.union(ahead.join(other(many, "held"), "token").where(F.expr(fits) & ~F.arrays_overlap("ahead", "held")).select("class", "b"))
    pairs = across.select(F.col("class").alias("a"), "b").distinct()
    pairs = pairs.join(held.withColumnRenamed("class", "a"), "a").join(held.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("most").alias("most_b"), F.col("end").alias("end_b"), F.col("held").alias("others")), "b")
    pairs = table(pairs.withColumn("common", F.size(F.array_intersect("held", "others"))).where(_likely()).select("a", "b"), "pairs")
    if pairs.take(1):
        links = links.unionByName(_verified(pairs, texts))
        roots = components(links)
    for done in (weighed, split):
        drop_table(done)

    rows = classes.where("piece is null").select("doc_id", "mark", "n", "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rows = rows.withColumn("root", F.coalesce("root", "class"))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    least = rows.where("n > 0").groupBy("root").agg(F.min(name).alias("least"))
    out = rows.join(least, "root", "left").withColumn("least", F.when(F.col("n") > 0, F.col("least")).otherwise(name))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), (name == F.col("least")).alias("first"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN s sa ON p.a = sa.doc_id JOIN s sb ON p.b = sb.doc_id WHERE 100 * p.n >= 75 * (len(sa.g) + len(sb.g) - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.g)
"""


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were.

    That is the one of the least doc_id; of rows that repeat its id and text, the one whose
    columns come first as JSON. Rows without a word are in no component and all stay.
    """
    found = table(linked(docs), "linked")
    lost = found.where("not first").select("doc_id", "mark").distinct()
    again = found.where("first and n_shingles > 0").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    whole = docs.select(F.struct("*").alias("_doc")).select("_doc", F.col("_doc.doc_id").cast("long").alias("_id"), F.xxhash64("_doc.text").alias("_mark"))
    on = lambda other: F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_mark") == other["mark"])
    kept = whole.join(lost, on(lost), "left_anti")
    if again.take(1):
        one = kept.join(again, on(again), "left_semi").groupBy("_id", "_mark").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
        kept = kept.join(again, on(again), "left_anti").select("_doc").unionByName(one.select("_doc"))
    return kept.select("_doc.*")
