"""Exact n-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles. Let t(x) be the least overlap that a set of size x needs with any
partner at the threshold. If every set is sorted by one global order, two partners share at least m shingles among the
first |x| - t(x) + m of either, for each m up to t. Longer prefixes cost more postings but let more accidental partners be
dismissed unverified, so each document picks its own m: it estimates its posting rows and candidates for m = 1, 2, ... from a
corpus-wide frequency sketch and takes the cheapest. A pair of documents with m1 and m2 is compared at the smaller of
the two, which either's prefix contains.

Global order: estimated frequency class (rarest first), then hash. The sketch counts every shingle of every document in
SKETCH counters; its size is fixed, and any order gives the same result, so its error only costs time.

Sets that are equal are joined as one. A group of near copies would still make postings in which every document meets every
other, so links are found in two passes over the same postings. First each document that shares much of its prefix with the
least document of its postings, its pivot, is compared with that: what it lacks of the pivot and what it has besides. Two documents of
one pivot P, that differ from it by r and e shingles and share d of those differences, overlap in |P| - r1 - r2 + d, so
they link exactly if w1 + w2 - (num + den) * d <= (den - num) * |P| with w = den * r + num * e. If d is 0 both link with P or neither
does; if not, they meet in a join of the differences, in which again only prefixes (additions, the rare ones, first) take
part. That decides all pairs of one pivot without making them. Shingles are held by 64-bit hashes: two different ones of a corpus
of n distinct shingles have one hash with a chance of about n * n / 2**65. The second pass makes pairs of documents of different
pivots and different components only, and verifies those that share enough prefix shingles. Every pair is met in one of the two
passes, so components are exact.

Links are also counted (linked()), those inside a component too. Round one pivot, pairs with w1 + w2 <= (den - num) * |P| link whatever
they share; they are counted from the sums of each w and not made. The others share differences, and only those whose shared
differences can do are made, as are all pairs of different pivots that share enough prefix shingles.

Nulls, empty and wordless texts have the empty set and link with nothing. A null id takes no part and has no component.
Rows with one id and different texts are joined under that id. Ids must be longs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .components import HEAVY, LEAST_HEAVY, components, with_classes
from .storage import cut, drop

SKETCH = 1 << 20
MAX_MATCH = 8
#: Cost of verifying a candidate, in posting rows.
VERIFY = 30.0
_CHUNK = 1 << 14
#: Sets that a task hands on at a time.
TAKE = 500
#: Bits of the filter of ids whose texts a verification needs.
FILTER_BITS = 1 << 22


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, raw, off in K.slices(column):
        words, _, _, first = K.words_of(raw, off)
        h, at = K.shingle_hashes(words, first, k)
        for r in range(len(off) - 1):
            yield np.unique(h[at[r] : at[r + 1]])


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * K.U(0x9E3779B97F4A7C15)) >> K.U(44)).astype(np.int64)


def survey(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: doc_id, n_shingles, digest of the set; kind 1: chunk of a task's frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int32)
        for b in batches:
            n, digests = [], []
            for s in sets_of(b.column(1), k):
                n.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest())
                sketch += np.bincount(_slot(s), minlength=SKETCH).astype(np.int32) if len(s) > SKETCH else 0
                if len(s) <= SKETCH:
                    np.add.at(sketch, _slot(s), 1)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary())], names)
        full = [(i, sketch[i * _CHUNK : (i + 1) * _CHUNK]) for i in range(SKETCH // _CHUNK)]
        full = [(i, c) for i, c in full if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(full), pa.int32()), pa.array([i for i, _ in full], pa.int64()), pa.array([0] * len(full), pa.int64()), pa.array([c.tobytes() for _, c in full], pa.binary())], names)

    names = ["kind", "doc_id", "n", "data"]
    return cut(docs.mapInArrow(K.lean(run), "kind int, doc_id long, n long, data binary"), "ngram-survey")


def frequency_sketch(surveyed: DataFrame) -> np.ndarray:
    """The tasks' sketches summed: SKETCH counters, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(data, np.int64 if len(data) == 8 * _CHUNK else np.int32).astype(np.int64)
                total[i] = total[i] + part if i in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "data"])

    parts = surveyed.where("kind = 1").select(F.col("doc_id").alias("chunk"), "data")
    some = parts.mapInArrow(K.lean(add), "chunk long, data binary")
    out = np.zeros(SKETCH, np.int64)
    for r in some.repartition("chunk").mapInArrow(K.lean(add), "chunk long, data binary").collect():
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] += np.frombuffer(r.data, np.int64)
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    """What a set of n needs in common with any partner: den * overlap >= num * union >= num * n."""
    return -(-num * n // den)


def prefix(s: np.ndarray, freq: np.ndarray, floor: float, num: int, den: int) -> tuple[int, int, np.ndarray]:
    """(m, rows of the prefix at m = 0, prefix in global order) of one sorted set."""
    n = len(s)
    t = least_overlap(n, num, den)
    estimate = np.maximum(freq[_slot(s)] - floor, 1.0)
    tier = np.log2(estimate).astype(K.U)
    key = (tier << K.U(58)) | (s >> K.U(6))
    longest = min(n, n - t + min(MAX_MATCH, t))
    order = np.argsort(key, kind="stable")[:longest]
    cost = np.cumsum(estimate[order])
    best, m = None, 1
    for i in range(1, min(MAX_MATCH, t) + 1):
        size = n - t + i
        spent = cost[size - 1] + VERIFY * (cost[size - 1] - size) / i
        if best is None or spent < best:
            best, m = spent, i
    return m, n - t, s[order[: n - t + m]]


def prefixes(docs: DataFrame, freq: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    floor = float(freq.sum() / SKETCH)
    small = np.minimum(freq, np.iinfo(np.int32).max).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(small)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            ms, bases, ns, toks = [], [], [], []
            for s in sets_of(b.column(1), k):
                m, base, p = prefix(s, f, floor, num, den) if len(s) else (0, 0, s)
                ms.append(m)
                bases.append(base)
                ns.append(len(s))
                toks.append(p.view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(p) for p in toks])]).astype(np.int32)
            flat = np.concatenate(toks) if toks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(ms, pa.int32()), pa.array(bases, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["id", "n", "m", "base", "tokens"])

    return docs.mapInArrow(K.lean(run), "id long, n long, m int, base int, tokens array<long>")


def with_sets(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b), a written table, with both sets, x and y. Sets are made for the texts that the pairs name, and no others."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits")).collect()
    filled = np.zeros(FILTER_BITS // 64, np.int64)  # half a megabyte, whatever the corpus
    for w in words:
        filled[w.word] = w.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            hit = np.flatnonzero((filled[at >> 6] >> (at & 63)) & 1)
            for i in range(0, len(hit), TAKE):  # sets are larger than their texts
                some = b.take(pa.array(hit[i : i + TAKE]))
                sets = [s.view(np.int64) for s in sets_of(some.column(1), k)]
                off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(sets)))], ["id", "shingles"])

    made = docs.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))).mapInArrow(K.lean(run), "id long, shingles array<long>")
    sets = made.join(ids, "id", "left_semi")
    total = pairs.count()
    left = beside(pairs, pairs, total, sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a", "b")
    return beside(left, pairs, total, sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b", "a").select("a", "b", "x", "y")


def beside(rows: DataFrame, pairs: DataFrame, total: int, sets: DataFrame, key: str, other: str) -> DataFrame:
    """rows joined with the set of their key. The set of a key with many pairs is copied, so that its rows can spread over tasks.

    pairs: the keys of rows, `total` of them; keys with more than 1 / HEAVY of all pairs are broadcast, so fewer than HEAVY.
    """
    bound = max(LEAST_HEAVY, total // HEAVY)
    times = pairs.groupBy(key).agg(F.count("*").alias("times")).where(F.col("times") > bound)
    heavy = F.broadcast(times.select(key, F.ceil(F.col("times") / bound).cast("int").alias("spread")))
    spread = F.coalesce("spread", F.lit(1))
    salted = rows.join(heavy, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), spread).cast("int")).drop("spread")
    copied = sets.join(heavy, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("spread")
    return salted.join(copied, [key, "salt"]).drop("salt")


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    pairs = cut(pairs.select("a", "b"), "ngram-pairs")
    full = with_sets(docs, pairs, k).withColumn("both", F.size(F.array_intersect("x", "y")))
    alike = F.col("both") * den >= (F.size("x") + F.size("y") - F.col("both")) * num
    out = cut(full.where(alike).select("a", "b"), "ngram-links")
    drop(pairs)
    return out


def around_pivots(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs: a and its pivot b.

    Returns the links (a, b) of documents with their pivot, those among documents of one pivot, and (a, b, w, t) of the
    documents that are decided. Among documents of one pivot are told, if every, all links with w1 + w2 > t, else those that
    components need.
    """
    pairs = cut(pairs.select("a", "b"), "ngram-pairs")
    full = with_sets(docs, pairs, k).select("a", "b", F.size("y").alias("size"), F.array_except("y", "x").alias("lacks"), F.array_except("x", "y").alias("adds"))
    full = full.withColumns({"w": den * F.size("lacks") + num * F.size("adds"), "t": (den - num) * F.col("size")}).where("w <= 2 * t")
    told = cut(full, "ngram-pivots")
    drop(pairs)
    direct = told.where("w <= t").select("a", "b")
    diffs = F.concat(F.transform("adds", lambda v: F.struct(v.alias("v"), F.lit(True).alias("added"))), F.transform("lacks", lambda v: F.struct(v.alias("v"), F.lit(False).alias("added"))))
    if every:
        # All stand in one order, so two documents share at most what either has from their first common difference on.
        tokens = told.select("a", "b", "w", "t", (F.size("adds") + F.size("lacks")).alias("n"), F.posexplode(diffs).alias("at", "d"))
        side = lambda x, i: tokens.select("b", "d.v", "d.added", F.col("a").alias(x), F.col("w").alias(f"w{i}"), (F.col("n") - F.col("at")).alias(f"rest{i}"), *["t"] * (i == 1))
        short = F.col("w1") + F.col("w2") - F.col("t")
        met = side("x", 1).join(side("y", 2), ["b", "v", "added"]).where((F.col("x") < F.col("y")) & (short > 0) & (short <= (num + den) * F.least("rest1", "rest2"))).select("b", "x", "y").distinct()
    else:
        # A pair is looked for where one of the two doesn't link with the pivot; of their common differences there are then more than w / (num + den).
        tokens = told.select("a", "b", (F.col("w") > F.col("t")).alias("far"), (F.size("adds") + F.size("lacks") - F.floor(F.col("w") / (num + den))).alias("ahead"), F.posexplode(diffs).alias("at", "d"))
        tokens = tokens.select("a", "b", "far", (F.col("at") < F.col("ahead")).alias("ahead"), "d.v", "d.added")
        one = tokens.where("far").select("b", "v", "added", F.col("a").alias("x"), F.col("ahead").alias("x_ahead"))
        two = tokens.where("ahead").select("b", "v", "added", F.col("a").alias("y"), F.col("far").alias("y_far"))
        met = one.join(two, ["b", "v", "added"]).where("x <> y AND (NOT y_far OR (x_ahead AND x < y))").select("b", "x", "y").distinct()
    p = met.join(told.select("b", F.col("a").alias("x"), F.col("w").alias("w1"), F.col("lacks").alias("l1"), F.col("adds").alias("a1"), "t"), ["b", "x"])
    p = p.join(told.select("b", F.col("a").alias("y"), F.col("w").alias("w2"), F.col("lacks").alias("l2"), F.col("adds").alias("a2")), ["b", "y"])
    common = F.size(F.array_intersect("l1", "l2")) + F.size(F.array_intersect("a1", "a2"))
    among = p.where(F.col("w1") + F.col("w2") - (num + den) * common <= F.col("t")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return direct, cut(among, "ngram-links") if every else among, told.select("a", "b", "w", "t")


def counted_round(decided: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, n): of each document and pivot, the links round the pivot with w1 + w2 <= t. weights: id, weight (how many rows a set stands for)."""
    each = decided.withColumnRenamed("a", "id").unionByName(decided.groupBy("b").agg(F.first("t").alias("t")).select(F.col("b").alias("id"), "b", F.lit(0).alias("w"), "t"))
    each = each.join(weights, "id")
    sums = each.groupBy("b", "w").agg(F.sum("weight").alias("weight"), F.first("t").alias("t"))
    # Every w asks for the weight of all up to t - w, so a pivot's sums stand in one line with the places that they ask for.
    line = sums.select("b", F.col("w").alias("at"), "weight", F.lit(None).cast("int").alias("asks"))
    line = line.unionByName(sums.select("b", (F.col("t") - F.col("w")).alias("at"), F.lit(0).cast("long").alias("weight"), F.col("w").alias("asks")))
    upto = F.sum("weight").over(Window.partitionBy("b").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    found = line.withColumn("upto", upto).where("asks IS NOT NULL").select("b", F.col("asks").alias("w"), "upto")
    return each.join(found, ["b", "w"]).select("id", (F.col("upto") - F.when(2 * F.col("w") <= F.col("t"), F.col("weight")).otherwise(0)).alias("n"))


def needed(num: int, den: int, na: str, nb: str, ta: str, tb: str, ma: str, mb: str) -> F.Column:
    """How many common shingles of two whole prefixes the overlap asks for that sets of na and nb need.

    In the prefix that ends first in the global order, a shingle without partner is missing from the other set, and at
    most n - overlap may be missing. Which one ends first isn't known here, so the weaker bound of the two counts.
    ta, tb: the columns with the sizes of which the prefixes' lengths are taken (of groups, the largest).
    """
    rest = lambda n, m: F.ceil(F.col(n) * num / den) - F.col(m)
    return F.greatest(F.lit(1), F.ceil((F.col(na) + F.col(nb)) * num / (num + den)) - F.greatest(rest(ta, ma), rest(tb, mb)))


def enough(num: int, den: int) -> F.Column:
    """Whether the sizes fit and `shared` common shingles of the prefixes can do."""
    return (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (F.col("shared") >= needed(num, den, "na", "nb", "na", "nb", "ma", "mb"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; component_id is the least id reachable by links (null for a null id)."""
    return _join(docs, doc_id, text, k, num, den, False)


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of join() with n_links: how many other rows link with the row's text (null for a null id, and such rows don't count)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _join(rows, "doc_id", "text", k, num, den, True)
    # An id of several rows: links are counted between rows, which get numbers of their own; repeats of a row have one number.
    rows = rows.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    nodes = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("text").alias("text"), F.count("*").alias("times")), "ngram-nodes")
    groups = join(rows, "doc_id", "text", k, num, den)
    known = groups.where("doc_id IS NOT NULL").select("doc_id", "component_id").distinct()
    counts = _join(nodes, "node", "text", k, num, den, True, "times").select(F.col("doc_id").alias("node"), "n_shingles", "n_links")
    out = rows.where("node IS NOT NULL").select("doc_id", "node").join(counts, "node").join(known, "doc_id").select("doc_id", "n_shingles", "component_id", "n_links")
    return out.unionByName(groups.where("doc_id IS NULL").withColumn("n_links", F.lit(None).cast("long")))


def _join(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int, count: bool, times: str | None = None) -> DataFrame:
    """count: with n_links; then every id has one row, which stands for as many rows as the column `times` says."""
    spark: SparkSession = docs.sparkSession
    every = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = every.where("id IS NOT NULL")
    surveyed = survey(every, k)
    rows = surveyed.where("kind = 0").select(F.col("doc_id").alias("id"), "n", "data")
    rows = rows.join(docs.select(F.col(doc_id).alias("id"), times), "id") if times else rows
    rows = rows.withColumn("times", F.col(times).cast("long") if times else F.lit(1).cast("long"))
    freq = frequency_sketch(surveyed)
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("data").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.sum("times").alias("weight"), F.count("*").alias("size"))
    reps = classes.select(F.col("rep").alias("id")).distinct()

    ahead = prefixes(known, freq, k, num, den).where("n > 0").join(reps, "id", "left_semi")
    ahead = cut(ahead, "ngram-prefixes")
    tokens = ahead.select("id", "n", "m", F.col("base"), F.posexplode("tokens").alias("at", "token"))
    tokens = tokens.select("token", "id", "n", "m", "at")
    shared = tokens.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("token", "least")
    postings = cut(tokens.join(shared, "token"), "ngram-postings")

    # First pass: each document and its pivot.
    sizes = ahead.select("id", "n", "m")
    stars = postings.where("id <> least").groupBy("id", "least").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    stars = stars.where(5 * F.col("shared") >= 2 * (F.col("n") - F.ceil(F.col("n") * num / den) + F.col("m")))
    stars = stars.groupBy("id").agg(F.max(F.struct("shared", (-F.col("least")).alias("neg"))).alias("best"))
    direct, among, decided = around_pivots(known, stars.select(F.col("id").alias("a"), (-F.col("best.neg")).alias("b")), k, num, den, count)
    links = cut(direct.unionByName(among), "ngram-links")
    groups = components(links)
    pivots = decided.select(F.col("b").alias("id"), F.col("b").alias("pivot")).distinct()
    pivots = pivots.unionByName(decided.select(F.col("a").alias("id"), F.col("b").alias("pivot")).join(pivots.select("id"), "id", "left_anti"))
    groups = cut(groups.withColumnRenamed("node", "id").join(pivots, "id", "full"), "ngram-groups")

    # Second pass: pairs of different pivots and, unless links are counted, components.
    placed = postings.drop("least").join(groups, "id", "left").withColumns({"component": F.coalesce("component", "id"), "pivot": F.coalesce("pivot", "id")})
    mixed = placed.groupBy("token").agg(*[f(c).alias(c[0] + n) for c in ("component", "pivot") for f, n in ((F.min, "lo"), (F.max, "hi"))]).where("plo < phi" if count else "clo < chi AND plo < phi").select("token")
    placed = cut(placed.join(mixed, "token"), "ngram-placed")
    drop(postings)
    # Of a document's tokens that others have, how many stand from each one on: partners share none before their first common one.
    met = placed
    placed = cut(placed.withColumn("rest", F.count("*").over(Window.partitionBy("id").orderBy(F.desc("at")))).drop("at"), "ngram-open")
    drop(met)
    # Partners differ in size by the threshold at most, so they stand in one size band or in neighbouring ones, which the join asks for.
    placed = placed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1.0001 * den / num)).cast("int"))
    each = placed.groupBy("token", "pivot", "band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("m").alias("m"), F.max("rest").alias("rest"), F.min("component").alias("c_lo"), F.max("component").alias("c_hi"))
    other = each.select("token", *[F.col(c).alias(c + "_b") for c in each.columns[1:]], F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("near"))
    sized = (den * F.col("hi_b") >= num * F.col("lo")) & (den * F.col("hi") >= num * F.col("lo_b"))
    need = needed(num, den, "lo", "lo_b", "hi", "hi_b", "m", "m_b")
    apart = F.lit(True) if count else F.least("c_lo", "c_lo_b") < F.greatest("c_hi", "c_hi_b")
    near = each.withColumn("near", F.col("band")).join(other, ["token", "near"]).where((F.col("pivot") < F.col("pivot_b")) & apart & sized & (F.least("rest", "rest_b") >= need)).select("token", "pivot", "band", "pivot_b", "band_b", need.alias("need"))
    side = lambda s: placed.select("token", *[F.col(c).alias(c + "_b" * (s == "b")) for c in ("pivot", "band")], F.col("id").alias(s), *[F.col(c).alias(c[0] + s) for c in ("n", "m", "rest", "component")])
    met = near.join(side("a"), ["token", "pivot", "band"]).where("ra >= need").join(side("b"), ["token", "pivot_b", "band_b"]).where("rb >= need" if count else "rb >= need AND ca <> cb")
    met = met.withColumn("shared", F.least("ra", "rb")).where(enough(num, den)).select("a", "b").distinct()
    if count:
        # A pivot can have a pivot too; the pairs round that one are told.
        own = lambda s: decided.select(F.col("a").alias(s), F.col("b").alias("p" + s))
        met = met.join(own("a"), "a", "left").join(own("b"), "b", "left")
        met = met.where(~(F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)) | F.coalesce(F.col("pa") == F.col("b"), F.lit(False)) | F.coalesce(F.col("pb") == F.col("a"), F.lit(False)))).select("a", "b")
    # What is shared in all, and at the smaller of the two lengths.
    whole = lambda s: ahead.select(F.col("id").alias(s), *[F.col(c).alias(c[0] + s) for c in ("n", "m", "base", "tokens")])
    full = met.join(whole("a"), "a").join(whole("b"), "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    match = F.least("ma", "mb")
    matched = F.size(F.array_intersect(F.slice("ta", F.lit(1), F.col("ba") + match), F.slice("tb", F.lit(1), F.col("bb") + match)))
    candidates = full.where(enough(num, den)).where(matched >= match)
    more = verified(known, candidates, k, num, den)

    total = rows.count()
    copies = with_classes(rows.where("n > 0 AND id IS NOT NULL"), classes.where("rep < last").select("data", "rep", "size"), "data", "size", total).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(more).unionByName(copies))
    out = rows.select("id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "id"), "id", "left")
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    if not count:
        return out
    weights = classes.select(F.col("rep").alias("id"), "weight")
    pairs = among.unionByName(more)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    made = both.join(weights.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("weight").alias("n"))
    sums = counted_round(decided, weights).unionByName(made).groupBy("id").agg(F.sum("n").alias("n"))
    of_class = classes.join(sums.withColumnRenamed("id", "rep"), "rep", "left").select("data", "size", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"))
    each = with_classes(rows.where("n > 0 AND id IS NOT NULL"), of_class, "data", "size", total).select(F.col("id").alias("doc_id"), "links")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).cast("long")
    return out.join(each, "doc_id", "left").withColumn("n_links", n_links).drop("links")
