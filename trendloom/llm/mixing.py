"""Temperature mixing of sources, realised as budgeted block permutations.

Weights: source s with token share p gets w ~ p ** a. The exponent a is found by bisection: the largest flattening whose
entropy doesn't exceed a target, or under which no source is repeated more often than a limit. The budget lets the source
that is repeated least be read exactly once, so every document is used.

Realisation: a source's documents are dealt by hash into blocks of about BLOCK_TOKENS tokens. A source read e times gives
each of its blocks floor(e) full passes and one pass cut at the block's share of the rest (to the nearest document), so
no sum runs over more than a block. Every pass of every block has its own order of documents and its own place among
all blocks: training reads in the order of (block_key, doc_key), and no global sort is needed.

Nulls: a null source is a source of its own; null and empty texts have no tokens, are used once for each full pass and
never in a cut pass. A source without tokens has weight 0 and is read once. Repeated rows are dealt one by one, ties of
keys included. Native DataFrame operations only; what is collected is one row for each source (MAX_SOURCES at most).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 250_000
MAX_SOURCES = 100_000
REPETITION = 2.0


@dataclass(frozen=True)
class Plan:
    exponent: float
    #: By source: weight, and how often it is read.
    weights: dict
    epochs: dict


def shares_at(tokens: dict, exponent: float) -> dict:
    top = max(tokens.values())
    raised = {s: (t / top) ** exponent for s, t in tokens.items()}
    total = math.fsum(raised.values())
    return {s: v / total for s, v in raised.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def solve(tokens: dict, repetition: float | None = REPETITION, target_entropy: float | None = None) -> Plan:
    """The smallest exponent in [0, 1] that keeps to each limit given."""
    real = {s: t for s, t in tokens.items() if t > 0}
    if not real:
        return Plan(1.0, {s: 0.0 for s in tokens}, {s: 1.0 for s in tokens})

    def reads(a: float) -> dict:
        w = shares_at(real, a)
        least = min(w[s] / real[s] for s in real)
        return {s: w[s] / real[s] / least for s in real}

    def fits(a: float) -> bool:
        return (repetition is None or max(reads(a).values()) <= repetition) and (target_entropy is None or entropy(shares_at(real, a)) <= target_entropy)

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    else:
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
    w, e = shares_at(real, high), reads(high)
    return Plan(high, {s: w.get(s, 0.0) for s in tokens}, {s: round(e.get(s, 1.0), 9) for s in tokens})


def count_words(text: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _number(key) -> F.Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, keep_columns: list[str], doc_id: str = "doc_id", source: str = "source", text: str = "text", repetition: float | None = REPETITION, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """keep_columns for each use of each row, then mix_source, mix_tokens, mix_weight, mix_copy (from 0), mix_block, block_key, doc_key."""
    spark = docs.sparkSession
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep_columns)], F.col(source).alias("mix_source"), count_words(text).alias("mix_tokens"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("__id"))
    found = rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r.mix_source: r.t for r in found}
    plan = solve(tokens, repetition, target_entropy)
    table = spark.createDataFrame(
        [(s, plan.weights[s], plan.epochs[s], max(1, -(-t // block_tokens))) for s, t in tokens.items()],
        "s string, mix_weight double, __reads double, __blocks long",
    )
    rows = rows.join(F.broadcast(table), F.col("mix_source").eqNullSafe(F.col("s"))).drop("s")
    name = F.coalesce("mix_source", F.lit(""))
    rows = rows.withColumn("mix_block", _number(F.md5(F.concat(F.lit("block/"), "__id"))) % F.col("__blocks"))
    block = Window.partitionBy("mix_source", "mix_block")
    full = F.floor("__reads").cast("long")
    cut_key = F.md5(F.concat(F.lit("doc/"), full.cast("string"), F.lit("/"), "__id"))
    rows = rows.withColumns({"__cut": cut_key, "__all": F.sum("mix_tokens").over(block)})
    before = F.sum("mix_tokens").over(block.orderBy("__cut", "mix_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_tokens")
    rows = rows.withColumn("__before", before)
    rest = F.round((F.col("__reads") - full) * F.col("__all"), 0)
    partial = (F.col("mix_tokens") > 0) & (rest > 0) & (2 * F.col("__before") + F.col("mix_tokens") <= 2 * rest)
    uses = (full + partial.cast("long")).cast("int")
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), uses - 1)).alias("mix_copy"))
    told = copies.withColumns(
        {
            "block_key": F.md5(F.concat(F.lit("order/"), F.col("mix_copy").cast("string"), F.lit("/"), name, F.lit("/"), F.col("mix_block").cast("string"))),
            "doc_key": F.md5(F.concat(F.lit("doc/"), F.col("mix_copy").cast("string"), F.lit("/"), "__id")),
        }
    )
    made = ["mix_source", "mix_tokens", "mix_weight", "mix_copy", "mix_block", "block_key", "doc_key"]
    names = [c + "_in" if c.lower() in made else c for c in keep_columns]
    return told.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], *made)
