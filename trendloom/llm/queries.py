"""Queries op1 to op10 and their SQL; each applies one operator to its whole table and derives the asked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, licenses, mixing, nbest, ngram_join, quality, sketches, suffix_runs, toxicity, warc
from .storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), ["doc_id"])


_WORDS = r"'[^\x20\x09-\x0D]+'"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters,
  length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs,
  len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in sorted(set(quality.FUNCTION_WORDS)))}], translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS n_function
  FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, list_extract(w, i) AS a, list_extract(w, i + 1) AS b, list_extract(w, i + 2) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
a AS (SELECT n.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM n LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 100 * n_dup_lines > 60 * n_lines
    OR 100 * n_upper > 40 * n_letters OR 100 * n_digits > 20 * word_chars OR 2 * n_bangs > n_words OR n_function < 2) AS kept
FROM a
"""

def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"]).drop("spans")


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, index = new_path(spark, "warc"), new_path(spark, "warc-index")
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_archives(pages, archive)
    directory = warc.build_index(manifest, index)
    return warc.read_captures(pages, directory, index, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = nbest.encode(table(spark, sf_dir, "documents"), ["doc_id"])
    return coded.select("doc_id", "ids", "n_pieces", "scores", "nbest", F.size("nbest").alias("n_best"), F.expr("transform(nbest, x -> size(x.changes))").alias("n_changes"), "ids_sha256", "decoded_sha256", "round_trip")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op2_ngram_join and how many other rows each one links with."""
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out()))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe_automaton.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_runs.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False)


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 9).alias("weight"), F.col("mix_copy").alias("copy"), F.col("mix_block").alias("block"), "block_key", "doc_key")


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS n, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS id FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY source),
x AS (SELECT max(t)::DOUBLE AS top, min(t) FILTER (t > 0)::DOUBLE AS low FROM s),
a AS (SELECT top, CASE WHEN top / low <= {mixing.REPETITION} THEN 0.0 ELSE 1 - ln({mixing.REPETITION}) / ln(top / low) END AS a FROM x),
w AS (SELECT source, t, CASE WHEN t > 0 THEN pow(t / top, a) ELSE 0 END AS u, CASE WHEN t > 0 THEN round(pow(top / t, 1 - a), 9) ELSE 1 END AS reads,
  greatest(1, ((t + {mixing.BLOCK_TOKENS - 1}) // {mixing.BLOCK_TOKENS})) AS blocks FROM s, a),
b AS (SELECT d.*, round(u / (SELECT sum(u) FROM w), 9) AS weight, reads, floor(reads)::BIGINT AS f,
  ('0x' || substr(md5('block/' || id), 1, 8))::BIGINT % blocks AS block FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
c AS (SELECT *, sum(n) OVER (PARTITION BY source, block) AS total, sum(n) OVER (PARTITION BY source, block ORDER BY md5('doc/' || f || '/' || id), n ROWS UNBOUNDED PRECEDING) - n AS before FROM b),
u AS (SELECT *, f + (n > 0 AND round((reads - f) * total) > 0 AND 2 * before + n <= 2 * round((reads - f) * total))::BIGINT AS uses FROM c),
e AS (SELECT *, unnest(range(0, uses)) AS copy FROM u)
SELECT doc_id, source, n AS n_tokens, weight, copy::INTEGER AS copy, block::BIGINT AS block, md5('order/' || copy || '/' || coalesce(source, '') || '/' || block) AS block_key,
  md5('doc/' || copy || '/' || id) AS doc_key FROM e
"""


def op9_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.against_next(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < best THEN best END AS refers_to
FROM p LEFT JOIN b USING (payload_digest)
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 3], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP2_LINKS_SQL = OP2_SQL.replace(
    "SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d",
    "SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(x.n_links, 0)::BIGINT AS n_links\nFROM documents d LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) x ON x.a = d.doc_id",
)

OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 49)::BIGINT)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w),
c AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS apart FROM f WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(coalesce(apart, true)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
t AS (SELECT k.doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

QUERIES = {
    "pipeline": pipeline,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op1_nbest_pieces": op1_nbest_pieces,
    "op4_token_counts": op4_token_counts,
    "op2_ngram_join": op2_ngram_join,
    "op2_ngram_links": op2_ngram_links,
    "op3_toxicity": op3_toxicity,
    "op6_temperature_mixing": op6_temperature_mixing,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_license_scan": op8_license_scan,
    "op9_threshold_sketch": op9_threshold_sketch,
    "op10_warc_index": op10_warc_index,
}
ORACLES = {
    "op2_ngram_join": OP2_SQL,
    "op2_ngram_links": OP2_LINKS_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op6_temperature_mixing": OP6_SQL,
    "op7_quality_cascade": OP7_SQL,
    "op10_warc_index": OP10_SQL,
}
