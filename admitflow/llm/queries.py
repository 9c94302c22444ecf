"""The opN_* queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm import (
    byte_bpe,
    cotraining,
    curve_packing,
    exact_whitening,
    hamming_search,
    jaccard_join,
    prefix_trie,
    quality_crf,
    quotient_dedup,
    randomness_scan,
    run_length_dedup,
    url_lists,
    warc_revisit,
)
from admitflow.llm.common import read_table

TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """A public vocabulary file of the installed package, else of the folder TOKENIZERS."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_dedup.report(read_table(spark, sf_dir, "documents"), watch=run_length_dedup.WATCH)


def op7_line_crf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    crf = quality_crf.fit_line_crf(docs, read_table(spark, sf_dir, "labels"))
    return quality_crf.label_lines(docs.select("doc_id", "text"), crf).drop("text")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.report(read_table(spark, sf_dir, "pages"))


def op10_randomness_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness_scan.report(read_table(spark, sf_dir, "documents"))


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.top_k(read_table(spark, sf_dir, "embeddings"))


#: Day (counted from 0) on which a page was fetched; the table has no time of its own.
FETCH_DAY = "(page_id * 7919) % 730"


def list_events(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts themselves: about half the hosts, and half the first segments of a quarter, come, go and return on days taken from a digest."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host"), url_lists.segment_of(F.col("url")).alias("seg")).where("host is not null")
    keys = hosts.select(F.col("host").alias("key"), F.lit(8).alias("below")).distinct().unionByName(hosts.where("seg <> ''").select(F.concat_ws("/", "host", "seg").alias("key"), F.lit(2).alias("below")).distinct())
    digit = lambda a, n=1: F.conv(F.substring("h", a, n), 16, 10).cast("int")
    drawn = keys.withColumn("h", F.md5("key")).where(digit(1) < F.col("below"))
    times = F.array(F.struct((digit(2, 2)).alias("day"), F.lit("add").alias("action")), F.struct((digit(2, 2) + digit(4, 2)).alias("day"), F.lit("remove").alias("action")), F.struct((digit(2, 2) + 2 * digit(4, 2)).alias("day"), F.lit("add").alias("action")))
    return drawn.select(F.concat(F.lit("list"), (digit(6) % 3).cast("string")).alias("list"), "key", F.explode(times).alias("t")).select("list", "key", "t.day", "t.action")


def op2_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(FETCH_DAY).cast("int").alias("fetch_day"))
    return url_lists.judge(captures, list_events(pages))


def op11_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_dedup.report(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(read_table(spark, sf_dir, "conversations"))


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_whitening.report(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotrained_quality": op1_cotrained_quality,
    "op2_temporal_url_lists": op2_temporal_url_lists,
    "op3_hamming_topk": op3_hamming_topk,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op5_partition_jaccard": op5_partition_jaccard,
    "op6_run_length_index": op6_run_length_index,
    "op7_line_crf_rules": op7_line_crf_rules,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_randomness_scan": op10_randomness_scan,
    "op11_quotient_dedup": op11_quotient_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_whitening": op13_exact_whitening,
}
ORACLES: dict[str, str] = {
    "op2_temporal_url_lists": r"""
WITH cap AS (
  SELECT page_id, url, CAST((page_id * 7919) % 730 AS INTEGER) AS fetch_day,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS seg
  FROM pages),
keys AS (
  SELECT DISTINCT host AS key, 8 AS below FROM cap WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT host || '/' || seg, 2 FROM cap WHERE host IS NOT NULL AND seg <> ''),
drawn AS (SELECT key, md5(key) AS h FROM keys WHERE CAST('0x' || substr(md5(key), 1, 1) AS INTEGER) < below),
nums AS (
  SELECT key, 'list' || (CAST('0x' || substr(h, 6, 1) AS INTEGER) % 3) AS list,
    CAST('0x' || substr(h, 2, 2) AS INTEGER) AS a, CAST('0x' || substr(h, 4, 2) AS INTEGER) AS b FROM drawn),
ev AS (
  SELECT list, key, a AS day, 'add' AS action FROM nums
  UNION ALL SELECT list, key, a + b, 'remove' FROM nums
  UNION ALL SELECT list, key, a + 2 * b, 'add' FROM nums),
days AS (SELECT list, key, day AS since, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS gone FROM ev GROUP BY 1, 2, 3),
spans AS (
  SELECT * FROM (SELECT list, key, since, gone, coalesce(lead(since) OVER (PARTITION BY list, key ORDER BY since), 1073741824) AS until FROM days) x WHERE gone = 0),
parts AS (SELECT page_id, fetch_day, seg, host, string_split(host, '.') AS p FROM cap WHERE host IS NOT NULL),
sub AS (SELECT page_id, fetch_day, seg, array_to_string(p[i:len(p)], '.') AS h FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts) y),
asked AS (SELECT page_id, fetch_day, h AS key FROM sub UNION ALL SELECT page_id, fetch_day, h || '/' || seg FROM sub WHERE seg <> ''),
hits AS (SELECT a.page_id, a.key FROM asked a JOIN spans s ON a.key = s.key AND a.fetch_day >= s.since AND a.fetch_day < s.until),
ranked AS (SELECT page_id, key, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, key) AS rn FROM hits)
SELECT c.page_id, c.url, c.fetch_day, coalesce(r.n, 0) AS n_active, r.key AS longest_key, coalesce(r.n, 0) > 0 AS blocked
FROM cap c LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON c.page_id = r.page_id
""",
    "op3_hamming_topk": """
WITH c AS (
  SELECT vec_id AS id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN coalesce(embedding[i], 0) > 0 THEN '1' ELSE '0' END), '') AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (
  SELECT q.id AS query_id, a.id AS neighbour_id, CAST(hamming(q.code, a.code) AS INTEGER) AS distance
  FROM c q JOIN c a ON q.id <> a.id WHERE q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rn FROM p)
SELECT query_id, CAST(rn AS INTEGER) AS rank, neighbour_id, distance FROM r WHERE rn <= 10
""",
    "op8_warc_revisits": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < page_id THEN least END AS refers_to
FROM m
""",
    "op11_quotient_dedup": r"""
WITH p AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY plain) AS group_size,
  row_number() OVER w = 1 AS kept,
  sha256(plain) AS text_sha256
FROM p WINDOW w AS (PARTITION BY plain ORDER BY n_points DESC, doc_id NULLS LAST)
""",
    "op12_prefix_trie": r"""
WITH d AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM d),
crc AS (
  SELECT conv_id, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END) AS acc
  FROM (SELECT DISTINCT conv_id FROM t) u),
c AS (SELECT conv_id, xor(acc, 4294967295) % 4 AS h FROM crc),
r AS (
  SELECT t.conv_id, t.pos, t.text, t.digest FROM t JOIN c ON c.conv_id = t.conv_id WHERE t.pos > c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.text, t.digest FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM r),
p AS (
  SELECT conv_id, depth, text, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM n
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
g AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words
  FROM p GROUP BY depth, path),
lasts AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
ends AS (
  SELECT p.path, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS sha
  FROM p JOIN lasts l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY p.path),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN kids k ON k.path = g.path),
up AS (SELECT *, unnest(range(0, depth + 1)) AS level FROM f),
sub AS (
  SELECT left(path, 64 * level) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM up GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM f JOIN sub s ON s.path = f.path
  LEFT JOIN f q ON f.depth > 0 AND q.path = left(f.path, 64 * (f.depth - 1))
  LEFT JOIN ends e ON e.path = f.path
""",
}
