"""Queries of the corpus driver and of the append-only log."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitflow.operators import corpus as C
from admitflow.operators import realise as R
from admitflow.plans.catalogue import register
from admitflow.plans.common import table
from admitflow.session import scratch_path
from admitflow.sources import sinks as K

SEED, BATCH = 42, 25


def order_pool(spark, sf):
    """Orders as grounded sources: the priority gives the macro domain, the customer the entity, the status the field."""
    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    macro = F.when(p.isin("1-URGENT", "2-HIGH"), "commerce").when(p.isin("3-MEDIUM", "4-NOT SPECIFIED"), "service").otherwise("workflow")
    key = F.col("o_orderkey")
    return o.select(
        macro.alias("macro"),
        F.concat(F.lit("orders-"), F.lower("o_orderstatus")).alias("dataset"),
        key.cast("string").alias("record_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"),
        F.lower("o_orderstatus").alias("field_id"),
        F.concat(F.lit("v"), (key % 50).cast("string")).alias("value"),
        key.alias("observed_at"),
        F.when(key % 3 != 0, key - key % 7).alias("valid_from"),
        F.lit("track").alias("goal"),
    )


_PLAN = f"""WITH pool AS (
  SELECT *, sha256('{SEED}:' || macro || ':' || dataset || ':' || record_id || ':' || field_id) AS key FROM (
    SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'commerce' WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'service' ELSE 'workflow' END AS macro,
      'orders-' || lower(o_orderstatus) AS dataset, CAST(o_orderkey AS VARCHAR) AS record_id, 'c' || o_custkey AS entity, lower(o_orderstatus) AS field_id, 'v' || (o_orderkey % 50) AS value,
      o_orderkey AS observed_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 7 END AS valid_from FROM orders) q),
tot AS (SELECT CAST(count(*) // 20 * 20 AS BIGINT) AS total FROM orders),
m AS (SELECT i, macro, total * pct // 100 AS n, total * 15 // 100 AS c, total FROM tot, (VALUES (0, 'commerce', 50), (1, 'service', 30), (2, 'workflow', 20)) v(i, macro, pct)),
r AS (SELECT *, n * c // total AS w, row_number() OVER (ORDER BY n * c % total DESC, n DESC, macro DESC) AS rk FROM m),
h AS (SELECT *, w + CASE WHEN rk <= c - (SELECT sum(w) FROM r) THEN 1 ELSE 0 END AS hold FROM r),
b AS (SELECT i * 3 AS pos, macro, 'UPDATE' AS decision, n - 3 * hold AS k, 1 AS size, 0 AS begun FROM h UNION ALL SELECT i * 3 + 1, macro, 'HOLD', hold, 2, n - 3 * hold FROM h UNION ALL SELECT i * 3 + 2, macro, 'IGNORE', hold, 1, n - 2 * hold FROM h),
o AS (SELECT *, coalesce(sum(k) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e0, coalesce(sum(k * size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM b),
d AS (SELECT macro, decision, size, begun + u AS draw, e0 + u + 1 AS event, s0 + u * size + 1 AS sequence FROM (SELECT *, unnest(range(CAST(k AS BIGINT))) AS u FROM o) x),
pr AS (SELECT *, row_number() OVER (PARTITION BY macro ORDER BY key) - 1 AS at, count(*) OVER (PARTITION BY macro) AS pool_size,
  row_number() OVER (PARTITION BY macro, field_id ORDER BY entity, key) - 1 AS nf, count(*) OVER (PARTITION BY macro, field_id) AS allf, count(*) OVER (PARTITION BY macro, field_id, entity) AS sizef,
  row_number() OVER (PARTITION BY macro ORDER BY entity, key) - 1 AS nm, count(*) OVER (PARTITION BY macro) AS allm, count(*) OVER (PARTITION BY macro, entity) AS sizem FROM pool),
pf AS (SELECT *, min(nf) OVER (PARTITION BY macro, field_id, entity) AS firstf, min(nm) OVER (PARTITION BY macro, entity) AS firstm FROM pr),
j AS (SELECT d.*, pf.dataset, pf.record_id, pf.entity, pf.field_id, pf.value, pf.observed_at, pf.valid_from,
  CASE WHEN allf > sizef THEN (draw + 1) % (allf - sizef) + CASE WHEN (draw + 1) % (allf - sizef) < firstf THEN 0 ELSE sizef END END AS wf,
  CASE WHEN allm > sizem THEN (draw + 1) % (allm - sizem) + CASE WHEN (draw + 1) % (allm - sizem) < firstm THEN 0 ELSE sizem END END AS wm
  FROM d JOIN pf ON pf.macro = d.macro AND pf.at = d.draw % pf.pool_size),
k AS (SELECT j.*, coalesce(a.record_id, z.record_id) AS distractor_id, coalesce(a.entity, z.entity, j.entity) AS shown, coalesce(a.value, z.value, j.value) AS shown_value FROM j
  LEFT JOIN pr a ON j.decision = 'IGNORE' AND a.macro = j.macro AND a.field_id = j.field_id AND a.nf = j.wf
  LEFT JOIN pr z ON j.decision = 'IGNORE' AND j.wf IS NULL AND z.macro = j.macro AND z.nm = j.wm),
x AS (SELECT *, unnest(range(size)) AS s FROM k),
p AS (SELECT 'r' || lpad(CAST(CAST(sequence + s AS BIGINT) AS VARCHAR), 9, '0') AS record_id, CAST(sequence + s AS BIGINT) AS sequence, macro || ':' || dataset || ':' || record_id || ':episode-' || lpad(CAST(CAST(event AS BIGINT) AS VARCHAR), 9, '0') AS group_id,
  macro, CASE WHEN s = 1 THEN 'UPDATE' ELSE decision END AS decision,
  CASE WHEN s = 1 THEN 'verification_confirmed' WHEN decision = 'UPDATE' THEN 'new_consistent' WHEN decision = 'HOLD' THEN 'tool_error_or_low_trust' ELSE 'explicit_conflict' END AS observation_type,
  CASE WHEN decision = 'HOLD' AND s = 0 THEN 'VERIFY' ELSE 'NO_VERIFY' END AS verification, CASE WHEN s = 1 THEN 'r' || lpad(CAST(CAST(sequence AS BIGINT) AS VARCHAR), 9, '0') END AS parent_id,
  dataset, record_id AS source_id, field_id, shown AS entity, shown_value AS value, distractor_id, CAST(1750000000 + 600 * event + 300 * s AS BIGINT) AS observed_at, CAST(1750000000 + 600 * event - greatest(0, observed_at - valid_from) AS BIGINT) AS valid_from FROM x)
"""


@register("corpus_plan", _PLAN.replace("greatest(0, observed_at - valid_from)", "CASE WHEN valid_from IS NOT NULL THEN greatest(0, observed_at - valid_from) END") + "SELECT * FROM p")
def corpus_plan(spark, sf):
    pool = order_pool(spark, sf)
    return C.plan(pool, pool.count() // 20 * 20, SEED).drop("goal")


@register(
    "corpus_report",
    _PLAN
    + f""", t AS (SELECT *, row_number() OVER (PARTITION BY field_id, entity, value ORDER BY sequence) AS nth FROM p), g AS (SELECT group_id, count(*) AS k FROM p GROUP BY 1)
    SELECT 'decision' AS metric, decision AS key, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'macro_domain', macro, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'observation', observation_type, count(*) FROM t GROUP BY 2
    UNION ALL SELECT 'source', dataset, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'verification', verification, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'accepted', '', count(*) FROM t UNION ALL SELECT 'rejected', '', count(*) FROM t WHERE nth > 1
    UNION ALL SELECT 'requests', '', CAST(ceil((count(*) + count(*) FILTER (WHERE nth > 1)) / {BATCH}e0) AS BIGINT) FROM t UNION ALL SELECT 'paired_hold_groups', '', count(*) FROM g WHERE k = 2 UNION ALL SELECT 'total_tokens', '', 0""",
)
def corpus_report(spark, sf):
    """The whole run: plan, rounds of realisation, checks while writing, publication, and the report of what was published."""
    pool = order_pool(spark, sf)
    total = pool.count() // 20 * 20
    got = C.build(pool, scratch_path(spark, "corpus"), total, SEED, BATCH, confirm_full=total)
    return C.report(got.accepted, got.rejected, got.requests)


@register(
    "response_log",
    """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, 'a' || doc_id AS answer, doc_id % 3 AS batch FROM documents), f AS (SELECT digest, min(batch) AS batch FROM d GROUP BY 1)
    SELECT d.digest, min(answer) AS answer, d.batch FROM d JOIN f ON d.digest = f.digest AND d.batch = f.batch GROUP BY 1, 3""",
)
def response_log(spark, sf):
    """Three batches of responses, the second of them written twice."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("answer"))
    log = K.AppendLog(spark, scratch_path(spark, "log"), "digest string, answer string")
    for batch in (0, 1, 2, 1):
        log.append(d.where(F.col("doc_id") % 3 == batch), batch)
    return log.rows().select("digest", "answer", "batch")


@register(
    "cached_realisation",
    """WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, coalesce(source, '') AS observation_text, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos FROM documents WHERE doc_id % 2 = 0),
    a AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, coalesce(source, '') AS observation_text, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos FROM documents),
    g AS (SELECT pos // 25 AS q, string_agg(record_id || '=' || observation_text, ';' ORDER BY record_id) AS body FROM r GROUP BY 1), h AS (SELECT pos // 25 AS q, string_agg(record_id || '=' || observation_text, ';' ORDER BY record_id) AS body FROM a GROUP BY 1)
    SELECT record_id, observation_text, EXISTS (SELECT 1 FROM g WHERE g.body = h.body) AS cached FROM a JOIN h ON a.pos // 25 = h.q""",
)
def cached_realisation(spark, sf):
    """Half of the documents are asked for, then all, then all again: the third run sends nothing, and only requests that are the same are taken from the log."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.coalesce("source", F.lit("")).alias("prompt"), (F.col("doc_id") % 2 == 0).alias("even"))
    log = K.AppendLog(spark, scratch_path(spark, "answers"), R.LOG)
    R.realise(d.where("even"), log, 0, BATCH)
    for _ in range(2):
        got = R.realise(d, log, 1, BATCH)
    return got.select("record_id", "observation_text", "cached")
