"""Catalogue: joins, quotas, labelling, scenario assembly, sources, Arrow functions, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitflow.functions import python_udfs as P
from admitflow.functions import scalars as S
from admitflow.operators import joins as J
from admitflow.operators import labelling as L
from admitflow.operators import metrics as M
from admitflow.operators import sequences as Q
from admitflow.operators import trees as T
from admitflow.plans.catalogue import register
from admitflow.plans.common import table
from admitflow.session import scratch_path
from admitflow.sources import sinks as K
from admitflow.streaming import keyed


@register(
    "one_to_one_reconcile",
    """WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'matched' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def one_to_one_reconcile(spark, sf):
    return J.reconcile(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@register(
    "distractor_pick",
    """WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer),
    p AS (SELECT a.c_custkey, b.c_custkey AS other, count(*) OVER (PARTITION BY a.c_custkey) AS n, row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_nationkey, b.c_custkey) - 1 AS i
      FROM c a JOIN c b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey <> b.c_nationkey)
    SELECT c_custkey, other AS distractor FROM p WHERE i = c_custkey % n""",
)
def distractor_pick(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    got = J.pick_other(c, ["c_mktsegment"], F.col("c_nationkey"), "c_custkey", F.col("c_custkey"))
    return got.select("c_custkey", F.col("other_c_custkey").alias("distractor"))


@register(
    "fallback_donor",
    """WITH s AS (SELECT s_suppkey, s_nationkey AS domain, n_regionkey AS macro, s_acctbal < 0 AS field, s_suppkey % 3 AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    m AS (SELECT a.s_suppkey, b.s_suppkey AS donor, a.v <> b.v AS differs, b.v, lv.l FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey JOIN (VALUES (0), (1), (2), (3), (4)) lv(l)
      ON CASE lv.l WHEN 0 THEN a.domain = b.domain AND a.field = b.field WHEN 1 THEN a.macro = b.macro AND a.field = b.field WHEN 2 THEN a.domain = b.domain WHEN 3 THEN a.macro = b.macro ELSE true END),
    c AS (SELECT s_suppkey, donor, v, l AS level FROM m WHERE differs UNION ALL SELECT s_suppkey, donor, NULL, l + 5 FROM m),
    r AS (SELECT *, min(level) OVER (PARTITION BY s_suppkey) AS best FROM c),
    k AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS n, row_number() OVER (PARTITION BY s_suppkey ORDER BY v, donor) - 1 AS i FROM r WHERE level = best)
    SELECT s_suppkey, CAST(level AS INTEGER) AS level, donor FROM k WHERE i = (s_suppkey * 7) % n""",
)
def fallback_donor(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", F.col("s_nationkey").alias("domain"), F.col("n_regionkey").alias("macro"), (F.col("s_acctbal") < 0).alias("field"), (F.col("s_suppkey") % 3).alias("v"))
    levels = [["domain", "field"], ["macro", "field"], ["domain"], ["macro"], []]
    return J.fallback_donor(s, levels, "v", "s_suppkey", F.col("s_suppkey") * 7)


@register(
    "successor_pairs",
    """WITH h AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'error')
    SELECT 'e' || event_id AS record_id, CAST(NULL AS VARCHAR) AS parent_id, 'HOLD' AS decision, t AS observed_at, 2 AS verification_left, 5 AS tool_left FROM h
    UNION ALL SELECT 'e' || event_id || '-v', 'e' || event_id, 'UPDATE', t + 300, 1, 4 FROM h""",
)
def successor_pairs(spark, sf):
    h = table(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    row = lambda rid, parent, d, t, v, tool: F.struct(rid.alias("record_id"), parent.alias("parent_id"), F.lit(d).alias("decision"), t.alias("observed_at"), F.lit(v).alias("verification_left"), F.lit(tool).alias("tool_left"))
    pair = F.array(row(F.col("id"), F.lit(None).cast("string"), "HOLD", F.col("t"), 2, 5), row(F.concat("id", F.lit("-v")), F.col("id"), "UPDATE", F.col("t") + 300, 1, 4))
    return h.select(F.explode(pair).alias("r")).select("r.*")


@register(
    "resume_anti_join",
    """WITH t AS (SELECT o_custkey % 100 AS cell, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), d AS (SELECT o_custkey % 100 AS cell, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT t.cell, t.o_orderpriority, t.n - coalesce(d.n, 0) AS remaining FROM t LEFT JOIN d ON t.cell = d.cell AND t.o_orderpriority = d.o_orderpriority WHERE t.n - coalesce(d.n, 0) > 0""",
)
def resume_anti_join(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("cell"), "o_orderpriority", "o_orderstatus")
    return J.multiset_remaining(o, o.where("o_orderstatus = 'F'"), ["cell", "o_orderpriority"])


@register(
    "cache_lookup",
    """WITH d AS (SELECT doc_id, sha256('v1:' || coalesce(text, '')) AS h FROM documents), c AS (SELECT h, arg_min('r' || doc_id, doc_id) AS value FROM d WHERE doc_id % 2 = 0 GROUP BY 1)
    SELECT doc_id, value, value IS NOT NULL AS hit FROM d LEFT JOIN c ON d.h = c.h""",
)
def cache_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.lit("v1:"), F.coalesce("text", F.lit(""))), 256).alias("h"))
    cache = d.where("doc_id % 2 = 0").select("h", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("value"), F.col("doc_id").alias("written"))
    hits, _misses = J.cache_lookup(d, cache, "h", "written")
    return hits.select("doc_id", "value", "hit")


@register(
    "apportionment",
    """WITH w AS (SELECT n_name, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    r AS (SELECT n_name, w, w * 1000e0 / (SELECT sum(w) FROM w) AS raw FROM w),
    f AS (SELECT *, floor(raw) AS fl, row_number() OVER (ORDER BY raw - floor(raw) DESC, w DESC, n_name DESC) AS rk FROM r)
    SELECT n_name, w AS weight, CAST(fl + CASE WHEN rk <= 1000 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM f""",
)
def apportionment(spark, sf):
    w = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("weight"))
    return Q.apportion(w, "weight", 1000, [F.desc("weight"), F.desc("n_name")])


@register(
    "quota_expand",
    """WITH m(i, t, u, g, h) AS (VALUES (0, 'new_consistent', 16, 3, 2), (1, 'explicit_conflict', 9, 6, 6), (2, 'implicit_conflict', 8, 6, 7), (3, 'stale', 8, 10, 3), (4, 'irrelevant', 4, 15, 2), (5, 'tool_error_or_low_trust', 8, 7, 6), (6, 'insufficient_or_ambiguous', 3, 2, 9)),
    v AS (SELECT *, least(h, greatest(0, 21 - coalesce(sum(h) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS v FROM m),
    c AS (SELECT i * 4 AS pos, t, 'UPDATE' AS d, 'NONE' AS a, u AS n FROM v UNION ALL SELECT i * 4 + 1, t, 'IGNORE', 'NONE', g FROM v UNION ALL SELECT i * 4 + 2, t, 'HOLD', 'VERIFY', v FROM v UNION ALL SELECT i * 4 + 3, t, 'HOLD', 'DEFER', h - v FROM v),
    x AS (SELECT *, unnest(generate_series(1, CAST(n AS INTEGER))) AS k FROM c WHERE n > 0),
    r AS (SELECT *, row_number() OVER (ORDER BY pos, k) AS unit FROM x)
    SELECT unit, t AS observation_type, d AS decision, a AS action FROM r WHERE unit <= 140""",
)
def quota_expand(spark, sf):
    return L.quota_units(spark, 140)


OBS = "CASE event_id % 7 WHEN 0 THEN 'new_consistent' WHEN 1 THEN 'explicit_conflict' WHEN 2 THEN 'implicit_conflict' WHEN 3 THEN 'stale' WHEN 4 THEN 'irrelevant' WHEN 5 THEN 'tool_error_or_low_trust' ELSE 'insufficient_or_ambiguous' END"
DEC = "CASE WHEN event_type = 'error' THEN 'HOLD' WHEN event_type = 'view' THEN 'IGNORE' ELSE 'UPDATE' END"
DOM = "CASE user_id % 5 WHEN 0 THEN 'retail' WHEN 1 THEN 'airline' WHEN 2 THEN 'telecom' WHEN 3 THEN 'database' ELSE 'other' END"


@register(
    "rule_labeller",
    f"""WITH e AS (SELECT event_id, {OBS} AS k, {DEC} AS d, {DOM} AS dom FROM events),
    s AS (SELECT *, CASE dom WHEN 'retail' THEN 'order_service_api' WHEN 'airline' THEN 'airline_booking_api' WHEN 'telecom' THEN 'telecom_account_api' WHEN 'database' THEN 'database_query' END AS prim,
      CASE dom WHEN 'retail' THEN 'forwarded_customer_message' WHEN 'airline' THEN 'travel_agency_forward' WHEN 'telecom' THEN 'unverified_support_message' ELSE 'cached_tool_result' END AS sec FROM e)
    SELECT event_id, d AS decision, k AS observation_type,
      CASE d WHEN 'UPDATE' THEN coalesce(prim, CASE k WHEN 'tool_error_or_low_trust' THEN 'official_recovered_tool' WHEN 'insufficient_or_ambiguous' THEN 'official_corroborated_partial' ELSE 'feed' END)
        WHEN 'HOLD' THEN CASE k WHEN 'implicit_conflict' THEN 'indirect_report' WHEN 'stale' THEN 'undated_cache' WHEN 'irrelevant' THEN 'unverified_auxiliary_source' WHEN 'insufficient_or_ambiguous' THEN 'ambiguous_report' ELSE sec END
        ELSE CASE k WHEN 'implicit_conflict' THEN 'uncorroborated_indirect_report' WHEN 'tool_error_or_low_trust' THEN 'tool_error_response' ELSE 'feed' END END AS obs_source,
      CASE k WHEN 'stale' THEN CASE d WHEN 'UPDATE' THEN event_id + 90 + 5 WHEN 'IGNORE' THEN greatest(0, event_id + 90 - 5) END WHEN 'insufficient_or_ambiguous' THEN NULL ELSE event_id + 100 END AS valid_from,
      CASE k WHEN 'new_consistent' THEN CASE d WHEN 'IGNORE' THEN 'duplicate_of_current_state' ELSE 'applies_to_current_entity' END WHEN 'explicit_conflict' THEN CASE d WHEN 'IGNORE' THEN 'explicitly_different_entity' ELSE 'explicit_value_conflict_with_current_state' END
        WHEN 'implicit_conflict' THEN 'conflict_inferred_from_consequence' WHEN 'irrelevant' THEN CASE d WHEN 'UPDATE' THEN 'maintained_long_term_field_outside_active_subgoal' ELSE 'outside_active_subgoal' END
        WHEN 'tool_error_or_low_trust' THEN 'tool_reliability_requires_assessment' WHEN 'insufficient_or_ambiguous' THEN 'partial_or_ambiguous_evidence' ELSE 'applies_to_current_entity' END AS condition,
      NOT (d = 'IGNORE' AND k IN ('irrelevant', 'insufficient_or_ambiguous')) AS relevant,
      CASE WHEN d = 'UPDATE' THEN 'primary_record' WHEN d = 'HOLD' THEN 'secondary' WHEN k = 'explicit_conflict' THEN 'primary_record' ELSE 'untrusted_or_inapplicable' END AS authority,
      d = 'UPDATE' OR (d = 'IGNORE' AND k = 'explicit_conflict') AS authenticated, CASE WHEN d = 'HOLD' THEN 'high' ELSE 'medium' END AS risk, d <> 'HOLD' AS reversible FROM s""",
)
def rule_labeller(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(DEC).alias("decision"), F.expr(OBS).alias("observation_type"), F.expr(DOM).alias("domain"))
    got = L.label(e, F.col("observation_type"), F.col("decision"), F.col("domain"), F.lit("feed"), F.col("event_id") + 100, F.col("event_id") + 90)
    return got.drop("domain")


@register(
    "corpus_schedule",
    """WITH t(macro, n) AS (VALUES ('commerce', 100), ('service', 60), ('workflow', 40)),
    c AS (SELECT macro, 'HOLD' AS d, n * 15 // 100 AS k FROM t UNION ALL SELECT macro, 'IGNORE', n * 15 // 100 FROM t UNION ALL SELECT macro, 'UPDATE', n - 3 * (n * 15 // 100) FROM t),
    u AS (SELECT macro, d, row_number() OVER (PARTITION BY macro ORDER BY d, k2) - 1 AS i FROM (SELECT macro, d, unnest(generate_series(1, CAST(k AS INTEGER))) AS k2 FROM c) x),
    p AS (SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'commerce' WHEN c_mktsegment = 'MACHINERY' THEN 'service' ELSE 'workflow' END AS macro, c_custkey FROM customer),
    q AS (SELECT *, row_number() OVER (PARTITION BY macro ORDER BY c_custkey) - 1 AS at, count(*) OVER (PARTITION BY macro) AS size FROM p),
    j AS (SELECT u.macro, u.d, u.i, q.c_custkey, u.i // q.size AS variant FROM u JOIN q ON u.macro = q.macro AND u.i % q.size = q.at)
    SELECT macro, i, 0 AS step, d AS decision, CAST(NULL AS VARCHAR) AS successor_of, c_custkey, variant, 1750000000 + 600 * i AS observed_at FROM j
    UNION ALL SELECT macro, i, 1, 'UPDATE', macro || '-' || i, c_custkey, variant, 1750000000 + 600 * i + 300 FROM j WHERE d = 'HOLD'""",
)
def corpus_schedule(spark, sf):
    seg = F.col("c_mktsegment")
    macro = F.when(seg.isin("AUTOMOBILE", "BUILDING"), "commerce").when(seg == "MACHINERY", "service").otherwise("workflow")
    return L.schedule(table(spark, sf, "customer").select(macro.alias("macro"), "c_custkey"), 200, "c_custkey")


@register(
    "stride_sample",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), s AS (SELECT DISTINCT k * n // 64 AS i FROM (SELECT DISTINCT n FROM r), range(64) t(k))
    SELECT doc_id, r.i % 4 AS shard, s.i IS NOT NULL AS sampled FROM r LEFT JOIN s ON r.i = s.i""",
)
def stride_sample(spark, sf):
    d = Q.ordinal(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    n = F.lit(table(spark, sf, "documents").count())
    marks = spark.range(64).select(F.floor(F.col("id") * n / 64).alias("ordinal")).distinct().withColumn("sampled", F.lit(True))
    return d.join(F.broadcast(marks), "ordinal", "left").select("doc_id", (F.col("ordinal") % 4).alias("shard"), F.coalesce("sampled", F.lit(False)).alias("sampled"))


@register(
    "seeded_order_sample",
    "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS position FROM documents ORDER BY 2 LIMIT 50",
)
def seeded_order_sample(spark, sf):
    key = F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256)
    top = table(spark, sf, "documents").select("doc_id", key.alias("key")).orderBy("key", "doc_id").limit(50)
    return top.withColumn("all", F.lit(1)).withColumn("position", (Q.step_index(["all"], ["key", "doc_id"]) + 1)).select("doc_id", "position")


@register(
    "tree_flatten",
    """WITH RECURSIVE edges AS (SELECT NULL AS parent, 'r' || r_regionkey AS id, r_name AS label, true AS is_action FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_name, n_nationkey % 2 = 0 FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_name, false FROM supplier),
    t AS (SELECT id, label, 0 AS depth, id AS path, label AS action FROM edges WHERE parent IS NULL
      UNION ALL SELECT e.id, e.label, t.depth + 1, t.path || '/' || e.id, CASE WHEN e.is_action THEN e.label ELSE t.action END FROM edges e JOIN t ON e.parent = t.id)
    SELECT id, label, depth, path, action FROM t""",
)
def tree_flatten(spark, sf):
    r = table(spark, sf, "region").selectExpr("CAST(NULL AS STRING) AS parent", "'r' || r_regionkey AS id", "r_name AS label", "true AS is_action")
    n = table(spark, sf, "nation").selectExpr("'r' || n_regionkey AS parent", "'n' || n_nationkey AS id", "n_name AS label", "n_nationkey % 2 = 0 AS is_action")
    s = table(spark, sf, "supplier").selectExpr("'n' || s_nationkey AS parent", "'s' || s_suppkey AS id", "s_name AS label", "false AS is_action")
    edges = r.unionByName(n).unionByName(s)
    return T.flatten(edges)


HEX15 = "CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS BIGINT)"


@register(
    "manifest_stats",
    f"""SELECT source, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, bit_xor({HEX15}) AS digest, CAST(sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS n_lines FROM documents GROUP BY 1""",
)
def manifest_stats(spark, sf):
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"), F.bit_xor(digest).alias("digest"), F.sum(lines).alias("n_lines"))


@register("pool_attach", "SELECT n_name, count(c_custkey) AS pool, count(c_custkey) = 0 AS missing FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def pool_attach(spark, sf):
    pool = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("pool"))
    n = F.coalesce("pool", F.lit(0))
    return table(spark, sf, "nation").join(pool, "n_nationkey", "left").select("n_name", n.alias("pool"), (n == 0).alias("missing"))


@register(
    "input_audit",
    """SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS orphan_labels,
    (SELECT count(*) FROM documents WHERE lang IS NULL OR source IS NULL OR text IS NULL) AS contract_errors, (SELECT count(DISTINCT source) FROM documents) AS n_groups""",
)
def input_audit(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    a = d.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("lang").isNull() | F.col("source").isNull() | F.col("text").isNull()).alias("contract_errors"), F.count_distinct("source").alias("n_groups"))
    b = lab.agg(F.count(F.lit(1)).alias("n_labels"))
    c = lab.join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_labels"))
    return a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True))


@register(
    "set_difference",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) a
    UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) b""",
)
def set_difference(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return size(c.intersect(o), "both").unionByName(size(c.subtract(o), "customers_only"))


@register(
    "rank_cut_split",
    """WITH g AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('7:' || conv_id), conv_id) - 1 AS i, count(*) OVER () AS n FROM g),
    c AS (SELECT *, least(greatest(1, CAST(floor(n * 0.8e0) AS BIGINT)), n - 2) AS a FROM r)
    SELECT conv_id, CASE WHEN i < a THEN 'train' WHEN i < least(a + greatest(1, CAST(floor(n * 0.1e0) AS BIGINT)), n - 1) THEN 'dev' ELSE 'test' END AS split FROM c""",
)
def rank_cut_split(spark, sf):
    g = table(spark, sf, "conversations").select("conv_id").distinct().withColumn("key", F.sha2(F.concat(F.lit("7:"), F.col("conv_id").cast("string")), 256))
    r = Q.ordinal(g, ["key", "conv_id"])
    dev, test = Q.group_cuts(g.count(), 0.8, 0.1)
    return r.select("conv_id", S.split_name(F.col("ordinal"), F.lit(dev), F.lit(test)).alias("split"))


@register(
    "replacement_round",
    """WITH d AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS h, doc_id % 2 = 0 AS drawn FROM documents), f AS (SELECT h, min(doc_id) AS first FROM d WHERE drawn GROUP BY 1),
    x AS (SELECT d.*, first < doc_id AS dup FROM d JOIN f ON d.h = f.h WHERE drawn), need AS (SELECT lang, source, count(*) AS k FROM x WHERE dup GROUP BY 1, 2),
    spare AS (SELECT d.doc_id, d.lang, d.source, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY d.doc_id) AS rn FROM d LEFT JOIN f ON d.h = f.h WHERE NOT drawn AND f.h IS NULL)
    SELECT doc_id, CASE WHEN dup THEN 'rejected' ELSE 'accepted' END AS route FROM x UNION ALL SELECT doc_id, 'replacement' FROM spare JOIN need ON spare.lang = need.lang AND spare.source = need.source WHERE rn <= k""",
)
def replacement_round(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    drawn, rest = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 <> 0")
    judged = Q.first_valid_wins(drawn.withColumn("valid", F.lit(True)), "h", "valid", "doc_id")
    need = judged.where("duplicate").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k"))
    spare = rest.join(drawn.select("h").distinct(), "h", "left_anti").join(F.broadcast(need), ["lang", "source"])
    spare = spare.withColumn("at", Q.step_index(["lang", "source"], ["doc_id"])).where("at < k")
    routed = judged.select("doc_id", F.when(F.col("duplicate"), "rejected").otherwise("accepted").alias("route"))
    return routed.unionByName(spare.select("doc_id", F.lit("replacement").alias("route")))


@register(
    "two_field_completion",
    """WITH p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), n AS (SELECT o_custkey, count(*) AS c, min(k) AS k FROM p GROUP BY 1)
    SELECT o_custkey, o_orderpriority AS field, k AS observed_at, false AS derived FROM p UNION ALL SELECT o_custkey, 'derived_status', k + 5, true FROM n WHERE c = 1""",
)
def two_field_completion(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("field")).agg(F.min("o_orderkey").alias("observed_at"))
    single = p.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"), F.min("observed_at").alias("k")).where("c = 1")
    return p.withColumn("derived", F.lit(False)).unionByName(single.select("o_custkey", F.lit("derived_status").alias("field"), (F.col("k") + 5).alias("observed_at"), F.lit(True).alias("derived")))


@register(
    "scenario_rows",
    """WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer),
    p AS (SELECT a.c_custkey, b.c_custkey AS other, count(*) OVER (PARTITION BY a.c_custkey) AS n, row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_nationkey, b.c_custkey) - 1 AS i FROM c a JOIN c b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey <> b.c_nationkey),
    d AS (SELECT c_custkey, other FROM p WHERE i = c_custkey % n), o AS (SELECT o_orderkey, o_custkey, other FROM orders JOIN d ON o_custkey = c_custkey)
    SELECT o_orderkey, 0 AS step, 'ambiguous' AS kind, 'HOLD' AS expected, o_custkey AS entity, CAST(NULL AS BIGINT) AS valid_from FROM o UNION ALL SELECT o_orderkey, 1, 'wrong_entity', 'IGNORE', other, o_orderkey + 10 FROM o
    UNION ALL SELECT o_orderkey, 2, 'authoritative', 'UPDATE', o_custkey, o_orderkey + 20 FROM o UNION ALL SELECT o_orderkey, 3, 'stale', 'IGNORE', o_custkey, o_orderkey - 5 FROM o""",
)
def scenario_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    donors = J.pick_other(c, ["c_mktsegment"], F.col("c_nationkey"), "c_custkey", F.col("c_custkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("other_c_custkey").alias("other"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(donors, "o_custkey")
    event = lambda i, kind, expected, who, valid: F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), F.lit(expected).alias("expected"), F.col(who).alias("entity"), valid.cast("bigint").alias("valid_from"))
    key = F.col("o_orderkey")
    events = F.array(event(0, "ambiguous", "HOLD", "o_custkey", F.lit(None)), event(1, "wrong_entity", "IGNORE", "other", key + 10), event(2, "authoritative", "UPDATE", "o_custkey", key + 20), event(3, "stale", "IGNORE", "o_custkey", key - 5))
    return o.select("o_orderkey", F.explode(events).alias("e")).select("o_orderkey", "e.*")


@register(
    "synthetic_trajectories",
    """SELECT 'toy-' || lpad(CAST(i AS VARCHAR), 4, '0') AS scenario_id, s AS step_index, CASE s WHEN 0 THEN 'IGNORE' WHEN 1 THEN 'HOLD' ELSE 'UPDATE' END AS decision,
    CASE s WHEN 0 THEN ['stale', 'wrong_entity', 'irrelevant'][1 + CAST('0x' || substr(sha256('42:' || i), 1, 4) AS INTEGER) % 3] WHEN 1 THEN 'weak_source' ELSE 'delayed_correction' END AS kind FROM range(500) a(i), range(3) b(s)""",
)
def synthetic_trajectories(spark, sf):
    kinds = F.array(F.lit("stale"), F.lit("wrong_entity"), F.lit("irrelevant"))
    pick = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.col("id").cast("string")), 256), 1, 4), 16, 10).cast("int") % 3
    step = lambda i, d, k: F.struct(F.lit(i).cast("bigint").alias("step_index"), F.lit(d).alias("decision"), k.alias("kind"))
    steps = F.array(step(0, "IGNORE", F.get(kinds, pick)), step(1, "HOLD", F.lit("weak_source")), step(2, "UPDATE", F.lit("delayed_correction")))
    return spark.range(500).select(F.concat(F.lit("toy-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("scenario_id"), F.explode(steps).alias("s")).select("scenario_id", "s.*")


@register(
    "source_union",
    """WITH u AS (SELECT 'documents' AS dataset, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark UNION ALL SELECT 'conversations', conv_id, text FROM conversations)
    SELECT dataset, count(*) AS n, count(DISTINCT md5(text)) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM u GROUP BY 1""",
)
def source_union(spark, sf):
    part = lambda name, key: table(spark, sf, name).select(F.lit(name).alias("dataset"), F.col(key).alias("id"), "text")
    u = part("documents", "doc_id").unionByName(part("benchmark", "item_id")).unionByName(part("conversations", "conv_id"))
    return u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("text")).alias("n_texts"), F.sum(F.length("text")).alias("chars"))


@register("roundtrip_export", "SELECT doc_id, source, lang, n_chars, md5(text) AS digest FROM documents")
def roundtrip_export(spark, sf):
    path = scratch_path(spark, "export")
    K.export_splits(table(spark, sf, "documents"), path, "doc_id", "doc_id", "doc_id")
    back = spark.read.schema("doc_id long, text string, source string, lang string, n_chars long").json(path)
    return back.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("digest"))


@register(
    "sequence_pack_pad",
    """WITH c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) % 9 AS n FROM conversations), s AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS n_labels FROM c GROUP BY 1)
    SELECT conv_id, n_tokens, n_labels, 64 - least(n_tokens, 64) AS n_padding FROM s""",
)
def sequence_pack_pad(spark, sf):
    n = (F.length(F.coalesce("text", F.lit(""))) % 9).cast("int")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", n.alias("n")))).alias("t"))
    ids = F.flatten(F.transform("t", lambda x: F.array_repeat(x["turn"], x["n"])))
    labels = F.flatten(F.transform("t", lambda x: F.array_repeat(F.when(x["role"] == "assistant", x["turn"]).otherwise(F.lit(-100)), x["n"])))
    p = c.select("conv_id", ids.alias("ids"), labels.alias("labels"))
    pad = F.greatest(F.lit(0), F.lit(64) - F.size("ids"))
    full = p.withColumn("padded", F.concat(F.array_repeat(F.lit(-1).cast("bigint"), pad), "ids"))
    return full.select("conv_id", F.size("ids").cast("bigint").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("n_labels"), (F.size("padded") - F.size("ids")).cast("bigint").alias("n_padding"))


def action_texts(spark, sf):
    """Action JSON of events; some are broken in known ways."""
    field = F.col("event_type")
    update = F.format_string('{"decision":"UPDATE","affected_fields":["%s"],"patches":[{"op":"SET_VALUE","field_id":"%s","value":%d}],"verification":null}', field, field, "event_id")
    ignore = F.lit('{"decision":"IGNORE","affected_fields":[],"patches":[],"verification":null}')
    i = F.col("event_id") % 8
    text = F.when(i == 0, F.concat(update, F.lit(" x"))).when(i == 1, F.lit("{}")).when(i == 2, F.replace(update, F.lit("null}"), F.lit("NaN}"))).when(i == 3, ignore).otherwise(update)
    return table(spark, sf, "events").select("event_id", text.alias("text"))


@register("strict_parse_flags", "SELECT event_id, event_id % 8 NOT IN (0, 1, 2) AS ok, CASE WHEN event_id % 8 IN (0, 1, 2, 3) THEN 'IGNORE' ELSE 'UPDATE' END AS decision, CASE WHEN event_id % 8 > 3 THEN 1 ELSE 0 END AS n_patches FROM events")
def strict_parse_flags(spark, sf):
    a = action_texts(spark, sf).select("event_id", P.strict_action("text").alias("a"))
    return a.select("event_id", "a.ok", "a.decision", "a.n_patches")


@register("parse_execute_rates", "SELECT count(*) AS n, round(avg(CASE WHEN event_id % 8 NOT IN (0, 1, 2) THEN 1e0 ELSE 0e0 END), 9) AS parsed_rate, round(avg(CASE WHEN event_id % 8 > 3 THEN 1e0 ELSE 0e0 END), 9) AS exact_rate FROM events")
def parse_execute_rates(spark, sf):
    a = action_texts(spark, sf).select(P.strict_action("text").alias("a")).select(F.col("a.ok").alias("parsed"), (F.col("a.ok") & (F.col("a.decision") == "UPDATE")).alias("exact"))
    r = M.binary_rates(a.persist(), ["parsed", "exact"])
    return a.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(r), F.lit(True)).select("n", F.round("parsed_rate", 9).alias("parsed_rate"), F.round("exact_rate", 9).alias("exact_rate"))


@register("grounding_terms", """SELECT event_id, json_extract_string(props, '$.k') || '|' || event_type AS terms FROM events""")
def grounding_terms(spark, sf):
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("a"), F.struct(F.col("event_type").alias("x"), F.array("event_type").alias("y")).alias("b")))
    return table(spark, sf, "events").select("event_id", F.array_join(P.grounding_terms_of(body), "|").alias("terms"))


@register("signed_feature_hash")
def signed_feature_hash(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", P.hashed_features_of("text").alias("v"))
    return v.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).alias("n_used"), F.round(F.sqrt(F.aggregate("v", F.lit(0e0), lambda a, x: a + x * x)), 6).alias("norm"))


@register(
    "stream_fold",
    """WITH e AS (SELECT user_id, event_id, event_type, value, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS errors FROM events),
    b AS (SELECT user_id, event_type, round(arg_max(value, event_id), 4) AS v FROM e WHERE event_type <> 'error' AND errors < 5 GROUP BY 1, 2),
    j AS (SELECT user_id, string_agg('"' || event_type || '": ' || v, ', ' ORDER BY event_type) AS body FROM b GROUP BY 1)
    SELECT e.user_id, count(*) AS n_revisions, count(*) FILTER (WHERE event_type <> 'error' AND errors < 5) AS n_actions, CAST(greatest(0, 5 - max(errors)) AS INTEGER) AS left, '{' || coalesce(any_value(body), '') || '}' AS belief
    FROM e LEFT JOIN j ON e.user_id = j.user_id GROUP BY 1""",
)
def stream_fold(spark, sf):
    files = scratch_path(spark, "fold-in")
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    events.write.parquet(files)
    return keyed.run_available(spark, files, events.schema)
