"""Catalogue: hashing, text, labels, validators, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitflow.functions import scalars as S
from admitflow.operators import sequences as Q
from admitflow.plans.catalogue import register
from admitflow.plans.common import table
from admitflow.session import scratch_path
from admitflow.sources.sinks import route

BUCKET = "CAST(('0x' || substr(sha256('42:' || {k}), 1, 16))::UBIGINT % {m} AS BIGINT)"
SPLIT = "CASE WHEN {b} < {x} THEN 'train' WHEN {b} < {y} THEN 'dev' ELSE 'test' END"


def split_sql(key: str, m: int = 10000, x: int = 8000, y: int = 9000) -> str:
    return SPLIT.format(b=BUCKET.format(k=key, m=m), x=x, y=y)


@register("hash_split_counts", f"SELECT {split_sql('doc_id')} AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def hash_split_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(S.export_split(F.col("doc_id")).alias("split"), "lang").agg(F.count(F.lit(1)).alias("n"))


@register(
    "hash_split_leak_audit",
    f"""WITH d AS (SELECT source, {split_sql('source')} AS split FROM documents),
    g AS (SELECT DISTINCT source, split FROM d),
    o AS (SELECT a.split, count(*) AS n FROM g a JOIN g b ON a.source = b.source AND a.split <> b.split GROUP BY 1)
    SELECT d.split, count(*) AS n_docs, count(DISTINCT source) AS n_groups, coalesce(max(o.n), 0) AS n_leaks
    FROM d LEFT JOIN o ON d.split = o.split GROUP BY 1""",
)
def hash_split_leak_audit(spark, sf):
    d = table(spark, sf, "documents").select("source", S.export_split(F.col("source")).alias("split"))
    groups = d.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("source", F.col("split").alias("other"))
    leaks = groups.join(other, "source").where("split <> other").groupBy("split").agg(F.count(F.lit(1)).alias("leaks"))
    sums = groups.groupBy("split").agg(F.sum("n").alias("n_docs"), F.count_distinct("source").alias("n_groups"))
    return sums.join(leaks, "split", "left").select("split", "n_docs", "n_groups", F.coalesce("leaks", F.lit(0)).alias("n_leaks"))


@register(
    "two_level_task_split",
    f"""WITH o AS (SELECT o_orderkey, {split_sql('o_custkey', 100, 75, 85)} AS split, {split_sql('(o_custkey + 1)', 100, 75, 85)} AS donor FROM orders)
    SELECT split, count(*) AS n_orders, count(*) FILTER (WHERE split <> donor) AS donor_violations FROM o GROUP BY 1""",
)
def two_level_task_split(spark, sf):
    o = table(spark, sf, "orders").select(S.task_split(F.col("o_custkey")).alias("split"), S.task_split(F.col("o_custkey") + 1).alias("donor"))
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("split") != F.col("donor")).alias("donor_violations"))


@register(
    "canonical_digest",
    """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":"' || r_name || '"}') AS digest
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def canonical_digest(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("region")))
    return j.select("n_nationkey", F.sha2(body, 256).alias("digest"))


@register(
    "slug_identifier",
    """SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_type || ' #' || p_size)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'part') AS slug FROM part""",
)
def slug_identifier(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.slug(F.concat("p_type", F.lit(" #"), "p_size"), F.lit("part")).alias("slug"))


NORM = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@register("text_normal_form", f"SELECT doc_id, length({NORM}) AS n, md5({NORM}) AS digest FROM documents")
def text_normal_form(spark, sf):
    t = S.normal_text(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("digest"))


@register(
    "exact_dedup_first_wins",
    f"""WITH d AS (SELECT doc_id, md5({NORM}) AS h, coalesce(n_chars, 0) >= 80 AS valid FROM documents),
    f AS (SELECT h, min(doc_id) AS first FROM d WHERE valid GROUP BY h)
    SELECT doc_id, valid, coalesce(f.first < doc_id, false) AS duplicate, valid AND NOT coalesce(f.first < doc_id, false) AS kept FROM d LEFT JOIN f USING (h)""",
)
def exact_dedup_first_wins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(S.normal_text(F.coalesce("text", F.lit("")))).alias("h"), (F.coalesce("n_chars", F.lit(0)) >= 80).alias("valid"))
    return Q.first_valid_wins(d, "h", "valid", "doc_id").select("doc_id", "valid", "duplicate", (F.col("valid") & ~F.col("duplicate")).alias("kept"))


MARK = "CASE doc_id % 5 WHEN 0 THEN 'Decision: update' WHEN 1 THEN 'relevant = x' WHEN 2 THEN 'Reason_Code=abcd_ef' WHEN 3 THEN 'decision: up' ELSE 'plain' END"
LEAK_SQL = "(?i)(decision|reason_code|conflict_type)\\s*[:=]\\s*(update|hold|ignore|[a-z_]{4,})|(relevant|condition|perturbation)\\s*[:=]"


@register("label_leak_scan", f"SELECT doc_id, regexp_matches({MARK} || ' ' || coalesce(text, ''), '{LEAK_SQL}') AS leaks FROM documents")
def label_leak_scan(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.label_leak(F.concat(F.expr(MARK), F.lit(" "), F.coalesce("text", F.lit("")))).alias("leaks"))


@register(
    "reason_codes",
    f"""WITH j AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    c AS (SELECT doc_id, list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_observation_text' END,
      CASE WHEN regexp_matches({MARK}, '{LEAK_SQL}') THEN 'label_leakage' END,
      CASE WHEN source IS NULL OR lang IS NULL THEN 'incomplete_provenance' END,
      CASE WHEN n_chars <> length(text) THEN 'missing_grounded_value' END,
      CASE WHEN quality = 0 THEN 'patch_rejected' END,
      CASE WHEN toxic = 1 THEN 'oracle_state_mismatch' END], lambda x: x IS NOT NULL) AS codes FROM j)
    SELECT doc_id, array_to_string(codes, ',') AS codes, len(codes) = 0 AS accepted FROM c""",
)
def reason_codes(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = table(spark, sf, "documents").join(lab, "doc_id", "left")
    codes = S.reason_codes(
        (F.trim(F.coalesce("text", F.lit(""))) == "", "empty_observation_text"),
        (S.label_leak(F.expr(MARK)), "label_leakage"),
        (F.col("source").isNull() | F.col("lang").isNull(), "incomplete_provenance"),
        (F.col("n_chars") != F.length("text"), "missing_grounded_value"),
        (F.col("quality") == 0, "patch_rejected"),
        (F.col("toxic") == 1, "oracle_state_mismatch"),
    )
    return j.select("doc_id", codes.alias("c")).select("doc_id", F.array_join("c", ",").alias("codes"), (F.size("c") == 0).alias("accepted"))


@register("router_counts", "SELECT CASE WHEN n_chars >= 200 THEN 'accepted' ELSE 'rejected' END AS route, source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2, 3")
def router_counts(spark, sf):
    path = scratch_path(spark, "routed")
    route(table(spark, sf, "documents").withColumn("long", F.col("n_chars") >= 200), "long", path)
    d = spark.read.schema("source string, lang string, n_chars long, route string").json(path)
    return d.groupBy("route", "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register(
    "grounded_term_presence",
    f"""WITH d AS (SELECT doc_id, {NORM} AS t, [lang, lower(source), regexp_extract({NORM}, '^\\S+'), ''] AS terms FROM documents)
    SELECT doc_id, CAST(len(list_filter(terms, lambda x: x <> '' AND contains(t, x))) AS BIGINT) AS n_present, len(list_filter(terms, lambda x: x <> '' AND NOT contains(t, x))) = 0 AS grounded FROM d""",
)
def grounded_term_presence(spark, sf):
    t = S.normal_text(F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"), F.array("lang", F.lower("source"), F.regexp_extract(t, r"^\S+", 0), F.lit("")).alias("terms"))
    here = F.size(F.filter("terms", lambda x: (x != "") & F.contains(F.col("t"), x)))
    return d.select("doc_id", here.cast("bigint").alias("n_present"), F.forall("terms", lambda x: (x == "") | F.contains(F.col("t"), x)).alias("grounded"))


DOMAIN = "CASE c_custkey % 8 WHEN 0 THEN 'Retail' WHEN 1 THEN 'shopping' WHEN 2 THEN 'airline' WHEN 3 THEN 'TELECOM' WHEN 4 THEN 'travel' WHEN 5 THEN 'commerce' WHEN 6 THEN 'database' ELSE 'tool_api' END"


@register(
    "macro_domain_map",
    f"""WITH c AS (SELECT n_name, lower({DOMAIN}) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_name, CASE WHEN d IN ('retail', 'shopping', 'shopping_admin') THEN 'commerce' WHEN d IN ('airline', 'telecom') THEN 'service' ELSE 'workflow' END AS macro,
      CASE WHEN d IN ('retail', 'shopping', 'shopping_admin', 'commerce') THEN 'commerce' WHEN d IN ('airline', 'telecom', 'service', 'travel') THEN 'service' ELSE 'workflow' END AS macro_wide,
      CASE WHEN d IN ('shopping', 'shopping_admin', 'retail') THEN 'order_service_api' WHEN d = 'airline' THEN 'airline_booking_api' WHEN d = 'telecom' THEN 'telecom_account_api' WHEN d = 'database' THEN 'database_query' WHEN d IN ('tool_api', 'workflow') THEN 'workflow_service_api' ELSE 'other' END AS primary_source,
      CASE WHEN d IN ('shopping', 'shopping_admin', 'retail') THEN 'forwarded_customer_message' WHEN d = 'airline' THEN 'travel_agency_forward' WHEN d = 'telecom' THEN 'unverified_support_message' ELSE 'cached_tool_result' END AS second_source,
      count(*) AS n FROM c GROUP BY ALL""",
)
def macro_domain_map(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("d", F.expr(DOMAIN))
    d = F.col("d")
    return c.groupBy("n_name", S.macro_domain(d).alias("macro"), S.macro_domain(d, wide=True).alias("macro_wide"), S.authoritative_source(d, F.lit("other")).alias("primary_source"), S.secondary_source(d).alias("second_source")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "unknown_and_type_pair",
    """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'Unknown' WHEN 2 THEN NULL WHEN 3 THEN event_type ELSE json_extract_string(props, '$.k') END AS old,
      CASE WHEN event_id % 5 = 4 THEN 'number' ELSE 'string' END AS old_type, CASE WHEN event_id % 2 = 0 THEN 'number' ELSE 'string' END AS new_type FROM events)
    SELECT event_id, old IS NULL OR lower(trim(old)) IN ('', 'unknown', 'n/a', 'none') AS is_unknown, CASE WHEN old_type = new_type THEN new_type ELSE 'string' END AS pair_type FROM e""",
)
def unknown_and_type_pair(spark, sf):
    i = F.col("event_id")
    old = F.when(i % 5 == 0, " N/A ").when(i % 5 == 1, "Unknown").when(i % 5 == 2, F.lit(None)).when(i % 5 == 3, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    old_type, new_type = F.when(i % 5 == 4, "number").otherwise("string"), F.when(i % 2 == 0, "number").otherwise("string")
    return table(spark, sf, "events").select("event_id", S.unknown_value(old).alias("is_unknown"), F.when(old_type == new_type, new_type).otherwise("string").alias("pair_type"))


KINDS = ("clean", "stale", "wrong_entity", "weak_source", "conflict", "irrelevant", "delayed_correction")


@register(
    "perturbation_variants",
    "\nUNION ALL ".join(
        f"""SELECT event_id, '{k}' AS kind, {"'other-' || user_id" if k == "wrong_entity" else "CAST(user_id AS VARCHAR)"} AS entity,
    {"'unverified_message'" if k == "weak_source" else "'primary'"} AS source, {"event_id - 100" if k == "stale" else "event_id + 5" if k == "delayed_correction" else "event_id"} AS valid_from,
    {"round(-value - 1, 6)" if k == "conflict" else "round(value, 6)"} AS value, {"false" if k == "irrelevant" else "true"} AS relevant FROM events"""
        for k in KINDS
    ),
)
def perturbation_variants(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    k, user = F.col("kind"), F.col("user_id").cast("string")
    return e.select(
        "event_id", "kind", F.when(k == "wrong_entity", F.concat(F.lit("other-"), user)).otherwise(user).alias("entity"),
        F.when(k == "weak_source", "unverified_message").otherwise("primary").alias("source"),
        F.when(k == "stale", F.col("event_id") - 100).when(k == "delayed_correction", F.col("event_id") + 5).otherwise(F.col("event_id")).alias("valid_from"),
        F.round(F.when(k == "conflict", -F.col("value") - 1).otherwise(F.col("value")), 6).alias("value"), (k != "irrelevant").alias("relevant"),
    )


@register(
    "visible_projection",
    """SELECT event_id, '{"entity":"' || user_id || '","field_id":"' || event_type || '"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"valid_from":' || event_id END || '}' AS visible FROM events""",
)
def visible_projection(spark, sf):
    seen = F.struct(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("field_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("valid_from"))
    return table(spark, sf, "events").select("event_id", F.to_json(seen, {"ignoreNullFields": "true"}).alias("visible"))


@register(
    "action_json_roundtrip",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'HOLD' WHEN 'view' THEN 'IGNORE' ELSE 'UPDATE' END AS decision, CAST(json_extract_string(props, '$.k') AS BIGINT) AS patch_value,
    CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS n_affected FROM events""",
)
def action_json_roundtrip(spark, sf):
    decision = F.when(F.col("event_type") == "error", "HOLD").when(F.col("event_type") == "view", "IGNORE").otherwise("UPDATE")
    fields = F.when(decision == "IGNORE", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    body = F.to_json(F.struct(decision.alias("decision"), fields.alias("affected_fields"), F.get_json_object("props", "$.k").cast("long").alias("value")))
    e = table(spark, sf, "events").select("event_id", F.from_json(body, "decision string, affected_fields array<string>, value long", {"mode": "FAILFAST"}).alias("a"))
    return e.select("event_id", "a.decision", F.col("a.value").alias("patch_value"), F.size("a.affected_fields").alias("n_affected"))


@register(
    "softmax_scores",
    """WITH l AS (SELECT vec_id, list_transform([0, 1, 2], lambda h: list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * ((i - 1 + h) % 3 - 1)))) AS z FROM embeddings),
    e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS p FROM l)
    SELECT vec_id, round(p[1] / list_sum(p), 6) AS p0, round(p[2] / list_sum(p), 6) AS p1, round(p[3] / list_sum(p), 6) AS p2, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS chosen FROM e""",
)
def softmax_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    logit = lambda h: F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * ((i + h) % 3 - 1)), F.lit(0e0), lambda a, v: a + v)
    z = F.array(*map(logit, range(3)))
    p = e.select("vec_id", S.softmax(z).alias("p"))
    return p.select("vec_id", *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(3)), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("chosen"))


@register(
    "eligible_rows",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS gold FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'P' AND l_returnflag = 'N' AND l_quantity > 10 AND CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber % 2 = 0 END IS NOT DISTINCT FROM true""",
)
def eligible_rows(spark, sf):
    line = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 10))
    authenticated = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber") % 2 == 0)
    j = line.join(table(spark, sf, "orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.where(authenticated.eqNullSafe(F.lit(True))).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("gold"))


@register(
    "label_contract_issues",
    """WITH e AS (SELECT event_id, user_id, value, event_type, CASE event_type WHEN 'error' THEN 'HOLD' WHEN 'view' THEN 'IGNORE' ELSE 'UPDATE' END AS d FROM events)
    SELECT event_id, 'unsafe_update' AS code FROM e WHERE d = 'UPDATE' AND value < 1
    UNION ALL SELECT event_id, 'unnecessary_hold' FROM e WHERE d = 'HOLD' AND user_id % 2 = 0
    UNION ALL SELECT event_id, 'unsupported_ignore' FROM e WHERE d = 'IGNORE' AND user_id % 7 = 0
    UNION ALL SELECT event_id, 'executor_rejected' FROM e WHERE event_id % 97 = 0""",
)
def label_contract_issues(spark, sf):
    d = F.when(F.col("event_type") == "error", "HOLD").when(F.col("event_type") == "view", "IGNORE").otherwise("UPDATE")
    codes = S.reason_codes(((d == "UPDATE") & (F.col("value") < 1), "unsafe_update"), ((d == "HOLD") & (F.col("user_id") % 2 == 0), "unnecessary_hold"), ((d == "IGNORE") & (F.col("user_id") % 7 == 0), "unsupported_ignore"), (F.col("event_id") % 97 == 0, "executor_rejected"))
    return table(spark, sf, "events").select("event_id", F.explode(codes).alias("code"))


@register(
    "scenario_contract",
    """SELECT conv_id, count(*) AS n_steps, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous,
    array_to_string(list_filter(['assistant', 'system', 'user'], lambda r: NOT list_contains(list(DISTINCT role), r)), ',') AS missing FROM conversations GROUP BY 1""",
)
def scenario_contract(spark, sf):
    c = table(spark, sf, "conversations")
    missing = c.groupBy("conv_id").agg(F.array_join(F.array_except(F.array(F.lit("assistant"), F.lit("system"), F.lit("user")), F.collect_set("role")), ",").alias("missing"))
    return Q.contiguity(c, "conv_id", "turn").join(missing, "conv_id")


@register(
    "base_task_key",
    f"""WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Shop:' || o_orderkey || ':' || o_orderstatus ELSE o_orderkey || ':' || o_orderstatus END AS rec FROM orders),
    k AS (SELECT o_orderkey, left(rec, length(rec) - 2) AS bare FROM b),
    t AS (SELECT o_orderkey, CASE WHEN starts_with(lower(bare), 'shop:') THEN bare ELSE 'shop:' || bare END AS task FROM k)
    SELECT o_orderkey, task, {split_sql('task', 100, 75, 85)} AS split, substr(sha256(task || ':' || {split_sql('task', 100, 75, 85)} || ':' || (o_orderkey % 4)), 1, 16) AS scenario_id FROM t""",
)
def base_task_key(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    record = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Shop:"), key, F.lit(":"), "o_orderstatus")).otherwise(F.concat(key, F.lit(":"), "o_orderstatus"))
    t = o.select("o_orderkey", S.base_task_key(F.lit("shop"), record, F.lit(None).cast("string"), F.col("o_orderstatus")).alias("task"))
    t = t.withColumn("split", S.task_split(F.col("task")))
    return t.withColumn("scenario_id", S.scenario_key(F.col("task"), F.col("split"), F.col("o_orderkey") % 4))


@register(
    "derived_lineage",
    """SELECT doc_id, source || ':' || doc_id AS parent_record_id, lang || ':' || CASE WHEN n_chars > 500 THEN 'UPDATE' ELSE 'IGNORE' END AS transformation,
    regexp_matches(CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE sha256(coalesce(text, '')) END, '^[0-9a-fA-F]{64}$') AS valid_hash, 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id FROM documents""",
)
def derived_lineage(spark, sf):
    d = table(spark, sf, "documents")
    digest = F.when(F.col("doc_id") % 4 == 0, "zz").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    return d.select(
        "doc_id", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("parent_record_id"),
        F.concat_ws(":", "lang", F.when(F.col("n_chars") > 500, "UPDATE").otherwise("IGNORE")).alias("transformation"),
        S.valid_digest(digest).alias("valid_hash"), F.concat(F.lit("rec-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("record_id"),
    )


@register(
    "rendered_observation",
    """SELECT event_id, 'Entity ' || user_id || ' reports ' || event_type || ' as ' || coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END, 'None') || '.' AS sentence FROM events""",
)
def rendered_observation(spark, sf):
    value = F.coalesce(F.when(F.col("event_id") % 6 != 0, F.get_json_object("props", "$.k")), F.lit("None"))
    return table(spark, sf, "events").select("event_id", F.format_string("Entity %d reports %s as %s.", "user_id", "event_type", value).alias("sentence"))


@register(
    "chat_messages",
    """SELECT conv_id, string_agg(role || ':' || md5(coalesce(text, '')), '|' ORDER BY turn) AS messages, count(*) AS n FROM conversations GROUP BY 1""",
)
def chat_messages(spark, sf):
    c = table(spark, sf, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.md5(F.coalesce("text", F.lit("")))).alias("m"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["m"]), "|").alias("messages"), F.count(F.lit(1)).alias("n"))


@register(
    "json_or_text",
    """WITH u AS (SELECT 'e' AS src, event_id AS id, props AS raw FROM events UNION ALL SELECT 'd', doc_id, coalesce(text, '') FROM documents)
    SELECT src, id, src = 'e' AS is_json, CASE WHEN src = 'e' THEN json_extract_string(raw, '$.k') ELSE md5(raw) END AS value FROM u""",
)
def json_or_text(spark, sf):
    e = table(spark, sf, "events").select(F.lit("e").alias("src"), F.col("event_id").alias("id"), F.col("props").alias("raw"))
    d = table(spark, sf, "documents").select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("raw"))
    v = e.unionByName(d).withColumn("v", F.try_parse_json("raw"))
    is_json = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return v.select("src", "id", is_json.alias("is_json"), F.when(is_json, F.try_variant_get("v", "$.k", "string")).otherwise(F.md5("raw")).alias("value"))


@register("typed_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), -1) AS missing, CAST(floor(epoch(ts)) AS BIGINT) AS observed_at FROM events")
def typed_decode(spark, sf):
    s = F.from_json("props", "k long, missing long", {"mode": "FAILFAST"})
    return table(spark, sf, "events").select("event_id", s["k"].alias("k"), F.coalesce(s["missing"], F.lit(-1)).alias("missing"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("observed_at"))


@register("lr_schedule", "SELECT i AS iteration, round(CASE WHEN i + 1 <= 6 THEN (i + 1) / 6e0 ELSE 0.5e0 * (1e0 + cos(pi() * (i + 1 - 6) / 119e0)) END, 9) AS multiplier, round(8e0 / (100 + i), 9) AS loss_scale FROM range(125) t(i)")
def lr_schedule(spark, sf):
    i = spark.range(125).withColumnRenamed("id", "iteration")
    return i.select("iteration", F.round(S.warm_cosine(F.col("iteration"), 125, 0.05), 9).alias("multiplier"), F.round(S.token_loss_scale(F.col("iteration") + 100, 4, 2), 9).alias("loss_scale"))


@register(
    "slot_lookup_costs",
    """WITH s AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'error') AS e, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, coalesce(e, -1) AS first_error, e IS NULL AS missing, n AS n_slots, 0e0 AS stall, 0e0 AS false_update FROM s""",
)
def slot_lookup_costs(spark, sf):
    """A slot for each type of event, at its first event; a user has as many as there are types."""
    first = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("id")).agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    slots = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "id"))).alias("slots"), F.sum("n").alias("n_slots"))
    hit, zero = S.slot_of(F.col("slots"), F.lit("error")), S.zero_costs()
    return slots.select("user_id", F.coalesce(hit["event_id"], F.lit(-1)).alias("first_error"), hit.isNull().alias("missing"), "n_slots", *(zero[c].alias(c) for c in ("stall", "false_update")))

