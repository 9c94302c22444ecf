"""Catalogue: sources and sinks. Each query writes files of a source's format from the tables and reads them back through the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.plans.catalogue import register
from admitflow.plans.common import table
from admitflow.session import scratch_path
from admitflow.sources import readers as R
from admitflow.sources import sinks as K


def _document(rows: DataFrame, order: str, body, name: str) -> str:
    """Path of one JSON array with the bodies of a small table, in order."""
    path = scratch_path(rows.sparkSession, name)
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.to_json(body).alias("v"))))
    rows.agg(F.format_string("[%s]", F.array_join(F.transform(texts, lambda x: x["v"]), ",")).alias("value")).write.text(path)
    return path


@register("jsonl_scan", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def jsonl_scan(spark, sf):
    path = scratch_path(spark, "jsonl")
    cols = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    table(spark, sf, "customer").select(*cols).write.json(path)
    return R.read_jsonl(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")


@register(
    "jsonl_audit",
    """SELECT c_custkey // 1000 AS part, row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) AS line, CASE c_custkey % 3 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' END AS problem FROM customer QUALIFY problem IS NOT NULL""",
)
def jsonl_audit(spark, sf):
    """A file for each thousand customers, read back in splits."""
    k = F.col("c_custkey") % 3
    line = F.when(k == 0, '{"a":').when(k == 1, "[1]").otherwise(F.to_json(F.struct("c_name")))
    path = scratch_path(spark, "lines")
    rows = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 1000).alias("part"), line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(path)
    return R.jsonl_problems(spark, path).select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), "line", "problem")


@register("json_document_scan", "SELECT n_nationkey, n_name FROM nation")
def json_document_scan(spark, sf):
    path = _document(table(spark, sf, "nation"), "n_nationkey", F.struct("n_nationkey", "n_name"), "document")
    return R.read_json_document(spark, path, "n_nationkey int, n_name string")


RECORD_COLUMNS = ["record_id", "domain", "scenario_type", "entity", "field_id", "old_value", "new_value", "source", "observed_at", "valid_from", "goal", "source_text"]


@register(
    "service_adapter",
    """WITH s AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'airline' ELSE 'tau2' END AS domain, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS reason FROM supplier WHERE s_suppkey % 5 <> 0),
    n AS (SELECT *, 1700000000 + row_number() OVER (ORDER BY k) - 1 AS t FROM s)
    SELECT domain || ':' || k || ':status' AS record_id, domain, 'transaction' AS scenario_type, 'o' || k AS entity, 'status' AS field_id, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'was' END AS old_value, 'v' || k AS new_value,
      'change_order' AS source, CAST(t AS BIGINT) AS observed_at, CAST(t AS BIGINT) AS valid_from, CASE WHEN reason = '' THEN 'complete the service task' ELSE reason END AS goal, trim(reason || ' known') AS source_text FROM n
    WHERE t < 1700000000 + 40""",
)
def service_adapter(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    text = k.cast("string")
    pairs = F.map_concat(F.create_map(F.lit("order_id"), F.concat(F.lit("o"), text), F.lit("status"), F.concat(F.lit("v"), text)), F.when(k % 7 != 0, F.create_map(F.lit("old_status"), F.lit("was"))).otherwise(F.create_map().cast("map<string,string>")))
    act = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("arguments"))
    nothing = F.create_map().cast("map<string,string>")
    actions = F.when(k % 5 == 0, F.array(act("noop", nothing))).otherwise(F.array(act("noop", nothing), act("change_order", pairs)))
    told = F.struct(F.when(k % 2 == 0, "airline").alias("domain"), F.when(k % 3 == 0, "").otherwise(F.col("s_name")).alias("reason_for_call"), F.lit("known").alias("known_info"))
    body = F.struct(text.alias("id"), F.struct(told.alias("instructions")).alias("user_scenario"), F.struct(actions.alias("actions")).alias("evaluation_criteria"))
    return R.service_tasks(spark, _document(s, "s_suppkey", body, "service"), limit=40).select(*RECORD_COLUMNS)


@register(
    "web_adapter",
    """WITH n AS (SELECT n_nationkey AS k, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation WHERE n_nationkey % 4 <> 0)
    SELECT CAST(k AS VARCHAR) AS record_id, 'shop' AS domain, 'information_tool' AS scenario_type, CASE WHEN k % 2 = 0 THEN 'order:' || k ELSE 'shop:' || k END AS entity, CASE WHEN k % 3 = 0 THEN 'order_total' ELSE 'reference_answer' END AS field_id,
      'unknown' AS old_value, n_name AS new_value, 'shop_website' AS source, CAST(1730000000 + i AS BIGINT) AS observed_at, CAST(1730000000 + i AS BIGINT) AS valid_from, 'find ' || n_name AS goal, 'find ' || n_name AS source_text FROM n""",
)
def web_adapter(spark, sf):
    k = F.col("n_nationkey")
    extra = F.map_concat(
        F.when(k % 2 == 0, F.create_map(F.lit("order_number"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(k % 3 == 0, F.create_map(F.lit("info"), F.lit("Order Total!"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    answer = F.struct(F.when(k % 4 != 0, F.struct(F.array("n_name", F.lit("second")).alias("must_include"))).alias("reference_answers"))
    body = F.struct(k.cast("string").alias("task_id"), F.array(F.lit("shop")).alias("sites"), F.concat(F.lit("find "), "n_name").alias("intent"), extra.alias("instantiation_dict"), answer.alias("eval"))
    return R.web_tasks(spark, _document(table(spark, sf, "nation"), "n_nationkey", body, "web")).select(*RECORD_COLUMNS)


@register(
    "table_adapter",
    """WITH n AS (SELECT n_nationkey AS k, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation WHERE n_nationkey % 5 <> 0)
    SELECT 'dbbench:' || k || ':region' AS record_id, 'database' AS domain, 'information_tool' AS scenario_type, CASE WHEN k % 2 = 0 THEN 'nations' ELSE 'table-' || k END AS entity, 'region' AS field_id, CAST(n_regionkey AS VARCHAR) AS old_value,
      n_name AS new_value, 'database_query' AS source, CAST(1720000000 + i AS BIGINT) AS observed_at, CAST(1720000000 + i AS BIGINT) AS valid_from, 'which ' || n_name AS goal, 'which ' || n_name AS source_text FROM n""",
)
def table_adapter(spark, sf):
    k = F.col("n_nationkey")
    info = F.struct(F.array(F.struct(F.lit("region").alias("name"), F.lit("int").alias("type"))).alias("columns"), F.array(F.array(F.col("n_regionkey").cast("string"), F.lit("x"))).alias("rows"))
    label = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name"))
    body = F.struct(F.concat(F.lit("which "), "n_name").alias("description"), label.alias("label"), F.struct(F.when(k % 2 == 0, "nations").otherwise("").alias("table_name"), info.alias("table_info")).alias("table"))
    path = scratch_path(spark, "questions")
    table(spark, sf, "nation").repartition(1).sortWithinPartitions("n_nationkey").select(F.to_json(body).alias("value")).write.text(path)
    return R.table_questions(spark, path).select(*RECORD_COLUMNS)


@register(
    "trace_adapter",
    """WITH n AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT 'call_' || r_name AS entity, CAST(i AS INTEGER) AS at, n_name AS new_value FROM n UNION ALL SELECT 'call_' || r_name, 0, 'root of ' || r_name FROM region""",
)
def trace_adapter(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    leaf = lambda x: F.struct(F.lit("Observation").alias("node_type"), F.to_json(F.struct(x["n_name"].alias("response"))).alias("observation"))
    root = F.struct(F.lit("Action").alias("node_type"), F.concat(F.lit("call_"), "r_name").alias("description"), F.concat(F.lit("root of "), "r_name").alias("observation"), F.transform("n", leaf).alias("children"))
    body = F.to_json(F.struct(F.struct(root.alias("tree")).alias("tree"))).alias("value")
    path = scratch_path(spark, "traces")
    table(spark, sf, "region").join(n, "r_regionkey").select(F.col("r_regionkey").alias("r"), body).write.partitionBy("r").text(path)
    got = R.tool_traces(spark, path)
    return got.select("entity", F.regexp_extract("record_id", r":(\d+)$", 1).cast("int").alias("at"), "new_value")


@register(
    "manifest_union",
    """SELECT 'lines' AS source_dataset, 's' || s_suppkey AS record_id, s_name AS new_value, 1000 + s_suppkey AS observed_at, true AS has_digest FROM supplier
    UNION ALL SELECT 'document', 'n' || n_nationkey, n_name, 2000 + n_nationkey, true FROM nation""",
)
def manifest_union(spark, sf):
    root = scratch_path(spark, "manifest")

    def record(key, prefix, value, base):
        fixed = {"domain": "d", "scenario_type": "environment", "entity": "e", "field_id": "f", "source": "src", "goal": "g", "source_text": "t"}
        t = (F.col(key) + base).cast("bigint")
        return F.struct(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), *(F.lit(v).alias(c) for c, v in fixed.items()), F.col(value).alias("new_value"), t.alias("observed_at"))

    table(spark, sf, "supplier").select(F.to_json(record("s_suppkey", "s", "s_name", 1000)).alias("value")).write.text(f"{root}/lines")
    rows = F.array_sort(F.collect_list(record("n_nationkey", "n", "n_name", 2000)))
    table(spark, sf, "nation").agg(F.to_json(F.struct(rows.alias("records"))).alias("value")).write.text(f"{root}/document")
    entry = '{"dataset":"%s","version":"1","license":"none","path":"%s","format":"%s"}'
    K.write_text(spark, f"{root}/manifest.json", '{"sources":[' + ",".join(entry % x for x in (("lines", "./lines", "jsonl"), ("document", "document", "json"))) + "]}")
    return R.load_manifest(spark, root).select("source_dataset", "record_id", "new_value", "observed_at", (F.length("source_sha256") == 64).alias("has_digest"))


@register(
    "artifact_audit",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'blank url' ELSE '' END || CASE WHEN n_nationkey % 6 = 0 THEN ',' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN 'bad digest' ELSE '' END AS problems
    FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0""",
)
def artifact_audit(spark, sf):
    k = F.col("n_nationkey")
    digest = F.sha2("n_name", 256)
    rows = table(spark, sf, "nation").select(
        k, F.lit("d").alias("dataset"), F.lit("1").alias("version"), F.lit("none").alias("license"), F.when(k % 3 == 0, " ").otherwise("u").alias("url"), F.col("n_name").alias("relative_path"),
        F.when(k % 2 == 0, F.substring(digest, 1, 63)).otherwise(F.upper(digest)).alias("sha256"),
    )
    return R.artifact_problems(rows).select("n_nationkey", F.array_join("problems", ",").alias("problems"))


@register("verified_files", "SELECT r_name AS dataset, sha256(r_name || chr(10)) AS actual, r_regionkey % 2 = 0 AS verified FROM region")
def verified_files(spark, sf):
    root = scratch_path(spark, "artifacts")
    table(spark, sf, "region").select("r_name", F.col("r_name").alias("value")).write.partitionBy("r_name").text(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"(r_name=[^/]*/[^/]+)$", 1).alias("relative_path"))
    listed = files.withColumn("dataset", F.url_decode(F.regexp_extract("relative_path", "r_name=([^/]*)/", 1)))
    right = F.sha2(F.concat("dataset", F.lit("\n")), 256)
    wanted = listed.join(table(spark, sf, "region"), F.col("dataset") == F.col("r_name")).select("relative_path", F.when(F.col("r_regionkey") % 2 == 0, F.upper(right)).otherwise(F.sha2(F.lit("other"), 256)).alias("sha256"))
    got = R.verified_artifacts(spark, root, wanted)
    return got.select(F.url_decode(F.regexp_extract("relative_path", "r_name=([^/]*)/", 1)).alias("dataset"), "actual", "verified")


@register(
    "file_lines",
    "SELECT sha256(r_name || chr(10) || chr(10) || r_regionkey || chr(10)) AS sha256, CAST(2 AS BIGINT) AS n_lines FROM region",
)
def file_lines(spark, sf):
    path = scratch_path(spark, "files")
    body = F.concat("r_name", F.lit("\n\n"), F.col("r_regionkey").cast("string"))
    rows = [r.value for r in table(spark, sf, "region").select(body.alias("value")).collect()]  # five regions
    for i, v in enumerate(rows):
        K.write_text(spark, f"{path}/{i}", v)
    return K.file_stats(spark, path).select("sha256", "n_lines")


@register(
    "published_splits",
    """SELECT CASE WHEN c_custkey % 5 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT c_mktsegment) AS scenarios FROM customer WHERE c_custkey % 5 <> 1 GROUP BY 1""",
)
def published_splits(spark, sf):
    path, c = scratch_path(spark, "published"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    part = lambda *ks: c.where((F.col("c_custkey") % 5).isin(*ks))
    K.publish({"train": part(2, 3, 4), "dev": part(0), "test": part(1)}, path, "c_mktsegment")
    said = spark.read.text(f"{path}/manifest").select(F.from_json("value", "map<string,struct<rows:bigint,scenarios:bigint,sha256:string>>").alias("m")).select(F.explode("m").alias("split", "m"))
    return said.select("split", F.col("m.rows").alias("n"), F.col("m.scenarios").alias("scenarios"))
