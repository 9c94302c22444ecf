"""Sources: JSON lines, JSON documents, manifests, and adapters to the normalised record.

A normalised record has record_id, domain, scenario_type, entity, field_id, old_value, new_value
(JSON scalars as text), source, observed_at, valid_from, goal, source_text, and provenance columns.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitflow.functions.scalars import slug
from admitflow.operators.sequences import ordinal
from admitflow.session import ship
from admitflow.sources import lines
from admitflow.sources.traces import observations

REQUIRED = ("id", "domain", "scenario_type", "entity", "field_id", "old_value", "new_value", "source", "observed_at", "goal", "source_text")
SCENARIO_TYPES = ("information_tool", "transaction", "environment")
ENTITY_KEYS = ("order_id", "reservation_id", "booking_id", "user_id", "phone_number")  # fixed values
BASE_TIME = {"service": 1_700_000_000, "trace": 1_710_000_000, "table": 1_720_000_000, "web": 1_730_000_000}  # fixed values
RECORD = (
    "id string, domain string, scenario_type string, entity string, field_id string, old_value string, new_value string, source string, "
    "observed_at long, valid_from long, goal string, source_text string, aliases array<string>"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema, located: bool = False) -> DataFrame:
    """Splittable scan of JSON lines; blank lines are skipped, anything that does not fit the schema is an error. located: the error names path and line, for one more pass that counts lines."""
    if located:
        return lines.json_lines(spark, path, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_problems(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line (from 1), problem: lines that are not one JSON object, from files of any size."""
    return lines.problems(spark, path)


def read_json_document(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a top-level array, or of the records array of an object; other documents are an error."""
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    rows = F.coalesce(F.try_variant_get(v, "$.records", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    checked = F.when(rows.isNull(), F.raise_error(F.concat(F.lit("neither an array nor records in "), F.col("_metadata.file_path"))).cast("array<variant>")).otherwise(rows)
    return raw.select(F.explode(checked).alias("v")).select(F.from_json(F.to_json("v"), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _with_ordinal(df: DataFrame, base: int, limit: int | None, order: list[str]) -> DataFrame:
    """observed_at and valid_from from the position among emitted rows; the first limit of them."""
    out = ordinal(df, order, "_n")
    if limit is not None:
        out = out.where(F.col("_n") < limit)
    t = (F.lit(base) + F.col("_n")).cast("bigint")
    return out.withColumns({"observed_at": t, "valid_from": t}).drop("_n", *order)


def _files(spark: SparkSession, path, schema) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_row"))


def service_tasks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Tasks with scripted actions: the first action with arguments supplies entity, field and value. Maps keep the document's key order."""
    schema = "id string, user_scenario struct<instructions:struct<domain:string,reason_for_call:string,known_info:string>>, evaluation_criteria struct<actions:array<struct<name:string,arguments:map<string,string>>>>"
    t = _files(spark, path, schema)
    ins = F.col("user_scenario.instructions")
    act = F.get(F.filter("evaluation_criteria.actions", lambda a: F.coalesce(F.size(a["arguments"]), F.lit(0)) > 0), F.lit(0))
    t = t.withColumn("_a", act).where(F.col("_a").isNotNull()).withColumn("_i", ins)
    args, domain = F.col("_a.arguments"), F.coalesce(F.col("_i.domain"), F.lit("tau2"))
    keys = F.map_keys(args)
    field = F.coalesce(F.get(F.array_except(keys, F.array(*map(F.lit, ENTITY_KEYS))), F.lit(0)), F.get(keys, F.lit(0)))
    entity = F.coalesce(*(F.try_element_at(args, F.lit(k)) for k in ENTITY_KEYS), F.concat(domain, F.lit("-task-"), "id"))
    t = t.withColumn("field_id", field)
    text = F.concat_ws(" ", F.nullif("_i.reason_for_call", F.lit("")), F.nullif("_i.known_info", F.lit("")))
    out = t.select(
        F.concat_ws(":", domain, "id", "field_id").alias("record_id"), domain.alias("domain"), F.lit("transaction").alias("scenario_type"), entity.alias("entity"), "field_id",
        F.coalesce(F.try_element_at(args, F.concat(F.lit("old_"), "field_id")), F.lit("unknown")).alias("old_value"), F.try_element_at(args, F.col("field_id")).alias("new_value"),
        F.coalesce("_a.name", F.lit("tau2_environment")).alias("source"), F.coalesce(F.nullif("_i.reason_for_call", F.lit("")), F.lit("complete the service task")).alias("goal"),
        F.coalesce(F.nullif(text, F.lit("")), F.to_json(args)).alias("source_text"), "_path", "_row",
    )
    return _with_ordinal(out, BASE_TIME["service"], limit, ["_path", "_row"])


def tool_traces(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Observations of call trees in pre-order; the tool is the nearest action above. A document is read in one pass by one task, whatever its nodes and levels; ValueError names one that is not JSON."""
    ship(spark)
    flat = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(observations, "path string, at long, action string, observation string")
    v = F.coalesce(F.try_parse_json("observation"), F.to_variant_object(F.struct(F.col("observation").alias("response"))))
    response = F.coalesce(F.try_variant_get(v, "$.response", "variant"), v)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    out = flat.select(
        F.concat(stem, F.lit(":"), F.col("at").cast("string")).alias("record_id"), F.lit("tool_api").alias("domain"), F.lit("information_tool").alias("scenario_type"), F.col("action").alias("entity"),
        F.lit("tool_result").alias("field_id"), F.lit("unknown").alias("old_value"), response.cast("string").alias("new_value"), F.col("action").alias("source"),
        F.concat(F.lit("use "), "action", F.lit(" result")).alias("goal"), F.col("observation").alias("source_text"), F.col("path").alias("_path"), F.col("at").alias("_row"),
    )
    return _with_ordinal(out, BASE_TIME["trace"], limit, ["_path", "_row"])


def table_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions over a table: first column's name, its first cell, and the first label. Rows without columns, rows or labels are skipped."""
    schema = "description string, label array<string>, source string, table struct<table_name:string,table_info:struct<columns:array<struct<name:string,type:string>>,rows:array<array<string>>>>"
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_row"), "value")
    numbered = ordinal(raw, ["_path", "_row"], "_line").where(F.trim("value") != "")
    q = numbered.select("_path", "_row", "_line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("q")).select("_path", "_row", "_line", "q.*")
    info = F.col("table.table_info")
    q = q.where((F.size(info["columns"]) > 0) & (F.size(info["rows"]) > 0) & (F.size("label") > 0))
    line = F.col("_line").cast("string")
    field = F.coalesce(F.nullif(info["columns"][0]["name"], F.lit("")), F.lit("answer"))
    text = F.coalesce("description", F.lit(""))
    out = q.select(
        F.concat(F.lit("dbbench:"), line, F.lit(":"), field).alias("record_id"), F.lit("database").alias("domain"), F.lit("information_tool").alias("scenario_type"),
        F.coalesce(F.nullif("table.table_name", F.lit("")), F.concat(F.lit("table-"), line)).alias("entity"), field.alias("field_id"),
        F.coalesce(F.get(info["rows"][0], F.lit(0)), F.lit("unknown")).alias("old_value"), F.get("label", F.lit(0)).alias("new_value"), F.lit("database_query").alias("source"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit("query the database")).alias("goal"), text.alias("source_text"), "_path", "_row",
    )
    return _with_ordinal(out, BASE_TIME["table"], limit, ["_path", "_row"])


def _first_scalar(value):
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack += list(x.values())[::-1]
        elif isinstance(x, list):
            stack += x[::-1]
        elif x is not None:
            return json.dumps(x) if isinstance(x, bool) else str(x)
    return None


@F.pandas_udf(T.StringType())
def first_scalar(body: pd.Series) -> pd.Series:
    """First scalar of a JSON text, depth first in the document's key order (which VARIANT does not keep)."""
    return body.map(lambda t: None if t is None else _first_scalar(json.loads(t)))


def web_tasks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Web tasks with a reference answer."""
    schema = "task_id string, sites array<string>, intent string, instantiation_dict map<string,string>, eval struct<reference_answers:string>"
    t = _files(spark, path, schema).withColumn("answer", first_scalar("eval.reference_answers")).where("answer is not null")
    site = F.coalesce(F.get("sites", F.lit(0)), F.lit("web"))
    order, intent = F.try_element_at("instantiation_dict", F.lit("order_number")), F.coalesce("intent", F.lit(""))
    out = t.select(
        F.col("task_id").alias("record_id"), site.alias("domain"), F.lit("information_tool").alias("scenario_type"),
        F.coalesce(F.concat(F.lit("order:"), F.nullif(order, F.lit(""))), F.concat(site, F.lit(":"), "task_id")).alias("entity"),
        slug(F.try_element_at("instantiation_dict", F.lit("info")), F.lit("reference_answer")).alias("field_id"), F.lit("unknown").alias("old_value"), F.col("answer").alias("new_value"),
        F.concat(site, F.lit("_website")).alias("source"), F.coalesce(F.nullif(intent, F.lit("")), F.lit("complete the web task")).alias("goal"), intent.alias("source_text"), "_path", "_row",
    )
    return _with_ordinal(out, BASE_TIME["web"], limit, ["_path", "_row"])


def with_provenance(df: DataFrame, dataset: str, version: str, licence: str, uri: str) -> DataFrame:
    """Adds the provenance columns; the digest covers the normalised row in a canonical JSON form (sorted keys)."""
    body = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    return df.withColumns({
        "source_dataset": F.lit(dataset), "source_version": F.lit(version), "license": F.lit(licence),
        "source_uri": F.concat(F.lit(uri + "#"), F.col("record_id")), "source_sha256": F.sha2(body, 256), "transformation": F.lit("identity"), "parent_record_id": F.lit(None).cast("string"),
    })


def confined(root: str, path: str) -> str:
    """root/path, if that stays below root."""
    parts: list[str] = []
    for p in PurePosixPath(path).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"{path} leaves {root}")
            parts.pop()
        elif p == "/":
            raise ValueError(f"{path} is absolute")
        elif p != ".":
            parts.append(p)
    return "/".join([root.rstrip("/"), *parts])


def _text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_manifest(spark: SparkSession, root: str, name: str = "manifest.json") -> DataFrame:
    """Union of the sources that a manifest lists (format jsonl or json), each with provenance. Missing keys, files or records are errors."""
    body = json.loads(_text_of(spark, confined(root, name)))
    entries = body.get("sources") if isinstance(body, dict) else None
    if not isinstance(entries, list) or not entries:
        raise ValueError("manifest needs a non-empty list of sources")
    parts = []
    for i, e in enumerate(entries):
        lacking = [k for k in ("dataset", "version", "license", "path", "format") if not (isinstance(e, dict) and e.get(k))]
        if lacking:
            raise ValueError(f"source {i} lacks {', '.join(lacking)}")
        path = confined(root, e["path"])
        df = read_jsonl(spark, path, RECORD, located=True) if e["format"] == "jsonl" else read_json_document(spark, path, RECORD)
        parts.append(with_provenance(checked_records(df).withColumnRenamed("id", "record_id"), e["dataset"], e["version"], e["license"], path))
    out = reduce(DataFrame.unionByName, parts)
    if out.isEmpty():
        raise ValueError("manifest gives no records")
    return out


def checked_records(df: DataFrame) -> DataFrame:
    """df; a row that lacks a required field (old_value may be null) or has an unknown scenario type is an error."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED if c != "old_value")))
    bad = F.when(F.size(lacking) > 0, F.concat(F.lit("record lacks "), F.array_join(lacking, ","))).when(~F.col("scenario_type").isin(*SCENARIO_TYPES), F.concat(F.lit("scenario type "), F.col("scenario_type")))
    return df.withColumn("id", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("id")))


def artifact_problems(artifacts: DataFrame) -> DataFrame:
    """Rows of an artifact manifest (dataset, version, license, url, relative_path, sha256) with what is wrong: blank texts, digests that are not 64 hex digits."""
    names = ("dataset", "version", "license", "url", "relative_path", "sha256")
    blank: Column = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"blank {c}")) for c in names)))
    digest = F.when(~F.coalesce(F.regexp_like("sha256", F.lit("^[0-9a-fA-F]{64}$")), F.lit(False)), F.array(F.lit("bad digest"))).otherwise(F.array().cast("array<string>"))
    return artifacts.withColumn("problems", F.concat(blank, digest)).where(F.size("problems") > 0)


def verified_artifacts(spark: SparkSession, root: str, artifacts: DataFrame) -> DataFrame:
    """relative_path, expected, actual, verified for each listed artifact, hashing the files on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.ltrim(F.element_at(F.split("path", rf"\Q{base}\E"), -1), F.lit("/"))
    have = files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("actual"))
    return artifacts.select("relative_path", F.lower("sha256").alias("expected")).join(have, "relative_path", "left").withColumn("verified", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))
