"""Sinks: routed and split tables, manifests, file statistics, an answer cache. All go through Spark's writers, so commits are atomic per job."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from admitflow.functions.scalars import export_split
from admitflow.operators.sequences import step_index
from admitflow.session import shuffles_dropped


def route(df: DataFrame, accepted: str, path: str) -> None:
    """One job writes accepted and rejected rows to path/route=accepted and path/route=rejected."""
    df.withColumn("route", F.when(F.col(accepted), "accepted").otherwise("rejected")).write.partitionBy("route").mode("append").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_splits(df: DataFrame, path: str, group: str, ident: str, order: str, seed: int = 42) -> dict:
    """Write rows to path/split=... with step_index within their group; then the manifest. Rows that repeat ident are an error."""
    twice = df.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{ident} {twice[0][0]} is not unique")
    rows = df.withColumn("split", export_split(F.col(group), seed)).withColumn("step_index", step_index([group], [order]))
    rows.write.partitionBy("split").json(path)
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups")).collect()
    manifest = {"seed": seed, "splits": {r["split"]: {"rows": r["rows"], "groups": r["groups"]} for r in sorted(counts, key=lambda r: r["split"])}}
    write_text(df.sparkSession, f"{path}-manifest", json.dumps(manifest, sort_keys=True))
    return manifest


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and non-blank lines of each file below path."""
    digests = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_lines"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return digests.select(name.alias("file"), "sha256").join(lines.select(name.alias("file"), "n_lines"), "file", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def publish(splits: dict[str, DataFrame], path: str, scenario: str) -> dict:
    """Write train and dev (test stays unpublished) and, last, a manifest with counts, scenarios and digests."""
    if not {"train", "dev"} <= set(splits):
        raise ValueError("train and dev are required")
    out: dict = {}
    for name in ("train", "dev"):
        df = splits[name]
        if df.where(F.col(scenario).isNull() | (F.trim(scenario) == "")).limit(1).count():
            raise ValueError(f"blank {scenario} in {name}")
        df.write.mode("overwrite").json(f"{path}/{name}")
        n = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(scenario).alias("scenarios")).first()
        digests = file_stats(df.sparkSession, f"{path}/{name}").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256)).first()[0]
        out[name] = {"rows": n["rows"], "scenarios": n["scenarios"], "sha256": digests}
    write_text(next(iter(splits.values())).sparkSession, f"{path}/manifest", json.dumps(out, sort_keys=True))
    return out


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    """Move a finished folder to its name, which must be free."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    files = a.getFileSystem(conf)
    if files.exists(b):
        raise FileExistsError(new)
    if b.getParent() is not None:
        files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"{old} could not be renamed to {new}")


def _removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def publish_checked(df: DataFrame, path: str, checks: dict[str, tuple[Column, object]], **options: str) -> DataFrame:
    """Write df beside path, with metrics observed in the same pass (name -> (aggregate, wanted value)), and move it there only if all hold.

    Else nothing is left and AssertionError names what failed. A path that exists is an error. Returns what path holds.
    """
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    seen = Observation()
    names = {f"m{i}": name for i, name in enumerate(checks)}
    watched = df.observe(seen, *(checks[name][0].alias(m) for m, name in names.items())) if checks else df
    try:
        with shuffles_dropped(spark):
            watched.write.options(**options).parquet(staged)
        got = seen.get if checks else {}
        wrong = {name: (got[m], checks[name][1]) for m, name in names.items() if got[m] != checks[name][1]}
        if wrong:
            raise AssertionError("; ".join(f"{name} is {have}, not {want}" for name, (have, want) in wrong.items()))
        _renamed(spark, staged, path)
    except BaseException:
        _removed(spark, staged)
        raise
    return spark.read.schema(df.schema).parquet(path)


class AppendLog:
    """An append-only log of rows that are told apart by a digest. A batch has an id and writes its own folder, so a batch that is repeated, after a failure or not, counts once; of rows with one digest the first batch's stays."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        """schema: columns of the rows, digest (string) among them."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def rows(self) -> DataFrame:
        """All rows, with batch."""
        empty = self.spark.createDataFrame([], f"{self.schema}, batch long")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return empty
        return self.spark.read.schema(empty.schema).parquet(self.path)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Rows whose digest no earlier batch has; of several, the least by all columns, so that a repeated batch writes the same."""
        names = [c for c in self.rows().columns if c != "batch"]
        first = rows.select(*names).groupBy("digest").agg(F.min(F.struct(*(c for c in names if c != "digest"))).alias("r")).select("digest", "r.*") if len(names) > 1 else rows.select("digest").distinct()
        fresh = first.join(self.rows().where(F.col("batch") < batch).select("digest"), "digest", "left_anti").select(*names)
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def metric_json(metrics: dict[str, float]) -> str:
    """The same metrics as JSON with sorted keys; JSON has no NaN or infinity, so those are errors."""
    return json.dumps(dict(sorted(metrics.items())), indent=2, sort_keys=True, allow_nan=False) + "\n"


def metric_report(metrics: dict[str, float]) -> str:
    """Sorted Markdown table."""
    return "\n".join(["| metric | value |", "|---|---|", *(f"| {k} | {v:.6g} |" for k, v in sorted(metrics.items()))]) + "\n"


class AnswerCache:
    """Answers keyed by request digest, in an append-only table; of several the first written counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema("digest string, answer string, written long").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "digest string, answer string, written long")

    def split(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(asked with answer where known, asked rows that are not)."""
        first = self._rows().groupBy("digest").agg(F.min_by("answer", "written").alias("answer"))
        return asked.join(first, "digest"), asked.join(first, "digest", "left_anti")

    def add(self, answers: DataFrame, written: int) -> None:
        answers.select("digest", "answer", F.lit(written).cast("long").alias("written")).dropDuplicates(["digest"]).write.mode("append").parquet(self.path)
