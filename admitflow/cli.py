"""Entry points: ``python -m admitflow.cli COMMAND ...``. Each reads and writes Spark tables; results are printed as JSON.

sources    read a manifest of sources into one normalised table
corpus     plan, realise, check and publish a corpus of decision points
export     write rows to train, dev and test by a hash of their group, with a manifest
publish    publish train and dev of an export with counts and digests
validate   count what the input audits find in a table of decision points; exit 1 if anything is wrong
evaluate   decision metrics of a table with truth and prediction
trial      readiness gate: metrics against bounds; exit 1 if one fails
query      run a query of the catalogue over a folder of tables and write its rows
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.config import load_config
from admitflow.operators import corpus, metrics
from admitflow.session import build
from admitflow.sources import readers, sinks


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def sources(spark: SparkSession, a: argparse.Namespace) -> dict:
    root, _, name = a.manifest.rpartition("/")
    df = readers.load_manifest(spark, root, name)
    df.write.parquet(a.out)
    return {"rows": spark.read.parquet(a.out).count()}


def build_corpus(spark: SparkSession, a: argparse.Namespace) -> dict:
    given = {"total": 140, "seed": 42, "batch": 25, "max_attempts": 3} | (load_config(a.config).get("corpus", {}) if a.config else {})
    given |= {k: v for k in ("total", "seed", "batch", "max_attempts", "max_requests", "confirm_full") if (v := getattr(a, k)) is not None}
    done = spark.read.parquet(a.done) if a.done else None
    got = corpus.build(_read(spark, a.pool), a.out, done=done, **given)
    rows = corpus.report(got.accepted, got.rejected, got.requests).collect()
    return {"resumed": got.resumed, "report": {f"{r.metric} {r.key}".strip(): r.n for r in sorted(rows)}}


def export(spark: SparkSession, a: argparse.Namespace) -> dict:
    return sinks.export_splits(_read(spark, a.rows), a.out, a.group, a.ident, a.order, a.seed)


def publish(spark: SparkSession, a: argparse.Namespace) -> dict:
    return sinks.publish({s: spark.read.json(f"{a.splits}/split={s}") for s in ("train", "dev")}, a.out, a.group)


def validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    df = _read(spark, a.rows)
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("record_id").alias("ids"), F.count_if(F.col("group_id").isNull() | (F.trim("group_id") == "")).alias("blank_groups"), F.count_if(~F.coalesce(F.col("decision").isin(*metrics.DECISIONS), F.lit(False))).alias("unknown_decisions"))
    r = one.first().asDict()
    groups = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "HOLD").alias("holds"))
    r["repeated_ids"] = r["rows"] - r.pop("ids")
    r["unresolved_holds"] = groups.where("holds > 0 and n <> 2").count()
    return r | {"ok": not any(v for k, v in r.items() if k != "rows")}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    return metrics.decision_metrics(_read(spark, a.rows), a.truth, a.predicted).first().asDict(recursive=True)


def trial(spark: SparkSession, a: argparse.Namespace) -> dict:
    got = metrics.threshold_gate(_read(spark, a.metrics), _read(spark, a.bounds)).collect()
    return {"ok": all(r.passed for r in got), "failed": sorted(r.metric for r in got if not r.passed)}


def query(spark: SparkSession, a: argparse.Namespace) -> dict:
    from admitflow.plans import catalogue

    known = catalogue.queries()
    if a.name not in known:
        raise SystemExit(f"no query {a.name}; there are {', '.join(sorted(known))}")
    known[a.name](spark, a.tables).write.parquet(a.out)
    return {"rows": spark.read.parquet(a.out).count()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="admitflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--master", help="Spark master, if the session has none of its own")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *needed, **optional):
        c = sub.add_parser(name)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        for n, kind in optional.items():
            c.add_argument(f"--{n.replace('_', '-')}", **({"type": kind} if isinstance(kind, type) else {"default": kind, "type": type(kind)}))
        c.set_defaults(run=run)

    add("sources", sources, "manifest", "out")
    add("corpus", build_corpus, "pool", "out", config=str, done=str, total=int, seed=int, batch=int, max_attempts=int, max_requests=int, confirm_full=int)
    add("export", export, "rows", "out", group="group_id", ident="record_id", order="sequence", seed=42)
    add("publish", publish, "splits", "out", group="group_id")
    add("validate", validate, "rows")
    add("evaluate", evaluate, "rows", truth="truth", predicted="predicted")
    add("trial", trial, "metrics", "bounds")
    add("query", query, "name", "tables", "out")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    out = a.run(spark or build("admitflow", a.master), a)
    print(json.dumps(out, sort_keys=True, default=str))
    return 0 if out.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())
