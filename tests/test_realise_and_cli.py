"""Batched requests with a cache, and the entry points."""

import json

import pytest
from pyspark.sql import functions as F

from admitflow import cli
from admitflow.operators import realise as R
from admitflow.sources.sinks import AppendLog


def records(spark, n):
    return spark.createDataFrame([(f"r{i:03d}", f"say {i}") for i in range(n)], "record_id string, prompt string").repartition(4)


def test_each_request_is_answered_once(spark, tmp_path):
    calls = f"{tmp_path}/calls"

    def counted(asked):
        with open(calls, "a") as f:
            f.write("x")
        return R.echo(asked)

    def sent():
        with open(calls) as f:
            return len(f.read())

    log = AppendLog(spark, f"file://{tmp_path}/log", R.LOG)
    run = lambda n, k, **o: {r.record_id: (r.observation_text, r.cached) for r in R.realise(records(spark, n), log, k, 5, generate=counted, **o).collect()}
    assert run(12, 0) == {f"r{i:03d}": (f"say {i}", False) for i in range(12)} and sent() == 3
    assert run(12, 0) == {f"r{i:03d}": (f"say {i}", False) for i in range(12)} and sent() == 3
    got = run(17, 1)
    assert sent() == 5 and got["r000"] == ("say 0", True) and got["r016"] == ("say 16", False)
    run(17, 2, prompt_version="v2")
    assert sent() == 9 and run(0, 3) == {} and log.rows().count() == 9
    assert log.rows().agg(F.sum("prompt_tokens")).first()[0] == 2 * (12 + 7 + 17)


def test_incomplete_answers_are_errors(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log", R.LOG)
    with pytest.raises(ValueError, match="each record once"):
        R.realise(records(spark, 4), log, 0, 2, generate=lambda asked: R.echo(asked[:1]))


def call(spark, capsys, *argv):
    code = cli.main(list(argv), spark)
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_entry_points(spark, tmp_path, capsys):
    base = f"file://{tmp_path}"
    rows = [(m, "set", f"{i}", f"e{i}", "status", f"v{i}", 1000 + i, 990, "track") for m in ("commerce", "service", "workflow") for i in range(9)]
    spark.createDataFrame(rows, "macro string, dataset string, record_id string, entity string, field_id string, value string, observed_at long, valid_from long, goal string").write.parquet(f"{base}/pool")
    code, out = call(spark, capsys, "corpus", "--pool", f"{base}/pool", "--out", f"{base}/corpus", "--total", "40")
    assert code == 0 and out["report"]["accepted"] == 40 and out["report"]["decision HOLD"] == 6
    with pytest.raises(ValueError, match="confirm_full"):
        cli.main(["corpus", "--pool", f"{base}/pool", "--out", f"{base}/full", "--total", "6000"], spark)
    code, out = call(spark, capsys, "validate", "--rows", f"{base}/corpus")
    assert (code, out["ok"], out["rows"], out["unresolved_holds"]) == (0, True, 40, 0)
    spark.read.parquet(f"{base}/corpus").where("parent_id is null").write.parquet(f"{base}/broken")
    code, out = call(spark, capsys, "validate", "--rows", f"{base}/broken")
    assert code == 1 and out["unresolved_holds"] == 6
    code, out = call(spark, capsys, "export", "--rows", f"{base}/corpus", "--out", f"{base}/splits")
    assert code == 0 and sum(s["rows"] for s in out["splits"].values()) == 40
    spark.createDataFrame([("UPDATE", "UPDATE"), ("HOLD", "UPDATE")], "truth string, predicted string").write.parquet(f"{base}/said")
    assert call(spark, capsys, "evaluate", "--rows", f"{base}/said")[0] == 0
    spark.createDataFrame([("a", 0.5)], "metric string, value double").write.parquet(f"{base}/m")
    spark.createDataFrame([("a", "min", 0.6)], "metric string, op string, bound double").write.parquet(f"{base}/b")
    assert call(spark, capsys, "trial", "--metrics", f"{base}/m", "--bounds", f"{base}/b") == (1, {"failed": ["a"], "ok": False})
    assert call(spark, capsys, "query", "--name", "decision_metrics", "--tables", "/root/testdata/sf0.001", "--out", f"{base}/q")[0] == 0
