import json

import pytest

from admitflow.config import deep_merge, load_config
from admitflow.sources import readers as R
from admitflow.sources import sinks as W


def put(path, body):
    path.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")
    return f"file://{path}"


def record(i, **kw):
    return {"id": f"r{i}", "domain": "retail", "scenario_type": "transaction", "entity": f"e{i}", "field_id": "f", "old_value": None, "new_value": "x", "source": "s", "observed_at": 5, "goal": "g", "source_text": "t", **kw}


def test_service_tasks(spark, tmp_path):
    tasks = [
        {"id": "1", "user_scenario": {"instructions": {"domain": "retail", "reason_for_call": "change size", "known_info": "you are Ann"}}, "evaluation_criteria": {"actions": [{"name": "noop", "arguments": {}}, {"name": "modify", "arguments": {"zeta": "L", "order_id": "#W1", "alpha": "q", "old_zeta": "M"}}]}},
        {"id": "2", "user_scenario": {"instructions": {"domain": "airline"}}, "evaluation_criteria": {"actions": []}},
        {"id": "3", "user_scenario": {"instructions": {"domain": "airline"}}, "evaluation_criteria": {"actions": [{"name": "book", "arguments": {"cabin": "eco"}}]}},
    ]
    got = sorted(R.service_tasks(spark, put(tmp_path / "t.json", tasks)).collect(), key=lambda r: r.observed_at)
    assert [(r.record_id, r.entity, r.field_id, r.old_value, r.new_value, r.source, r.observed_at) for r in got] == [
        ("retail:1:zeta", "#W1", "zeta", "M", "L", "modify", 1_700_000_000),
        ("airline:3:cabin", "airline-task-3", "cabin", "unknown", "eco", "book", 1_700_000_001),
    ]
    assert got[0].source_text == "change size you are Ann" and got[1].goal == "complete the service task"
    assert R.service_tasks(spark, f"file://{tmp_path}/t.json", limit=1).count() == 1


def test_tool_traces(spark, tmp_path):
    tree = {"tree": {"tree": {"node_type": "Root", "observation": " ", "children": [
        {"node_type": "Action", "description": "search", "children": [{"node_type": "Input", "observation": '{"response": {"b": 1, "a": "é"}}', "children": []}]},
        {"node_type": "Input", "observation": "plain text", "children": []},
    ]}}}
    got = sorted(R.tool_traces(spark, put(tmp_path / "trace.json", tree)).collect(), key=lambda r: r.observed_at)
    assert [(r.record_id, r.entity, r.new_value) for r in got] == [("trace:0", "search", '{"a":"é","b":1}'), ("trace:1", "tool_api", "plain text")]


def test_table_questions_and_web_tasks(spark, tmp_path):
    lines = [
        {"description": "how many", "label": ["7"], "table": {"table_name": "T", "table_info": {"columns": [{"name": "n", "type": "INT"}], "rows": [["3"]]}}},
        {"description": "none", "label": [], "table": {"table_info": {"columns": [], "rows": []}}},
        {"description": "", "label": ["z"], "table": {"table_info": {"columns": [{"name": "m"}], "rows": [[]]}}},
    ]
    got = sorted(R.table_questions(spark, put(tmp_path / "q.jsonl", "\n".join(map(json.dumps, lines)))).collect(), key=lambda r: r.observed_at)
    assert [(r.record_id, r.entity, r.old_value, r.new_value) for r in got] == [("dbbench:0:n", "T", "3", "7"), ("dbbench:2:m", "table-2", "unknown", "z")]
    tasks = [
        {"task_id": 1, "sites": ["shop"], "intent": "status", "instantiation_dict": {"order_number": "170", "info": "Order  Status!"}, "eval": {"reference_answers": {"z": None, "y": [None, {"b": "done"}], "a": "late"}}},
        {"task_id": 2, "sites": ["shop"], "intent": "", "eval": {"reference_answers": {}}},
        {"task_id": 3, "sites": [], "intent": "", "eval": {"reference_answers": {"exact_match": "x"}}},
    ]
    got = sorted(R.web_tasks(spark, put(tmp_path / "w.json", tasks)).collect(), key=lambda r: r.observed_at)
    assert [(r.record_id, r.entity, r.field_id, r.new_value, r.source) for r in got] == [("1", "order:170", "order_status", "done", "shop_website"), ("3", "web:3", "reference_answer", "x", "web_website")]


def test_manifest_and_problems(spark, tmp_path):
    put(tmp_path / "a.jsonl", "\n".join(json.dumps(record(i)) for i in range(3)) + "\n\n")
    put(tmp_path / "b.json", {"records": [record(9)]})
    entry = {"dataset": "d", "version": "1", "license": "MIT", "path": "a.jsonl", "format": "jsonl"}
    put(tmp_path / "manifest.json", {"sources": [entry, {**entry, "path": "b.json", "format": "json"}]})
    got = R.load_manifest(spark, f"file://{tmp_path}").collect()
    assert sorted(r.record_id for r in got) == ["r0", "r1", "r2", "r9"] and all(len(r.source_sha256) == 64 for r in got)
    for bad in ({"sources": []}, {"sources": [{**entry, "license": ""}]}, {"sources": [{**entry, "path": "../x"}]}):
        put(tmp_path / "bad.json", bad)
        with pytest.raises(ValueError):
            R.load_manifest(spark, f"file://{tmp_path}", "bad.json")
    path = put(tmp_path / "c.jsonl", '{"a": 1}\n\nnot json\n[1]\n')
    assert [(r.line, r.problem) for r in R.jsonl_problems(spark, path).orderBy("line").collect()] == [(3, "not JSON"), (4, "not an object")]
    with pytest.raises(Exception, match="record lacks goal"):
        R.checked_records(spark.createDataFrame([tuple(record(1, goal=None).values()) + (None, None)], R.RECORD.replace("valid_from long, goal string, source_text string, aliases array<string>", "goal string, source_text string, valid_from long, aliases array<string>"))).collect()


def test_artifacts(spark, tmp_path):
    import hashlib

    put(tmp_path / "f.txt", "abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    schema = "dataset string, version string, license string, url string, relative_path string, sha256 string"
    a = spark.createDataFrame([("d", "1", "MIT", "u", "f.txt", digest.upper()), ("d", "1", "", "u", "g.txt", "zz")], schema)
    assert [(r.relative_path, len(r.problems)) for r in R.artifact_problems(a).collect()] == [("g.txt", 2)]
    assert {r.relative_path: r.verified for r in R.verified_artifacts(spark, f"file://{tmp_path}", a).collect()} == {"f.txt": True, "g.txt": False}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", f"g{i // 2}", i, i % 3 > 0) for i in range(40)], "record_id string, group_id string, at long, ok boolean")
    at = f"file://{tmp_path}"
    W.route(df, "ok", f"{at}/routed")
    assert {r.route: r["count"] for r in spark.read.json(f"{at}/routed").groupBy("route").count().collect()} == {"accepted": 26, "rejected": 14}
    m = W.export_splits(df, f"{at}/splits", "group_id", "record_id", "at")
    back = spark.read.json(f"{at}/splits")
    assert sum(s["rows"] for s in m["splits"].values()) == 40 and back.groupBy("group_id").agg({"split": "approx_count_distinct"}).where("`approx_count_distinct(split)` > 1").count() == 0
    with pytest.raises(ValueError):
        W.export_splits(df.union(df.limit(1)), f"{at}/again", "group_id", "record_id", "at")
    p = W.publish({"train": df, "dev": df.limit(3)}, f"{at}/pub", "group_id")
    assert p["train"]["rows"] == 40 and p["dev"]["rows"] == 3
    cache = W.AnswerCache(spark, f"{at}/cache")
    asked = spark.createDataFrame([("a",), ("b",)], "digest string")
    assert cache.split(asked)[1].count() == 2
    cache.add(spark.createDataFrame([("a", "1")], "digest string, answer string"), 1)
    cache.add(spark.createDataFrame([("a", "2")], "digest string, answer string"), 2)
    hit, miss = cache.split(asked)
    assert [(r.digest, r.answer) for r in hit.collect()] == [("a", "1")] and [r.digest for r in miss.collect()] == ["b"]
    assert W.metric_report({"b": 1.0, "a": 0.5}).splitlines()[2] == "| a | 0.5 |"


def test_config(tmp_path):
    put(tmp_path / "base.json", {"a": {"x": 1, "y": [1]}, "b": 2})
    put(tmp_path / "own.json", {"base": "base.json", "a": {"y": [2]}, "c": 3})
    assert load_config(tmp_path / "own.json") == {"a": {"x": 1, "y": [2]}, "b": 2, "c": 3}
    assert deep_merge({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}
    assert R.confined("/r", "a/./b/../c") == "/r/a/c"
    with pytest.raises(ValueError):
        R.confined("/r", "a/../../c")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from admitflow.sources import lines

    body = [f'{{"i": {i}, "t": "{"x" * (i % 37)}"}}' for i in range(400)]
    body[7], body[250] = "", "  "
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(body).encode())
    (tmp_path / "b.jsonl").write_text("\n".join(body) + "\n")
    path, key = f"file://{tmp_path}/*.jsonl", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    try:
        got = lines.numbered(spark, path)
        assert got.rdd.getNumPartitions() > 1
        rows = sorted((r.path[-7], r.line, r.body) for r in got.collect())
        assert rows == sorted((f, i + 1, b) for f in "ab" for i, b in enumerate(body))
        assert R.read_jsonl(spark, path, "i int, t string", located=True).count() == 796
        assert R.jsonl_problems(spark, path).count() == 0
        body[300], body[100] = "[1]", '{"i": "no"'
        (tmp_path / "b.jsonl").write_text("\n".join(body) + "\n")
        assert sorted((r.path[-7], r.line, r.problem) for r in R.jsonl_problems(spark, path).collect()) == [("b", 101, "not JSON"), ("b", 301, "not an object")]
        body[100] = body[101]
        (tmp_path / "b.jsonl").write_text("\n".join(body) + "\n")
        with pytest.raises(Exception, match=r"b\.jsonl:301: not an object"):
            R.read_jsonl(spark, path, "i int, t string", located=True).collect()
    finally:
        spark.conf.set(key, before)
