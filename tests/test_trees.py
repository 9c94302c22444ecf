"""Trees of any size: documents read with a stack, edges by pointer doubling."""

import json
import random

import pytest

from admitflow.operators import trees
from admitflow.sources import readers
from admitflow.sources.traces import nodes_of


def deep(levels, width=0):
    """A chain of actions, each with leaves, as text (too deep for a recursive writer)."""
    head = "".join('{"observation": "o%d", "children": [%s' % (i, "".join('{"observation": "leaf"}, ' for _ in range(width))) for i in range(levels))
    tail = "".join('], "node_type": "Action", "description": "a%d"}' % i for i in reversed(range(levels)))
    return head + '{"observation": "end", "node_type": "Observation"}' + tail


def test_deep_documents_are_read(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"tree": {"x": [1, {"y": 2}], "tree": ' + deep(3000, 2) + '}, "observation": "outside"}')
    got = readers.tool_traces(spark, f"file://{tmp_path}/t.json").orderBy("observed_at").collect()
    assert len(got) == 3000 * 3 + 1
    assert (got[0].entity, got[0].new_value) == ("a0", "o0") and (got[1].entity, got[1].new_value) == ("a0", "leaf")
    assert (got[-1].entity, got[-1].new_value, got[-1].record_id) == ("a2999", "end", "t:9000")


def test_nodes_agree_with_a_plain_walk():
    rng = random.Random(3)

    def node(depth):
        n = {"observation": rng.choice([None, "x", "é \"q\" \\ ,]}", {"b": [1, 2], "a": None}, 3.5, True])}
        if rng.random() < 0.6:
            n["node_type"] = rng.choice(["Action", "Observation"])
        if rng.random() < 0.5:
            n["description"] = rng.choice(["", "d1", "d2"])
        if depth and rng.random() < 0.8:
            n["children"] = [node(depth - 1) if rng.random() < 0.9 else rng.choice([1, "s", None, [{"observation": "no"}]]) for _ in range(rng.randrange(4))]
        items = list(n.items())
        rng.shuffle(items)
        return dict(items)

    def walk(n, parent, out):
        seen = n.get("observation")
        out.append([parent, n.get("node_type"), n.get("description"), seen if seen is None or isinstance(seen, str) else json.dumps(seen, ensure_ascii=False, separators=(",", ":"))])
        me = len(out) - 1
        for c in n.get("children", []):
            if isinstance(c, dict):
                walk(c, me, out)
        return out

    for _ in range(200):
        t = node(4)
        assert nodes_of(json.dumps(t, indent=rng.choice([None, 1]))) == walk(t, -1, [])
        assert nodes_of(json.dumps({"a": {"children": [1]}, "tree": {"k": 1, "tree": t}, "z": 0})) == walk(t, -1, [])
    assert nodes_of("[1]") == [] and nodes_of('{"children": 5}') == [[-1, None, None, None]]
    for bad in ("{", '{"a" 1}', '{"a": 1} x', '{"children": [{} {}]}', "", '{"a": 1 "b": 2}'):
        with pytest.raises(ValueError):
            nodes_of(bad)


def test_edges_of_many_levels(spark):
    rows = [(0, None, "root", False)] + [(i, i - 1, f"l{i}", i % 7 == 0) for i in range(1, 300)] + [(1000 + i, 5, f"leaf{i}", False) for i in range(400)] + [(5000, 5001, "loop", True), (5001, 5000, "loop", True), (6000, 9999, "orphan", True), (None, 0, "null", True)]
    got = {r.id: r for r in trees.flatten(spark.createDataFrame(rows, "id long, parent long, label string, is_action boolean")).collect()}
    assert set(got) == {*range(300), *range(1000, 1400)}
    assert (got[299].depth, got[299].action, got[299].path) == (299, "l294", "/".join(map(str, range(300))))
    assert (got[1003].depth, got[1003].action, got[1003].path) == (6, "root", "0/1/2/3/4/5/1003") and got[7].action == "l7"
    assert trees.flatten(spark.createDataFrame([], "id long, parent long, label string, is_action boolean")).count() == 0
