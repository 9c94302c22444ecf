"""Streams that stop and start again: the two-clock loop and windows with labelled late rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Row

from admitflow.streaming import two_clocks as C
from admitflow.streaming.late import LateWindows


class Plain:
    def __init__(self):
        self.slots = {}

    def has(self, name):
        return name in self.slots

    def put(self, name, value):
        self.slots[name] = value

    def hold(self, name):
        assert name in self.slots


def events(n=120):
    rng = random.Random(6)
    return [(f"k{rng.randrange(3)}", i, *rng.choice([("revise", "UPDATE", f"f{rng.randrange(10)}"), ("revise", "HOLD", f"f{rng.randrange(10)}"), ("revise", "IGNORE", None), ("act", None, "verify"), ("act", None, "look")]), str(i)) for i in range(n)]


def folded(rows):
    state, out = {}, []
    for r in rows:
        clocks, belief, ledger = state.setdefault(r[0], (C.Clocks(), Plain(), []))
        refused = C.advance(clocks, belief, ledger, Row(**dict(zip(("key", "seq", "kind", "decision", "name", "value"), r, strict=True))))
        out.append((r[0], r[1], *vars(clocks).values(), ",".join(map(str, ledger)), refused))
    return sorted(out)


def test_budgets_and_clocks():
    c, belief, ledger = C.Clocks(tool_left=2, verification_left=1), Plain(), []
    step = lambda kind, decision=None, name=None, seq=0: C.advance(c, belief, ledger, Row(kind=kind, decision=decision, name=name, value="1", seq=seq))
    assert step("act", name="verify") is None and (c.tool_left, c.verification_left, c.action_k) == (1, 0, 1)
    assert step("act", name="verify") == "budget used up" and (c.tool_left, c.action_k) == (1, 1)
    assert step("act", name="look") is None and step("act", name="look") == "budget used up" and c.action_k == 2
    assert step("revise", "HOLD", "f") == "HOLD patch target does not exist" and (c.revision_t, c.steps_left, c.n_slots) == (1, 7, 0)
    for i in range(8):
        assert step("revise", "UPDATE", f"f{i}") is None
    assert step("revise", "UPDATE", "f8") == "no empty belief slot" and (c.n_slots, c.steps_left) == (8, 0)
    for s in range(6):
        step("revise", "HOLD", "f1", s)
    assert ledger == [2, 3, 4, 5]


def test_a_restarted_loop_goes_on(spark, tmp_path):
    rows, base = events(), f"file://{tmp_path}"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], C.INPUT).coalesce(2).write.mode("append").parquet(f"{base}/in")
        got = C.run(spark, f"{base}/in", f"{base}/out", f"{base}/check")
        assert sorted(map(tuple, got.collect())) == folded(rows[: 40 * k + 40])
    assert sorted(map(tuple, C.run(spark, f"{base}/in", f"{base}/out", f"{base}/check").collect())) == folded(rows)


def test_late_rows_are_labelled_and_kept(spark, tmp_path):
    base, day = f"file://{tmp_path}", datetime(2024, 1, 1)
    at = lambda h, m=0: day + timedelta(hours=h, minutes=m)
    files = [[(at(0, 5), "a", 1.0), (at(2), "a", 2.0)], [(at(0, 7), "a", 3.0), (at(1, 55), "a", 4.0), (at(5), "b", 5.0), (None, "b", 6.0)], [(at(2, 30), "b", 7.0)]]
    schema = "ts timestamp, kind string, value double"
    w = LateWindows(spark, f"{base}/out", ["kind"], "value", "1 hour", "10 minutes")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        w.run(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/check")
        if k == 1:  # a batch that runs again replaces what it wrote
            w.take(spark.createDataFrame(rows, schema), 1)
    got = sorted((r.start, r.kind, r.late, r.n, r.total) for r in w.counts().collect())
    assert got == sorted([(at(0), "a", False, 1, 1.0), (at(2), "a", False, 1, 2.0), (at(0), "a", True, 1, 3.0), (at(1), "a", False, 1, 4.0), (at(5), "b", False, 1, 5.0), (at(2), "b", True, 1, 7.0)])
    assert sorted(r.value for r in w.late_rows().collect()) == [3.0, 7.0]
