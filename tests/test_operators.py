import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitflow.functions import python_udfs as P
from admitflow.functions import scalars as S
from admitflow.operators import joins as J
from admitflow.operators import labelling as L
from admitflow.operators import metrics as M
from admitflow.operators import sequences as Q
from admitflow.streaming import keyed


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_metric_vectors(spark):
    df = spark.createDataFrame(list(zip("UHIU", "UUIH")), "t string, p string")
    r = M.decision_metrics(df, "t", "p", classes=("U", "H", "I"), positive="U").first()
    assert (r.n, r.accuracy, r.false_update_rate, r.missed_update_rate) == (4, 0.5, 0.5, 0.5)
    empty = M.decision_metrics(df.limit(0), "t", "p").first()
    assert (empty.accuracy, empty.macro_f1) == (0.0, 0.0)
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, S.set_f1(arr("a", "b"), arr("a", "c")), S.set_f1(arr(), arr())) == (0.5, 1.0)
    t = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, True), (2, 2, False), (3, 1, True)], "task int, trial int, ok boolean")
    assert tuple(M.all_first_k(t, "task", "trial", "ok", 2).first()) == (2, 0.5)
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate((0, 1, 1, 0))] + [("b", 0, 5), ("c", 0, 0), ("d", 0, 1), ("d", 1, 1)], "k string, i int, x int")
    assert {r.k: float(r.area) for r in Q.contamination_area(s, "k", "i", "x").collect()} == {"a": 2.0, "b": 5.0, "c": 0.0, "d": 1.0}
    assert {r.k: r.latency for r in Q.recovery_latency(s, "k", "i", "x").collect()} == {"a": 2, "b": 1, "c": 0, "d": 2}


def test_policy_mathematics(spark):
    d = lambda x: F.lit(float(x))
    up, down, held, free = one(spark, S.clipped_ratio(d(1), d(0), 0.2), S.clipped_ratio(d(-1), d(0), 0.2), S.gradient_coefficient(d(1), d(0), d(2), 0.2), S.gradient_coefficient(d(1), d(0), d(-2), 0.2))
    assert (up, down, held) == (1.2, 0.8, 0.0) and math.isclose(free, -2 * math.e)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "g string, x double")
    got = sorted((r.g, round(r.advantage, 4)) for r in M.group_advantages(df, "g", "x").collect())
    assert got == [("a", -1.0), ("a", 1.0), ("b", 0.0)]
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, x)) for x in rng.normal(size=(50, 3))]
    df = spark.createDataFrame(rows, "n double, o double, a double")
    loss, kl = df.agg(M.surrogate_loss(F.col("n"), F.col("o"), F.col("a"), 0.2), M.sampled_kl(F.col("n"), F.col("o"))).first()
    n, o, a = np.array(rows).T
    r = np.exp(np.clip(n - o, -20, 20))
    assert math.isclose(loss, -np.mean(np.minimum(r * a, np.clip(r, 0.8, 1.2) * a)), rel_tol=1e-9)
    assert math.isclose(kl, np.mean(np.exp(np.clip(o - n, -20, 20)) - (o - n) - 1), rel_tol=1e-9)


@pytest.mark.parametrize("initial", [0.0, 0.7])
def test_projected_multipliers_are_the_recursion(spark, initial):
    steps = [0.3, -0.9, 0.2, 0.4, -0.1, -2.0, 0.05]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(steps)], "g int, i int, x double")
    got = [r.multiplier for r in Q.projected_multipliers(df, ["i"], F.col("x"), initial, ["g"]).orderBy("i").collect()]
    want, m = [], initial
    for x in steps:
        m = max(0.0, m + x)
        want.append(m)
    assert np.allclose(got, want)


def test_scalars(spark):
    assert one(spark, S.slug(F.lit("  Order  Status! "), F.lit("f")), S.slug(F.lit("--"), F.lit("f")), S.slug(F.lit(None).cast("string"), F.lit("f"))) == ("order_status", "f", "f")
    assert one(spark, *(S.unknown_value(F.lit(x)) for x in (" N/A", "none", "x", "")), S.unknown_value(F.lit(None).cast("string"))) == (True, True, False, True, True)
    assert one(spark, *(S.label_leak(F.lit(x)) for x in ("Decision = hold", "decision: ab", "REASON_CODE:abcd", "relevant:", "all fine"))) == (True, False, True, True, False)
    assert one(spark, *(S.warm_cosine(F.lit(i), 10, 0.25) for i in (0, 1, 9))) == pytest.approx((0.5, 1.0, 0.0), abs=1e-12)
    assert one(spark, S.base_task_key(F.lit("D"), F.lit("d:7:f"), F.lit(None).cast("string"), F.lit("f")), S.base_task_key(F.lit("D"), F.lit(None).cast("string"), F.lit("p"), F.lit("f"))) == ("d:7", "D:p")
    p = one(spark, S.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))[0]
    assert p == [0.5, 0.5]
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42:g1").digest()[:8], "big") % 10000
    assert one(spark, S.hash_bucket(F.lit("g1"), 42, 10000)) == (want,)


def test_quotas(spark):
    count = lambda df, *k: {tuple(r[x] for x in k): r["n"] for r in df.groupBy(*k).agg(F.sum("count").alias("n")).collect()}
    assert count(L.quota_cells(spark), "decision") == {("UPDATE",): 56, ("IGNORE",): 49, ("HOLD",): 35}
    assert count(L.quota_cells(spark), "action")[("VERIFY",)] == 21
    assert count(L.quota_cells(spark, "full"), "decision") == {("UPDATE",): 4200, ("IGNORE",): 900, ("HOLD",): 900}
    assert L.quota_units(spark, 30).count() == 30 and L.source_targets(140) == [70, 35, 21, 14]
    for bad in (0, 141):
        with pytest.raises(ValueError):
            L.quota_units(spark, bad)
    pool = spark.createDataFrame([(m, i) for m in L.MACRO_SHARE for i in range(4)], "macro string, id int")
    rows = L.schedule(pool, 20, "id").collect()
    assert sorted((d, sum(r.decision == d for r in rows)) for d in ("UPDATE", "HOLD", "IGNORE")) == [("HOLD", 1), ("IGNORE", 1), ("UPDATE", 18)]
    rows = L.schedule(pool, 200, "id").collect()
    assert [sum(r.decision == d for r in rows) for d in ("UPDATE", "HOLD", "IGNORE")] == [140, 30, 30] and sum(r.successor_of is not None for r in rows) == 30
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "n string, w int")
    assert {r.n: r.allocated for r in Q.apportion(a, "w", 10, [F.desc("w"), F.desc("n")]).collect()} == {"x": 3, "y": 3, "z": 4}


def test_partner_picks(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("b", 1, 5)], "g string, e int, id int")
    got = {r.id: r.other_id for r in J.pick_other(df, ["g"], F.col("e"), "id", F.col("id")).collect()}
    assert got == {1: 4, 2: 3, 3: 1, 4: 2}
    donors = {r.id: (r.level, r.donor) for r in J.fallback_donor(df.withColumn("v", F.col("e")), [["g"], []], "v", "id", F.lit(0)).collect()}
    assert donors[5][0] == 1 and donors[1] == (0, 3)
    r = {x.k: (x.n_left, x.n_right, x.state) for x in J.reconcile(spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int"), "k").collect()}
    assert r == {1: (2, 0, "missing"), 2: (1, 1, "matched"), 3: (0, 1, "extra")}


def test_first_valid_wins_and_ordinal(spark):
    df = spark.createDataFrame([(1, "x", False), (2, "x", True), (3, "x", True), (4, "x", False), (5, "y", True)], "i int, t string, ok boolean")
    assert {r.i: r.duplicate for r in Q.first_valid_wins(df, "t", "ok", "i").collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}
    o = Q.ordinal(spark.range(1000).repartition(7), ["id"], buckets=5).collect()
    assert all(r.id == r.ordinal for r in o)


GOOD = '{"decision":"UPDATE","affected_fields":["f"],"patches":[{"op":"SET_VALUE","field_id":"f","value":1}],"verification":null}'


def test_strict_parser():
    assert P.parse_action(GOOD)["n_patches"] == 1
    for bad in (None, "", GOOD + " x", GOOD.replace("1}", "NaN}"), GOOD.replace('"verification"', '"decision":"HOLD","verification"'), "[]", "{}", GOOD.replace("null", '{"tool":"t"}'), GOOD.replace('"f"],', '"f","f"],'), GOOD.replace("UPDATE", "MAYBE")):
        with pytest.raises(ValueError):
            P.parse_action(bad)
    assert P.grounding_terms('{"a": ["x", {"b": "y"}], "c": "x"}') == ["x", "y"]
    assert P.grounding_terms("the " * 40 + "'blue key' and 'status'") == ["blue key"]
    v = P.hashed_features("a b a", 16)
    assert math.isclose(sum(x * x for x in v), 1.0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 5, "error" if i % 4 == 0 else ("view", "click")[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    for k in range(4):
        df.where(f"event_id >= {50 * k} and event_id < {50 * k + 50}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/e")
    got = {r.user_id: (r.n_revisions, r.n_actions, r.left, r.belief) for r in keyed.run_available(spark, f"file://{tmp_path}/e", df.schema).collect()}
    want = {r.user_id: (r.n_revisions, r.n_actions, r.left, r.belief) for r in keyed.fold_batch(df).collect()}
    assert got == want


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "i int, x double")
    low, high = M.bootstrap_interval(df, "x", 200, 0.95, 3).first()
    a, b = M.exact_bootstrap([i % 2 for i in range(400)], 3, 500, 0.95)
    assert low < 0.5 < high and abs(low - a) < 0.03 and abs(high - b) < 0.03


def test_bootstrap_mean_interval(spark):
    rows = [(i, float(i % 4)) for i in range(400)] + [(900, None)]
    df = spark.createDataFrame(rows, "i int, x double")
    got = M.bootstrap_mean_interval(df, "x", 3).first()
    assert got.asDict().keys() == {"mean", "low", "high"} and got.mean == 1.5
    assert (got.low, got.high) == tuple(M.bootstrap_interval(df.where("x is not null"), "x", 2000, 0.95, 3).first())
    a, b = M.exact_bootstrap([v for _, v in rows if v is not None], 3, 2000, 0.95)
    assert abs(got.low - a) < 0.02 and abs(got.high - b) < 0.02
    assert tuple(M.bootstrap_mean_interval(df.limit(0), "x", 3).first()) == (None, None, None)


def test_schedule_prefix(spark):
    plan = spark.createDataFrame([(i, f"r{i * 7 % 20}") for i in range(20)], "pos long, rid string")
    stored = lambda ids: spark.createDataFrame(list(enumerate(ids)), "line long, rid string")
    rest = lambda ids: [r.rid for r in Q.schedule_remaining(plan, stored(ids), "rid", ["pos"], ["line"]).orderBy("pos").collect()]
    ids = [f"r{i * 7 % 20}" for i in range(20)]
    assert rest(ids[:6]) == ids[6:] and rest([]) == ids and rest(ids) == []
    for bad in (ids[:5] + ["x"], [ids[1], ids[0]], ids[1:4], [ids[0], None], ids + [None]):
        with pytest.raises(ValueError):
            rest(bad)


def test_threshold_gate(spark):
    m = spark.createDataFrame([("a", 0.5)], "metric string, value double")
    rules = spark.createDataFrame([("a", "min", 0.5), ("a", "min_exclusive", 0.5), ("a", "max", 0.4), ("b", "min", 0.0)], "metric string, op string, bound double")
    assert sorted((r.metric, r.op, r.passed) for r in M.threshold_gate(m, rules).collect()) == [("a", "max", False), ("a", "min", True), ("a", "min_exclusive", False), ("b", "min", False)]
    with pytest.raises(Exception, match="unknown operator"):
        M.threshold_gate(m, rules.limit(1).withColumn("op", F.lit("odd"))).collect()


def test_bootstrap_of_repeated_rows(spark):
    """Equal rows are resampled one by one: the interval agrees with that of index draws."""
    df = spark.createDataFrame([(float(i % 2),) for i in range(400)], "x double").repartition(3)
    low, high = M.bootstrap_interval(df, "x", 400, 0.95, 3).first()
    a, b = M.exact_bootstrap([i % 2 for i in range(400)], 3, 400, 0.95)
    assert abs(low - a) < 0.02 and abs(high - b) < 0.02


def test_splits_are_never_empty():
    from admitflow.operators import sequences

    for n in range(3, 60):
        a, b = sequences.group_cuts(n, 0.8, 0.1)
        assert 0 < a < b < n
    assert sequences.group_cuts(19, 0.8, 0.1) == (15, 16)
    for bad in ((2, 0.8, 0.1), (9, 0.9, 0.1), (9, 0.0, 0.1), (9, 0.5, -0.1)):
        with pytest.raises(ValueError):
            sequences.group_cuts(*bad)


def test_metric_json():
    import json

    from admitflow.sources import sinks

    assert json.loads(sinks.metric_json({"b": 1.5, "a": 0.0})) == {"a": 0.0, "b": 1.5}
    assert sinks.metric_json({"b": 1, "a": 0}).index('"a"') < sinks.metric_json({"b": 1, "a": 0}).index('"b"')
    with pytest.raises(ValueError):
        sinks.metric_json({"a": float("nan")})
