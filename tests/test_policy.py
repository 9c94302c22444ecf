import numpy as np
from pyspark.sql import functions as F

from admitflow.functions import scalars as S
from admitflow.operators import policy as P


def examples(n=80):
    out = []
    for i in range(n):
        x = np.array(P.hashed_features(("good official" if i % 3 == 0 else "weak message" if i % 3 == 1 else "other stale") + f" w{i % 5}", 64))
        out.append((x, i % 3, i % 2 if i % 3 < 2 else -1, 1 if i % 3 == 1 else -1, 2))
    return out


def test_supervised_learning():
    heads, rows = P.Heads(64), examples()
    losses = P.train_supervised(heads, rows, epochs=30)
    assert losses[-1] < losses[0] and P.evaluate_supervised(heads, rows)["accuracy"] > 0.9
    again = P.Heads.load(heads.save())
    assert (again.decision == heads.decision).all() and again.max_slots == 8
    _, f, v = heads.probabilities(rows[0][0], 2, False)
    assert f[2:8].max() == 0 and v[1] == 0


def test_scoring(spark):
    heads = P.Heads(64)
    P.train_supervised(heads, examples(), epochs=20)
    df = spark.createDataFrame([(1, "good official w1"), (2, "weak message w2"), (3, None)], "id long, text string")
    got = {r.id: r for r in P.score_rows(df, heads, "text", "id").collect()}
    assert got[1].decision == "UPDATE" and got[2].decision == "HOLD" and abs(got[3].p_update - 1 / 3) < 1e-9


def test_answers_and_plans(spark):
    fence = '```json\n{"records": [{"record_id": "b", "observation_text": "x"}, {"record_id": "a", "observation_text": "y"}]}\n```'
    df = spark.createDataFrame([(fence, ["a", "b"]), ('[{"record_id": "a"}]', ["a", "b"]), ("nonsense", ["a"])], "t string, asked array<string>")
    got = df.select(S.answers_of(F.col("t")).alias("a"), "asked").select(S.answers_complete(F.col("a"), F.col("asked")).alias("ok"), F.size("a").alias("n")).collect()
    assert [r.ok for r in got] == [True, False, False] and got[0].n == 2
    arr = lambda *x: F.array(*map(F.lit, x))
    plan = S.label_plan(arr("a", "b"), F.lit("c"), arr("c"), F.lit("UPDATE"), 4)
    r = spark.range(1).select(*(v.alias(k) for k, v in plan.items())).first()
    assert (r.registry, r.affected, r.slot_mask, r.verify_label) == (["a", "b", "c"], [0, 0, 1, 0], [1, 1, 1, 0], -100)
    r = spark.range(1).select(*(S.drawn_index(arr(0.2, 0.5, 0.3), F.lit(u)).alias(f"u{i}") for i, u in enumerate((0.0, 0.2, 0.69, 0.99)))).first()
    assert tuple(r) == (0, 1, 1, 2)
    recs = F.array(F.struct(F.lit("b").alias("record_id")), F.struct(F.lit("a").alias("record_id")))
    a, b = spark.range(1).select(S.request_digest(F.lit("v"), F.lit("m"), recs), S.request_digest(F.lit("v"), F.lit("m"), F.reverse(recs))).first()
    assert a == b


def training_rows(spark, dims=64):
    rows = [(x.tolist(), n, i % 4 != 0, d, f if f < n else -1, v if i % 4 else -1, 1.0 + i % 2) for i, (x, d, f, v, n) in enumerate(examples())]
    return spark.createDataFrame(rows, P.TRAINING).repartition(5), rows


def test_distributed_training_learns(spark):
    df, _ = training_rows(spark)
    heads = P.Heads(64)
    losses = P.fit_supervised(df, heads, epochs=12)
    assert losses[-1] < losses[0] / 2 and P.evaluate_supervised(heads, examples())["accuracy"] > 0.9
    assert P.gradient(df.limit(0), heads)[0] == 0


def test_gradients_are_those_of_single_rows(spark):
    df, rows = training_rows(spark)
    rng = np.random.default_rng(2)
    heads = P.Heads(64, 8, rng.normal(size=(3, 64)), rng.normal(size=(9, 64)), rng.normal(size=(2, 64)))
    n, loss, grads = P.gradient(df, heads)
    want, total = [np.zeros_like(g) for g in grads], 0.0
    for x, slots, can, d, f, v, w in rows:
        x = np.array(x)
        for g, p, k in zip(want, heads.probabilities(x, slots, can), (d, f, v), strict=True):
            if k >= 0:
                total -= w * np.log(p[k] + 1e-12)
                g -= w * np.outer(p, x)
                g[k] += w * x
    assert n == len(rows) and abs(loss - total) < 1e-8 and all(np.allclose(a, b) for a, b in zip(grads, want, strict=True))


def test_group_relative_steps_favour_what_scored_well(spark):
    x = np.array(P.hashed_features("some message", 64))
    heads = P.Heads(64)
    logs = [P.Heads.log_probability(heads.probabilities(x, 2, True), (d, 0, 0)) for d in range(3)]
    used = [(0, 0, -1), (1, 0, 0), (2, -1, -1)]
    rows = [(x.tolist(), 2, True, *used[d], 1.0, float(logs[d]), g, 1.0 if d == 1 else 0.0) for g in range(4) for d in range(3)]
    df = spark.createDataFrame(rows, P.TRAINING + ", old double, g int, score double")
    losses = P.fit_group_relative(df, heads, "g", "score", passes=3, rate=1.0)
    p = heads.probabilities(x, 2, True)[0]
    assert p[1] > 0.34 > max(p[0], p[2]) and losses[-1] < losses[0]
    again = heads.clone()
    assert P.fit_group_relative(df, heads, "g", "score", passes=2, rate=1.0)  # the ratios are beyond the clip: no step moves
    assert (heads.decision == again.decision).all()
