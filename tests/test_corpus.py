"""The corpus driver: plan, queue, gate and publication."""

import random

import pytest
from pyspark.sql import functions as F

from admitflow.operators import corpus as C

POOL = "macro string, dataset string, record_id string, entity string, field_id string, value string, observed_at long, valid_from long, goal string"


def pool(spark, n=4, fields=("status",)):
    rows = [(m, d, f"{i}", f"{d}:{i}", f, f"ready-{i}", 1000 + i, 990 + i if i % 2 else None, f"complete {d} task {i}") for m, d in (("commerce", "retail"), ("service", "airline"), ("workflow", "database")) for i in range(n) for f in fields]
    return spark.createDataFrame(rows, POOL)


def test_shares_are_largest_remainders():
    targets = {"commerce": 10, "service": 6, "workflow": 4}
    assert C.shares(targets, 3) == {"commerce": 1, "service": 1, "workflow": 1}
    assert C.shares({"commerce": 3000, "service": 1800, "workflow": 1200}, 900) == {"commerce": 450, "service": 270, "workflow": 180}


def test_golden_counts_of_a_full_run(spark, tmp_path):
    with pytest.raises(ValueError, match="confirm_full"):
        C.build(pool(spark), f"file://{tmp_path}/no", total=6000)
    sources = pool(spark, 700, ("a", "b", "c"))
    got = C.build(sources, f"file://{tmp_path}/full", total=6000, batch=25, confirm_full=6000)
    n = {(r.metric, r.key): r.n for r in C.report(got.accepted, got.rejected, got.requests).collect()}
    want = {
        ("accepted", ""): 6000, ("rejected", ""): got.rejected, ("requests", ""): got.requests, ("paired_hold_groups", ""): 900, ("total_tokens", ""): 0,
        ("decision", "UPDATE"): 4200, ("decision", "HOLD"): 900, ("decision", "IGNORE"): 900, ("macro_domain", "commerce"): 3000, ("macro_domain", "service"): 1800, ("macro_domain", "workflow"): 1200,
        ("observation", "new_consistent"): 3300, ("observation", "explicit_conflict"): 900, ("observation", "tool_error_or_low_trust"): 900, ("observation", "verification_confirmed"): 900,
        ("verification", "VERIFY"): 900, ("verification", "NO_VERIFY"): 5100, ("source", "retail"): 3000, ("source", "airline"): 1800, ("source", "database"): 1200,
    }
    assert n == want
    distinct = lambda df: df.withColumns({"observation_text": F.concat("record_id", F.lit(" "), "value"), "tokens": F.lit(1)})
    got = C.build(sources, f"file://{tmp_path}/distinct", total=6000, batch=25, confirm_full=6000, realise=distinct)
    assert (got.rejected, got.requests) == (0, 240)


def test_small_plan(spark):
    rows = C.plan(pool(spark), 20, seed=9).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, 21))
    assert {d: sum(r.decision == d for r in rows) for d in ("UPDATE", "HOLD", "IGNORE")} == {"UPDATE": 14, "HOLD": 3, "IGNORE": 3}
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        if r.parent_id:
            h = by_id[r.parent_id]
            assert (h.decision, r.decision, h.group_id, r.observed_at - h.observed_at, r.sequence - h.sequence) == ("HOLD", "UPDATE", r.group_id, 300, 1)
        if r.decision == "IGNORE":
            assert r.distractor_id and r.distractor_id != r.source_id and r.entity.endswith(f":{r.distractor_id}")
        assert r.valid_from is None or r.valid_from <= r.observed_at
    assert rows[0].observed_at == 1_750_000_600 and len({r.group_id for r in rows}) == 17
    with pytest.raises(ValueError, match="multiple of 20"):
        C.plan(pool(spark), 30)
    with pytest.raises(ValueError, match="lack macro domains"):
        C.plan(pool(spark).where("macro <> 'service'"), 20)
    with pytest.raises(ValueError, match="two entities"):
        C.plan(pool(spark).withColumn("entity", F.lit("one")), 20)


def queue(texts, batch, max_attempts):
    """One batch after another; texts: id -> texts by attempt."""
    waiting, seen, out, attempts, requests, rejected = list(texts), set(), {}, {}, 0, 0
    while waiting:
        taken, waiting = waiting[:batch], waiting[batch:]
        requests += 1
        for i in taken:
            text = texts[i][attempts.get(i, 0)]
            normal = " ".join(text.lower().split())
            if normal and normal not in seen:
                seen.add(normal)
                out[i] = text
                continue
            rejected += 1
            attempts[i] = attempts.get(i, 0) + 1
            assert attempts[i] < max_attempts
            waiting.append(i)
    return out, requests, rejected


@pytest.mark.parametrize(("seed", "batch"), [(1, 7), (3, 200)])
def test_rounds_accept_what_the_queue_accepts(spark, seed, batch):
    rng = random.Random(seed)
    texts = {f"c{i:03d}": [rng.choice(["", f"T {rng.randrange(60)}", f"t  {rng.randrange(60)}"]) for _ in range(4)] + [f"last {i}"] for i in range(90)}
    want, requests, rejected = queue(texts, batch, 6)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "record_id string, texts array<string>")
    realise = lambda d: d.withColumn("observation_text", F.get("texts", F.col("attempt")))
    issues = lambda d: F.when(F.trim("observation_text") == "", F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>"))
    got = C.fill(df, ["record_id"], realise, issues, 6, batch)
    assert {r.record_id: r.observation_text for r in got.accepted.collect()} == want
    assert (got.requests, got.rejected.count()) == (requests, rejected)
    got.discard()
    with pytest.raises(RuntimeError, match="allowed"):
        C.fill(df, ["record_id"], realise, issues, 6, batch, max_requests=requests - 1)
    with pytest.raises(RuntimeError, match="exhausted"):
        C.fill(df, ["record_id"], realise, issues, 2, batch)


def test_resuming_needs_the_beginning_of_the_schedule(spark, tmp_path):
    sources = pool(spark, 30)
    whole = C.build(sources, f"file://{tmp_path}/whole", total=40).accepted
    done = whole.where("sequence <= 15")
    rest = C.build(sources, f"file://{tmp_path}/rest", total=40, done=done)
    assert rest.resumed == 15 and sorted(r.sequence for r in rest.accepted.collect()) == list(range(16, 41))
    with pytest.raises(ValueError):
        C.build(sources, f"file://{tmp_path}/odd", total=40, done=whole.where("sequence between 2 and 9"))


def test_a_corpus_that_fails_its_checks_is_not_published(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(C, "expectations", lambda total: {"rows": (F.count(F.lit(1)), total + 1)})
    with pytest.raises(AssertionError, match="rows is 20, not 21"):
        C.build(pool(spark), f"file://{tmp_path}/bad", total=20)
    assert os.listdir(tmp_path) == []


def test_append_log_counts_a_repeated_batch_once(spark, tmp_path):
    from admitflow.sources.sinks import AppendLog

    log = AppendLog(spark, f"file://{tmp_path}/log", "digest string, answer string")
    rows = lambda *r: spark.createDataFrame(list(r), "digest string, answer string")
    assert log.rows().count() == 0
    log.append(rows(("a", "1"), ("a", "0"), ("b", "2")), 0)
    log.append(rows(("b", "9"), ("c", "3")), 1)
    for _ in range(2):
        log.append(rows(("b", "9"), ("c", "3")), 1)
        log.append(rows(("a", "1"), ("a", "0"), ("b", "2")), 0)
    assert sorted(map(tuple, log.rows().collect())) == [("a", "0", 0), ("b", "2", 0), ("c", "3", 1)]


def test_a_build_leaves_only_what_it_publishes(spark, tmp_path):
    """At 54 million orders the cached sorts, stored tables and shuffles of a build took some 90 GB of disk."""
    import os

    from admitflow import session

    top = session.scratch_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0].replace("//", "/", 1)
    tables = lambda: {d for d in os.listdir(f"{top}/admitflow")} if os.path.isdir(f"{top}/admitflow") else set()
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, held = tables(), cached()
    got = C.build(pool(spark, 30), f"file://{tmp_path}/out", total=400)
    assert (got.accepted.count(), tables() - before, cached() - held) == (400, set(), 0)
    plan = C.plan(pool(spark, 30), 40)
    assert plan.count() == 40 and len(tables() - before) == 1 and cached() == held
    session.discard(plan)
    assert tables() == before


def test_odd_orders_give_what_sql_gives(spark, tmp_path):
    """A status with one customer in a macro domain (distractors of any field), a domain with few orders (many rounds), texts that repeat."""
    import duckdb

    from admitflow.plans import catalogue

    rng = random.Random(5)
    rows = []
    for i in range(1, 2401):
        priority = rng.choices(["1-URGENT", "3-MEDIUM", "5-LOW"], [1, 6, 3])[0]
        status = rng.choice("FOP")
        customer = 7 if (priority, status) == ("5-LOW", "P") else rng.choice([7, 7, 7, rng.randrange(40)])
        rows.append((i * 3, customer, status, priority))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").repartition(3).write.parquet(f"file://{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("corpus_plan", "corpus_report"):
        got = catalogue.queries()[name](spark, f"file://{tmp_path}")
        want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracles()[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name


def test_rejections_with_issues_and_repeats_are_told_apart(spark):
    rows = [("a", ["x", "x1"]), ("b", ["X", "x2"]), ("c", ["bad", "x"]), ("d", ["bad", "x4"]), ("e", [" x ", "x1"])]
    df = spark.createDataFrame(rows, "record_id string, texts array<string>")
    realise = lambda d: d.withColumn("observation_text", F.coalesce(F.get("texts", F.col("attempt")), F.concat(F.lit("last "), "record_id")))
    issues = lambda d: F.when(F.col("observation_text").isin("bad", " x "), F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    got = C.fill(df, ["record_id"], realise, issues, 3, 2)
    assert {r.record_id: (r.attempt, r.observation_text) for r in got.accepted.collect()} == {"a": (0, "x"), "b": (1, "x2"), "c": (2, "last c"), "d": (1, "x4"), "e": (1, "x1")}
    assert {(r.record_id, r.attempt): r.issues for r in got.rejected.collect()} == {("b", 0): ["duplicate_text"], ("c", 0): ["odd"], ("d", 0): ["odd"], ("e", 0): ["odd", "duplicate_text"], ("c", 1): ["duplicate_text"]}
