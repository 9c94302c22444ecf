"""Catalogue: aggregates, windows and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitflow.functions import scalars as S
from admitflow.operators import metrics as M
from admitflow.operators import sequences as Q
from admitflow.plans.catalogue import register
from admitflow.plans.common import table

JUDGED = """j AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'HOLD' WHEN quality = 1 THEN 'UPDATE' ELSE 'IGNORE' END AS truth,
  CASE WHEN n_chars % 11 = 0 THEN 'HOLD' WHEN n_chars > 400 THEN 'UPDATE' ELSE 'IGNORE' END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def judged(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    truth = F.when(F.col("toxic") == 1, "HOLD").when(F.col("quality") == 1, "UPDATE").otherwise("IGNORE")
    guess = F.when(F.col("n_chars") % 11 == 0, "HOLD").when(F.col("n_chars") > 400, "UPDATE").otherwise("IGNORE")
    return j.select("doc_id", truth.alias("truth"), guess.alias("predicted"))


def _f1_sql(c: str) -> str:
    tp, den = f"count(*) FILTER (WHERE truth = '{c}' AND predicted = '{c}')", f"(count(*) FILTER (WHERE truth = '{c}') + count(*) FILTER (WHERE predicted = '{c}'))"
    return f"CASE WHEN {den} = 0 THEN 0e0 ELSE 2e0 * {tp} / {den} END"


@register(
    "decision_metrics",
    f"""WITH {JUDGED} SELECT count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(({" + ".join(map(_f1_sql, M.DECISIONS))}) / 3, 9) AS macro_f1,
    round(CASE WHEN count(*) FILTER (WHERE truth <> 'UPDATE') = 0 THEN 0e0 ELSE count(*) FILTER (WHERE truth <> 'UPDATE' AND predicted = 'UPDATE') * 1e0 / count(*) FILTER (WHERE truth <> 'UPDATE') END, 9) AS false_update_rate,
    round(CASE WHEN count(*) FILTER (WHERE truth = 'UPDATE') = 0 THEN 0e0 ELSE count(*) FILTER (WHERE truth = 'UPDATE' AND predicted <> 'UPDATE') * 1e0 / count(*) FILTER (WHERE truth = 'UPDATE') END, 9) AS missed_update_rate FROM j""",
)
def decision_metrics(spark, sf):
    m = M.decision_metrics(judged(spark, sf), "truth", "predicted")
    return m.select("n", *(F.round(c, 9).alias(c) for c in m.columns if c != "n"))


@register("keyed_truth_pairing", f"WITH {JUDGED} SELECT truth, predicted, count(*) AS n FROM j GROUP BY 1, 2")
def keyed_truth_pairing(spark, sf):
    j = judged(spark, sf)
    return j.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


@register(
    "policy_bundle",
    f"""WITH {JUDGED} SELECT count(*) AS n, round(({" + ".join(map(_f1_sql, M.DECISIONS))}) / 3, 9) AS macro_f1,
    round(avg(CASE WHEN truth = predicted THEN 1e0 WHEN truth <> 'IGNORE' AND predicted <> 'IGNORE' THEN 2e0 / 3 ELSE 0e0 END), 9) AS set_f1 FROM j""",
)
def policy_bundle(spark, sf):
    fields = lambda d: F.when(d == "UPDATE", F.array(F.lit("a"))).when(d == "HOLD", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    j = judged(spark, sf).withColumn("f1", S.set_f1(fields(F.col("truth")), fields(F.col("predicted"))))
    m = M.decision_metrics(j, "truth", "predicted").select("n", F.round("macro_f1", 9).alias("macro_f1"))
    return m.join(F.broadcast(j.agg(F.round(F.avg("f1"), 9).alias("set_f1"))), F.lit(True))


@register(
    "set_f1",
    """WITH c AS (SELECT conv_id, list(DISTINCT role) AS a, list(DISTINCT CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'system' END) AS b FROM conversations GROUP BY 1)
    SELECT conv_id, round(2e0 * len(list_intersect(a, b)) / (len(a) + len(b)), 9) AS f1 FROM c""",
)
def set_f1(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("a"), F.collect_set(F.when(F.col("turn") % 2 == 0, "user").otherwise("system")).alias("b"))
    return c.select("conv_id", F.round(S.set_f1(F.col("a"), F.col("b")), 9).alias("f1"))


FLAGS = {"t": ("event_id % 2", "event_id % 3", "event_id % 5"), "p": ("user_id % 2", "event_id % 4", "user_id % 3"), "m": ("event_id % 7", "1", "user_id % 5")}


@register(
    "masked_micro_f1",
    f"""WITH c AS (SELECT unnest([{", ".join(f"CAST({x} = 0 AS INT)" for x in FLAGS["t"])}]) AS t, unnest([{", ".join(f"CAST({x} = 0 AS INT)" for x in FLAGS["p"])}]) AS p, unnest([{", ".join(f"CAST({x} <> 0 AS INT)" for x in FLAGS["m"])}]) AS m FROM events)
    SELECT count(*) AS n, round(2e0 * count(*) FILTER (WHERE t = 1 AND p = 1) / (count(*) FILTER (WHERE t = 1) + count(*) FILTER (WHERE p = 1)), 9) AS micro_f1 FROM c WHERE m = 1""",
)
def masked_micro_f1(spark, sf):
    e = table(spark, sf, "events")
    arr = lambda k, op: F.array(*(F.expr(f"int({x} {op} 0)") for x in FLAGS[k]))
    got = M.masked_micro_f1(e.select(arr("t", "=").alias("t"), arr("p", "=").alias("p"), arr("m", "<>").alias("m")), "t", "p", "m")
    return got.select("n", F.round("micro_f1", 9).alias("micro_f1"))


@register(
    "passk",
    """WITH t AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS trial FROM events),
    g AS (SELECT user_id, count(*) AS n, bool_and(ok) AS all_ok FROM t WHERE trial <= 3 GROUP BY 1 HAVING count(*) = 3)
    SELECT count(*) AS tasks, round(coalesce(avg(CASE WHEN all_ok THEN 1e0 ELSE 0e0 END), 0e0), 9) AS pass_k FROM g""",
)
def passk(spark, sf):
    e = table(spark, sf, "events").withColumn("trial", Q.step_index(["user_id"], ["event_id"]) + 1).withColumn("ok", F.col("event_type") != "error")
    got = M.all_first_k(e, "user_id", "trial", "ok", 3)
    return got.select("tasks", F.round("pass_k", 9).alias("pass_k"))


@register(
    "rates_grouping_sets",
    """WITH l AS (SELECT l_returnflag, CAST(l_discount > 0.05 AS INT) AS stall, CAST(l_tax > 0.04 AS INT) AS hold, 1 AS n FROM lineitem)
    SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS domain, round(sum(stall) * 1e0 / greatest(sum(n), 1), 9) AS stall_rate, round(sum(hold) * 1e0 / greatest(sum(n), 1), 9) AS hold_rate
    FROM l GROUP BY GROUPING SETS ((), (l_returnflag))""",
)
def rates_grouping_sets(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("stall"), (F.col("l_tax") > 0.04).cast("int").alias("hold"), F.lit(1).alias("n"))
    got = M.rates_with_total(rows, "l_returnflag", ["stall", "hold"], "n")
    return got.select("domain", F.round("stall_rate", 9).alias("stall_rate"), F.round("hold_rate", 9).alias("hold_rate"))


@register(
    "group_advantage",
    """WITH s AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1)
    SELECT o_orderkey, round(CASE WHEN n < 2 THEN 0e0 ELSE (o_totalprice - m) / (s + 1e-6) END, 5) AS advantage FROM orders JOIN s USING (o_custkey)""",
)
def group_advantage(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return M.group_advantages(o, "o_custkey", "o_totalprice").select("o_orderkey", F.round("advantage", 5).alias("advantage"))


RATIO = "least(greatest(exp(least(greatest(l_tax - l_discount, -20e0), 20e0)), 0.97e0), 1.03e0)"


@register(
    "clipped_surrogate",
    f"""WITH r AS (SELECT l_returnflag, exp(least(greatest(l_tax - l_discount, -20e0), 20e0)) AS r, {RATIO} AS c, l_quantity - 25e0 AS a FROM lineitem)
    SELECT l_returnflag, round(-avg(least(r * a, c * a)), 6) AS loss, round(avg(CASE WHEN (a >= 0 AND r > 1.03e0) OR (a < 0 AND r < 0.97e0) THEN 0e0 ELSE a * r END), 6) AS coefficient, round(avg(c), 8) AS ratio FROM r GROUP BY 1""",
)
def clipped_surrogate(spark, sf):
    new, old, a = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") - 25e0
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(M.surrogate_loss(new, old, a, 0.03), 6).alias("loss"), F.round(F.avg(S.gradient_coefficient(new, old, a, 0.03)), 6).alias("coefficient"), F.round(F.avg(S.clipped_ratio(new, old, 0.03)), 8).alias("ratio"))


@register("sampled_kl", "SELECT l_linestatus, round(avg(exp(least(greatest(l_discount - l_tax, -20e0), 20e0)) - (l_discount - l_tax) - 1), 9) AS kl FROM lineitem GROUP BY 1")
def sampled_kl(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(M.sampled_kl(F.col("l_tax"), F.col("l_discount")), 9).alias("kl"))


@register(
    "iteration_rollup",
    """WITH e AS (SELECT user_id, user_id % 9 AS grp, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events),
    t AS (SELECT user_id, grp, sum(pow(0.9e0, step) * value) AS episode_return, count(*) AS n_events, sum(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) AS stall FROM e GROUP BY 1, 2),
    g AS (SELECT grp, count(*) AS n, avg(episode_return) AS r, var_pop(episode_return) AS v, sum(stall) AS stall, sum(n_events) AS ev FROM t GROUP BY 1)
    SELECT grp, n AS trajectories, round(r, 5) AS mean_return, round(v, 4) AS return_variance, round(stall / ev, 9) AS stall_rate FROM g""",
)
def iteration_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("step", Q.step_index(["user_id"], ["event_id"])).withColumn("stall", (F.col("event_type") == "error").cast("double"))
    t = M.trajectory_totals(e, "user_id", "step", "value", ["stall"], 0.9)
    g = t.groupBy((F.col("user_id") % 9).alias("grp"))
    return g.agg(F.count(F.lit(1)).alias("trajectories"), F.round(F.avg("episode_return"), 5).alias("mean_return"), F.round(F.var_pop("episode_return"), 4).alias("return_variance"), F.round(F.sum("stall") / F.sum("n_events"), 9).alias("stall_rate"))


@register("mean_group_variance", "WITH g AS (SELECT o_custkey, var_pop(o_totalprice) AS v FROM orders GROUP BY 1) SELECT count(*) AS n_groups, round(avg(v), 2) AS mean_variance FROM g")
def mean_group_variance(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.var_pop("o_totalprice").alias("v"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("v"), 2).alias("mean_variance"))


@register("mean_nll", "SELECT l_returnflag, count(*) AS n, round(-avg(ln(l_discount + 1e-12)), 8) AS nll, round(avg(CASE WHEN l_discount >= 0.05 THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM lineitem GROUP BY 1")
def mean_nll(spark, sf):
    right = F.when(F.col("l_discount") >= 0.05, 1e0).otherwise(0e0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(-F.avg(F.log(F.col("l_discount") + 1e-12)), 8).alias("nll"), F.round(F.avg(right), 9).alias("accuracy"))


@register(
    "bootstrap_ci",
    """WITH RECURSIVE q(k, p, total) AS (SELECT 0, exp(-1e0), exp(-1e0) UNION ALL SELECT k + 1, p / (k + 1), total + p / (k + 1) FROM q WHERE k < 11),
    c AS (SELECT list(CAST(floor(total * 2147483647) AS BIGINT) ORDER BY k) AS cuts FROM q),
    d AS (SELECT quality, CAST('0x' || substr(md5('7:' || doc_id), 1, 15) AS BIGINT) % 2147483647 AS a, CAST('0x' || substr(md5('7:' || doc_id), 17, 15) AS BIGINT) % 2147483647 AS b FROM labels WHERE quality IS NOT NULL),
    w AS (SELECT s, quality, len(list_filter(cuts, lambda x: x <= (a + s * b) % 2147483647)) AS w FROM d, c, range(1, 2001) t(s)),
    m AS (SELECT s, CAST(sum(w * quality) AS DOUBLE) / greatest(1, sum(w)) AS m FROM w GROUP BY 1)
    SELECT (SELECT round(avg(quality), 9) FROM d) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""",
)
def bootstrap_ci(spark, sf):
    got = M.bootstrap_mean_interval(table(spark, sf, "labels"), "quality", 7, ident="doc_id")
    return got.select(*(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@register(
    "threshold_gate",
    """WITH m AS (SELECT 'quality_rate' AS metric, avg(quality * 1e0) AS value FROM labels UNION ALL SELECT 'toxic_rate', avg(toxic * 1e0) FROM labels),
    r(metric, op, bound) AS (VALUES ('quality_rate', 'min', 0.5e0), ('toxic_rate', 'max', 0.03e0), ('toxic_rate', 'min_exclusive', 0e0), ('absent', 'min', 0e0))
    SELECT r.metric, op, bound, round(value, 9) AS value, coalesce(CASE op WHEN 'min' THEN value >= bound WHEN 'min_exclusive' THEN value > bound ELSE value <= bound END, false) AS passed FROM r LEFT JOIN m ON r.metric = m.metric""",
)
def threshold_gate(spark, sf):
    lab = table(spark, sf, "labels").agg(F.avg("quality").alias("quality_rate"), F.avg("toxic").alias("toxic_rate"))
    long = lab.unpivot([], ["quality_rate", "toxic_rate"], "metric", "value")
    rules = spark.createDataFrame([("quality_rate", "min", 0.5), ("toxic_rate", "max", 0.03), ("toxic_rate", "min_exclusive", 0.0), ("absent", "min", 0.0)], "metric string, op string, bound double")
    return M.threshold_gate(long, rules).withColumn("value", F.round("value", 9))


@register("last_write_oracle", "SELECT user_id, event_type, round(arg_max(value, event_id), 6) AS last_value FROM events GROUP BY 1, 2")
def last_write_oracle(spark, sf):
    got = Q.last_write(table(spark, sf, "events"), ["user_id", "event_type"], "value", ["event_id"])
    return got.withColumn("last_value", F.round("last_value", 6))


@register("step_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS step FROM conversations")
def step_index(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", Q.step_index(["conv_id"], ["turn", "role"]).alias("step"))


@register("potential_shaping", "SELECT event_id, round(0.9e0 * value - lag(value, 1, 0e0) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS reward FROM events")
def potential_shaping(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(Q.potential_difference(F.col("value"), ["user_id"], ["event_id"], 0.9), 6).alias("reward"))


@register(
    "contamination_area",
    """WITH e AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
    SELECT user_id, round(CASE WHEN count(*) = 1 THEN max(value) ELSE sum((value + nxt) / 2) END, 4) AS area FROM e GROUP BY 1""",
)
def contamination_area(spark, sf):
    got = Q.contamination_area(table(spark, sf, "events"), "user_id", "event_id", "value")
    return got.withColumn("area", F.round("area", 4))


@register(
    "recovery_latency",
    """WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, min(i) FILTER (WHERE x > 0) AS f, count(*) AS n FROM e GROUP BY 1),
    b AS (SELECT e.user_id, min(i) FILTER (WHERE i > f AND x <= 0) AS b FROM e JOIN f ON e.user_id = f.user_id GROUP BY 1)
    SELECT f.user_id, CASE WHEN f IS NULL THEN 0 WHEN b IS NULL THEN n ELSE b - f END AS latency FROM f JOIN b ON f.user_id = b.user_id""",
)
def recovery_latency(spark, sf):
    e = table(spark, sf, "events").withColumn("x", (F.col("event_type") == "error").cast("int"))
    return Q.recovery_latency(e, "user_id", "event_id", "x")


@register(
    "projected_multipliers",
    """WITH d AS (SELECT user_id % 10 AS grp, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS day, avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) AS rate FROM events GROUP BY 1, 2),
    s AS (SELECT *, sum(0.5e0 * (rate - 0.05e0)) OVER (PARTITION BY grp ORDER BY day) AS s FROM d)
    SELECT grp, day, round(greatest(0.1e0 + s, s - min(s) OVER (PARTITION BY grp ORDER BY day)), 7) AS multiplier FROM s""",
)
def projected_multipliers(spark, sf):
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint")
    d = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("grp"), day.alias("day")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    got = Q.projected_multipliers(d, ["day"], F.lit(0.5) * (F.col("rate") - F.lit(0.05)), 0.1, ["grp"])
    return got.select("grp", "day", F.round("multiplier", 7).alias("multiplier"))


@register(
    "bounded_ledger",
    "SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS ledger FROM events WHERE event_type = 'error'",
)
def bounded_ledger(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select("event_id", F.array_join(Q.bounded_ledger(F.col("event_id").cast("string"), ["user_id"], ["event_id"], 4), ",").alias("ledger"))


@register("budget_depletion", "SELECT event_id, CAST(greatest(0, 5 - sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS left_over FROM events")
def budget_depletion(spark, sf):
    spend = (F.col("event_type") == "error").cast("int")
    return table(spark, sf, "events").select("event_id", Q.budget_left(5, spend, ["user_id"], ["event_id"]).alias("left_over"))


@register("retention_topn", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def retention_topn(spark, sf):
    o = table(spark, sf, "orders").withColumn("rn", Q.step_index(["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]))
    return o.where("rn < 3").select("o_custkey", "o_orderkey")


@register("first_row_per_key", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def first_row_per_key(spark, sf):
    line = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return Q.first_per_key(line, "l_partkey", ["l_orderkey", "l_linenumber"])


@register(
    "validity_labels",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id - (event_id % 3) * 400 END AS valid_from FROM events),
    p AS (SELECT event_id, valid_from, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM e)
    SELECT event_id, CASE WHEN valid_from IS NULL THEN 'HOLD' WHEN valid_from < prev THEN 'IGNORE' ELSE 'UPDATE' END AS decision FROM p""",
)
def validity_labels(spark, sf):
    from pyspark.sql import Window

    valid = F.when(F.col("event_id") % 5 != 0, F.col("event_id") - (F.col("event_id") % 3) * 400)
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("event_id", F.when(valid.isNull(), "HOLD").when(valid < prev, "IGNORE").otherwise("UPDATE").alias("decision"))


@register(
    "stream_windows",
    "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select((F.unix_timestamp("w.start") / 3600).cast("bigint").alias("hour"), "event_type", "n", "total")


@register("usage_total", "SELECT event_type, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END) AS BIGINT) AS tokens FROM events GROUP BY 1")
def usage_total(spark, sf):
    usage = F.when(F.col("event_id") % 4 != 0, F.from_json("props", "map<string,bigint>"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.coalesce(F.try_element_at(usage, F.lit("k")), F.lit(0))).alias("tokens"))


@register("multi_value_groups", "SELECT count(*) AS multi FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1)")
def multi_value_groups(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("k"))
    return g.agg(F.count_if(F.col("k") > 1).alias("multi"))


@register(
    "state_vs_oracle",
    """WITH s AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), o AS (SELECT event_type, max(value) AS m FROM events GROUP BY 1)
    SELECT user_id, round(avg(CASE WHEN v >= 0.5e0 * m THEN 1e0 ELSE 0e0 END), 9) AS consistency FROM s JOIN o USING (event_type) GROUP BY 1""",
)
def state_vs_oracle(spark, sf):
    e = table(spark, sf, "events")
    state = Q.last_write(e, ["user_id", "event_type"], "value", ["event_id"])
    oracle = e.groupBy("event_type").agg(F.max("value").alias("m"))
    ok = F.when(F.col("last_value") >= F.lit(0.5) * F.col("m"), 1e0).otherwise(0e0)
    return state.join(oracle, "event_type").groupBy("user_id").agg(F.round(F.avg(ok), 9).alias("consistency"))


@register(
    "best_checkpoint",
    """WITH r AS (SELECT user_id % 10 AS run, event_id // 500 AS step, avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END) AS a, avg(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END) AS b, avg(CASE WHEN event_type = 'signup' THEN 1e0 ELSE 0e0 END) AS c, avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) AS f FROM events GROUP BY 1, 2),
    s AS (SELECT run, step, a + b + c - 2 * f AS score FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, step) AS rn FROM s)
    SELECT run, step, round(score, 9) AS score FROM k WHERE rn = 1""",
)
def best_checkpoint(spark, sf):
    """Shares of event types stand for the four scores (one is absent) and the false update rate."""
    rate = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("run"), F.floor(F.col("event_id") / 500).alias("step"))
    m = e.agg(rate("click").alias("decision_macro_f1"), rate("view").alias("affected_micro_f1"), rate("signup").alias("verification_f1"), rate("error").alias("false_update_rate"))
    best = M.best_checkpoint(m.withColumn("patch_operation_micro_f1", F.lit(None).cast("double")), ["run"], "step", M.checkpoint_score())
    return best.withColumn("score", F.round("score", 9))
