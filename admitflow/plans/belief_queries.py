"""Queries of the belief operators: action histories judged and folded, the ledger, the gates, the replay of conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from admitflow.functions import scalars as S
from admitflow.operators import belief as B
from admitflow.plans.catalogue import register
from admitflow.plans.common import table


def _action(decision, affected, patches, verification=None):
    verify = F.lit(None) if verification is None else verification
    return F.struct(decision.alias("decision"), affected.alias("affected_fields"), patches.alias("patches"), verify.cast("struct<tool:string,field_id:string>").alias("verification")).cast(B.ACTION)


def _patch(op, field, value):
    return F.struct(op.alias("op"), field.alias("field_id"), value.cast("string").alias("value"))


@register(
    "ordered_rule_errors",
    """WITH r AS (SELECT CASE WHEN l_linenumber > 6 THEN 'affected fields must be unique' WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'IGNORE must not carry fields, patches, or verification'
      WHEN l_returnflag = 'A' AND l_quantity < 5 THEN 'verification target is outside affected fields' WHEN l_returnflag = 'N' AND l_tax > 0.07 THEN 'UPDATE may not request verification'
      WHEN l_quantity > 45 THEN 'SET_VALUE type does not match the target slot' END AS error FROM lineitem)
    SELECT coalesce(error, 'none') AS error, count(*) AS n, coalesce(contains(error, 'outside affected fields'), false) AS collateral FROM r GROUP BY 1, 3""",
)
def ordered_rule_errors(spark, sf):
    """Every line asks for an action on one slot that holds a whole number."""
    flag, field = F.col("l_returnflag"), F.lit("quantity")
    astray = (flag == "A") & (F.col("l_quantity") < 5)
    asks = F.when(astray, F.struct(F.lit("t").alias("tool"), F.lit("elsewhere").alias("field_id"))).when((flag == "N") & (F.col("l_tax") > 0.07), F.struct(F.lit("t").alias("tool"), field.alias("field_id")))
    decision = F.when((flag == "R") & (F.col("l_discount") > 0.05), "IGNORE").when(astray, "HOLD").otherwise("UPDATE")
    affected = F.when(F.col("l_linenumber") > 6, F.array(field, field)).otherwise(F.array(field))
    value = F.when(F.col("l_quantity") > 45, F.lit('"many"')).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    action = _action(decision, affected, F.when(astray, F.array(_patch(F.lit("SET_STATUS"), field, F.lit(f'"{B.PENDING}"')))).otherwise(F.array(_patch(F.lit("SET_VALUE"), field, value))), asks)
    shape = F.create_map(field, F.struct(F.lit("part").alias("entity"), F.lit("int").alias("kind")))
    rows = table(spark, sf, "lineitem").select(action.alias("action"), F.lit(None).cast(B.OBSERVATION).alias("obs"))
    error = B.action_error(F.col("action"), F.col("obs"), shape)
    e = rows.groupBy(error.alias("e")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.coalesce("e", F.lit("none")).alias("error"), "n", F.coalesce(F.contains("e", F.lit("outside affected fields")), F.lit(False)).alias("collateral"))


@register(
    "action_gate",
    """WITH s AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS pending FROM orders GROUP BY 1)
    SELECT c_custkey, (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AND (s.o_custkey IS NULL OR pending = 1) AS blocked FROM customer LEFT JOIN s ON c_custkey = o_custkey""",
)
def action_gate(spark, sf):
    """A customer's slot "orders" is pending while one of its orders is."""
    slots = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "P").alias("pending"))
    j = table(spark, sf, "customer").join(slots, F.col("c_custkey") == F.col("o_custkey"), "left")
    none = F.create_map().cast("map<string,string>")
    statuses = F.when(F.col("pending").isNull(), none).otherwise(F.create_map(F.lit("orders"), F.when(F.col("pending"), B.PENDING).otherwise(B.TRUSTED)))
    risk = F.when(F.col("c_mktsegment") == "MACHINERY", "high").otherwise("low")
    return j.select("c_custkey", B.blocks_action(statuses, F.array(F.lit("orders")), risk, F.col("c_acctbal") >= 0).alias("blocked"))


@register(
    "belief_fold",
    """WITH a AS (SELECT user_id, event_type, arg_max(round(value, 4), event_id) AS v FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || printf('%.4f', v), ';' ORDER BY event_type) AS belief FROM a GROUP BY 1""",
)
def belief_fold(spark, sf):
    """Every event sets a slot of its user; the slots are there from the beginning, without values."""
    e = table(spark, sf, "events").where("event_type <> 'error'")
    field = F.col("event_type")
    initial = e.select("user_id", field.alias("field_id")).distinct()
    initial = initial.select("user_id", "field_id", F.lit(None).cast("string").alias("value"), F.lit(B.EMPTY).alias("status"), F.lit("initial").alias("source"), F.lit(0).alias("observed_at"), F.lit(None).cast("long").alias("valid_from"), F.lit("user").alias("entity"))
    action = _action(F.lit("UPDATE"), F.array(field), F.array(_patch(F.lit("SET_VALUE"), field, F.round("value", 4))))
    done = B.judge(e.select("user_id", "event_id", action.alias("action"), F.lit(None).cast(B.OBSERVATION).alias("observation")), initial, ["user_id"], ["event_id"])
    slots = B.final_slots(done, initial, ["user_id"], ["event_id"])
    text = F.concat("field_id", F.lit("="), F.format_string("%.4f", F.col("value").cast("double")))
    return slots.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("belief"))


#: A history of actions for each user, with every kind of mistake; the same expressions in both dialects.
_N = "event_id"
_OP = f"CASE WHEN {_N} % 4 = 0 THEN 'ADD_FIELD' WHEN {_N} % 4 = 3 OR {_N} % 23 = 0 THEN 'SET_STATUS' WHEN {_N} % 41 = 1 THEN 'SET_PROVENANCE' WHEN {_N} % 43 = 1 THEN 'SET_VALIDITY' ELSE 'SET_VALUE' END"
_DECISION = f"CASE WHEN {_N} % 4 = 3 THEN 'HOLD' WHEN {_N} % 29 = 0 THEN 'IGNORE' ELSE 'UPDATE' END"
_VALUE = (
    f"CASE WHEN {_OP} = 'SET_STATUS' THEN CASE WHEN {_N} % 31 = 0 THEN '\"odd\"' ELSE '\"pending_verification\"' END WHEN {_OP} = 'SET_PROVENANCE' THEN CASE WHEN {_N} % 2 = 0 THEN '\"hand\"' ELSE '7' END "
    f"WHEN {_OP} = 'SET_VALIDITY' THEN CASE WHEN {_N} % 3 = 0 THEN 'true' WHEN {_N} % 3 = 1 THEN '12' ELSE '1.5' END "
    f"WHEN {_N} % 7 = 0 THEN '\"s' || {_N} || '\"' WHEN {_N} % 11 = 0 THEN 'null' WHEN {_N} % 13 = 1 THEN '0.5' ELSE CAST({_N} AS VARCHAR(20)) END"
)
_AFFECTED = f"CASE WHEN {_N} % 17 = 0 THEN 2 WHEN {_N} % 19 = 0 OR ({_N} % 29 = 0 AND {_N} % 2 = 0) THEN 0 WHEN {_N} % 37 = 0 THEN -1 ELSE 1 END"
_EXTRA = f"{_N} % 10 = 5 AND {_DECISION} = 'UPDATE'"
_BARE = f"{_N} % 29 = 0 AND {_N} % 2 = 0"


def executor_actions(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.expr(_OP).alias("op"), F.expr(_DECISION).alias("d"), F.expr(_VALUE).alias("v"), F.expr(_AFFECTED).alias("aff"), F.expr(_EXTRA).alias("extra"), F.expr(_BARE).alias("bare"))
    field, n = F.col("event_type"), F.col("event_id")
    none = F.array().cast("array<string>")
    affected = F.when(F.col("aff") == 2, F.array(field, field)).when(F.col("aff") == 0, none).when(F.col("aff") == -1, F.array(F.lit("elsewhere"))).otherwise(F.when(F.col("extra"), F.array(field, F.lit("extra"))).otherwise(F.array(field)))
    one = F.array(_patch(F.col("op"), field, F.col("v")))
    more = F.when(F.col("extra"), F.concat(one, F.array(_patch(F.lit("ADD_FIELD"), F.lit("extra"), F.lit("1"))))).otherwise(one)
    patches = F.when(F.col("bare"), F.array().cast("array<struct<op:string,field_id:string,value:string>>")).otherwise(more)
    asks = F.when(n % 47 == 0, F.struct(F.lit("t").alias("tool"), F.lit("elsewhere").alias("field_id")))
    obs = F.struct(field.alias("field_id"), F.col("v").alias("value"), F.concat(F.lit("src"), (n % 5).cast("string")).alias("source"), n.alias("observed_at"), F.when(n % 2 == 0, n).alias("valid_from"), F.when(n % 13 == 0, "other").otherwise("self").alias("entity"))
    return e.select("user_id", "event_id", _action(F.col("d"), affected, patches, asks).alias("action"), F.when(n % 3 != 0, obs).cast(B.OBSERVATION).alias("observation"))


_KIND = "CASE WHEN {0} IS NULL OR {0} = 'null' THEN 'null' WHEN {0} IN ('true', 'false') THEN 'bool' WHEN {0} LIKE '\"%' THEN 'str' WHEN regexp_full_match({0}, '-?[0-9]+') THEN 'int' ELSE 'float' END"
#: The fold in order, one action of every user at a time. st: user_id, i, event_id, error, slots (field, value, status, source, observed_at, valid_from, entity), held.
_FOLD = f"""WITH RECURSIVE a AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {_DECISION} AS d,
    CASE {_AFFECTED} WHEN 2 THEN [event_type, event_type] WHEN 0 THEN [] WHEN -1 THEN ['elsewhere'] ELSE CASE WHEN {_EXTRA} THEN [event_type, 'extra'] ELSE [event_type] END END AS aff,
    CASE WHEN {_BARE} THEN [] WHEN {_EXTRA} THEN [struct_pack(op := {_OP}, f := event_type, v := {_VALUE}), struct_pack(op := 'ADD_FIELD', f := 'extra', v := '1')] ELSE [struct_pack(op := {_OP}, f := event_type, v := {_VALUE})] END AS p,
    CASE WHEN event_id % 47 = 0 THEN 'elsewhere' END AS ask,
    CASE WHEN event_id % 3 <> 0 THEN struct_pack(f := event_type, s := 'src' || (event_id % 5), t := event_id, y := CASE WHEN event_id % 2 = 0 THEN event_id END, e := CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'self' END) END AS o
  FROM events),
st AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS error,
    CAST([] AS STRUCT(f VARCHAR, v VARCHAR, st VARCHAR, s VARCHAR, t BIGINT, y BIGINT, e VARCHAR)[]) AS slots, CAST([] AS BIGINT[]) AS held FROM events
  UNION ALL
  SELECT user_id, i, event_id, error,
    CASE WHEN error IS NOT NULL OR d = 'IGNORE' THEN slots
      WHEN d = 'HOLD' THEN list_transform(slots, lambda s: struct_pack(f := s.f, v := s.v, st := CASE WHEN list_contains(list_transform(p, lambda q: q.f), s.f) THEN 'pending_verification' ELSE s.st END, s := s.s, t := s.t, y := s.y, e := s.e))
      ELSE list_concat(
        list_transform(slots, lambda s: list_reduce(list_prepend(s, list_transform(list_filter(p, lambda q: q.f = s.f), lambda q: struct_pack(f := s.f,
          v := CASE WHEN q.op = 'SET_VALUE' THEN q.v ELSE s.v END,
          st := CASE q.op WHEN 'SET_VALUE' THEN 'trusted' WHEN 'SET_STATUS' THEN trim(q.v, '"') ELSE s.st END,
          s := CASE WHEN q.op = 'SET_VALUE' AND o IS NOT NULL THEN o.s WHEN q.op = 'SET_PROVENANCE' THEN trim(q.v, '"') ELSE s.s END,
          t := CASE WHEN q.op = 'SET_VALUE' AND o IS NOT NULL THEN o.t ELSE s.t END,
          y := CASE WHEN q.op = 'SET_VALUE' AND o IS NOT NULL THEN o.y WHEN q.op = 'SET_VALIDITY' THEN CASE q.v WHEN 'true' THEN 1 ELSE TRY_CAST(q.v AS BIGINT) END ELSE s.y END,
          e := CASE WHEN q.op = 'SET_VALUE' AND o IS NOT NULL THEN o.e ELSE s.e END))), lambda x, y: y)),
        list_transform(list_filter(p, lambda q: q.op = 'ADD_FIELD'), lambda q: struct_pack(f := q.f, v := q.v, st := 'trusted', s := CASE WHEN o IS NULL THEN 'unknown' ELSE o.s END, t := CASE WHEN o IS NULL THEN 0 ELSE o.t END, y := o.y, e := CASE WHEN o IS NULL THEN 'unknown' ELSE o.e END)))
    END,
    CASE WHEN error IS NULL AND d = 'HOLD' AND o IS NOT NULL THEN list_append(held, event_id)[-4:] ELSE held END
  FROM (
    SELECT *, CASE
      WHEN len(aff) <> len(list_distinct(aff)) THEN 'affected fields must be unique'
      WHEN d = 'IGNORE' THEN CASE WHEN len(aff) > 0 OR len(p) > 0 OR ask IS NOT NULL THEN 'IGNORE must not carry fields, patches, or verification' END
      WHEN len(aff) = 0 THEN 'non-IGNORE decisions require affected fields'
      WHEN d = 'HOLD' AND ask IS NOT NULL AND NOT list_contains(aff, ask) THEN 'verification target is outside affected fields'
      WHEN d = 'HOLD' THEN list_filter(list_transform(p, lambda q: CASE WHEN NOT list_contains(aff, q.f) THEN 'HOLD patch is outside affected fields'
        WHEN q.op <> 'SET_STATUS' OR q.v <> '"pending_verification"' THEN 'HOLD may only set pending status'
        WHEN NOT list_contains(list_transform(slots, lambda s: s.f), q.f) THEN 'HOLD patch target does not exist' END), lambda m: m IS NOT NULL)[1]
      WHEN ask IS NOT NULL THEN 'UPDATE may not request verification'
      WHEN len(p) = 0 THEN 'UPDATE requires at least one patch'
      ELSE list_filter(list_transform(p, lambda q: CASE WHEN NOT list_contains(aff, q.f) THEN 'UPDATE patch is outside affected fields'
        WHEN q.op = 'ADD_FIELD' AND list_contains(list_transform(slots, lambda s: s.f), q.f) THEN 'ADD_FIELD target already exists'
        WHEN q.op = 'ADD_FIELD' AND len(slots) >= 4 THEN 'no empty belief slot'
        WHEN q.op <> 'ADD_FIELD' AND NOT list_contains(list_transform(slots, lambda s: s.f), q.f) THEN 'patch target does not exist'
        WHEN o IS NOT NULL AND q.op IN ('ADD_FIELD', 'SET_VALUE') AND q.f <> o.f THEN 'observation may only supply the matching field'
        WHEN o IS NOT NULL AND q.op = 'SET_VALUE' AND list_filter(slots, lambda s: s.f = q.f)[1].e <> o.e THEN 'observation entity does not match the target slot'
        WHEN q.op = 'SET_VALUE' AND coalesce(list_filter(slots, lambda s: s.f = q.f)[1].v, 'null') <> 'null'
          AND {_KIND.format("list_filter(slots, lambda s: s.f = q.f)[1].v")} <> {_KIND.format("q.v")} THEN 'SET_VALUE type does not match the target slot'
        WHEN q.op = 'SET_STATUS' AND q.v NOT IN ('"empty"', '"trusted"', '"pending_verification"') THEN 'SET_STATUS value is invalid'
        WHEN q.op = 'SET_PROVENANCE' AND q.v NOT LIKE '"%' THEN 'SET_PROVENANCE requires a string'
        WHEN q.op = 'SET_VALIDITY' AND {_KIND.format("q.v")} NOT IN ('null', 'int', 'bool') THEN 'SET_VALIDITY requires an integer or null' END), lambda m: m IS NOT NULL)[1] END AS error
    FROM (SELECT a.*, st.slots, st.held FROM st JOIN a ON a.user_id = st.user_id AND a.i = st.i + 1) j) k)
"""
EXECUTOR_SLOTS = 4


@register("executor_errors", _FOLD + "SELECT user_id, event_id, error FROM st WHERE event_id IS NOT NULL")
def executor_errors(spark, sf):
    done = B.judge(executor_actions(spark, sf), None, ["user_id"], ["event_id"], EXECUTOR_SLOTS)
    return done.select("user_id", "event_id", "error")


@register(
    "executor_state",
    _FOLD + "SELECT user_id, x.f AS field_id, x.v AS value, x.st AS status, x.s AS source, x.t AS observed_at, x.y AS valid_from, x.e AS entity FROM (SELECT user_id, unnest(arg_max(slots, i)) AS x FROM st GROUP BY user_id) z",
)
def executor_state(spark, sf):
    done = B.judge(executor_actions(spark, sf), None, ["user_id"], ["event_id"], EXECUTOR_SLOTS)
    return B.final_slots(done, None, ["user_id"], ["event_id"])


@register("held_ledger", _FOLD + "SELECT user_id, x AS event_id, CAST(list_position(held, x) AS INTEGER) AS place FROM (SELECT user_id, arg_max(held, i) AS held, unnest(arg_max(held, i)) AS x FROM st GROUP BY user_id) z")
def held_ledger(spark, sf):
    done = B.judge(executor_actions(spark, sf), None, ["user_id"], ["event_id"], EXECUTOR_SLOTS)
    return B.ledger(done, ["user_id"], ["event_id"]).select("user_id", "event_id", "place")


@register("gold_values", _FOLD + "SELECT event_id, list_filter(p, lambda q: q.op = 'SET_VALUE' AND q.f = aff[1])[1].v AS gold FROM a")
def gold_values(spark, sf):
    a = executor_actions(spark, sf)
    return a.select("event_id", B.gold_value(F.col("action.patches"), F.get("action.affected_fields", F.lit(0)), strict=False).alias("gold"))


@register(
    "label_plans",
    _FOLD
    + """, r AS (SELECT event_id, aff, d, event_id % 4 AS k, f0, CASE WHEN list_contains(list_slice(['click', 'error', 'view'], 1, CAST(event_id % 4 AS INTEGER)), f0) THEN list_slice(['click', 'error', 'view'], 1, CAST(event_id % 4 AS INTEGER)) ELSE list_append(list_slice(['click', 'error', 'view'], 1, CAST(event_id % 4 AS INTEGER)), f0) END AS registry
      FROM (SELECT a.*, e.event_type AS f0 FROM a JOIN events e ON e.event_id = a.event_id) z)
    SELECT event_id, array_to_string(registry, ',') AS registry, array_to_string(list_transform(range(4), lambda i: CASE WHEN list_contains(aff, registry[i + 1]) THEN 1 ELSE 0 END), ',') AS affected,
      array_to_string(list_transform(range(4), lambda i: CASE WHEN i < len(registry) AND d <> 'IGNORE' THEN 1 ELSE 0 END), ',') AS slot_mask, CASE WHEN d = 'HOLD' THEN 1 ELSE -100 END AS verify_label FROM r""",
)
def label_plans(spark, sf):
    """Slots of a state of none to three fields; the observed field joins them where it is new."""
    a = executor_actions(spark, sf).join(table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    slots = F.slice(F.array(F.lit("click"), F.lit("error"), F.lit("view")), F.lit(1), (F.col("event_id") % 4).cast("int"))
    plan = S.label_plan(slots, F.col("event_type"), F.col("action.affected_fields"), F.col("action.decision"), 4)
    text = {k: F.array_join(v.cast("array<string>"), ",") for k, v in plan.items() if k != "verify_label"}
    return a.select("event_id", *(v.alias(k) for k, v in text.items()), plan["verify_label"].alias("verify_label"))


@register(
    "verification_admission",
    """WITH r AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS asked, event_id % 3 <> 0 AS evidence, event_type IN ('error', 'view') AND event_id % 3 <> 0 AND event_id % 5 < 3 AS fits FROM events),
    s AS (SELECT *, coalesce(sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
    SELECT user_id, event_id, fits AND before < 2 AS paid, asked AND before >= 2 AS budget_violation, asked AND evidence AND NOT fits AS misdirected FROM s""",
)
def verification_admission(spark, sf):
    asked = F.col("event_type").isin("error", "view")
    evidence = F.col("event_id") % 3 != 0
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return B.admit_verifications(e, ["user_id"], ["event_id"], asked, evidence, evidence & (F.col("event_id") % 5 < 3), 2).drop("event_type")


@register(
    "scenario_fold",
    """WITH t AS (SELECT conv_id, role, length(coalesce(text, '')) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) - 1 AS step, CASE WHEN role IN ('user', 'assistant') THEN 'UPDATE' ELSE 'HOLD' END AS decision FROM conversations),
    o AS (SELECT conv_id, role, arg_max(v, step) AS final FROM t WHERE decision = 'UPDATE' GROUP BY 1, 2), n AS (SELECT conv_id, count(*) AS roles FROM o GROUP BY 1),
    g AS (SELECT t.*, roles, CASE WHEN decision = 'UPDATE' AND t.v = final THEN 1 ELSE 0 END AS good FROM t LEFT JOIN o ON o.conv_id = t.conv_id AND o.role = t.role LEFT JOIN n ON n.conv_id = t.conv_id),
    d AS (SELECT *, good - lag(good, 1, 0) OVER (PARTITION BY conv_id, role ORDER BY step) AS gain, max(step) OVER (PARTITION BY conv_id) AS final_step FROM g),
    p AS (SELECT *, CASE WHEN roles IS NULL THEN 1e0 ELSE CAST(sum(gain) OVER (PARTITION BY conv_id ORDER BY step) AS DOUBLE) / roles END AS now, CASE WHEN roles IS NULL THEN 1e0 ELSE CAST(coalesce(sum(gain) OVER (PARTITION BY conv_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / roles END AS before FROM d)
    SELECT CAST(conv_id AS VARCHAR) AS key, step, decision, true AS executed, round(now - before + CASE WHEN step = final_step AND now = 1 THEN 1e0 ELSE 0e0 END, 9) AS reward, CASE WHEN step = final_step THEN 'terminal' ELSE 'next_event' END AS transition, step = final_step AND now = 1 AS success,
      4096 AS tokens_left, 0e0 AS false_update, 0e0 AS unsafe_action, CASE WHEN decision = 'HOLD' THEN 1e0 ELSE 0e0 END AS stall, 0e0 AS verification, 0e0 AS budget_violation, 0e0 AS invalid_patch, 0e0 AS collateral_edit, 0e0 AS invalid_format FROM p""",
)
def scenario_fold(spark, sf):
    """Turns replayed as events: users and assistants set the slot of their role to the length of their text, others hold it. The reward is the gain in agreement with the last values, and one more for full agreement at the end."""
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", text)
    t = table(spark, sf, "conversations").select("conv_id", "role", F.length(text).alias("v"), (F.row_number().over(order) - 1).cast("long").alias("step"))
    updates = F.col("role").isin("user", "assistant")
    role = F.col("role")
    patch = F.when(updates, _patch(F.lit("SET_VALUE"), role, F.col("v"))).otherwise(_patch(F.lit("SET_STATUS"), role, F.lit(f'"{B.PENDING}"')))
    action = _action(F.when(updates, "UPDATE").otherwise("HOLD"), F.array(role), F.array(patch))
    obs = F.struct(role.alias("field_id"), F.col("v").cast("string").alias("value"), F.lit("conversation").alias("source"), F.col("step").alias("observed_at"), F.col("step").alias("valid_from"), F.lit("conv").alias("entity"))
    initial = t.select("conv_id", role.alias("field_id")).distinct()
    initial = initial.select("conv_id", "field_id", F.lit(None).cast("string").alias("value"), F.lit(B.EMPTY).alias("status"), F.lit("initial").alias("source"), F.lit(0).alias("observed_at"), F.lit(None).cast("long").alias("valid_from"), F.lit("conv").alias("entity"))
    done = B.judge(t.select("*", action.alias("action"), obs.alias("observation")), initial, ["conv_id"], ["step"])
    return B.replayed(done, "conv_id", "step").select(F.col("conv_id").cast("string").alias("key"), "step", F.col("action.decision").alias("decision"), "executed", F.round("reward", 9).alias("reward"), "transition", "success", F.lit(4096).cast("long").alias("tokens_left"), *S.COST_NAMES)
