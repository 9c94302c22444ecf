"""Belief state under typed patches: ordered rules, the fold of an action history, the evidence ledger and the gates.

An action is judged by an ordered table of rules (condition, message), evaluated on columns. A rule
looks at the action, its observation, and the *shape* of the state: which slots exist, their entities
and the types of their values. An action that breaks a rule changes nothing.

Shapes only grow: a slot is never removed, its entity never changes, and a value's type is settled by
the first value that isn't null. So a key's whole history of shapes is a few facts (slot, since
when, entity, type, since when), and an action can be judged apart from its neighbours, against
the facts that are older than itself. ``judge`` finds the facts by rounds: judge the actions that could
establish one, take the earliest success of every slot by a partial aggregate, repeat until the facts
stay. A round is right up to the first fact that it adds, so the facts are those of the fold in order,
after as many rounds as facts that depend on one another (usually two or three). No history is
collected: the actions of one key can be any number, on any number of tasks.

The final state is then the last successful write of each attribute, and the ledger the last held observations.

Values are JSON texts; their types are those of their tokens (int and float differ, as do true and 1).
Keys and orders may be several columns; rows of a key whose order is the same are all judged by what
came before them. A null key is a key like any other. Null fields and patches count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.functions.scalars import zero_costs
from admitflow.session import discard, store

# Fixed values.
PENDING, TRUSTED, EMPTY = "pending_verification", "trusted", "empty"
STATUSES = (EMPTY, TRUSTED, PENDING)
MAX_SLOTS, LEDGER = 8, 4
OBSERVATION = "struct<field_id:string,value:string,source:string,observed_at:bigint,valid_from:bigint,entity:string>"
ACTION = "struct<decision:string,affected_fields:array<string>,patches:array<struct<op:string,field_id:string,value:string>>,verification:struct<tool:string,field_id:string>>"
SHAPE = "map<string,struct<entity:string,kind:string>>"

Rule = tuple[Column, str]


def kind_of(value: Column) -> Column:
    """Type of a JSON text: null, bool, int, float, str, list or dict."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | (v == "null"), "null")
        .when(v.isin("true", "false"), "bool")
        .when(F.startswith(v, F.lit('"')), "str")
        .when(F.startswith(v, F.lit("[")), "list")
        .when(F.startswith(v, F.lit("{")), "dict")
        .when(F.regexp_like(v, F.lit("^-?[0-9]+$")), "int")
        .otherwise("float")
    )


def first_broken(rules: list[Rule]) -> Column:
    """Message of the first rule whose condition holds."""
    return F.coalesce(*(F.when(broken, F.lit(message)) for broken, message in rules))


def first_of(items: Column, error: Callable[[Column], Column]) -> Column:
    """The first message among those of an array's items."""
    return F.get(F.filter(F.transform(items, error), lambda e: e.isNotNull()), F.lit(0))


def _hold_rules(patch: Column, affected: Column, shape: Column) -> list[Rule]:
    settles = (patch["op"] == "SET_STATUS") & (patch["value"] == f'"{PENDING}"')
    return [
        (~F.array_contains(affected, patch["field_id"]), "HOLD patch is outside affected fields"),
        (~F.coalesce(settles, F.lit(False)), "HOLD may only set pending status"),
        (~F.map_contains_key(shape, patch["field_id"]), "HOLD patch target does not exist"),
    ]


def _update_rules(patch: Column, affected: Column, obs: Column, shape: Column, full: Column) -> list[Rule]:
    op, field, kind = patch["op"], patch["field_id"], kind_of(patch["value"])
    there, slot = F.map_contains_key(shape, field), F.try_element_at(shape, field)
    told = obs.isNotNull() & op.isin("ADD_FIELD", "SET_VALUE")
    return [
        (~F.array_contains(affected, field), "UPDATE patch is outside affected fields"),
        ((op == "ADD_FIELD") & there, "ADD_FIELD target already exists"),
        ((op == "ADD_FIELD") & full, "no empty belief slot"),
        ((op != "ADD_FIELD") & ~there, "patch target does not exist"),
        (told & ~field.eqNullSafe(obs["field_id"]), "observation may only supply the matching field"),
        (told & there & ~slot["entity"].eqNullSafe(obs["entity"]), "observation entity does not match the target slot"),
        ((op == "SET_VALUE") & (slot["kind"] != "null") & (slot["kind"] != kind), "SET_VALUE type does not match the target slot"),
        ((op == "SET_STATUS") & ~F.coalesce(patch["value"].isin(*(f'"{s}"' for s in STATUSES)), F.lit(False)), "SET_STATUS value is invalid"),
        ((op == "SET_PROVENANCE") & (kind != "str"), "SET_PROVENANCE requires a string"),
        ((op == "SET_VALIDITY") & ~kind.isin("null", "int", "bool"), "SET_VALIDITY requires an integer or null"),
    ]


def action_error(action: Column, obs: Column, shape: Column, max_slots: int = MAX_SLOTS) -> Column:
    """Message of the first rule that the action breaks in a state of this shape (``SHAPE``); null if it may run."""
    none = lambda t: F.array().cast(t)
    affected = F.coalesce(action["affected_fields"], none("array<string>"))
    patches = F.coalesce(action["patches"], none("array<struct<op:string,field_id:string,value:string>>"))
    verify, decision = action["verification"], action["decision"]
    hold, ignore = decision == "HOLD", decision == "IGNORE"
    update = ~hold & ~ignore
    fields = F.transform(patches, lambda p: p["field_id"])
    full = F.size(shape) >= max_slots
    rules: list[Rule] = [
        (F.size(affected) != F.size(F.array_distinct(affected)), "affected fields must be unique"),
        (ignore & ((F.size(affected) > 0) | (F.size(patches) > 0) | verify.isNotNull()), "IGNORE must not carry fields, patches, or verification"),
        (~ignore & (F.size(affected) == 0), "non-IGNORE decisions require affected fields"),
        (hold & verify.isNotNull() & ~F.coalesce(F.array_contains(affected, verify["field_id"]), F.lit(False)), "verification target is outside affected fields"),
        (update & verify.isNotNull(), "UPDATE may not request verification"),
        (update & (F.size(patches) == 0), "UPDATE requires at least one patch"),
        (update & (F.size(fields) != F.size(F.array_distinct(fields))), "UPDATE patch fields must be unique"),
    ]
    held = first_of(patches, lambda p: first_broken(_hold_rules(p, affected, shape)))
    written = first_of(patches, lambda p: first_broken(_update_rules(p, affected, obs, shape, full)))
    return F.coalesce(first_broken(rules), F.when(hold, held).when(update, written))


def blocks_action(statuses: Column, dependent: Column, risk: Column, reversible: Column) -> Column:
    """Whether a risky action (high risk or not reversible) must wait: a dependent slot is missing or pending. statuses: map of slot to status."""
    waits = F.exists(dependent, lambda f: F.coalesce(F.try_element_at(statuses, f) == PENDING, F.lit(True)))
    return ((risk == "high") | ~reversible) & waits


def gold_value(patches: Column, field: Column, strict: bool = True) -> Column:
    """Value of the first SET_VALUE patch of the field. Without one, an error that names the field, or null if not strict."""
    own = F.get(F.filter(patches, lambda p: (p["op"] == "SET_VALUE") & (p["field_id"] == field)), F.lit(0))
    if not strict:
        return own["value"]
    lacking = F.raise_error(F.concat(F.lit("no SET_VALUE patch for "), F.coalesce(field, F.lit("null")))).cast("string")
    return F.when(own.isNull(), lacking).otherwise(own["value"])


def _rows(actions: DataFrame, keys: list[str], order: list[str], *more: str) -> DataFrame:
    """key, at (position; that of the initial state comes before all), action, obs and, packed, the columns asked for."""
    at = F.struct(F.lit(1).alias("after"), *(F.col(c) for c in order))
    return actions.select(F.struct(*keys).alias("key"), at.alias("at"), F.col("action").cast(ACTION).alias("action"), F.col("observation").cast(OBSERVATION).alias("obs"), *([F.struct(*more).alias("row")] if more else []))


def _beginning(actions: DataFrame, initial: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """The initial slots (keys, field_id, value, status, source, observed_at, valid_from, entity) with their position."""
    types = dict(actions.dtypes)
    if initial is None:
        schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", field_id string, value string, status string, source string, observed_at bigint, valid_from bigint, entity string"
        initial = actions.sparkSession.createDataFrame([], schema)
    first = F.struct(F.lit(0).alias("after"), *(F.lit(None).cast(types[c]).alias(c) for c in order))
    key = F.struct(*(F.col(k).cast(types[k]).alias(k) for k in keys))
    return initial.select(key.alias("key"), first.alias("at"), F.col("field_id").alias("field"), "value", "status", "source", F.col("observed_at").cast("bigint").alias("observed_at"), F.col("valid_from").cast("bigint").alias("valid_from"), "entity")


def _earliest(known: DataFrame) -> DataFrame:
    """Rows (key, field, entity, since, kind, kind_since; since is null where only a type is known) -> the facts of each slot."""
    settled = F.when(F.col("kind") != "null", F.struct("kind_since", "kind"))
    found = known.groupBy("key", "field").agg(F.min(F.when(F.col("since").isNotNull(), F.struct("since", "entity"))).alias("e"), F.min(settled).alias("k")).where("e is not null")
    return found.select("key", "field", F.col("e.entity").alias("entity"), F.col("e.since").alias("since"), F.coalesce("k.kind", F.lit("null")).alias("kind"), F.col("k.kind_since").alias("kind_since"))


def _error(max_slots: int) -> tuple[Column, Column]:
    """The shape at a row's position, from the column ``known``, and the error under it; built once, used by every round."""
    older = F.map_filter("known", lambda _, f: f["since"] < F.col("at"))
    kind = lambda f: F.when(f["kind_since"] < F.col("at"), f["kind"]).otherwise("null")
    shape = F.coalesce(F.transform_values(older, lambda _, f: F.struct(f["entity"].alias("entity"), kind(f).alias("kind"))), F.create_map().cast(SHAPE))
    return shape, action_error(F.col("action"), F.col("obs"), F.col("shape"), max_slots)


def _judged(rows: DataFrame, facts: DataFrame, error: tuple[Column, Column]) -> DataFrame:
    """rows with error, each judged against the facts older than itself. A key has about as many facts as slots."""
    maps = facts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("entity", "since", "kind", "kind_since")))).alias("known"))
    return rows.join(maps, "key", "left").withColumn("shape", error[0]).withColumn("error", error[1]).drop("known", "shape")


def _established(rows: DataFrame) -> DataFrame:
    """What the successful ones of the judged rows establish: new slots, and types of values."""
    p = rows.where("error is null").select("key", "at", "obs", F.explode("action.patches").alias("p"))
    added = F.col("p.op") == "ADD_FIELD"
    entity = F.when(F.col("obs").isNull(), "unknown").otherwise(F.col("obs.entity"))
    return p.where(F.col("p.op").isin("ADD_FIELD", "SET_VALUE")).select("key", F.col("p.field_id").alias("field"), F.when(added, entity).alias("entity"), F.when(added, F.col("at")).alias("since"), kind_of(F.col("p.value")).alias("kind"), F.col("at").alias("kind_since"))


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose facts are not the same."""
    digest = F.xxhash64("field", "entity", "since", "kind", "kind_since").cast("decimal(38,0)")
    a, b = (t.groupBy("key").agg(F.sum(digest).alias(n)) for t, n in ((before, "a"), (after, "b")))
    return a.join(b, "key", "full_outer").where("not a <=> b").select("key")


def history_facts(actions: DataFrame, initial: DataFrame | None, keys: list[str], order: list[str], error: tuple[Column, Column]) -> DataFrame:
    """key, field, entity, since, kind, kind_since: the facts of every key's history, as a stored table."""
    base = _beginning(actions, initial, keys, order).select("key", "field", "entity", F.col("at").alias("since"), kind_of(F.col("value")).alias("kind"), F.col("at").alias("kind_since"))
    facts = store(_earliest(base), "belief-facts")
    may = ~F.col("action.decision").isin("HOLD", "IGNORE") & F.exists("action.patches", lambda p: p["op"].isin("ADD_FIELD", "SET_VALUE"))
    candidates = store(_rows(actions, keys, order).where(may), "belief-candidates")
    active, keys_left = candidates, None
    while True:
        own = base if keys_left is None else base.join(keys_left, "key", "left_semi")
        found = _earliest(own.unionByName(_established(_judged(active, facts, error))))
        if keys_left is not None:
            found = found.unionByName(facts.join(keys_left, "key", "left_anti"))
        found = store(found, "belief-facts")
        keys_left = store(_changed(facts, found), "belief-keys")
        discard(facts)
        facts = found
        if keys_left.isEmpty():
            break
        active = candidates.join(keys_left, "key", "left_semi")
    discard(candidates)
    return facts


def judge(actions: DataFrame, initial: DataFrame | None, keys: list[str], order: list[str], max_slots: int = MAX_SLOTS) -> DataFrame:
    """actions (keys, order, action, observation, any others) with error, the message of the first broken rule, null where the action ran."""
    kept = [c for c in actions.columns if c != "error"]
    error = _error(max_slots)
    facts = history_facts(actions, initial, keys, order, error)
    return _judged(_rows(actions, keys, order, *kept), facts, error).select("row.*", "error")


def final_slots(judged: DataFrame, initial: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """keys, field_id, value, status, source, observed_at, valid_from, entity after all actions that ran: the last write of each attribute."""
    p = _rows(judged.where("error is null"), keys, order).select("key", "at", "obs", F.explode("action.patches").alias("p"))
    op, told = F.col("p.op"), F.col("obs").isNotNull()
    added, valued = op == "ADD_FIELD", op.isin("ADD_FIELD", "SET_VALUE")
    plain = F.get_json_object(F.concat(F.lit('{"v":'), F.col("p.value"), F.lit("}")), "$.v")
    number = F.when(plain == "true", 1).when(plain == "false", 0).otherwise(F.expr("try_cast(get_json_object(concat('{\"v\":', p.value, '}'), '$.v') as bigint)"))
    from_obs = lambda name, otherwise: F.when(told, F.col(f"obs.{name}")).otherwise(F.lit(otherwise))
    supplied = added | ((op == "SET_VALUE") & told)
    writes = p.select(
        "key",
        F.col("p.field_id").alias("field"),
        F.when(valued, F.struct("at", F.col("p.value").alias("v"))).alias("value"),
        F.when(valued, F.struct("at", F.lit(TRUSTED).alias("v"))).when(op == "SET_STATUS", F.struct("at", plain.alias("v"))).alias("status"),
        F.when(supplied, F.struct("at", from_obs("source", "unknown").alias("v"))).when(op == "SET_PROVENANCE", F.struct("at", plain.alias("v"))).alias("source"),
        F.when(supplied, F.struct("at", from_obs("observed_at", 0).cast("bigint").alias("v"))).alias("observed_at"),
        F.when(supplied, F.struct("at", from_obs("valid_from", None).cast("bigint").alias("v"))).when(op == "SET_VALIDITY", F.struct("at", number.cast("bigint").alias("v"))).alias("valid_from"),
        F.when(supplied, F.struct("at", from_obs("entity", "unknown").alias("v"))).alias("entity"),
    )
    names = ("value", "status", "source", "observed_at", "valid_from", "entity")
    begun = _beginning(judged, initial, keys, order)
    begun = begun.select("key", "field", *(F.struct("at", F.col(n).alias("v")).alias(n) for n in names))
    last = writes.unionByName(begun).groupBy("key", "field").agg(*(F.max(n).alias(n) for n in names))
    return last.select("key.*", F.col("field").alias("field_id"), *(F.col(f"{n}.v").alias(n) for n in names))


def ledger(judged: DataFrame, keys: list[str], order: list[str], capacity: int = LEDGER) -> DataFrame:
    """keys, order, place (1: oldest) and the observation's fields: the last held observations of each key."""
    held = _rows(judged.where("error is null"), keys, order).where("action.decision = 'HOLD' and obs is not null")
    latest = held.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))).where(F.col("n") <= capacity)
    size = latest.groupBy("key").agg(F.max("n").alias("size"))
    return latest.join(size, "key").select("key.*", *(F.col(f"at.{c}").alias(c) for c in order), (F.col("size") - F.col("n") + 1).alias("place"), "obs.*")


def admit_verifications(requests: DataFrame, keys: list[str], order: list[str], asked: Column, evidence: Column, fits: Column, budget: int) -> DataFrame:
    """requests with paid, budget_violation and misdirected.

    A request is paid for if it asks the right tool for the right field (fits) while the budget lasts; asking afterwards
    violates the budget, whatever is asked; asking wrongly although there is evidence is misdirected. Only the
    first ``budget`` fitting requests of a key are looked for, so none is sorted beyond them.
    """
    kept = [c for c in requests.columns if c not in ("paid", "budget_violation", "misdirected")]
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = requests.select(F.struct(*keys).alias("key"), F.struct(*order).alias("at"), flag(asked).alias("asked"), flag(evidence).alias("evidence"), flag(asked & fits).alias("fits"), F.struct(*kept).alias("row"))
    first = rows.where("fits").select("key", "at").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("n") <= budget)
    spent = first.where(F.col("n") == budget).select("key", F.col("at").alias("until"))
    dry = F.lit(True) if budget <= 0 else F.coalesce(F.col("at") > F.col("until"), F.lit(False))
    seen = rows.join(spent, "key", "left").withColumn("dry", dry)
    return seen.select("row.*", (F.col("fits") & ~F.col("dry")).alias("paid"), (F.col("asked") & F.col("dry")).alias("budget_violation"), (F.col("asked") & F.col("evidence") & ~F.col("fits")).alias("misdirected"))


def replayed(judged: DataFrame, key: str, order: str, gamma: float = 1.0) -> DataFrame:
    """judged with executed, reward, transition, success and the costs of a recorded history, replayed against its own last values.

    A slot agrees when it is trusted and holds the last value that the history sets it to; a step changes the agreement of
    one slot, so the agreement of the state is a running sum. Each step must have one patch. The reward is gamma times
    the agreement after the step less that before it, and one more at the end of a history that agrees fully.
    """
    p = judged.withColumns({"_field": F.get("action.patches", F.lit(0))["field_id"], "_value": F.get("action.patches", F.lit(0))["value"], "_sets": F.col("error").isNull() & (F.col("action.decision") == "UPDATE"), "executed": F.col("error").isNull()})
    last = p.where("_sets").groupBy(F.col(key).alias("_k"), F.col("_field").alias("_f")).agg(F.max_by("_value", order).alias("_last"))
    fields = last.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    ends = p.groupBy(F.col(key).alias("_k")).agg(F.max(order).alias("_end"))
    p = p.join(last, p[key].eqNullSafe(F.col("_k")) & p["_field"].eqNullSafe(F.col("_f")), "left").drop("_k", "_f")
    p = p.join(ends.join(fields, ends["_k"].eqNullSafe(fields["_k"]), "left").select(ends["_k"], "_end", "_n"), p[key].eqNullSafe(F.col("_k")), "left").drop("_k")
    good = F.when(F.col("executed"), (F.col("_sets") & (F.col("_value") == F.col("_last"))).cast("int"))
    slot, history = Window.partitionBy(key, "_field").orderBy(order), Window.partitionBy(key).orderBy(order)
    p = p.withColumn("_good", F.coalesce(F.last(good, ignorenulls=True).over(slot.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    p = p.withColumn("_gain", F.when(F.col("_last").isNotNull(), F.col("_good") - F.lag("_good", 1, 0).over(slot)).otherwise(0))
    share = lambda c: F.when(F.col("_n").isNull(), 1e0).otherwise(c.cast("double") / F.col("_n"))
    after = F.sum("_gain").over(history.rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumns({"_now": share(after), "_before": share(after - F.col("_gain"))})
    over = F.col(order) == F.col("_end")
    won = over & (F.col("_now") == 1)
    held = (F.col("action.decision") == "HOLD").cast("double")
    broken = F.col("error").isNotNull()
    costs = zero_costs() | {"stall": held, "invalid_patch": broken.cast("double"), "collateral_edit": F.coalesce(F.contains("error", F.lit("outside affected fields")), F.lit(False)).cast("double")}
    p = p.withColumns({"reward": gamma * F.col("_now") - F.col("_before") + won.cast("double"), "transition": F.when(over, "terminal").otherwise("next_event"), "success": won, **costs})
    return p.drop("_field", "_value", "_sets", "_last", "_end", "_n", "_good", "_gain", "_now", "_before")
