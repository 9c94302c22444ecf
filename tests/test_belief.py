"""Belief operators: every rule and its order, histories of any length, the ledger and the gates."""

import json
import random

from pyspark.sql import functions as F

from admitflow.operators import belief as B

ROW = f"key string, seq long, action {B.ACTION}, observation {B.OBSERVATION}"
INITIAL = "key string, field_id string, value string, status string, source string, observed_at long, valid_from long, entity string"


def act(decision, *patches, fields=("f",), verify=None):
    return (decision, list(fields), [(op, field, value) for op, field, value in patches], verify)


def obs(field="f", entity="e", value="5", at=9):
    return (field, value, "api", at, at, entity)


def start(*slots):
    """(field, value, entity) of key k."""
    return [("k", f, v, "trusted", "s", 1, None, e) for f, v, e in slots]


def judged(spark, rows, slots, max_slots=8):
    actions = spark.createDataFrame([("k", i, a, o) for i, (a, o) in enumerate(rows)], ROW)
    initial = spark.createDataFrame(slots, INITIAL)
    return B.judge(actions, initial, ["key"], ["seq"], max_slots), initial


def test_each_rule_and_the_state_it_leaves(spark):
    cases = [
        (act("IGNORE", fields=()), obs(), None),
        (act("IGNORE"), obs(), "IGNORE must not carry fields, patches, or verification"),
        (act("UPDATE", ("SET_VALUE", "f", "1"), fields=("f", "f")), None, "affected fields must be unique"),
        (act("UPDATE", ("SET_VALUE", "f", "1"), fields=()), None, "non-IGNORE decisions require affected fields"),
        (act("HOLD", verify=("t", "z")), obs(), "verification target is outside affected fields"),
        (act("HOLD", ("SET_STATUS", "g", '"pending_verification"')), obs(), "HOLD patch is outside affected fields"),
        (act("HOLD", ("SET_VALUE", "f", "1")), obs(), "HOLD may only set pending status"),
        (act("HOLD", ("SET_STATUS", "g", '"pending_verification"'), fields=("g",)), obs(), "HOLD patch target does not exist"),
        (act("UPDATE", ("SET_VALUE", "f", "1"), verify=("t", "f")), None, "UPDATE may not request verification"),
        (act("UPDATE"), None, "UPDATE requires at least one patch"),
        (act("UPDATE", ("SET_VALUE", "f", "1"), ("SET_STATUS", "f", '"trusted"')), None, "UPDATE patch fields must be unique"),
        (act("UPDATE", ("SET_VALUE", "g", "1")), None, "UPDATE patch is outside affected fields"),
        (act("UPDATE", ("ADD_FIELD", "f", "1")), None, "ADD_FIELD target already exists"),
        (act("UPDATE", ("SET_VALUE", "g", "1"), fields=("g",)), None, "patch target does not exist"),
        (act("UPDATE", ("SET_VALUE", "f", "1")), obs("h"), "observation may only supply the matching field"),
        (act("UPDATE", ("SET_VALUE", "f", "1")), obs(entity="z"), "observation entity does not match the target slot"),
        (act("UPDATE", ("SET_VALUE", "f", "true")), None, "SET_VALUE type does not match the target slot"),
        (act("UPDATE", ("SET_VALUE", "f", "1.0")), None, "SET_VALUE type does not match the target slot"),
        (act("UPDATE", ("SET_STATUS", "f", '"odd"')), None, "SET_STATUS value is invalid"),
        (act("UPDATE", ("SET_PROVENANCE", "f", "3")), None, "SET_PROVENANCE requires a string"),
        (act("UPDATE", ("SET_VALIDITY", "f", '"x"')), None, "SET_VALIDITY requires an integer or null"),
        (act("UPDATE", ("SET_VALIDITY", "f", "true")), None, None),
        (act("UPDATE", ("SET_PROVENANCE", "f", '"by \\"hand\\""')), None, None),
        (act("UPDATE", ("ADD_FIELD", "n", "null"), fields=("n",)), obs("n"), None),
        (act("UPDATE", ("ADD_FIELD", "m", "1"), fields=("m",)), None, "no empty belief slot"),
        (act("UPDATE", ("SET_VALUE", "n", '"s"'), fields=("n",)), None, None),
        (act("UPDATE", ("SET_VALUE", "n", "1"), fields=("n",)), None, "SET_VALUE type does not match the target slot"),
        (act("HOLD", ("SET_STATUS", "n", '"pending_verification"'), fields=("n",)), obs("n"), None),
    ]
    done, initial = judged(spark, [(a, o) for a, o, _ in cases], start(("f", "0", "e")), 2)
    assert [r.error for r in done.orderBy("seq").collect()] == [e for _, _, e in cases]
    slots = {r.field_id: r for r in B.final_slots(done, initial, ["key"], ["seq"]).collect()}
    f, n = slots["f"], slots["n"]
    assert (f.value, f.status, f.source, f.observed_at, f.valid_from, f.entity) == ("0", "trusted", 'by "hand"', 1, 1, "e")
    assert (n.value, n.status, n.source, n.observed_at, n.valid_from, n.entity) == ('"s"', "pending_verification", "api", 9, 9, "e")


def test_ledger_keeps_the_last_held(spark):
    rows = [(act("HOLD"), obs(value=str(i), at=i) if i != 3 else None) for i in range(6)] + [(act("HOLD", verify=("t", "z")), obs(value="bad"))]
    done, _ = judged(spark, rows, start(("f", "0", "e")))
    got = B.ledger(done, ["key"], ["seq"], 4).orderBy("place").collect()
    assert [(r.place, r.value, r.seq) for r in got] == [(1, "1", 1), (2, "2", 2), (3, "4", 4), (4, "5", 5)]


def plain_fold(rows, cap):
    """One action after another, for actions of ADD_FIELD and SET_VALUE only."""
    slots, errors = {}, []
    for (_, fields, patches, _), o in rows:
        error = None
        for op, field, value in patches:
            kind = type(json.loads(value))
            if field not in fields:
                error = "UPDATE patch is outside affected fields"
            elif op == "ADD_FIELD" and field in slots:
                error = "ADD_FIELD target already exists"
            elif op == "ADD_FIELD" and len(slots) >= cap:
                error = "no empty belief slot"
            elif op == "SET_VALUE" and field not in slots:
                error = "patch target does not exist"
            elif o and o[0] != field:
                error = "observation may only supply the matching field"
            elif o and field in slots and slots[field][1] != o[5]:
                error = "observation entity does not match the target slot"
            elif op == "SET_VALUE" and slots[field][0] not in (kind, type(None)):
                error = "SET_VALUE type does not match the target slot"
            if error:
                break
        errors.append(error)
        for op, field, value in patches if not error else ():
            slots[field] = (type(json.loads(value)), (o[5] if o else "unknown") if op == "ADD_FIELD" else slots[field][1], value)
    return errors, {f: s[2] for f, s in slots.items()}


def test_a_long_history_of_one_key(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "d", "e", "f"]
    rows = []
    for _ in range(1500):
        picked = rng.sample(names, rng.choice([1, 1, 1, 2]))
        patches = [(rng.choice(["ADD_FIELD", "SET_VALUE", "SET_VALUE"]), f, rng.choice(["1", "2.5", '"x"', "null", "true", "[1]"])) for f in picked]
        rows.append((act("UPDATE", *patches, fields=picked), obs(picked[0], rng.choice(["e", "e", "z"])) if rng.random() < 0.5 else None))
    want, slots = plain_fold(rows, 4)
    actions = spark.createDataFrame([(None, i, a, o, "x", i) for i, (a, o) in enumerate(rows)], ROW + ", error string, known long").repartition(6)
    done = B.judge(actions, None, ["key"], ["seq"], 4)
    assert [r.error for r in done.orderBy("seq").collect()] == want
    assert {r.field_id: r.value for r in B.final_slots(done, None, ["key"], ["seq"]).collect()} == slots
    assert done.columns == ["key", "seq", "action", "observation", "known", "error"]


def test_no_actions(spark):
    done, initial = judged(spark, [], start(("f", "0", "e")))
    assert done.count() == 0 and B.final_slots(done, initial, ["key"], ["seq"]).count() == 1
    assert B.ledger(done, ["key"], ["seq"]).count() == 0


def test_gate(spark):
    statuses = F.create_map(F.lit("f"), F.lit("trusted"), F.lit("p"), F.lit("pending_verification"))
    gate = lambda fields, risk, reversible: B.blocks_action(statuses, F.array(*map(F.lit, fields)), F.lit(risk), F.lit(reversible))
    cases = [(["f", "gone"], "high", True, True), (["f"], "high", True, False), (["p"], "low", True, False), (["p"], "low", False, True), (["gone"], "high", False, True), (["f"], "low", False, False)]
    got = spark.range(1).select(*(gate(f, r, v).alias(f"c{i}") for i, (f, r, v, _) in enumerate(cases))).first()
    assert list(got) == [w for *_, w in cases]


def test_admission_of_verifications(spark):
    rows = [("k", i, asked, ev, fits) for i, (asked, ev, fits) in enumerate([(True, True, True), (True, True, False), (True, False, None), (False, True, True), (True, True, True), (True, True, True), (None, True, True), (True, True, False)])]
    df = spark.createDataFrame(rows, "key string, seq long, a boolean, e boolean, paid boolean")
    got = B.admit_verifications(df.withColumnRenamed("paid", "fits"), ["key"], ["seq"], F.col("a"), F.col("e"), F.col("fits"), 2).orderBy("seq").collect()
    assert [r.paid for r in got] == [True, False, False, False, True, False, False, False]
    assert [r.budget_violation for r in got] == [False] * 5 + [True, False, True]
    assert [r.misdirected for r in got] == [False, True, False, False, False, False, False, True]
    none = B.admit_verifications(df, ["key"], ["seq"], F.col("a"), F.col("e"), F.lit(True), 0).collect()
    assert not any(r.paid for r in none)
