"""Quotas, schedules and the rule labeller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admitflow.functions.scalars import authoritative_source, secondary_source
from admitflow.operators.sequences import grouped_ordinal

# UPDATE, IGNORE and HOLD counts of each observation type, and HOLD rows to verify.
PREVIEW = {
    "new_consistent": (16, 3, 2), "explicit_conflict": (9, 6, 6), "implicit_conflict": (8, 6, 7), "stale": (8, 10, 3),
    "irrelevant": (4, 15, 2), "tool_error_or_low_trust": (8, 7, 6), "insufficient_or_ambiguous": (3, 2, 9),
}
FULL = {
    "new_consistent": (850, 50, 0), "explicit_conflict": (700, 100, 100), "implicit_conflict": (650, 100, 150), "stale": (700, 150, 50),
    "irrelevant": (0, 400, 500), "tool_error_or_low_trust": (800, 50, 50), "insufficient_or_ambiguous": (500, 50, 50),
}
VERIFY = {"preview": 21, "full": 900}
MACRO_SHARE = {"commerce": 50, "service": 30, "workflow": 20}
CLOCK = 1_750_000_000


def quota_cells(spark: SparkSession, kind: str = "preview") -> DataFrame:
    """position, observation_type, decision, action, count: VERIFY takes HOLD quota in order until it is used up, the rest is DEFER."""
    rows = [(i, t, *c) for i, (t, c) in enumerate((PREVIEW if kind == "preview" else FULL).items())]
    m = spark.createDataFrame(rows, "i int, observation_type string, update_n int, ignore_n int, hold_n int")
    before = F.coalesce(F.sum("hold_n").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    verify = F.least(F.col("hold_n"), F.greatest(F.lit(0), F.lit(VERIFY[kind]) - before))
    m = m.withColumn("v", verify)
    cells = F.array(
        *(F.struct(F.lit(j).alias("j"), F.lit(d).alias("decision"), F.lit(a).alias("action"), n.cast("int").alias("count")) for j, (d, a, n) in enumerate((("UPDATE", "NONE", F.col("update_n")), ("IGNORE", "NONE", F.col("ignore_n")), ("HOLD", "VERIFY", F.col("v")), ("HOLD", "DEFER", F.col("hold_n") - F.col("v")))))
    )
    return m.select("i", "observation_type", F.explode(cells).alias("c")).where("c.count > 0").select((F.col("i") * 4 + F.col("c.j")).alias("position"), "observation_type", "c.decision", "c.action", "c.count")


def quota_units(spark: SparkSession, total: int) -> DataFrame:
    """unit, observation_type, decision, action: one row per unit; below 140 a prefix of the preview, else 140 or 6000 exactly."""
    if total <= 0 or (total > 140 and total != 6000):
        raise ValueError("total must be 1 to 140, or 6000")
    cells = quota_cells(spark, "full" if total == 6000 else "preview")
    end = F.sum("count").over(Window.orderBy("position"))
    units = cells.withColumn("end", end).withColumn("unit", F.explode(F.sequence(F.col("end") - F.col("count") + 1, F.col("end"))))
    return units.where(F.col("unit") <= total).select("unit", "observation_type", "decision", "action")


def macro_targets(total: int) -> dict[str, int]:
    if total <= 0 or total % 20:
        raise ValueError("total must be a positive multiple of 20")
    return {k: total * share // 100 for k, share in MACRO_SHARE.items()}


def source_targets(total: int) -> list[int]:
    """Shares of 50, 25 and 15 percent and the rest."""
    first = [total * 50 // 100, total * 25 // 100, total * 15 // 100]
    return [*first, total - sum(first)]


def schedule(pool: DataFrame, total: int, ident: str) -> DataFrame:
    """macro, n (within it), decision, successor_of, ident, variant, observed_at: per macro 70 % UPDATE, 15 % HOLD, 15 % IGNORE; each HOLD is followed by the UPDATE that resolves it. pool: macro, ident."""
    spark = pool.sparkSession
    rows = []
    for macro, n in macro_targets(total).items():
        hold, ignore = n * 15 // 100, n * 15 // 100
        rows += [(macro, "HOLD", hold), (macro, "IGNORE", ignore), (macro, "UPDATE", n - 2 * hold - ignore)]
    counts = spark.createDataFrame(rows, "macro string, decision string, k int").where("k > 0")
    w = Window.partitionBy("macro").orderBy("decision")
    units = counts.withColumn("end", F.sum("k").over(w)).withColumn("i", F.explode(F.sequence(F.col("end") - F.col("k"), F.col("end") - 1))).select("macro", "decision", "i")
    ranked = grouped_ordinal(pool, ["macro"], [ident], "at")
    size = pool.groupBy("macro").agg(F.count(F.lit(1)).alias("size"))
    drawn = units.join(size, "macro").withColumn("at", F.pmod("i", "size").cast("int")).withColumn("variant", F.floor(F.col("i") / F.col("size")).cast("bigint")).join(ranked, ["macro", "at"])
    steps = F.when(F.col("decision") == "HOLD", F.array(F.struct(F.lit(0).alias("s"), F.lit("HOLD").alias("d")), F.struct(F.lit(1).alias("s"), F.lit("UPDATE").alias("d")))).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.col("decision").alias("d"))))
    out = drawn.withColumn("step", F.explode(steps))
    key = F.concat_ws("-", "macro", F.col("i").cast("string"))
    return out.select("macro", F.col("i").cast("bigint").alias("i"), F.col("step.s").alias("step"), F.col("step.d").alias("decision"), F.when(F.col("step.s") == 1, key).alias("successor_of"), ident, "variant", (F.lit(CLOCK) + 600 * F.col("i") + 300 * F.col("step.s")).cast("bigint").alias("observed_at"))


def label(df: DataFrame, kind: Column, decision: Column, domain: Column, source: Column, observed: Column, current_valid: Column) -> DataFrame:
    """df with what the decision table says of an observation: source, valid_from, condition, relevance, authority, authentication and risk."""
    is_ = lambda *ks: kind.isin(*ks)
    u, g, h = decision == "UPDATE", decision == "IGNORE", decision == "HOLD"
    hold_source = (
        F.when(is_("new_consistent", "explicit_conflict", "tool_error_or_low_trust"), secondary_source(domain))
        .when(is_("implicit_conflict"), "indirect_report").when(is_("stale"), "undated_cache")
        .when(is_("irrelevant"), "unverified_auxiliary_source").otherwise("ambiguous_report")
    )
    ignore_source = F.when(is_("implicit_conflict"), "uncorroborated_indirect_report").when(is_("tool_error_or_low_trust"), "tool_error_response").otherwise(source)
    update_source = F.when(is_("tool_error_or_low_trust"), "official_recovered_tool").when(is_("insufficient_or_ambiguous"), "official_corroborated_partial").otherwise(source)
    stale_from = F.when(u, current_valid + 5).when(g, F.greatest(F.lit(0), current_valid - 5))
    valid_from = F.when(is_("stale"), stale_from).when(is_("insufficient_or_ambiguous"), F.lit(None)).otherwise(observed)
    condition = (
        F.when(is_("new_consistent"), F.when(g, "duplicate_of_current_state").otherwise("applies_to_current_entity"))
        .when(is_("explicit_conflict"), F.when(g, "explicitly_different_entity").otherwise("explicit_value_conflict_with_current_state"))
        .when(is_("implicit_conflict"), "conflict_inferred_from_consequence")
        .when(is_("irrelevant"), F.when(u, "maintained_long_term_field_outside_active_subgoal").otherwise("outside_active_subgoal"))
        .when(is_("tool_error_or_low_trust"), "tool_reliability_requires_assessment")
        .when(is_("insufficient_or_ambiguous"), "partial_or_ambiguous_evidence").otherwise("applies_to_current_entity")
    )
    other_entity = g & is_("explicit_conflict")
    return df.withColumns({
        "obs_source": F.when(u, authoritative_source(domain, update_source)).when(h, hold_source).otherwise(ignore_source),
        "valid_from": valid_from.cast("bigint"),
        "condition": condition,
        "relevant": ~(g & is_("irrelevant", "insufficient_or_ambiguous")),
        "authority": F.when(u, "primary_record").when(h, "secondary").when(other_entity, "primary_record").otherwise("untrusted_or_inapplicable"),
        "authenticated": u | (~h & other_entity),
        "risk": F.when(h, "high").otherwise("medium"),
        "reversible": ~h,
    })
