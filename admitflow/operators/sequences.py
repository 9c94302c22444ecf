"""Ordered-sequence operators: indexes, folds over windows, ledgers, budgets, multipliers, quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_index(group: list[str], order: list[str]) -> Column:
    return (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint")


def contiguity(df: DataFrame, key: str, step: str) -> DataFrame:
    """Per key: whether its steps are exactly 0..n-1."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("n_steps"), ((F.min(step) == 0) & (F.max(step) == n - 1) & (F.count_distinct(step) == n)).alias("contiguous"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: a partial aggregate, no window over a hot key."""
    picked = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def potential_difference(phi: Column, group: list[str], order: list[str], gamma: float, initial: float = 0.0) -> Column:
    return F.lit(gamma) * phi - F.lag(phi, 1, initial).over(Window.partitionBy(*group).orderBy(*order))


def contamination_area(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Trapezoids of unit width; a single value is itself."""
    w = Window.partitionBy(key).orderBy(order)
    nxt = df.withColumn("_next", F.lead(value).over(w))
    return nxt.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).otherwise(F.sum((F.col(value) + F.col("_next")) / 2)).alias("area"))


def recovery_latency(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Steps from the first positive value to the first later one that is not; 0 if never positive, the series' length if it stays positive."""
    w = Window.partitionBy(key).orderBy(order)
    i = df.withColumn("_i", F.row_number().over(w)).withColumn("_first", F.min(F.when(F.col(value) > 0, F.col("_i"))).over(Window.partitionBy(key)))
    back = F.min(F.when((F.col("_i") > F.col("_first")) & (F.col(value) <= 0), F.col("_i")))
    first = F.max("_first")
    return i.groupBy(key).agg(F.when(first.isNull(), F.lit(0)).when(back.isNull(), F.count(F.lit(1))).otherwise(back - first).cast("bigint").alias("latency"))


def projected_multipliers(df: DataFrame, order: list[str], increment: Column, initial: float, group: list[str]) -> DataFrame:
    """max(0, previous + increment) along the order, in closed form: the running sum less its running minimum where that is below zero."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("_s", F.sum(increment).over(w))
    return s.withColumn("multiplier", F.greatest(F.lit(initial) + F.col("_s"), F.col("_s") - F.min("_s").over(w))).drop("_s")


def bounded_ledger(item: Column, group: list[str], order: list[str], capacity: int) -> Column:
    """The last capacity items up to the row, oldest first."""
    return F.collect_list(item).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(1 - capacity, 0))


def budget_left(start: int, spend: Column, group: list[str], order: list[str]) -> Column:
    """What is left after the row, never below 0."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.greatest(F.lit(0), F.lit(start) - F.sum(spend).over(w)).cast("bigint")


def last_write(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("last_value"))


def first_valid_wins(df: DataFrame, text: str, valid: str, order: str) -> DataFrame:
    """df with duplicate: an earlier valid row has the text. Invalid rows do not claim it."""
    first = df.where(F.col(valid)).groupBy(F.col(text).alias("_text")).agg(F.min(order).alias("_first"))
    return df.join(first, F.col(text) == F.col("_text"), "left").withColumn("duplicate", F.coalesce(F.col("_first") < F.col(order), F.lit(False))).drop("_text", "_first")


def apportion(df: DataFrame, weight: str, total: int, ties: list[Column]) -> DataFrame:
    """Largest remainders: integer shares of total in proportion to weight. df is a small table of categories."""
    sums = df.agg(F.sum(weight).alias("_sum"))
    raw = df.join(F.broadcast(sums), F.lit(True)).withColumn("_raw", F.col(weight) * F.lit(float(total)) / F.col("_sum")).withColumn("_floor", F.floor("_raw"))
    floors = raw.agg(F.sum("_floor").alias("_given"))
    rank = F.row_number().over(Window.orderBy((F.col("_raw") - F.col("_floor")).desc(), *ties))
    out = raw.join(F.broadcast(floors), F.lit(True)).withColumn("_rank", rank)
    return out.withColumn("allocated", (F.col("_floor") + (F.col("_rank") <= F.lit(total) - F.col("_given")).cast("int")).cast("bigint")).drop("_sum", "_raw", "_floor", "_given", "_rank")


def ordinal(df: DataFrame, order: list[str], out: str = "ordinal", buckets: int | None = None) -> DataFrame:
    """Global position from 0 without a single-partition window: range-partitioned sort, running counts per range, and the ranges' offsets (one row per partition). As many ranges as the session has shuffle partitions, unless told. The sorted rows stay cached; once the result is stored, release(result) lets them go."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).persist()
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())
    at, rows = 0, []
    for part, n in sizes:
        rows.append((part, at))
        at += n
    base = df.sparkSession.createDataFrame(rows, "_part long, _base long")
    numbered = ranged.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_in")).drop("_id", "_part", "_in", "_base")
    numbered._cached_rows = ranged
    return numbered


def release(numbered: DataFrame) -> None:
    """Let go of the rows that ordinal cached for its result."""
    numbered._cached_rows.unpersist()


def grouped_ordinal(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Position from 0 within each group, for groups of any size: the global position less that of the group's first row. Null keys are one group; the order must be total."""
    at = ordinal(df, [*group, *order], "_at_all")
    if not group:
        return at.withColumnRenamed("_at_all", out)
    first = at.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.min("_at_all").alias("_first_at"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)))
    return at.join(first, same).withColumn(out, F.col("_at_all") - F.col("_first_at")).select(*df.columns, out)


def group_cuts(n: int, train_fraction: float, dev_fraction: float) -> tuple[int, int]:
    """Of n shuffled groups, where dev and where test begin. No split is empty; ValueError below three groups or for fractions that leave no test."""
    if train_fraction <= 0 or dev_fraction < 0 or train_fraction + dev_fraction >= 1:
        raise ValueError("fractions must be positive and leave a test split")
    if n < 3:
        raise ValueError("three groups are needed for three splits")
    first = min(max(1, int(n * train_fraction)), n - 2)
    return first, min(first + max(1, int(n * dev_fraction)), n - 1)


def schedule_remaining(schedule: DataFrame, done: DataFrame, ident: str, order: list[str], done_order: list[str] | None = None) -> DataFrame:
    """The rows of schedule that follow those in done. ValueError unless the ids of done, in done_order, are the first ids of the schedule. Orders must be total."""
    planned = ordinal(schedule, order, "_at")
    stored = ordinal(done, done_order or order, "_at").select("_at", F.col(ident).alias("_stored"))
    n = stored.count()
    if n > planned.count():
        raise ValueError("there are more stored rows than the schedule has")
    odd = stored.join(planned.select("_at", F.col(ident).alias("_planned")), "_at").where(~F.col("_stored").eqNullSafe(F.col("_planned"))).orderBy("_at").first()
    if odd is not None:
        raise ValueError(f"stored row {odd['_at']} is {odd['_stored']}, the schedule has {odd['_planned']}")
    return planned.where(F.col("_at") >= n).drop("_at")
