"""Joins: reconciliation, anti-joins, leak audits, and picking partners without enumerating pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.operators.sequences import grouped_ordinal
from admitflow.session import discard, store


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per key: how often it is on each side, and "matched", "missing" or "extra"."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    state = F.when(F.col("n_right").isNull(), "missing").when(F.col("n_left").isNull(), "extra").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), state.alias("state"))


def multiset_remaining(target: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of target less those of done, where positive: a bag difference by counts."""
    a = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    b = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    left = F.col("_a") - F.coalesce("_b", F.lit(0))
    return a.join(b, keys, "left").withColumn("remaining", left).where("remaining > 0").select(*keys, "remaining")


def split_leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def pick_other(rows: DataFrame, group: list[str], block: Column, ident: str, salt: Column, prefix: str = "other_", only: DataFrame | None = None) -> DataFrame:
    """For each row another row of its group with a different block value: number salt mod count in the order (block, ident).

    Rows of a group are numbered in that order; a row's own block is a run [first, first + size),
    so the wanted number is known without pairing: past the run, it moves up by its size. Rows
    whose group holds one block get nothing. Numbers come from a range-partitioned sort, so a
    group can be larger than a task; a row whose group has a null gets nothing. only: idents
    of the rows that ask, if not all do.
    """
    r = rows.withColumn("_block", block).withColumn("_salt", salt)
    numbered = grouped_ordinal(r, group, ["_block", ident], "_at")
    sizes = numbered.groupBy(*group, "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    totals = numbered.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"))
    asked = numbered.join(sizes, [*group, "_block"]).join(totals, group).where("_total > _size")
    if only is not None:
        asked = asked.join(only.select(ident), ident, "left_semi")
    i = F.pmod(F.col("_salt"), F.greatest(F.col("_total") - F.col("_size"), F.lit(1)))
    asked = asked.withColumn("_want", F.when(i < F.col("_first"), i).otherwise(i + F.col("_size")).cast("bigint"))
    there = numbered.select(*group, F.col("_at").cast("bigint").alias("_want"), *(F.col(c).alias(prefix + c) for c in rows.columns if c not in group))
    return asked.join(there, [*group, "_want"]).drop("_block", "_salt", "_at", "_first", "_size", "_total", "_want")


def fallback_donor(rows: DataFrame, levels: list[list[str]], value: str, ident: str, salt: Column) -> DataFrame:
    """ident, level, donor: the donor from the first level (list of equal columns) that has one with another value, else from the first level that has any other row.

    Two counts tell which of the waiting rows a level serves; only a level that serves some is sorted, and served rows wait no longer.
    """
    pool = store(rows.withColumns({"_all": F.lit(0), "_salt0": salt}), "donor-pool")
    waiting = store(pool.select(ident), "donor-waiting")
    parts, left = [], True
    for n, (block, keys) in enumerate((b, k) for b in (value, ident) for k in levels):
        group = keys or ["_all"]
        base = pool.select(*dict.fromkeys([*group, ident, value, "_salt0"]))
        sizes = base.groupBy(*group, F.col(block).alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
        totals = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"))
        served = base.withColumn("_b", F.col(block)).join(waiting, ident, "left_semi").join(sizes, [*group, "_b"]).join(totals, group).where("_total > _size").select(ident)
        served = store(served, "donor-served")
        if not served.isEmpty():
            got = pick_other(base, group, F.col(block), ident, F.col("_salt0"), only=served)
            parts.append(got.select(ident, F.lit(n).alias("level"), F.col(f"other_{ident}").alias("donor")))
            rest = store(waiting.join(served, ident, "left_anti"), "donor-waiting")
            discard(waiting)
            waiting, left = rest, not rest.isEmpty()
        if not left:
            break
    none = pool.select(ident, F.lit(0).alias("level"), F.col(ident).alias("donor")).limit(0)
    return reduce(DataFrame.unionByName, parts, none)


def cache_lookup(asked: DataFrame, cache: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(asked with value and hit, misses); of several cache rows of a key the first written counts."""
    first = cache.groupBy(key).agg(F.min_by("value", order).alias("value"))
    out = asked.join(first, key, "left").withColumn("hit", F.col("value").isNotNull())
    return out, asked.join(first, key, "left_anti")
