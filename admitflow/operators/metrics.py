"""Aggregates: decision metrics, group statistics, policy-gradient losses, trajectories."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions.scalars import clipped_ratio, probability_ratio, safe_div
from admitflow.session import ship

DECISIONS = ("UPDATE", "HOLD", "IGNORE")


def decision_metrics(df: DataFrame, truth: str, predicted: str, classes=DECISIONS, positive: str = "UPDATE") -> DataFrame:
    """One row: accuracy, macro_f1 (plain mean over classes), false_update_rate, missed_update_rate, n; a zero denominator gives 0."""
    t, p = F.col(truth), F.col(predicted)
    n = lambda cond: F.count_if(cond).cast("double")
    sums = [F.count(F.lit(1)).alias("n"), n(t == p).alias("right"), n((t != positive) & (p == positive)).alias("fu"), n(t != positive).alias("not_pos"), n((t == positive) & (p != positive)).alias("mu"), n(t == positive).alias("pos")]
    for i, c in enumerate(classes):
        sums += [n((t == c) & (p == c)).alias(f"tp{i}"), n((t != c) & (p == c)).alias(f"fp{i}"), n((t == c) & (p != c)).alias(f"fn{i}")]
    s = df.agg(*sums)
    f1 = []
    for i in range(len(classes)):
        tp, fp, fn = (F.col(f"{k}{i}") for k in ("tp", "fp", "fn"))
        f1.append(safe_div(2 * tp, 2 * tp + fp + fn))
    return s.select(
        "n",
        safe_div(F.col("right"), F.col("n")).alias("accuracy"),
        (sum(f1, F.lit(0e0)) / len(classes)).alias("macro_f1"),
        safe_div(F.col("fu"), F.col("not_pos")).alias("false_update_rate"),
        safe_div(F.col("mu"), F.col("pos")).alias("missed_update_rate"),
    )


def masked_micro_f1(df: DataFrame, truth: str, predicted: str, mask: str) -> DataFrame:
    """Micro-F1 over positions of equal-length flag arrays whose mask is set, and how many those are."""
    cells = df.select(F.explode(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p"), F.col(mask).alias("m"))).alias("c")).where("c.m = 1")
    tp, fp, fn = (F.count_if(x) for x in ((F.col("c.t") == 1) & (F.col("c.p") == 1), (F.col("c.t") == 0) & (F.col("c.p") == 1), (F.col("c.t") == 1) & (F.col("c.p") == 0)))
    return cells.agg(F.count(F.lit(1)).alias("n"), safe_div(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def all_first_k(df: DataFrame, task: str, trial: str, ok: str, k: int) -> DataFrame:
    """pass^k: of the tasks with k trials or more, the share whose first k all succeed; 0 if none."""
    per = df.where(F.col(trial) <= k).groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("all_ok")).where(F.col("n") == k)
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.coalesce(F.avg(F.col("all_ok").cast("double")), F.lit(0e0)).alias("pass_k"))


def rates_with_total(df: DataFrame, group: str, counters: list[str], denominator: str) -> DataFrame:
    """Per group and for all ("all"): each counter over the denominator, which is at least 1."""
    agg = df.groupingSets([[], [F.col(group)]], F.col(group)).agg(F.grouping(group).alias("g"), *(F.sum(c).alias(c) for c in {*counters, denominator}))
    floor = F.greatest(F.col(denominator), F.lit(1))
    return agg.select(F.when(F.col("g") == 1, "all").otherwise(F.col(group).cast("string")).alias("domain"), *((F.col(c) / floor).alias(f"{c}_rate") for c in counters))


def group_advantages(df: DataFrame, group: str, value: str, eps: float = 1e-6, out: str = "advantage") -> DataFrame:
    """(value - mean) / (population deviation + eps) within a group; 0 in groups of one. One shuffle to sums, then a join whose large groups Spark splits."""
    stats = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    score = F.when(F.col("_n") < 2, F.lit(0e0)).otherwise((F.col(value) - F.col("_m")) / (F.col("_s") + F.lit(eps)))
    return df.join(stats, group).withColumn(out, score).drop("_n", "_m", "_s")


def surrogate_loss(new: Column, old: Column, advantage: Column, eps: float) -> Column:
    """Aggregate: minus the mean of min(ratio * A, clipped ratio * A)."""
    return -F.avg(F.least(probability_ratio(new, old) * advantage, clipped_ratio(new, old, eps) * advantage))


def sampled_kl(policy: Column, reference: Column) -> Column:
    d = reference - policy
    return F.avg(F.exp(F.least(F.greatest(d, F.lit(-20e0)), F.lit(20e0))) - d - 1)


def trajectory_totals(df: DataFrame, key: str, step: str, reward: str, costs: list[str], gamma: float, per_event: bool = False) -> DataFrame:
    """Per trajectory: discounted return, number of events and summed costs (or their mean per event). step counts from 0."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(F.sum(F.pow(F.lit(gamma), F.col(step)) * F.col(reward)).alias("episode_return"), n.alias("n_events"), *((F.sum(c) / n if per_event else F.sum(c)).alias(c) for c in costs))


#: Weights are drawn as (A + sample * B) modulo this prime, A and B from a digest of the row: independent between rows, pairwise between samples.
_PRIME = (1 << 31) - 1
_BLOCK_ROWS = 512


def _poisson_cuts() -> list[int]:
    """Weight k is drawn below the (k+1)th of these: the distribution function of Poisson(1), in units of 1 / _PRIME."""
    out, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        out.append(math.floor(total * _PRIME))
        p /= k + 1
    return out


def _weighted_sums(samples: int):
    """Rows (a, b, v) -> per sample the sum of the weights and of the weighted values; a task emits one row per sample."""
    cuts = np.array(_poisson_cuts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.arange(1, samples + 1, dtype=np.int64)
        weights, sums, seen = np.zeros(samples, np.int64), np.zeros(samples), False
        for batch in batches:
            a, b, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(0, len(v), _BLOCK_ROWS):
                at, seen = slice(i, i + _BLOCK_ROWS), True
                w = np.searchsorted(cuts, (a[at, None] + b[at, None] * n) % _PRIME, side="right")
                weights += w.sum(axis=0)
                sums += v[at] @ w
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(weights), pa.array(sums)], ["sample", "w", "wv"])

    return run


def bootstrap_interval(df: DataFrame, value: str, samples: int, confidence: float, seed: int, ident: str | None = None) -> DataFrame:
    """low, high: the percentile interval of resampled means.

    Resamples are Poisson-weighted, so no row moves: each task keeps a vector of weighted sums and emits one row per sample.
    The weights of a row follow from the seed and ident (a column without repeats), or else from the row's place, so
    that equal rows draw weights of their own.
    """
    ship(df.sparkSession)
    key = F.col(ident).cast("string") if ident else F.monotonically_increasing_id().cast("string")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))))
    draw = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") % _PRIME
    rows = df.select(draw(1).alias("a"), draw(17).alias("b"), F.col(value).cast("double").alias("v"))
    sums = rows.mapInArrow(_weighted_sums(samples), "sample long, w long, wv double").groupBy("sample").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))
    means = sums.select((F.col("wv") / F.greatest(F.col("w"), F.lit(1))).alias("m"))
    a = (1 - confidence) / 2
    return means.agg(F.percentile("m", a).alias("low"), F.percentile("m", 1 - a).alias("high"))


def bootstrap_mean_interval(df: DataFrame, value: str, seed: int, samples: int = 2000, confidence: float = 0.95, ident: str | None = None) -> DataFrame:
    """mean, low, high: the mean of all rows and the percentile interval of its resamples. Null values are passed over; without any value all three are null."""
    rows = df.where(F.col(value).isNotNull())
    return rows.agg(F.avg(F.col(value).cast("double")).alias("mean")).crossJoin(bootstrap_interval(rows, value, samples, confidence, seed, ident))


def exact_bootstrap(values, seed: int, samples: int, confidence: float) -> tuple[float, float]:
    """The sequential form over a bounded driver-side vector: PCG64 index draws, linear quantiles."""
    v = np.asarray(values, dtype=np.float64)
    if not len(v):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = v[rng.integers(0, len(v), size=(samples, len(v)))].mean(axis=1)
    a = (1 - confidence) / 2
    return float(np.quantile(means, a)), float(np.quantile(means, 1 - a))


def binary_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.agg(*(F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0e0)).alias(f"{f}_rate") for f in flags))


def threshold_gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """rules: metric, op (min, min_exclusive, max), bound; metrics: metric, value. A missing metric fails; an unknown op is an error."""
    v, b = F.col("value"), F.col("bound")
    ok = F.when(F.col("op") == "min", v >= b).when(F.col("op") == "min_exclusive", v > b).when(F.col("op") == "max", v <= b).otherwise(F.raise_error(F.concat(F.lit("unknown operator "), F.col("op"))).cast("boolean"))
    return rules.join(metrics, "metric", "left").select("metric", "op", "bound", "value", F.coalesce(F.when(v.isNull(), F.lit(False)).otherwise(ok), F.lit(False)).alias("passed"))


def checkpoint_score(row: str | None = None) -> Column:
    """The four F1 less twice the false update rate; absent (null) metrics count as 0. row: a struct that holds them, else the columns do."""
    m = lambda name: F.coalesce(F.col(f"{row}.{name}" if row else name).cast("double"), F.lit(0e0))
    return m("decision_macro_f1") + m("affected_micro_f1") + m("verification_f1") + m("patch_operation_micro_f1") - F.lit(2e0) * m("false_update_rate")


def dev_score(success: Column, false_updates: Column, invalid_format: Column) -> Column:
    return success - false_updates - invalid_format


def best_checkpoint(df: DataFrame, group: list[str], step: str, score: Column) -> DataFrame:
    """group, step, score: the first step of the highest score; null scores are passed over."""
    order = F.struct(F.col("_score"), -F.col("_step"))
    scored = df.select(*group, F.col(step).cast("long").alias("_step"), score.alias("_score")).where("_score is not null")
    best = scored.groupBy(*group).agg(F.max(order).alias("_b"))
    return best.select(*group, (-F.col("_b.col2")).alias(step), F.col("_b._score").alias("score"))
