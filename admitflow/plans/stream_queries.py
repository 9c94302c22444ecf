"""Queries that run as streams, stopped and started again on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitflow.plans.catalogue import register
from admitflow.plans.common import table
from admitflow.session import scratch_path
from admitflow.streaming import two_clocks
from admitflow.streaming.late import LateWindows

#: Into how many arrivals a table is cut; the stream is started anew for each.
ARRIVALS = 3
_BUCKET = "CAST(floor((event_id + CASE WHEN event_id % 17 = 0 THEN {n} * 0.4e0 ELSE 0 END) * 3 / ({n} * 1.4e0)) AS BIGINT)"


def _arrivals(df, bucket, path):
    """Write the rows of one bucket after the other; yields when each is there."""
    for k in range(ARRIVALS):
        df.where(bucket == k).write.mode("append").parquet(path)
        yield k


@register(
    "late_windows",
    f"""WITH t AS (SELECT max(event_id) + 1 AS n FROM events), e AS (SELECT ts, event_type, value, {_BUCKET.format(n="(SELECT n FROM t)")} AS b FROM events),
    m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM e GROUP BY b)
    SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, coalesce(ts < mark, false) AS late, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN m ON e.b = m.b GROUP BY 1, 2, 3""",
)
def late_windows(spark, sf):
    """A seventeenth of the events arrives long after its time."""
    e = table(spark, sf, "events")
    n = e.agg(F.max("event_id")).first()[0] + 1
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    files, check = scratch_path(spark, "late-in"), scratch_path(spark, "late-check")
    windows = LateWindows(spark, scratch_path(spark, "late-out"), ["event_type"], "value", "1 hour", "1 hour")
    for _ in _arrivals(e, F.expr(_BUCKET.format(n=n)), files):
        windows.run(spark.readStream.schema(e.schema).parquet(files), check)
    return windows.counts().select((F.unix_timestamp("start") / 3600).cast("long").alias("hour"), "event_type", "late", "n", F.round("total", 4).alias("total"))


@register(
    "two_clock_loop",
    """WITH e AS (SELECT user_id, event_id, event_type, 'f' || (event_id % 11) AS f FROM events),
    s AS (SELECT user_id, f, since FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY since) AS rk FROM (SELECT user_id, f, min(event_id) AS since FROM e WHERE event_type = 'view' GROUP BY 1, 2) a) b WHERE rk <= 8),
    x AS (SELECT e.*, event_type IN ('error', 'view', 'signup') AS revises, s.since = event_id AS opens, CASE WHEN event_type = 'view' AND s.since IS NULL THEN 'no empty belief slot' WHEN event_type = 'error' AND coalesce(s.since > event_id, true) THEN 'HOLD patch target does not exist' END AS err,
      count(*) FILTER (WHERE event_type = 'purchase') OVER w AS asked FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.f = e.f WINDOW w AS (PARTITION BY e.user_id ORDER BY event_id)),
    y AS (SELECT *, event_type = 'click' OR (event_type = 'purchase' AND asked <= 2) AS takes FROM x),
    z AS (SELECT *, takes AND count(*) FILTER (WHERE takes) OVER (PARTITION BY user_id ORDER BY event_id) <= 5 AS acts FROM y)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, count(*) FILTER (WHERE revises) OVER w AS revision_t, count(*) FILTER (WHERE acts) OVER w AS action_k, greatest(0, 8 - count(*) FILTER (WHERE revises) OVER w) AS steps_left,
      5 - count(*) FILTER (WHERE acts) OVER w AS tool_left, 2 - count(*) FILTER (WHERE acts AND event_type = 'purchase') OVER w AS verification_left, count(*) FILTER (WHERE event_type = 'view' AND opens) OVER w AS n_slots,
      least(4, count(*) FILTER (WHERE event_type = 'error' AND err IS NULL) OVER w) AS n_held, CASE WHEN revises THEN err WHEN NOT acts THEN 'budget used up' END AS refused
    FROM z WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def two_clock_loop(spark, sf):
    kind = F.col("event_type")
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("seq"),
        F.when(kind.isin("error", "view", "signup"), "revise").otherwise("act").alias("kind"),
        F.when(kind == "error", "HOLD").when(kind == "view", "UPDATE").otherwise("IGNORE").alias("decision"),
        F.when(kind == "purchase", "verify").when(kind == "click", "look").otherwise(F.concat(F.lit("f"), (F.col("event_id") % 11).cast("string"))).alias("name"),
        F.col("value").cast("string").alias("value"),
    )
    n = e.agg(F.max("seq")).first()[0] + 1
    files, out, check = (scratch_path(spark, f"clocks-{x}") for x in ("in", "out", "check"))
    got = None
    for _ in _arrivals(e, F.floor(F.col("seq") * ARRIVALS / n), files):
        got = two_clocks.run(spark, files, out, check)
    held = F.when(F.col("held") == "", 0).otherwise(F.size(F.split("held", ","))).cast("long")
    return got.withColumn("n_held", held).drop("held")
