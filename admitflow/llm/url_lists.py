"""Operator 2, URL filters: temporal list join. SQL functions only.

Dated list entries (a key, "add" or "remove", a day) become validity intervals per list and
key; every capture is judged by the intervals that hold on its fetch day. A key is a host
(it covers its subdomains) or host/first-segment (it covers that part of the site).

Captures are first reduced to distinct (host, segment, day) triples, which carry the join;
verdicts are then attached to the captures. Intervals are cut at ``ERA_DAYS`` boundaries, and
key and era together are the join key, so a key with a long history does not meet all of its
captures. All joins are plain equi-joins, whose large partitions Spark splits.

Defined results: a capture without a host (null or malformed url) or without a day matches
nothing. On one day the last word is "remove". Entries with a null key or day, or another
action, are ignored. Repeated captures are judged alike, each in its own row. Extra columns
of the captures stay, whatever their names; those named like a result are replaced. A very long
url is matched whole. Without captures there are no rows, without entries nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERA_DAYS = 128
FAR = 1 << 30
RESULT = ("n_active", "longest_key", "blocked")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or leading www.; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def segment_of(url: Column) -> Column:
    """First path segment, empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def validity(events: DataFrame) -> DataFrame:
    """list, key, day, action -> list, key, since, until (exclusive; FAR while it holds)."""
    days = events.where("key is not null and day is not null and action in ('add', 'remove')").groupBy("list", "key", F.col("day").cast("int").alias("since")).agg(F.max(F.col("action") == "remove").alias("gone"))
    w = Window.partitionBy("list", "key").orderBy("since")
    days = days.withColumn("until", F.coalesce(F.lead("since").over(w), F.lit(FAR)))
    return days.where("not gone").select("list", "key", "since", "until")


def _keys(host: Column, segment: Column) -> Column:
    """The host, its parents, and those with the first segment."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.concat(hosts, F.when(segment != "", F.transform(hosts, lambda h: F.concat_ws("/", h, segment))).otherwise(F.array().cast("array<string>")))


def judge(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "fetch_day", era: int = ERA_DAYS) -> DataFrame:
    """captures with n_active (active list entries), longest_key (of those, the longest, then the first) and blocked."""
    captures = captures.drop(*(c for c in RESULT if c in captures.columns))
    keep = captures.columns
    rows = captures.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), segment_of(F.col(url)).alias("seg"), F.col(day).cast("int").alias("day"))
    fine = F.col("host").isNotNull() & F.col("day").isNotNull()
    triples = rows.where(fine).select("host", "seg", "day").distinct()
    spans = validity(events)
    edge = triples.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if edge.lo is not None:
        spans = spans.where((F.col("since") <= edge.hi) & (F.col("until") > edge.lo))
        last = F.least(F.col("until") - 1, F.lit(edge.hi))
        spans = spans.withColumn("era", F.explode(F.sequence(F.floor(F.greatest(F.col("since"), F.lit(edge.lo)) / era), F.floor(last / era))))
    else:
        spans = spans.where("false").withColumn("era", F.lit(0).cast("long"))
    asked = triples.withColumn("key", F.explode(F.array_distinct(_keys(F.col("host"), F.col("seg"))))).withColumn("era", F.floor(F.col("day") / era))
    hits = asked.join(spans, ["key", "era"]).where("day >= since and day < until")
    best = F.struct((-F.length("key")).alias("n"), F.col("key").alias("key"))
    found = hits.groupBy("host", "seg", "day").agg(F.count(F.lit(1)).alias("n_active"), F.min(best)["key"].alias("longest_key"))
    judged = rows.where(fine).join(found, ["host", "seg", "day"], "left")
    out = judged.unionByName(rows.where(~fine), allowMissingColumns=True)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "longest_key", (F.coalesce("n_active", F.lit(0)) > 0).alias("blocked"))
