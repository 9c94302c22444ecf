"""Structured Streaming: keyed folds over ordered events, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.session import scratch_path

BUDGET = 5
#: last value of each field as JSON, budget left, revision clock t and action clock k
STATE = "belief string, left int, t long, k long"
OUTPUT = "user_id long, n_revisions long, n_actions long, left int, belief string"


def fold_events(rows: list[tuple], state: tuple) -> tuple:
    """rows (event_id, event_type, value) in order. Every row is a revision; an error spends budget; other rows act while budget lasts and write their field."""
    import json

    belief, left, t, k = json.loads(state[0]), state[1], state[2], state[3]
    for _, kind, value in sorted(rows):
        t += 1
        if kind == "error":
            left = max(0, left - 1)
        elif left > 0:
            k += 1
            belief[kind] = round(value, 4)
    return json.dumps(belief, sort_keys=True), left, t, k


FRESH = ("{}", BUDGET, 0, 0)


def fold_batch(events: DataFrame) -> DataFrame:
    """The batch twin: one row per user after all of their events."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        belief, left, t, k = fold_events(list(zip(pdf["event_id"], pdf["event_type"], pdf["value"], strict=True)), FRESH)
        return pd.DataFrame([(key[0], t, k, left, belief)], columns=["user_id", "n_revisions", "n_actions", "left", "belief"])

    return events.select("user_id", "event_id", "event_type", "value").groupBy("user_id").applyInPandas(run, OUTPUT)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else FRESH
    rows = [r for pdf in frames for r in zip(pdf["event_id"], pdf["event_type"], pdf["value"], strict=True)]
    now = fold_events(rows, now)
    state.update(now)
    yield pd.DataFrame([(key[0], now[2], now[3], now[1], now[0])], columns=["user_id", "n_revisions", "n_actions", "left", "belief"])


def fold_stream(stream: DataFrame) -> DataFrame:
    """Updates per user and micro-batch. Files must arrive in event order."""
    return stream.select("user_id", "event_id", "event_type", "value").groupBy("user_id").applyInPandasWithState(_update, OUTPUT, STATE, "update", "NoTimeout")


def run_available(spark, path: str, schema) -> DataFrame:
    """Fold what the path holds as a stream, and return the last update of each user."""
    out, check = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-check")
    stream = fold_stream(spark.readStream.schema(schema).parquet(path))
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True)
    writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start().awaitTermination()
    got = spark.read.parquet(out)
    return got.groupBy("user_id").agg(F.max_by(F.struct("n_revisions", "n_actions", "left", "belief"), "batch").alias("s")).select("user_id", "s.*")


def windowed_counts(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and totals per window and type; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
