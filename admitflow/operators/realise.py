"""Batched requests to a text generator, with an append-only cache: each request is answered once, across tasks and runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import scalars as S
from admitflow.operators.sequences import ordinal
from admitflow.session import discard, ship, store
from admitflow.sources.sinks import AppendLog

LOG = "digest string, answer string, prompt_tokens long, answer_tokens long"


def requests_of(records: DataFrame, batch: int, prompt_version: str, model: str, ident: str = "record_id", payload: str = "prompt") -> DataFrame:
    """request (number), digest, records (array of struct record_id, payload; batch of them at most): records in the order of their ids."""
    rows = ordinal(records.select(F.col(ident).cast("string").alias("record_id"), F.col(payload).cast("string").alias("payload")), ["record_id"], "at")
    grouped = rows.groupBy(F.floor(F.col("at") / batch).alias("request")).agg(F.array_sort(F.collect_list(F.struct("record_id", "payload"))).alias("records"))
    return grouped.withColumn("digest", S.request_digest(F.lit(prompt_version), F.lit(model), F.col("records")))


def echo(records: list[dict]) -> str:
    """The deterministic stand-in for a generator: it repeats the payloads, as JSON in a fence."""
    told = [{"record_id": r["record_id"], "observation_text": r["payload"]} for r in records]
    return "```json\n" + json.dumps({"records": told}, ensure_ascii=False) + "\n```"


def _generated(generate: Callable[[list[dict]], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(1).to_pylist()
            answers = [generate(records) for records in asked]
            asks = [sum(len((r["payload"] or "").split()) for r in records) for records in asked]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(asks, pa.int64()), pa.array([len(a.split()) for a in answers], pa.int64())], ["digest", "answer", "prompt_tokens", "answer_tokens"])

    return run


def realise(records: DataFrame, log: AppendLog, run_id: int, batch: int = 25, prompt_version: str = "v1", model: str = "echo", generate: Callable[[list[dict]], str] = echo, ident: str = "record_id", payload: str = "prompt") -> DataFrame:
    """record_id, observation_text, digest, cached (whether an earlier run answered). ValueError if an answer doesn't give each record asked for exactly once.

    Only requests that the log lacks are sent, one task's after another, and their answers appended as batch run_id
    before any is used; a run that is repeated finds its own answers and sends nothing. records: ids without repeats.
    """
    spark = records.sparkSession
    ship(spark)
    asked = store(requests_of(records, batch, prompt_version, model, ident, payload), "realise-asked")
    misses = asked.dropDuplicates(["digest"]).join(log.rows().select("digest"), "digest", "left_anti")
    if not misses.isEmpty():
        fresh = store(misses.select("digest", "records").mapInArrow(_generated(generate), LOG), "realise-fresh")
        log.append(fresh, run_id)
        discard(fresh)
    answers = log.rows().select("digest", "answer", (F.col("batch") < run_id).alias("cached"))
    told = asked.join(answers, "digest").withColumn("told", S.answers_of(F.col("answer")))
    complete = S.answers_complete(F.col("told"), F.transform("records", lambda r: r["record_id"]))
    bad = told.where(~complete).select("digest").limit(1).collect()
    if bad:
        raise ValueError(f"the answer to request {bad[0][0]} does not give each record once")
    return told.select("digest", "cached", F.explode("told").alias("t")).select("t.record_id", "t.observation_text", "digest", "cached")
