"""Columns with names of the operators' own, null and repeated ids, very long texts."""

import hashlib
import random
import re
import time

import pytest

from admitflow.llm import jaccard_join, quality_crf, randomness_scan, run_length_dedup, url_lists

OWN = "_af_row _af_key _af_th _af_spans _af_kept _af_n_bytes _af_n_removed _af_base _af_cands _af_seg _af_host _af_day row base spans candidates host seg day key th rep label n_words kept".split()
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in OWN)
LONG = "the quick brown fox jumps over a lazy dog while nine grey owls watch from the old oak and say nothing at all to anyone " * 5


def documents(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), *(f"{c}:{i}" for c in OWN)) for i, t in rows], SCHEMA)


def same_columns(before, after, changed=()):
    kept = [c for c in before.columns if c not in changed]
    assert after.columns == before.columns
    want = {r.doc_id: r for r in before.select(kept).collect()}
    for r in after.collect():
        assert all(r[c] == want[r.doc_id][c] for c in kept)


ROWS = [(1, LONG), (2, LONG + "x"), (3, "password = abcdef0123456789 and a word"), (4, None), (5, "")]


def test_columns_of_any_name_survive_one_of_each(spark):
    df = documents(spark, ROWS)
    same_columns(df, jaccard_join.one_of_each(df))
    again = documents(spark, [*ROWS, (1, "another text that shares an id with the first one of them")])
    got = jaccard_join.one_of_each(again)
    assert got.columns == again.columns and {r._af_row for r in got.where("doc_id = 3").collect()} == {"_af_row:3"}


def test_columns_of_any_name_survive_strip_and_redact(spark):
    df = documents(spark, ROWS)
    same_columns(df, run_length_dedup.strip(df, 64), ("text", "n_chars"))
    same_columns(df, randomness_scan.redact(df), ("text", "n_chars"))
    assert randomness_scan.redact(df).where("doc_id = 3").first().text == "[assign] and a word"


def test_columns_of_any_name_survive_line_labels_and_url_lists(spark):
    df = documents(spark, ROWS)
    crf = quality_crf.fit_line_crf(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    got = quality_crf.label_lines(df, crf)
    assert {r._af_row for r in got.collect()} == {f"_af_row:{i}" for i in range(1, 6)}
    caps = df.selectExpr("*", "'http://a.example/x/y' AS url", "7 AS fetch_day")
    events = spark.createDataFrame([("l", "a.example/x", 3, "add")], "list string, key string, day int, action string")
    judged = url_lists.judge(caps, events)
    same_columns(caps, judged.select(*caps.columns))
    assert all(r.blocked and r.longest_key == "a.example/x" for r in judged.collect())


def test_null_and_repeated_ids_in_the_run_length_index(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(300)}" for _ in range(4000)]
    shared = " ".join(words[:60])
    texts = [" ".join(rng.choice(words) for _ in range(30)) + " " + (shared if i % 3 == 0 else "") for i in range(150)] + [LONG] * 40

    def digest(ids):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
        return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run_length_dedup.report(df, 64).collect())

    unique = digest(list(range(len(texts))))
    assert sum(r[1] for r in unique) > 0
    assert digest([None] * len(texts)) == unique
    assert digest([i % 2 for i in range(len(texts))]) == unique


def brute_exposed(spans, base):
    held = lambda a, z: all(any(b <= p < e for b, e in base) for p in range(a, z))
    return [(a, z) for a, z in spans if not held(a, z)]


@pytest.mark.parametrize("block", [2, 200])
def test_spans_held_by_base_spans(spark, block, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(randomness_scan, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for i in range(60):
        base = sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(12))))
        spans, at = [], 0
        for _ in range(rng.randrange(8)):
            at += rng.randrange(0, 9)
            spans.append((at, at + rng.randrange(1, 7)))
            at = spans[-1][1]
        rows.append((i, [(a, 3, z) for a, z in spans], [(a, rng.randrange(3), z) for a, z in base]))
    kind = "array<struct<start:bigint,rank:int,end:bigint>>"
    df = spark.createDataFrame(rows, f"i int, s {kind}, b {kind}")
    got = {r.i: [(x.start, x.end) for x in r.o] for r in df.select("i", randomness_scan._exposed(F.col("s"), F.col("b")).alias("o")).collect()}
    assert got == {i: brute_exposed([(a, z) for a, _, z in s], [(a, z) for a, _, z in b]) for i, s, b in rows}


def test_a_text_with_very_many_secrets(spark):
    rng = random.Random(5)
    runs = [hashlib.md5(str(rng.random()).encode()).hexdigest() for _ in range(30_000)]
    text = "é" + " \n".join(runs) + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    r = randomness_scan.report(df).first()
    assert r.n_hex == len(re.findall("[0-9a-f]{16,}", text)) == 30_000
    want = [f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", text)]
    assert [s for s in r.spans.split(",") if s.startswith("hex")] == want
    assert randomness_scan.redact(df).first().text == re.sub("[0-9a-f]{16,}", "[hex]", text)
    assert time.perf_counter() - began < 240
