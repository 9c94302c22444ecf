"""Corpus pipeline: rules, near-duplicate removal, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's rows to the shared folder, rereads them, and
deletes the table before once the next one is there (the last stage reads its own until the end).

Defined results, for every stage: null text is empty. Rows that repeat a doc_id, or whose doc_id is
null, are documents of their own. Texts are taken whole, however long. An empty table gives an empty
table. The five columns of documents go on; others, whatever their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from admitflow.llm import curve_packing, jaccard_join, quality_crf, randomness_scan, run_length_dedup
from admitflow.llm.common import discard, read_table, store
from admitflow.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Strings of so many bytes that start twice or more are cut out: passages of over 50 words have about 300.
PASSAGE_BYTES = 256


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose lines are mostly boilerplate, go."""
    crf = quality_crf.fit_line_crf(docs, read_table(spark, sf_dir, "labels"))
    return quality_crf.label_lines(docs.select(*COLUMNS), crf).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the join (5-word shingles, 80 %) stays."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that start twice or more in the corpus are cut out of the texts."""
    return run_length_dedup.strip(docs.select(*COLUMNS), PASSAGE_BYTES)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span that the scan finds gives way to a mark of its kind."""
    return randomness_scan.redact(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, neighbours along the curve together."""
    return curve_packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]

#: Stages cut texts by a trained model, hashes and a tokenizer, which SQL can't express; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
