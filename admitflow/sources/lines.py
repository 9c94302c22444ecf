"""Lines of text files with their numbers, from splits of the files: no file is ever one row.

Spark reads a file in splits, and a line belongs to the split in which it begins. Each task numbers the lines of its
splits as they pass; one count per split, summed up along the file, gives where each split begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admitflow.session import ship

_ROWS = "path string, split long, at long, body string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, split, body -> the same with at, the place of a line in its split; a task's rows come split by split."""
    now, n = None, 0
    for b in batches:
        places = np.empty(b.num_rows, np.int64)
        for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if key != now:
                now, n = key, 0
            places[i], n = n, n + 1
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places), b.column(2)], ["path", "split", "at", "body"])


def _in_splits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    ship(spark)
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "\r$", "").alias("body")).mapInArrow(_numbered, _ROWS)


def _begins(lines: DataFrame) -> DataFrame:
    """path, split, begin: the lines before each split, from one count per split."""
    counts = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line (from 1), body of every line, blank ones too; without its line end. Empty files give no rows."""
    lines = _in_splits(spark, path)
    return lines.join(_begins(lines), ["path", "split"]).select("path", (F.col("begin") + F.col("at") + 1).alias("line"), "body")


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines in the schema; blank lines are skipped. An error names path and line of one that is no JSON object or does not fit."""
    rows = numbered(spark, path).where(F.trim("body") != "")
    text = F.col("body")
    got = F.from_json(text, f"{schema}, `_misfit` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_misfit"})
    rows = rows.select("path", "line", text.alias("body"), got.alias("r"))
    bad = ~F.startswith(F.ltrim("body"), F.lit("{")) | F.col("r").isNull() | F.col("r._misfit").isNotNull()
    where = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": not an object of the schema"))
    names = [n for n in spark.createDataFrame([], schema).columns]
    checked = F.when(bad, F.raise_error(where).cast(rows.schema["r"].dataType)).otherwise(F.col("r"))
    return rows.select(checked.alias("r")).select(*(F.col(f"r.`{n}`").alias(n) for n in names))


def problems(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line, problem: lines that are not one JSON object. Only those lines and one count per split are joined."""
    lines = _in_splits(spark, path)
    v = F.try_parse_json("body")
    problem = F.when(v.isNull(), "not JSON").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not an object")
    found = lines.where(F.trim("body") != "").select("path", "split", "at", problem.alias("problem")).where("problem is not null")
    return found.join(_begins(lines), ["path", "split"]).select("path", (F.col("begin") + F.col("at") + 1).alias("line"), "problem")
