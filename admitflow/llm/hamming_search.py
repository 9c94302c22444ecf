"""Operator 3, exact top-k search: incremental multi-index hashing for binary codes.

A vector's code is the sign bit of each of its first 64 numbers. Equal codes are one entry,
with the smallest k + 1 ids (enough for any k nearest other ids). Codes are indexed in about
64 / log2(number of codes) segments. In round r each open query looks up every segment value
at distance r from its own; codes within ``segments * (r + 1) - 1`` are then all found. Found
codes are verified by their whole distance, and a query closes once its kth distance is
within that bound, so the answer is exact. Each round's probes are equi-joined to the index;
Spark splits its large partitions.

Defined results: null and empty vectors have no code: they neither ask nor answer. Null
numbers count as not positive. Ties go to the smaller id. Rows that repeat an id count once.
With fewer than k others all are returned. Extra columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admitflow.llm.common import discard, store

BITS = 64
K = 10
QUERY_STEP = 100


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, code (long)."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(F.coalesce(F.get(F.col(vec_col), i) > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def _segment_bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    edges = [round(BITS * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _value(code: F.Column, first: int, width: int) -> F.Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1)).cast("long")


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, neighbour_id, distance: for each id divisible by query_step its k nearest others."""
    ids = store(codes(vectors, id_col, vec_col).distinct(), "mih-codes")
    ranked = ids.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("rn") <= k + 1)
    entries = store(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-entries")
    n = entries.count()
    queries = ids.where(F.col("id") % query_step == 0)
    open_ = store(queries.select(F.col("code").alias("q")).distinct(), "mih-open")
    segments = min(BITS // 4, max(4, round(BITS / max(4.0, math.log2(max(2, n))))))
    bounds = _segment_bounds(segments)
    index = store(
        entries.select(F.col("code").alias("c"), F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _value(F.col("code"), a, w).alias("val")) for i, (a, w) in enumerate(bounds)))).alias("s")).select("c", "s.seg", "s.val"),
        "mih-index",
    )
    need, best, done = k + 1, None, []
    for r in range(max(w for _, w in bounds) + 1):
        probes = None
        for i, (a, w) in enumerate(bounds):
            if r > w:
                continue
            masks = F.expr(f"filter(sequence(0L, {(1 << w) - 1}L), x -> bit_count(x) = {r})")
            part = open_.select("q", F.lit(i).alias("seg"), _value(F.col("q"), a, w).alias("own"), F.explode(masks).alias("mask")).select("q", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("val"))
            probes = part if probes is None else probes.unionByName(part)
        found = probes.join(index.hint("merge"), ["seg", "val"]).select("q", "c", F.bit_count(F.col("q").bitwiseXOR(F.col("c"))).alias("d")).distinct()
        if best is not None:
            found = found.unionByName(best.join(open_, "q", "left_semi")).distinct()
        nearest = found.join(entries.select(F.col("code").alias("c"), F.get("ids", F.lit(0)).alias("least")), "c")
        nearest = nearest.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("d", "least"))).where(F.col("rn") <= need)
        best = store(nearest.select("q", "c", "d"), f"mih-best-{r}")
        covered = segments * (r + 1) - 1
        state = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
        left = state.where((F.col("n") < min(need, n)) | ((F.col("d") > covered) & F.lit(covered < BITS))).select("q")
        fresh = store(left, f"mih-open-{r}")
        done.append(best.join(fresh, "q", "left_anti"))
        if fresh.isEmpty():
            break
        open_ = fresh
    discard(index)
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    near = queries.join(result, F.col("code") == F.col("q")).select(F.col("id").alias("query_id"), "c", F.col("d").alias("distance"))
    pairs = near.join(entries.withColumnRenamed("code", "c"), "c").select("query_id", "distance", F.explode("ids").alias("neighbour_id")).where("neighbour_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "neighbour_id", F.col("distance").cast("int").alias("distance"))
