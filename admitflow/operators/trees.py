"""Trees given as edges: paths from the roots by pointer doubling, for any size and depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.session import discard, store


def flatten(edges: DataFrame, ident: str = "id", parent: str = "parent", label: str = "label", is_action: str = "is_action") -> DataFrame:
    """ident, label, depth, path (idents from the root, joined by /) and action (label of the nearest action at or above; the root's label if there is none).

    Each round doubles the stretch that a node knows above itself, so a tree of d levels takes log2(d) joins. A node whose
    parent has many children is one key of a join, which Spark splits. Idents must be distinct. Nodes that no root reaches
    (an absent parent, a cycle) are left out, as are null idents. An empty table gives no rows.
    """
    own = edges.where(F.col(ident).isNotNull()).select(
        F.col(ident).alias("id"),
        F.col(parent).alias("up"),
        F.col(label).alias("label"),
        F.lit(0).cast("long").alias("depth"),
        F.col(ident).cast("string").alias("path"),
        F.when(F.coalesce(F.col(is_action), F.lit(False)) | F.col(parent).isNull(), F.struct(F.col(label).alias("v"))).alias("action"),
    )
    state = store(own, "tree-0")
    n, level = state.count(), 0
    while (1 << level) <= 2 * n:
        open_ = state.where("up is not null")
        if open_.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"), F.col("action").alias("action2"))
        joined = open_.join(above, "up").select("id", F.col("up2").alias("up"), "label", (F.col("depth") + F.col("depth2") + 1).alias("depth"), F.concat_ws("/", "path2", "path").alias("path"), F.coalesce("action", "action2").alias("action"))
        fresh = store(state.where("up is null").unionByName(joined), f"tree-{level + 1}")
        discard(state)
        state, level = fresh, level + 1
    return state.where("up is null").select(F.col("id").alias(ident), F.col("label").alias(label), F.col("depth").cast("int").alias("depth"), "path", F.col("action.v").alias("action"))
