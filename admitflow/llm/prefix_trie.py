"""Operator 12, conversation prefix trie.

Every turn has a SHA-256 of its role and text; a conversation's prefix of length d has the
digest of (digest of length d - 1, turn d), chained along the turns in order. All prefixes are
exploded, one slim row each, and grouped by (depth, digest) into the nodes of a trie.

A node is named by its smallest member. If a conversation names a node, it names all nodes
below it on its own path too, so the nodes that one conversation names form a *run* of
depths ending at its last turn. Each run is exploded to all runs above it, found by joining
its prefixes to the nodes: with each goes the depth at which the run hangs from it. The
totals of the runs, summed by (ancestor, depth), and a running sum along each run give the
sums of every subtree. That is the explosion of each node to all its ancestors with the nodes
of a run taken together, and it keeps a long conversation from costing the square of its length.

The root, which holds every conversation, is never a join key. Popular prefixes are keys of
equi-joins whose large partitions Spark splits, and of hash aggregates, which combine before
the shuffle. A conversation is one sorted stream, chained with constant memory. The ids that
end at a node are range-sorted by (node, id), written out as pieces of text by each task, and
the pieces of a node are hashed in order as a stream, so even the most popular one is not gathered.

Defined results: a null turn comes before all others; turns with the same number are ordered by
the digest of role and text (null and empty are the same), so repeated rows are turns of their own. Rows
without a conv_id belong to no conversation and are passed over. A very long text is only hashed
and its words counted, in one row. Other columns are passed over, whatever their names. An
empty table gives no rows (not even a root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admitflow.llm.common import discard, prepare, store, take

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose first turns are taken from the same one, and the bound on how many turns.
FAMILY, LEAD = 20, 4
#: Ids in one piece of text on the way to a node's digest.
PIECE_IDS = 50_000
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_digest, words: the numbered turns of the table."""
    rows = take(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    slim = rows.select(
        "conv_id",
        "turn",
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("turn_digest"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    return slim.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "turn_digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, pos, turn_digest, words: conversation c begins with the first h turns of c - c % FAMILY, h = crc32(c) % LEAD, followed by its own after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % LEAD).cast("int")
    own = turns.where(F.col("pos") > h)
    base = turns.where(F.col("pos") < LEAD).withColumnRenamed("conv_id", "base")
    asks = turns.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).where("h > 0")
    lead = asks.join(base, "base").where(F.col("pos") <= F.col("h")).select(*own.columns)
    return own.unionByName(lead)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, pos) -> conv_id, depth, digest, words; only the last digest is carried on."""
    now, depth, last = None, 0, b""
    for batch in batches:
        convs, turns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        depths, digests = [], []
        for conv, turn in zip(convs, turns, strict=True):
            if conv != now:
                now, depth, last = conv, 0, b""
            depth, last = depth + 1, hashlib.sha256(last + turn).digest()
            depths.append(depth)
            digests.append(last)
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column(0), "depth": pa.array(depths, pa.int64()), "digest": pa.array(digests, pa.binary()), "words": batch.column(3)})


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, words: every prefix of every conversation, from depth 1; words are those of its last text."""
    ordered = turns.select("conv_id", "pos", "turn_digest", "words").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(_chained, "conv_id long, depth long, digest binary, words long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (digest, conv_id) -> digest, first (id of the piece), ids (joined by commas)."""
    now, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"digest": pa.array([now], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))], pa.string())})

    for batch in batches:
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (digest != now or len(ids) >= PIECE_IDS):
                yield piece()
                ids = []
            now = digest
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (digest, first) -> digest, ends_sha256."""
    now, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"digest": pa.array([now], pa.binary()), "ends_sha256": pa.array([sha.hexdigest()], pa.string())})

    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest != now:
                if sha:
                    yield row()
                now, sha = digest, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if sha:
        yield row()


def ends_of(ends: DataFrame) -> DataFrame:
    """digest, conv_id (one row each) -> digest, ends_sha256 of the ids in ascending order."""
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = ends.select("digest", "conv_id").repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pieces, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """turns (conv_id, pos, turn_digest, words) and members (conv_id, each once, turnless ones too) -> the nodes."""
    prepare(turns.sparkSession)
    members = store(members.select("conv_id"), "trie-members")
    least, total = members.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    first = F.lit(least).cast("long")
    paths = store(prefixes(turns), "trie-prefixes")
    nodes = store(paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words")), "trie-nodes")

    # the runs, and where each hangs from every run above it
    runs = nodes.groupBy("name").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    runs = store(runs.withColumn("top", F.when(F.col("name") == first, F.lit(0).cast("long")).otherwise(F.col("top"))), "trie-runs")
    named = paths.select("conv_id", "depth", "digest").join(nodes.select("depth", "digest", "name"), ["depth", "digest"]).where("conv_id <> name").select("conv_id", "name", "depth")
    to_root = runs.where(F.col("name") != first).select(F.col("name").alias("conv_id"), first.alias("name"), F.lit(0).cast("long").alias("depth"))
    hung = named.unionByName(to_root).groupBy("conv_id", "name").agg(F.max("depth").alias("at"))
    above = store(hung.join(runs.select(F.col("name").alias("conv_id"), "top", "bottom", "saved"), "conv_id"), "trie-above")
    children = store(above.where("at = top - 1").groupBy("name", "at").agg(F.count(F.lit(1)).alias("branches")), "trie-children")

    # a run's last node is childless unless another run hangs from it
    leaf = runs.select("name", "bottom").join(children.select("name", F.col("at").alias("bottom")), ["name", "bottom"], "left_anti").select(F.col("name").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    below = above.join(leaf, "conv_id", "left").groupBy("name", "at").agg(F.sum("saved").alias("saved_below"), F.sum(F.coalesce("leaf", F.lit(0))).alias("leaves_below"))
    root = members.sparkSession.range(1).select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), first.alias("name"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    every = nodes.unionByName(root.where("n_convs > 0"))
    own = every.join(runs.select("name", "top", "bottom"), "name", "left")
    own = own.withColumns({"top": F.coalesce("top", F.lit(0).cast("long")), "bottom": F.coalesce("bottom", F.lit(0).cast("long"))})
    hung_from = below.join(children, ["name", "at"], "left").withColumnRenamed("at", "depth")
    own = own.join(hung_from, ["name", "depth"], "left").na.fill(0, ["saved_below", "leaves_below", "branches"])
    childless = (F.col("depth") == F.col("bottom")) & (F.col("branches") == 0)
    up = Window.partitionBy("name").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns(
        {
            "n_children": F.col("branches") + (F.col("depth") < F.col("bottom")).cast("long"),
            "n_leaves": F.sum(F.col("leaves_below") + childless.cast("long")).over(up),
            "saved_tokens": F.sum(F.col("saved_below") + (F.col("n_convs") - 1) * F.col("words")).over(up),
        }
    )
    parents = above.where("at = top - 1").select(F.col("conv_id").alias("name"), F.col("top").alias("depth"), F.col("name").alias("parent"))
    own = own.join(parents, ["name", "depth"], "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("name")).otherwise(F.col("parent"))

    # what ends where
    last = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = paths.join(last, ["conv_id", "depth"]).select("digest", "conv_id")
    turnless = members.join(last.select("conv_id"), "conv_id", "left_anti").select(F.lit(b"").alias("digest"), "conv_id")
    shas = ends_of(ends.unionByName(turnless))
    out = own.join(shas, "digest", "left").select(
        F.col("name").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    result = store(out, "trie")
    for table in (members, paths, nodes, runs, above, children):
        discard(table)
    return result


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node."""
    prepare(conversations.sparkSession)
    turns = store(turns_of(conversations), "trie-turns")
    result = trie(rebuilt(turns), turns.where("pos = 1").select("conv_id"))
    discard(turns)
    return result
