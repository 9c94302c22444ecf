"""The two-clock loop as a keyed stream: observations advance the revision clock, actions the action clock.

A revision always takes a step, whether its patch is accepted or not. An action is refused while a budget that
it needs is used up, and then takes nothing and leaves its clock alone. State is a value (clocks and budgets), a map
(belief by field) and a list (held observations), each kept by itself, so a row costs what it touches and not the
size of the belief. With ``ttl_ms`` the state of a key that was quiet so long is dropped.

Rows of a key are taken in the order of seq within a micro-batch; files must arrive in that order. A key is one task's
work, as state is; its history is never held. The rows of a batch are written to a folder of their own, replaced if the
batch is run again, so a restart from the checkpoint gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from admitflow.session import ship

STEPS, TOOL, VERIFICATION, MAX_SLOTS, LEDGER = 8, 5, 2, 8, 4
#: kind: revise or act; decision (UPDATE, HOLD, IGNORE) of a revision; name: field of a revision, action (verify or any other) of an act.
INPUT = "key string, seq long, kind string, decision string, name string, value string"
OUTPUT = "key string, seq long, revision_t long, action_k long, steps_left long, tool_left long, verification_left long, n_slots long, held string, refused string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Clocks:
    revision_t: int = 0
    action_k: int = 0
    steps_left: int = STEPS
    tool_left: int = TOOL
    verification_left: int = VERIFICATION
    n_slots: int = 0


CLOCKS = "revision_t long, action_k long, steps_left long, tool_left long, verification_left long, n_slots long"


def advance(c: Clocks, belief, ledger: list[int], row) -> str | None:
    """One row; changes what it is given, and returns why the row was refused. belief: has(name), put(name, value, status), hold(name)."""
    if row.kind == "act":
        verifies = row.name == "verify"
        if c.tool_left <= 0 or (verifies and c.verification_left <= 0):
            return "budget used up"
        c.tool_left, c.verification_left, c.action_k = c.tool_left - 1, c.verification_left - verifies, c.action_k + 1
        return None
    c.revision_t, c.steps_left = c.revision_t + 1, max(0, c.steps_left - 1)
    if row.decision == "IGNORE":
        return None
    there = belief.has(row.name)
    if row.decision == "HOLD":
        if not there:
            return "HOLD patch target does not exist"
        belief.hold(row.name)
        ledger[:] = [*ledger, row.seq][-LEDGER:]
        return None
    if not there and c.n_slots >= MAX_SLOTS:
        return "no empty belief slot"
    c.n_slots += not there
    belief.put(row.name, row.value)
    return None


class _Belief:
    """The map state as advance() wants it."""

    def __init__(self, state):
        self.state = state

    def has(self, name: str) -> bool:
        return self.state.containsKey((name,))

    def put(self, name: str, value: str | None) -> None:
        self.state.updateValue((name,), (value, "trusted"))

    def hold(self, name: str) -> None:
        self.state.updateValue((name,), (self.state.getValue((name,))[0], "pending_verification"))


class TwoClocks(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.clocks = handle.getValueState("clocks", CLOCKS, self.ttl_ms)
        self.belief = handle.getMapState("belief", "name string", "value string, status string", self.ttl_ms)
        self.ledger = handle.getListState("ledger", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clocks = Clocks(*self.clocks.get()) if self.clocks.exists() else Clocks()
        ledger = [r[0] for r in self.ledger.get()] if self.ledger.exists() else []
        belief, before = _Belief(self.belief), list(ledger)
        for row in sorted(rows, key=lambda r: r.seq):
            refused = advance(clocks, belief, ledger, row)
            yield Row(key=key[0], seq=row.seq, **vars(clocks) | {"held": ",".join(map(str, ledger)), "refused": refused})
        self.clocks.update(astuple(clocks))
        if ledger != before:
            self.ledger.put([(s,) for s in ledger])

    def close(self) -> None:
        pass


def loop(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of INPUT rows -> OUTPUT rows, one for each. Needs the RocksDB state store (``run`` sets it)."""
    ship(stream.sparkSession)
    rows = stream.selectExpr(*(f"{c.split()[0]}" for c in INPUT.split(", ")))
    return rows.groupBy("key").transformWithState(TwoClocks(ttl_ms), OUTPUT, "append", "ProcessingTime" if ttl_ms else "None")


def run(spark: SparkSession, path: str, out: str, checkpoint: str, ttl_ms: int | None = None) -> DataFrame:
    """Advance the loop over the files that are at path and not yet done, and return all rows so far."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = loop(spark.readStream.schema(INPUT).parquet(path), ttl_ms)
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUTPUT + ", batch long").parquet(out).drop("batch") if _holds(spark, out) else spark.createDataFrame([], OUTPUT)


def _holds(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
