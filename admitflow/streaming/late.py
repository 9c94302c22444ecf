"""Windowed counts of a stream whose late rows are labelled and kept, not dropped.

The watermark of a micro-batch is the latest event time of the batches before it less the allowed delay, as Spark's own is;
rows older than it are late. Each batch writes its partial counts, its late rows and its latest time to folders of its own,
replaced if the batch is run again; what a batch calls late depends on the batches before it alone, so that a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.streaming.two_clocks import _holds


class LateWindows:
    """ts (timestamp) and the columns of by, counted and value summed by windows of ``every``."""

    def __init__(self, spark: SparkSession, out: str, by: list[str], value: str, every: str = "1 hour", delay: str = "10 minutes"):
        self.spark, self.out, self.by, self.value, self.every, self.delay = spark, out.rstrip("/"), by, value, every, delay

    def _latest(self, before: int):
        if not _holds(self.spark, f"{self.out}/latest"):
            return None
        return self.spark.read.schema("ts timestamp, batch long").parquet(f"{self.out}/latest").where(F.col("batch") < before).agg(F.max("ts")).first()[0]

    def take(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch."""
        latest = self._latest(batch)
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        late = F.coalesce(F.col("ts") < mark, F.lit(False)) if latest is not None else F.lit(False)
        rows = rows.withColumn("late", late).persist()
        try:
            start = F.window("ts", self.every)["start"].alias("start")
            counts = rows.where("ts is not null").groupBy(start, *self.by, "late").agg(F.count(F.lit(1)).alias("n"), F.sum(self.value).alias("total"))
            counts.write.mode("overwrite").parquet(f"{self.out}/counts/batch={batch}")
            rows.where("late").drop("late").write.mode("overwrite").parquet(f"{self.out}/late/batch={batch}")
            rows.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{self.out}/latest/batch={batch}")
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take what the stream has and is not yet done."""
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.take).start().awaitTermination()

    def counts(self) -> DataFrame:
        """start, by, late, n, total over all batches. Rows without a time are in no window."""
        return self.spark.read.parquet(f"{self.out}/counts").groupBy("start", *self.by, "late").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def late_rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/late")
