"""Shared helpers: scratch tables in the folder all executors share, and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.session import ship

#: Words remembered by one Python worker before its dictionary is started anew.
WORD_CACHE = 250_000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What every operator does first: workers can import this package, and an Arrow batch has BATCH_BYTES at most (one row at least), so that neither the JVM nor a worker holds many texts at once."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only in local mode, where driver and executors are one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        known = jsc.getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="admitflow-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/admitflow/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    prepare(spark)
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._admitflow_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that no result depends on any more."""
    path = getattr(df, "_admitflow_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name before case is ignored, so that no other column can clash with them or with an operator's own."""
    lower = [c.lower() for c in df.columns]
    at = [df.columns.index(n) if n in df.columns else lower.index(n.lower()) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(lower)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name beginning with ``name`` that none of the frames has."""
    used = {c.lower() for f in frames for c in f.columns}
    while name.lower() in used:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RESIDENT: dict = {}


def resident(key, make):
    """What one Python worker keeps between tasks: the object of a single key at a time, so that caches of one stage do not stay through the next."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
