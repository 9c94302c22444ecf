"""Operator 11, exact dedup: counting quotient filters, then byte verification.

Texts are equal when they are identical after white space is deleted. Each task puts the
64-bit fingerprints of its texts into counting quotient filters, one per slice of the
fingerprint space (its leading bits); the filters of a slice are merged by their sorted
remainders. A merge loses nothing: quotient and remainder together are the whole fingerprint,
so a filter can be read back as the sorted list of its fingerprints and counts, and built
again with more quotient bits. Only texts whose fingerprint counts more than one are compared
by their bytes: they are grouped by the normalised text itself, one partial group per distinct
text and task, so a group of any size shuffles one copy of its text from each task. Of a group,
the row with the most code points stays, then the smallest doc_id.

The number of slices follows the number of rows (``SLICE_ROWS``), so that the filter of a slice
stays small. The repeated fingerprints are broadcast up to ``BROADCAST_ROWS``, beyond that the
join is shuffled and Spark splits its large partitions. Verdicts reach the rows by SHA-256.

Defined results: null text is empty, and empty texts (or texts of white space only) equal each
other. A null doc_id comes after all others. Of rows that repeat each other in doc_id and text
exactly one stays. A very long text is one row of the scan and, if its fingerprint repeats, one
key of the grouping; it is never cut. Other columns, whatever their names, are passed over by
``report`` and kept by ``unique_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import discard, fresh, prepare, store, take

#: The deleted characters, U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
FINGERPRINT_BITS = 64
#: Rows for which one more slice of the fingerprint space is made.
SLICE_ROWS = 1_000_000
BROADCAST_ROWS = 1_000_000
#: Fingerprints that a task gathers before they go into its filters.
PENDING = 1 << 20
_HEAD = struct.Struct("<BBBQQ")


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


class QuotientFilter:
    """A counting quotient filter over ``bits``-bit fingerprints.

    The quotient's home slot is marked occupied; the remainders of a quotient form a sorted run
    of slots from there on, shifted right while slots are taken, and a run's last slot is marked.
    A count above one is held by counter slots behind the remainder (count - 1 in digits of a
    slot's size), which a third mark tells from remainders.
    """

    def __init__(self, bits: int, quotient_bits: int, width: int, occupied: np.ndarray, run_end: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.bits, self.quotient_bits, self.width = bits, quotient_bits, width
        self.occupied, self.run_end, self.counter, self.slots = occupied, run_end, counter, slots

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints (below 2^bits) and their counts."""
        n = len(values)
        q = min(bits, max(1, int(np.ceil(np.log2(max(n, 1) * 1.1 + 1)))))
        r = bits - q
        width = max(1, -(-r // 8))
        quotient = (values >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
        remainder = values & np.uint64((1 << r) - 1)
        more = counts.astype(np.uint64) - np.uint64(1)
        digits = np.zeros(n, np.int64)
        rest = more.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(8 * width) if width < 8 else np.zeros_like(rest)
        before = np.cumsum(1 + digits) - (1 + digits)
        start = before + np.maximum.accumulate(quotient - before) if n else before
        total = int(start[-1] + 1 + digits[-1]) if n else 0
        slots = np.zeros((total, width), np.uint8)
        occupied, run_end, counter = np.zeros(1 << q, bool), np.zeros(total, bool), np.zeros(total, bool)

        def put(at: np.ndarray, numbers: np.ndarray) -> None:
            slots[at] = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]

        if n:
            put(start, remainder)
            occupied[quotient] = True
            last = np.append(quotient[1:] != quotient[:-1], True)
            run_end[(start + digits)[last]] = True
            rest = more
            for k in range(int(digits.max())):
                has = digits > k
                put(start[has] + 1 + k, rest[has])
                counter[start[has] + 1 + k] = True
                rest = rest >> np.uint64(8 * width) if width < 8 else rest
        return cls(bits, q, width, occupied, run_end, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct fingerprints and their counts."""
        home, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        if not len(home):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.maximum(home, np.append(0, ends[:-1] + 1))
        sizes = ends - starts + 1
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        number = np.zeros((len(at), 8), np.uint8)
        number[:, : self.width] = self.slots[at]
        number = number.view("<u8").ravel().astype(np.uint64)
        head = ~self.counter[at]
        first = np.flatnonzero(head)
        r = self.bits - self.quotient_bits
        high = np.repeat(home, sizes)[first].astype(np.uint64)
        values = (high << np.uint64(r)) | number[first] if r < 64 else number[first]
        counts = np.ones(len(first), np.int64)
        owner = np.cumsum(head) - 1
        tail = np.flatnonzero(~head)
        shift = ((tail - first[owner[tail]] - 1) * 8 * self.width).astype(np.uint64)
        np.add.at(counts, owner[tail], (number[tail] << shift).astype(np.int64))
        return values, counts

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.bits, self.quotient_bits, self.width, len(self.occupied), len(self.slots))
        return head + _bits(self.occupied) + _bits(self.run_end) + _bits(self.counter) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        bits, q, width, homes, total = _HEAD.unpack_from(data)
        raw, at = np.frombuffer(data, np.uint8, offset=_HEAD.size), 0
        flags = []
        for n in (homes, total, total):
            size = -(-n // 8)
            flags.append(np.unpackbits(raw[at : at + size], count=n, bitorder="little").astype(bool))
            at += size
        return cls(bits, q, width, *flags, raw[at:].reshape(total, width))


def merged_items(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list from several: the runs are merged and counts of equal fingerprints added."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _built(bits: int, lead: int):
    """Batches of fingerprints -> (slice, filter) rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, waiting, n = [], [], 0

        def settle() -> None:
            nonlocal waiting, n
            values = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            fresh_items = values[first], np.diff(np.append(first, len(values))).astype(np.int64)
            done[:] = [merged_items([*done, fresh_items])]
            waiting, n = [], 0

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += batch.num_rows
                if n >= PENDING:
                    settle()
        if waiting:
            settle()
        if not done:
            return
        values, counts = done[0]
        inner = bits - lead
        which = (values >> np.uint64(inner)).astype(np.int64) if lead else np.zeros(len(values), np.int64)
        cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(values)), strict=True):
            f = QuotientFilter.of(values[a:b] & np.uint64((1 << inner) - 1), counts[a:b], inner)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([which[a]], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary())})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, filter) rows sorted by slice -> one filter per slice; only one slice is held at a time."""

    def rows() -> Iterator[tuple[int, QuotientFilter]]:
        for batch in batches:
            for which, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield which, QuotientFilter.from_bytes(data.as_py())

    def sealed(which: int, items: list, bits: int) -> pa.RecordBatch:
        values, counts = merged_items(items)
        f = QuotientFilter.of(values, counts, bits)
        return pa.RecordBatch.from_pydict({"slice": pa.array([which], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary())})

    now, items, bits, size = None, [], 0, 0
    for which, f in rows():
        if which != now and items:
            yield sealed(now, items, bits)
            items, size = [], 0
        now, bits = which, f.bits
        items.append(f.items())
        size += len(items[-1][0])
        if size > PENDING:
            items, size = [merged_items(items)], 0
    if items:
        yield sealed(now, items, bits)


def corpus_filter(fingerprints: DataFrame, rows: int, bits: int = FINGERPRINT_BITS) -> tuple[DataFrame, int]:
    """One column of fingerprints -> (slice, filter) of all of them, and the leading bits that name a slice."""
    spark = fingerprints.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLICE_ROWS))
    lead = min(bits - 1, max(0, (wanted - 1).bit_length()))
    parts = fingerprints.mapInArrow(_built(bits, lead), "slice long, filter binary")
    return parts.repartition(wanted, "slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice long, filter binary"), lead


def repeated(filters: DataFrame, lead: int, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """fingerprint, n: those that count more than one."""
    inner = bits - lead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, counts = QuotientFilter.from_bytes(data.as_py()).items()
                more = counts > 1
                whole = values[more] | np.uint64(which << inner)
                yield pa.RecordBatch.from_pydict({"fingerprint": pa.array(whole.view(np.int64), pa.int64()), "n": pa.array(counts[more], pa.int64())})

    return filters.mapInArrow(run, "fingerprint long, n long")


def _rank() -> Column:
    """More code points first, then the smaller doc_id, null last: one number, so that its maximum can be kept by a hash aggregate."""
    return F.expr("cast(n_points as decimal(10, 0)) * 20000000000000000000BD + coalesce(9223372036854775808BD - cast(doc_id as decimal(20, 0)), 0BD)").cast("decimal(38,0)")


def judge(rows: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """rows (row, doc_id, text; row distinct) -> row, doc_id, keep_id, group_size, kept, text_sha256."""
    prepare(rows.sparkSession)
    text = F.coalesce("text", F.lit(""))
    plain = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_points"), F.translate(text, WHITE, "").alias("plain"))
    plain = plain.withColumn("fingerprint", F.shiftrightunsigned(F.xxhash64("plain"), 64 - bits) if bits < 64 else F.xxhash64("plain"))
    slim = store(plain.select("row", "doc_id", "n_points", "fingerprint", F.sha2("plain", 256).alias("sha")), "cqf-rows")
    filters, lead = corpus_filter(slim.select("fingerprint"), slim.count(), bits)
    twice = store(repeated(filters, lead, bits).select("fingerprint"), "cqf-repeated")
    small = twice.count() <= BROADCAST_ROWS
    suspects = plain.drop("row").join(F.broadcast(twice) if small else twice, "fingerprint", "left_semi")
    equal = suspects.groupBy("plain").agg(F.count(F.lit(1)).alias("n"), F.max(_rank()).alias("best")).where("n > 1")
    by_sha = equal.select(F.sha2("plain", 256).alias("sha"), "n", "best").groupBy("sha").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.count(F.lit(1)).alias("texts"))
    groups = store(by_sha.select("sha", "best", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("different texts share a SHA-256"))).alias("n")), "cqf-groups")
    best = slim.join(groups, "sha").where(_rank() == F.col("best")).groupBy("sha").agg(F.min("row").alias("first_row"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"))
    out = slim.join(best, "sha", "left")
    single = F.col("n").isNull()
    result = store(
        out.select(
            "row",
            "doc_id",
            F.when(single, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (single | (F.col("row") == F.col("first_row"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        ),
        "cqf-verdicts",
    )
    for table in (slim, twice, groups):
        discard(table)
    return result


def report(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = take(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return judge(rows, bits).drop("row")


def unique_documents(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """The documents that stay, with all their columns."""
    row = fresh("row", docs)
    stored = store(docs.withColumn(row, F.monotonically_increasing_id()), "cqf-documents")
    kept = judge(take(stored, row, "doc_id", "text").withColumnRenamed(row, "row"), bits).where("kept").select(F.col("row").alias(row))
    return stored.join(kept, row, "left_semi").drop(row)
