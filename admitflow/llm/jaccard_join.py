"""Operator 5, n-gram Jaccard join: universe partition and pigeonhole, verified exactly.

A text's set holds its distinct word n-grams (lower-cased A-Z; words are runs without ASCII
white space) as 64-bit hashes. Two sets with Jaccard similarity of at least p % differ in at
most ``(100 - p) * s // p`` elements, s being the smaller size. Sizes fall into bands; in band b the
universe of hashes is cut into H_b + 1 segments and a few spare ones, H_b being the difference
allowed at the band's upper end. A linked pair agrees on one segment at least, so each set is
indexed under its segments (own band, and the band below where a partner can be). Cost-based
allocation then looks at how many sets meet in each segment:
 - a segment that most of a band shares is skipped, and a rare one of the same band is widened
   to its one-deletion neighbourhood (allowances -1, 0 and +1; their sum stays the same, so the
   pigeonhole holds);
 - of the rest, each set keeps the rarest only, as many as the pigeonhole needs (``_rarest``).
   Empty segments come last and are not even indexed by sets that can do without. A frequent
   passage fills few segments of a text, so texts that share nothing else never meet in it.
Both are pure saving: without them the answer is the same.

From segment to link, without all pairs of a group:
 1. Equal sets are one class; a segment counts if two classes meet in it, one of them in its
    own band. Of segments with the same members one is kept, with its multiplicity.
 2. Star: each segment's most connected member is paired with the others. A pair is dropped
    if sizes, or the Hamming distance of parity sketches (a lower bound of the difference),
    rule it out; the rest are verified on whole sets.
 3. Segments whose members lie in several components are cut into blocks; block pairs compare
    sketches in memory and give pairs of different components: first only the nearest for
    each member and component, later all that are left and not yet examined.
Components come from min-label propagation with shortcuts. Each step is a stored table.

A filter of shared signatures (of bounded size) spares the others a second shuffle.

Defined results: without words the set is empty, linked with nothing, a component of its own.
With fewer words than n, the whole sequence is the one element. Rows that repeat a doc_id are
rows of their own. Null doc_ids take part and give null ids only if alone in a component. An
empty table gives no rows. Extra columns are passed over. Sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.llm.common import WordHashes, discard, fresh, mix64, prepare, reclaim, resident, store

WORDS = 5
PERCENT = 80
BLOCK = 512
#: Cost of verifying a pair, in signature rows; and the largest number of swaps (a saving only).
PAIR_COST = 16
MAX_SWAPS = 2000
#: Rows up to which a table of longs is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Largest size of the filter of shared signatures (8 MB).
FILTER_WORDS = 1 << 20

_U = np.uint64


def allowed(size: int, percent: int) -> int:
    """Most elements in which a linked pair differs whose smaller set has this size."""
    return (100 - percent) * size // percent


def band_tops(percent: int, limit: int = 1 << 40) -> list[int]:
    """Largest set size of each band, the first beginning at 1. The ratio of its ends gives the fewest segments for each element, own band and band below together."""
    tops, low, p, ratio = [], 1, percent / 100, 2.0
    for _ in range(60):  # the least (ratio - p) / log(ratio)
        ratio = (ratio - p) / math.log(ratio)
    while low < limit:
        tops.append(max(100 * low // percent, int(low * ratio)))
        low = tops[-1] + 1
    return tops


def segments_of(top: int, percent: int) -> int:
    """Segments of a band: the pigeonhole needs one more than the difference; the spare ones let sets do without frequent segments."""
    d = allowed(top, percent)
    return d + 1 + (2 + d // 12 if d else 0)


def shingle_set(text: str | None, words: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    h = words.of((text or "").encode().lower().split())
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=_U)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_class(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    with np.errstate(over="ignore"):
        a = int(mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
        b = int((mix64(s ^ _U(0x14057B7EF767814F)) * (s | _U(1))).sum(dtype=_U))
    return a, b


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements of each cell, at least two cells an element: 64-bit words."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    cells = np.bincount(((s >> _U(17)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view(np.int64)


def _cells(s: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each element, and the value it adds to its segment's signature."""
    with np.errstate(over="ignore"):
        m = mix64(s + _U(band * 2 + 1) * _U(0xD6E8FEB86659FD93))
    return ((m >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64), m | _U(1)


def _tag(total: np.ndarray, band: int, segment: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(total + mix64(segment.astype(_U) * _U(8) + _U(kind) + _U(band) * _U(1 << 40)))


def segment_signatures(s: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The signature of each segment, even unless the segment is empty; and which are not empty."""
    seg, add = _cells(s, band, segments)
    total = np.zeros(segments, dtype=_U)
    with np.errstate(over="ignore"):
        np.add.at(total, seg, add)
    full = np.bincount(seg, minlength=segments) > 0
    return (_tag(total, band, np.arange(segments), 0) & ~_U(1)) | (~full).astype(_U), full


def emitted(s: np.ndarray, band: int, top: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures in a band, and which of them are indexed: empty segments only where the others don't exceed the difference allowed."""
    sig, full = segment_signatures(s, band, segments_of(top, percent))
    return sig, full if full.sum() > allowed(min(len(s), top), percent) else np.ones(len(sig), dtype=bool)


def deletion_signatures(s: np.ndarray, band: int, segments: int, wanted: np.ndarray) -> np.ndarray:
    """For each wanted segment: its whole content, and the content without each single element."""
    seg, add = _cells(s, band, segments)
    total = np.zeros(segments, dtype=_U)
    with np.errstate(over="ignore"):
        np.add.at(total, seg, add)
        hit = np.isin(seg, wanted)
        return np.concatenate([_tag(total[wanted], band, wanted, 1), _tag(total[seg[hit]] - add[hit], band, seg[hit], 1)])


def own_bands(n: int, tops: list[int], percent: int) -> list[int]:
    """The band of a size, and the one below if a smaller partner can be in it."""
    b = int(np.searchsorted(tops, n))
    return [b, b - 1] if b and percent * n <= 100 * tops[b - 1] else [b]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(parts: list[np.ndarray], null: np.ndarray | None = None) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate([p.view(np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, mask=null))


def indexed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """row_id, doc_id, n, band, own and under (how many segments are indexed in the own band and the one below), c1, c2, sketch, sigs (one for each segment of the own band, then of the band below; null where not indexed)."""
    tops = band_tops(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, row = resident("words", WordHashes), TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows, size, band, c1, c2, sk, sg, used, count = np.arange(row, row + part.num_rows), [], [], [], [], [], [], [], [[], []]
                row += part.num_rows
                for t in part.column(1):
                    s = shingle_set(t.as_py(), words, n)
                    a, c = set_class(s)
                    size.append(len(s))
                    c1.append(a)
                    c2.append(c)
                    if len(s):
                        bands = own_bands(len(s), tops, percent)
                        band.append(bands[0])
                        sk.append(sketch(s))
                        got = [emitted(s, k, tops[k], percent) for k in bands]
                        sg.append(np.concatenate([x for x, _ in got]))
                        used.append(np.concatenate([x for _, x in got]))
                        for side in (0, 1):
                            count[side].append(int(got[side][1].sum()) if side < len(got) else 0)
                    else:
                        band.append(-1)
                        sk.append(np.zeros(0, np.int64))
                        sg.append(np.zeros(0, np.int64))
                        for side in (0, 1):
                            count[side].append(0)
                mask = ~np.concatenate(used) if used else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(0), pa.array(size, pa.int64()), pa.array(band, pa.int32()), *(pa.array(c, pa.int32()) for c in count), _signed(np.array(c1, _U)), _signed(np.array(c2, _U)), _lists(sk), _lists(sg, mask)],
                    ["row_id", "doc_id", "n", "band", "own", "under", "c1", "c2", "sketch", "sigs"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row_id long, doc_id long, n long, band int, own int, under int, c1 long, c2 long, sketch array<long>, sigs array<long>")


def _bits(sig: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two bits of a filter of so many 64-bit words (a power of two): word and bit of each."""
    bits = words.bit_length() + 5
    u = sig.view(_U)
    a, b = u >> _U(64 - bits), (u >> _U(2)) & _U((1 << bits) - 1)  # signatures are mixed already
    return (a >> _U(6)).astype(np.int64), a & _U(63), (b >> _U(6)).astype(np.int64), b & _U(63)


def _likely(first: DataFrame, dups: DataFrame, percent: int) -> DataFrame:
    """sig, slot, row_id of the indexed segments that a bit filter of dups (sig) lets through: all those in dups, and few others.

    The filter has 16 bits for each of dups, but never more than FILTER_WORDS words; a full one lets more
    through, and the join that follows drops them.
    """
    spark, tops = first.sparkSession, band_tops(percent)
    words, known = 1, dups.count()
    while 64 * words < 16 * known and words < FILTER_WORDS:
        words *= 2
    bits = words.bit_length() + 5
    place = (F.shiftrightunsigned("sig", 64 - bits), F.shiftrightunsigned("sig", 2).bitwiseAND(F.lit((1 << bits) - 1)))
    each = dups.select(F.explode(F.array(*place)).alias("p")).select(F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int")).alias("m"))
    got = each.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # FILTER_WORDS rows at most
    table = np.zeros(words, dtype=np.int64)
    table[got.column("w").to_numpy()] = got.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(table)
    width = np.array([segments_of(t, percent) for t in tops])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("none", object)
        table = shared.value.view(_U)
        for b in batches:
            lists = b.column("sigs")
            ends = lists.offsets.to_numpy()
            flat = lists.values.slice(ends[0], ends[-1] - ends[0])
            sig = flat.fill_null(0).to_numpy()
            w1, b1, w2, b2 = _bits(sig, len(table))
            hit = ((table[w1] >> b1) & (table[w2] >> b2) & _U(1)).astype(bool)
            if flat.null_count:
                hit &= flat.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(hit)
            row = np.searchsorted(ends - ends[0], at, side="right") - 1
            pos, band = at - (ends - ends[0])[row], b.column("band").to_numpy()[row].astype(np.int64)
            below = pos >= width[band]
            slot = (band - below << 40) + pos - np.where(below, width[band], 0)
            yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(slot), b.column("row_id").take(pa.array(row))], ["sig", "slot", "row_id"])

    return first.select("row_id", "band", "sigs").mapInArrow(run, "sig long, slot long, row_id long")


def _lookup(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that broadcasts the stored table small only while it has at most BROADCAST_ROWS rows."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def _allocate(meets: DataFrame, table: DataFrame, docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """meets (sig, slot, rep) after the swaps that pay; by band, how many segments are skipped and how many widened (those have slot -1)."""
    spark, tops = docs.sparkSession, band_tops(percent)
    mass = meets.groupBy("slot", "sig").agg((F.count(F.lit(1)) - 1).alias("m")).groupBy("slot").agg(F.sum("m").alias("mass"))
    sets = table.where("n > 0").groupBy("band").agg(F.count(F.lit(1)).alias("sets"))
    # only segments that over half of a band's sets share can pay: at most a few for each band
    hot = mass.withColumn("band", F.shiftright("slot", 40).cast("int")).join(sets, "band").where("mass * 2 > sets").orderBy(F.desc("mass"), "slot").limit(MAX_SWAPS).collect()
    if not hot:
        return meets, {}, {}
    known = {r.slot: r.mass for r in mass.where(F.shiftright("slot", 40).cast("int").isin(sorted({r.band for r in hot}))).orderBy("mass", "slot").limit(4 * MAX_SWAPS).collect()}
    skip, widen = [], {}
    for r in hot:
        segments = segments_of(tops[r.band], percent)
        taken = set(skip) | {(r.band << 40) + j for j in widen.get(r.band, [])}
        free = [j for j in range(min(segments, 4 * MAX_SWAPS)) if (r.band << 40) + j not in taken and (r.band << 40) + j != r.slot]
        if not free:
            continue
        cold = min(free, key=lambda j: (known.get((r.band << 40) + j, 0), j))
        rows = r.sets * (tops[r.band] / segments + 1)
        if PAIR_COST * (r.mass - 2 * known.get((r.band << 40) + cold, 0)) > rows:
            skip.append(r.slot)
            widen.setdefault(r.band, []).append(cold)
    if not skip:
        return meets, {}, {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = resident("words", WordHashes)
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(t, words, n)
                for k in own_bands(len(s), tops, percent) if len(s) else ():
                    if k in widen:
                        got = deletion_signatures(s, k, segments_of(tops[k], percent), np.array(widen[k]))
                        a, c = (np.array([x], _U).view(np.int64)[0] for x in set_class(s))
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(got), pa.int64()), _signed(got), pa.array([a] * len(got)), pa.array([c] * len(got))], ["doc_id", "sig", "c1", "c2"])

    wide = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sig long, c1 long, c2 long"), "jaccard-wide")
    both = wide.groupBy("sig").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a < b").select("sig")
    reps = table.where("rep = row_id").select("c1", "c2", "rep")
    extra = wide.join(both, "sig").join(reps, ["c1", "c2"]).select("sig", F.lit(-1).cast("long").alias("slot"), "rep").distinct()
    gone = spark.createDataFrame([(x,) for x in skip], "slot long")
    out = store(meets.join(F.broadcast(gone), "slot", "left_anti").select("sig", "slot", "rep").unionByName(extra), "jaccard-allocated")
    return out, dict(Counter(x >> 40 for x in skip)), {k: len(v) for k, v in widen.items()}


def _rarest(meets: DataFrame, table: DataFrame, percent: int, skipped: dict[int, int], widened: dict[int, int]) -> DataFrame:
    """sig, rep: of each set's segments in a band only as many as the pigeonhole needs, the rarest.

    Segments have one order for all sets (full ones before empty ones, then by how many sets have them). A set
    whose first d + 1 segments in that order (d: the difference allowed; a widened segment counts twice) are
    kept can have a partner only through one of those that both keep: if all of them differed, so would d + 1
    elements. Segments that no other set has come first and need not be looked at, so most sets keep nothing.
    """
    tops = F.array(*(F.lit(t) for t in band_tops(percent)))
    of = lambda counts, space: F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("int") for kv in counts.items() for x in kv)), space), F.lit(0)) if counts else F.lit(0)
    sides = table.where("rep = row_id").select("rep", "n", "band", "own", "under")
    space = F.shiftright("slot", 40).cast("int")
    often = meets.where("slot >= 0").groupBy("sig").agg(F.count(F.lit(1)).alias("f"))
    rows = meets.where("slot >= 0").join(often, "sig").join(sides, "rep").withColumn("space", space)
    top = F.element_at(tops, F.col("space") + 1)
    d = F.floor((100 - percent) * F.least("n", top) / percent)
    has = F.when(F.col("space") == F.col("band"), F.col("own")).otherwise(F.col("under"))
    by = Window.partitionBy("rep", "space")
    alone = has - of(skipped, F.col("space")) - F.count(F.lit(1)).over(by)
    rows = rows.withColumn("keep", d + 1 - 2 * of(widened, F.col("space")) - alone)
    rows = rows.withColumn("at", F.row_number().over(by.orderBy(F.col("sig").bitwiseAND(F.lit(1).cast("long")), "f", "sig")))
    kept = rows.where("at <= keep").select("sig", "rep")
    return kept.unionByName(meets.where("slot < 0").select("sig", "rep")) if widened else kept


def _distinct_groups(meets: DataFrame) -> DataFrame:
    """sig, rep, k (members), mult: one segment for each set of members (by a digest of 100 bits or so), and how many there are."""
    of = meets.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(1 << 40))).alias("s")).where("k > 1")
    one = of.groupBy("k", "x", "s").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("mult")).select("sig", "k", "mult")
    one = store(one, "jaccard-groups")
    return store(_lookup(meets, one, "sig").select("sig", "rep", "k", "mult"), "jaccard-members")


def _hamming(a: Column, b: Column) -> Column:
    """Of two sketches, the longer folded to the other's length."""

    def fold(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


class _Verifier:
    def __init__(self, docs: DataFrame, info: DataFrame, n: int, percent: int):
        self.docs, self.info, self.n, self.percent = docs, info, n, percent

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of the distinct pairs (a, b) of representatives those that link; sizes and sketches first, then whole sets."""
        p = self.percent
        side = lambda x: self.info.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        least, most = F.least("na", "nb"), F.greatest("na", "nb")
        near = near.where((100 * least >= p * most) & (_hamming(F.col("sa"), F.col("sb")) <= F.floor((100 - p) * least / p)))
        near = store(near.select("a", "b", "na", "nb"), f"jaccard-near-{name}")
        need = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
        need = store(self.info.join(need, "rep", "left_semi").select("rep", "doc_id", "c1", "c2"), f"jaccard-need-{name}")
        sets = store(self._sets(need), f"jaccard-sets-{name}")
        side = lambda x: sets.select(F.col("rep").alias(x), F.col("elements").alias(f"e{x}"))
        both = near.join(side("a"), "a").join(side("b"), "b")
        both = both.withColumn("common", F.size(F.array_intersect("ea", "eb")))
        out = store(both.where(100 * F.col("common") >= p * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), f"jaccard-links-{name}")
        for x in (near, need, sets):
            discard(x)
        return out

    def _sets(self, need: DataFrame) -> DataFrame:
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = resident("words", WordHashes)
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    part = b.slice(at, 200)
                    reps, sets = [], []
                    for rep, c1, c2, t in zip(*(part.column(c).to_pylist() for c in ("rep", "c1", "c2", "text")), strict=True):
                        s = shingle_set(t, words, n)
                        if tuple(np.array(set_class(s), _U).view(np.int64)) == (c1, c2):
                            reps.append(rep)
                            sets.append(s)
                    yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), _lists(sets)], ["rep", "elements"])

        docs = self.docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
        need = F.broadcast(need) if need.count() <= BROADCAST_ROWS // 4 else need
        rows = docs.join(need, F.col("_id").eqNullSafe(F.col("doc_id"))).select("rep", "c1", "c2", "text")
        return rows.mapInArrow(run, "rep long, elements array<long>").dropDuplicates(["rep"])


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) of every node of the stored edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = store(both, "jaccard-edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "jaccard-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = store(step.join(jump, "via").select("node", F.least("via", "far").alias("label"), "old"), "jaccard-labels")
        stable = new.where("label <> old").isEmpty()
        discard(labels)
        labels = new.select("node", "label")
        labels._admitflow_path = new._admitflow_path
        if stable:
            discard(both)
            return labels


def _block_pairs(rows: DataFrame, info: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """rows (sig, rep, label) -> distinct pairs (a, b) of different labels that sizes and sketches (in info) allow."""
    sizes = rows.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = rows.join(sizes, "sig").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "label")
    cut = cut.join(info.select("rep", "n", "sketch"), "rep").select("sig", "lo", "hi", "own", "rep", "label", "n", "sketch")  # sketches move once

    def unit(t: pa.Table) -> list[tuple[int, int]]:
        own, rep, label, n = (t.column(c).to_numpy() for c in ("own", "rep", "label", "n"))
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        words = [np.array(x, dtype=np.int64) for x in t.column("sketch").to_pylist()]
        width = min(map(len, words))
        for i, w in enumerate(words):
            while len(w) > width:
                w = w[: len(w) // 2] ^ w[len(w) // 2 :]
            words[i] = w
        bits = np.stack(words).view(np.uint64)
        out = []
        for i in range(len(rep)):
            if lo != hi and own[i] != lo:
                continue
            mate = (label != label[i]) & ((own == hi) if lo != hi else (rep > rep[i]))
            mate &= (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            at = np.flatnonzero(mate)
            if not len(at):
                continue
            far = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            ok = far <= (100 - percent) * np.minimum(n[at], n[i]) // percent
            at, far = at[ok], far[ok]
            if nearest and len(at):
                order = np.lexsort((rep[at], far, label[at]))
                at = at[order]
                at = at[np.concatenate(([True], label[at][1:] != label[at][:-1]))]
            out += [(min(rep[i], rep[j]), max(rep[i], rep[j])) for j in at]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("words", WordHashes)
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            pairs = unit(t) if t.num_rows > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in pairs]), pa.array([int(b) for _, b in pairs])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("sig", "lo", "hi")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *edges], [*edges, b.num_rows], strict=True):
                k = tuple(keys[:, a])
                if k != key and held:
                    yield from done()
                    held.clear()
                key = k
                held.append(b.slice(a, z - a))
        if held:
            yield from done()

    dealt = cut.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with an equal set; null for empty sets); one row per row."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    prepare(docs.sparkSession)
    first = store(indexed(docs, n, percent), "jaccard-index")
    classes = first.where("n > 0").groupBy("c1", "c2").agg(F.min_by("row_id", F.struct("doc_id", "row_id")).alias("rep"))
    narrow = store(first.where("n > 0").select("row_id", "doc_id", "n", "band", "own", "under", "c1", "c2").join(classes, ["c1", "c2"]), "jaccard-rows")
    tops = band_tops(percent)
    # a segment counts if two classes meet in it, one of them in its own band: the bit above the class says "band below"
    segments = F.element_at(F.array(*(F.lit(segments_of(t, percent)).cast("long") for t in tops)), F.col("band") + 1)
    sigs = first.where("n > 0").select("c1", segments.alias("segments"), F.posexplode("sigs").alias("pos", "sig")).where("sig is not null")
    under = F.lit(1 << 62)
    marked = F.col("c1").bitwiseAND(under - 1) + F.when(F.col("pos") >= F.col("segments"), under).otherwise(F.lit(0))
    dups = sigs.select("sig", marked.alias("x")).groupBy("sig").agg(F.min("x").alias("a"), F.max("x").alias("b")).where((F.col("a") < F.col("b")) & (F.col("a") < under)).select("sig")
    dups = store(dups, "jaccard-shared")
    bare = store(first.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id")), "jaccard-bare")
    reclaim(docs.sparkSession)
    met = _likely(first.where("n > 0"), dups, percent).join(dups, "sig")
    meets = store(met.join(narrow.select("row_id", "rep"), "row_id").select("sig", "slot", "rep").distinct(), "jaccard-meets")
    del met, sigs
    reclaim(docs.sparkSession)
    links = None
    if not meets.isEmpty():
        allocated, skipped, widened = _allocate(meets, narrow, docs, n, percent)
        meets = _distinct_groups(store(_rarest(allocated, narrow, percent, skipped, widened), "jaccard-rarest"))
        discard(dups)
        weight = meets.groupBy("rep").agg(F.round(F.sum(F.log2("k") * F.col("mult")), 3).alias("weight"))
        info = store(first.select(F.col("row_id").alias("rep"), "doc_id", "n", "c1", "c2", "sketch").join(weight, "rep"), "jaccard-info")
        discard(first)
        verify = _Verifier(docs, info, n, percent)
        sized = meets.join(info.select("rep", "weight", "n"), "rep")
        heavy = sized.groupBy("sig").agg(F.max_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hn")), F.struct("weight", -F.col("rep"))).alias("h")).select("sig", "h.*")
        alike = 100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")
        star = sized.join(heavy, "sig").where((F.col("rep") != F.col("hub")) & alike).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        star = store(star, "jaccard-star")
        del weight, heavy, sized
        reclaim(docs.sparkSession)
        links, examined = verify.links(star, "star"), star
        reclaim(docs.sparkSession)
        more = meets.where("k > 2").select("sig", "rep")
        for nearest in (True, False):
            labels = components(links)
            placed = more.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
            mixed = placed.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
            rest = store(placed.join(mixed, "sig").select("sig", "rep", "label"), "jaccard-rest")
            pairs = store(_block_pairs(rest, info, percent, nearest).join(examined, ["a", "b"], "left_anti"), "jaccard-blocks")
            discard(rest)
            del labels, placed, mixed
            reclaim(docs.sparkSession)
            if pairs.isEmpty():
                if nearest:
                    continue
                break
            links = store(links.unionByName(verify.links(pairs, "blocks")), "jaccard-links")
            examined = examined.unionByName(pairs)
            reclaim(docs.sparkSession)
    rows = narrow.select("row_id", "doc_id", "n", "rep")
    if links is not None:
        rows = rows.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    else:
        rows = rows.withColumn("label", F.col("rep"))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    names = rows.where("row_id = rep").select("rep", F.col("doc_id").alias("class_id"))
    full = rows.join(least, "label").join(names, "rep").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    return full.unionByName(bare)


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all but one row of each component: that with the least doc_id stays (ids before null; of equal ids the first stored row). Rows without words all stay."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    total = ids.first()
    if total.n == total.known and repeated.isEmpty():
        keep = join(docs.select("doc_id", "text"), n, percent).where("doc_id = component_id").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    row = fresh("row", docs)
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-docs")
    groups = join(rows.select(F.col(row).alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    keep = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias(row)).select(row)
    return rows.join(keep, row, "left_semi").select(*docs.columns)
