"""Operator 6, suffix-array dedup: a run-length index marks repeated byte strings.

Every byte covered by a ``length``-byte string that also starts somewhere else (in any text,
the same one included) is removed; strings are judged on the input. With ``watch``, a shorter
length, passages of over ``PASSAGE_WORDS`` words covered by repeated strings of that length
are counted as well (by another run of the same steps), and stay.

 1. Each window of ``length`` bytes has an anchor, its least-hashed ``KMER``-byte string.
    Equal windows have equal anchors at equal places, so only windows that share an anchor
    need comparing. The windows around one anchor occurrence form a segment. One pass stores
    anchor, segment digest and place (about one row per 185 bytes).
 2. Anchors that occur once are dropped. Segments that occur twice or more are marked whole,
    and one of them stands for all.
 3. Distinct segments of an anchor meet in one task, many anchors to a chunk: the suffix array
    of the chunk gives its Burrows-Wheeler transform, which is run-compressed, keeping suffix
    positions at run ends. The longest match of a suffix with a neighbour falls by one from
    each text position to the next except at run ends, so matching statistics are streamed
    from the sampled run ends alone: each such match of the length asked for is marked.
 4. Anchors with more than ``GROUP`` distinct segments are not gathered. Their windows are
    split in halves by distance from the anchor; parts of equal
    content are marked and go on as one; parts alone with their common core are done; the
    others are halved again.

Defined results: null and empty texts have no bytes (kept_sha256 is that of nothing). Rows that
repeat a doc_id, with the same or another text, are texts of their own. Null doc_ids take part.
Texts are told apart by id and 64-bit hash, and what is gathered for a text is bounded by its length,
so ids that are null or repeat cost no more than others. An empty table gives no rows. Extra columns are
passed over by report() and kept by strip(), whatever their names. A very long text is hashed in one piece and is bounded by the 2 GB of an
Arrow batch. Equality of segments and parts is that of 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import discard, fresh, mix64, prepare, reclaim, resident, store, take

LENGTH = 400
KMER = 32
#: Shorter repeats that are counted, not removed, if they have over so many words.
WATCH = 256
PASSAGE_WORDS = 50
#: Bytes of text that are hashed at a time (one text at least).
SLICE = 1 << 18
#: Most distinct segments of an anchor that are gathered in one task (1.5 MB, whose index takes about 150 MB), and bytes of a chunk.
GROUP = 2500
CHUNK = 250_000
BROADCAST_ROWS = 1_000_000
_NO_ID = -(1 << 63)
_U = np.uint64
_END = 0xFF  # never occurs in UTF-8


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data)
    word = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix64(word + _U(0x9E3779B97F4A7C15))
        count = n - KMER + 1
        out = h[:count].copy()
        for k in range(8, KMER, 8):
            out *= _U(0xD1342543DE82EF95)
            out += h[k : k + count]
        return mix64(out)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of width values, by block prefix and suffix minima."""
    n = len(values)
    pad = -n % width
    v = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, dtype=_U)]).reshape(-1, width)
    prefix = np.minimum.accumulate(v, axis=1).ravel()
    suffix = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


class _Powers:
    """Powers of two odd bases and of their inverses modulo 2^64, up to the longest buffer seen."""

    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self):
        self.size, self.tables = 0, ()

    def upto(self, n: int) -> tuple:
        if n > self.size:
            self.size = max(n, 2 * SLICE)
            steps = [np.full(self.size, b, dtype=_U) for base in self.BASES for b in (base, pow(base, -1, 1 << 64))]
            for x in steps:
                x[0] = 1
            self.tables = tuple(np.multiply.accumulate(x) for x in steps)
        return self.tables


def anchored_segments(data: np.ndarray, offsets: np.ndarray, window: int, powers: _Powers) -> tuple[np.ndarray, ...]:
    """Per anchor occurrence in the texts that lie in data at offsets: text, hash, digest (two halves), place, start and size of its segment, which holds the windows that have the anchor."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if len(data) < window or sizes.max() < window:
        return none, none.view(_U), none.view(_U), none.view(_U), none, none, none
    h = _kmer_hashes(data)
    order = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    place = (_window_minima(order, window - KMER + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    # windows that begin and end in one text; of each run of windows with the same anchor the first and the last
    edge = np.zeros(len(data) + 1, np.int8)
    held = sizes >= window
    np.add.at(edge, offsets[:-1][held], 1)
    np.add.at(edge, offsets[1:][held] - window + 1, -1)
    inside = np.cumsum(edge[: len(place)], dtype=np.int8) > 0
    fresh = inside.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    opens = np.zeros(len(place), bool)
    opens[offsets[:-1][held]] = True
    first = np.flatnonzero(fresh | (opens & inside))
    ends = inside.copy()
    ends[:-1] &= (place[1:] != place[:-1]) | ~inside[1:] | opens[1:]
    last = np.flatnonzero(ends)
    text = np.searchsorted(offsets, first, side="right") - 1
    at = place[first]
    start, stop = first, last + window
    digests = []
    with np.errstate(over="ignore"):
        tables = powers.upto(len(h))
        for k, values in enumerate((h, (h << _U(29)) | (h >> _U(35)))):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * tables[2 * k][: len(h)], dtype=_U)])
            own = (sums[stop - KMER + 1] - sums[start]) * tables[2 * k + 1][start]
            digests.append(mix64(own + mix64((at - start).astype(_U) + _U(k << 40)) + (stop - start).astype(_U)))
    return text, h[at], digests[0], digests[1], at - offsets[text], start - offsets[text], stop - start


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values in them; nulls are empty."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """akey, s1, s2 (segment digest), key (doc_id), th (text digest), place, start, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = resident("powers", _Powers)
        for b in batches:
            data, offsets = _flat(b.column("text"))
            keys, hashes, i = b.column("key").to_numpy(), b.column("th").to_numpy(), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
                own = offsets[i : j + 1]
                text, key, s1, s2, place, start, size = anchored_segments(data[own[0] : own[-1]], own - own[0], window, powers)
                if len(text):
                    cols = [key.view(np.int64), s1.view(np.int64), s2.view(np.int64), keys[i:j][text], hashes[i:j][text], place, start, size]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["akey", "s1", "s2", "key", "th", "place", "start", "size"])
                i = j

    return docs.select("key", "th", "text").mapInArrow(run, "akey long, s1 long, s2 long, key long, th long, place long, start long, size long")


def repeated_ranges(stretches: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Ranges of each byte string covered by a length-byte string that starts elsewhere in them, by the run-length index."""
    text = np.frombuffer(bytes([_END]).join(stretches) + bytes([_END]) * 8, dtype=np.uint8)
    n = len(text) - 7
    word = np.ndarray(shape=(n,), dtype=">u8", buffer=text.tobytes(), strides=(1,)).astype(_U)
    # prefix doubling to the full suffix order (neighbours then stay neighbours one byte earlier);
    # a rank is the first place of its group, and only groups of several suffixes are sorted again
    order = np.argsort(word)
    fresh = np.concatenate(([True], word[order[1:]] != word[order[:-1]]))
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    levels, k = [(8, rank.astype(np.int32))], 8
    pos = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
    while len(pos):
        suffix = order[pos]
        after = suffix + k
        key = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[pos] = suffix
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffix] = pos[np.maximum.accumulate(np.where(fresh, place[: len(pos)], 0))]
        k *= 2
        levels.append((k, rank.astype(np.int32)))
        pos = pos[~(fresh & np.concatenate((fresh[1:], [True])))]
    # Burrows-Wheeler transform; a stretch's first suffix has no character before it and ends a run
    before = np.where(order > 0, text[order - 1], _END)
    run_end = (before[1:] != before[:-1]) | (before[1:] == _END)
    # sampled run ends with a match of half the length at least (rank of the widest level below it)
    half = max((lv for lv in levels if lv[0] <= length), default=levels[0])[1]
    cut = np.flatnonzero(run_end & (half[order[1:]] == half[order[:-1]]))
    p, q = order[cut], order[cut + 1]
    ends = np.flatnonzero(text[:n] == _END)
    room = ends[np.searchsorted(ends, p)] - p
    room = np.minimum(room, ends[np.searchsorted(ends, q)] - q)
    got = np.zeros(len(p), np.int64)
    top = levels[-1][0]
    active = np.arange(len(p))
    while len(active):  # as many steps as the longest match has widths of the top level
        same = levels[-1][1][p[active] + got[active]] == levels[-1][1][q[active] + got[active]]
        active = active[same]
        got[active] += top
        active = active[got[active] < room[active]]
    for width, ranks in reversed(levels[:-1]):
        act = np.flatnonzero(got < room)
        same = ranks[p[act] + got[act]] == ranks[q[act] + got[act]]
        got[act[same]] += width
    act = np.flatnonzero(got < room)
    diff = word[p[act] + got[act]] ^ word[q[act] + got[act]]
    lead = np.zeros(len(act), np.int64)
    for i in range(7):
        lead += diff < (_U(1) << _U(8 * (7 - i)))
    got[act] += lead
    got = np.minimum(got, room)
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in stretches])))
    long = got >= length
    cover = np.zeros(n + 1, np.int64)
    for side in (p, q):
        np.add.at(cover, side[long], 1)
        np.add.at(cover, side[long] + got[long], -1)
    inside = np.concatenate(([0], (np.cumsum(cover[:n]) > 0).astype(np.int8), [0]))
    edge = np.diff(inside)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in stretches]
    for a, z, i in zip(begin, stop, np.searchsorted(starts, begin, side="right") - 1, strict=True):
        out[i].append((int(a - starts[i]), int(z - starts[i])))
    return out


def _indexed_marks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by akey -> marks; an anchor's rows stay in one chunk."""
    names = ["key", "th", "start", "size", "least"]
    resident("none", object)

    def marks(rows: list[tuple]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[:3])
        places, texts = [], []
        for key, th, start, data in rows:
            if places and places[-1][:2] == (key, th) and start <= places[-1][2] + len(texts[-1]):
                texts[-1] += data[len(texts[-1]) - (start - places[-1][2]) :] if start + len(data) > places[-1][2] + len(texts[-1]) else b""
            else:
                places.append((key, th, start))
                texts.append(data)
        found = [
            (key, th, start + a, z - a, length)
            for (key, th, start), spans in zip(places, repeated_ranges(texts, length), strict=True)
            for a, z in spans
        ]
        if found:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    held: list[tuple] = []
    size, last, cut = 0, None, 0
    for b in batches:
        for akey, key, th, start, data in zip(*(b.column(c).to_pylist() for c in ("akey", "key", "th", "start", "bytes")), strict=True):
            if akey != last:
                if size >= CHUNK:
                    if (m := marks(held)) is not None:
                        yield m
                    held, size = [], 0
                last = akey
            held.append((key, th, start, data))
            size += len(data)
    if held and (m := marks(held)) is not None:
        yield m


def _refined_marks(hot: DataFrame, length: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Marks, and the tables they are read from, of the segments hot (akey, key, th, place, start, bytes), by halving their windows' distances from the anchor."""
    lo = F.col("place") - (F.col("start") + F.octet_length("bytes") - length)
    parts = hot.where(F.octet_length("bytes") >= length).select("akey", "key", "th", "place", "start", "bytes", lo.alias("lo"), (F.col("place") - F.col("start")).alias("hi"))
    # blocks lie at fixed distances, so that parts of different segments get equal bounds
    width = 1 << (length - 1).bit_length()
    parts = parts.withColumn("block", F.lit(0).cast("long"))
    found, tables, level = [], [], 0
    parts = store(parts.withColumn("id", F.monotonically_increasing_id()), "dedup-parts-0")
    while True:
        if parts.isEmpty():
            discard(parts)
            break
        piece = lambda a, z: F.md5(F.substr("bytes", (a - F.col("start") + 1).cast("int"), (z - a).cast("int")))
        low = F.col("block") * width
        whole = F.concat_ws("-", "lo", "hi", piece(F.col("place") - F.col("hi"), F.col("place") - F.col("lo") + length))
        core = piece(F.col("place") - low, F.col("place") - low - width + 1 + length) if width < length else F.lit("")  # bytes that all windows of the block have
        # bytes stay where they are while digests are compared; the parts that go on fetch theirs by id
        marked = parts.select("id", "akey", "block", "key", "th", "place", "lo", "hi", whole.alias("whole"), core.alias("core"))
        kinds = marked.groupBy("akey", "block", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
        cores = marked.groupBy("akey", "block", "core").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a < b").select("akey", "block", "core", F.lit(True).alias("open"))
        done = store(marked.join(kinds, ["akey", "block", "whole"]).join(cores, ["akey", "block", "core"], "left").drop("whole", "core"), f"dedup-done-{level}")
        tables.append(done)
        found.append(done.where("n > 1").select("key", "th", (F.col("place") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + length).alias("size"), F.lit(length).cast("long").alias("least")))
        if width < 2:
            discard(parts)
            break
        # one of equal parts goes on, as it can equal windows of other kinds
        onward = done.where(F.col("open") & ((F.col("n") == 1) | (F.col("id") == F.col("one")))).select("id", "block")
        rest = parts.join(onward, ["id", "block"], "left_semi").drop("block")
        width //= 2
        rest = rest.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
        low = F.col("block") * width
        fresh = store(rest.withColumn("lo", F.greatest(F.col("lo"), low)).withColumn("hi", F.least(F.col("hi"), low + width - 1)), f"dedup-parts-{level + 1}")
        discard(parts)
        parts = fresh
        level += 1
    out = None
    for x in found:
        out = x if out is None else out.unionByName(x)
    return out, tables


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, th, start, size, least (length): ranges covered by strings of length bytes that start twice or more, overlapping ones among them. docs: key, th (hash of the text), text."""
    anchors = store(_anchors(docs, length), "dedup-anchors")
    again = store(anchors.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("akey"), "dedup-again")
    few = again.count() <= BROADCAST_ROWS
    shared = store(anchors.join(F.broadcast(again) if few else again, "akey"), "dedup-shared")
    discard(anchors)
    reclaim(docs.sparkSession)
    segments = shared.groupBy("akey", "s1", "s2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "th", "start", "size", "place")).alias("one"))
    segments = store(segments, "dedup-segments")
    reclaim(docs.sparkSession)
    alike = shared.join(segments.where("copies > 1").select("akey", "s1", "s2"), ["akey", "s1", "s2"])
    out = alike.select("key", "th", "start", "size", F.lit(length).cast("long").alias("least"))
    groups = store(segments.groupBy("akey").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "dedup-groups")
    if groups.isEmpty():
        return store(out.distinct(), "dedup-marks")
    wanted = segments.select("akey", "one.*").join(groups, "akey")
    by_doc = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("akey", "start", "size", "place", F.col("kinds"))).alias("wanted"))  # bounded by the text's length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["akey", "key", "th", "place", "start", "kinds", "bytes"]
        resident("none", object)
        for b in batches:
            data, offsets = _flat(b.column("text"))
            view, lists = memoryview(data), b.column("wanted")
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
            flat = lists.flatten()
            want = {n: flat.field(n) for n in ("akey", "start", "size", "place", "kinds")}
            begin = (offsets[row] + want["start"].to_numpy()).tolist()
            pieces = pa.array([view[a : a + n].tobytes() for a, n in zip(begin, want["size"].to_pylist(), strict=True)], pa.binary())
            cols = [want["akey"], *(b.column(n).take(pa.array(row)) for n in ("key", "th")), *(want[n] for n in ("place", "start", "kinds")), pieces]
            yield pa.RecordBatch.from_arrays(cols, names)

    source = docs
    if few:
        ids = store(wanted.select("key", "th").distinct(), "dedup-ids")
        source = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ["key", "th"], "left_semi")
    pieces = source.join(by_doc, ["key", "th"]).select("key", "th", "text", "wanted").mapInArrow(cut, "akey long, key long, th long, place long, start long, kinds long, bytes binary")
    again = shared.groupBy("akey", "key", "th", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():  # rows that repeat both id and text give the same pieces again
        pieces = pieces.dropDuplicates(["akey", "key", "th", "place"])
    pieces = store(pieces, "dedup-pieces")
    reclaim(docs.sparkSession)
    gathered = pieces.where(F.col("kinds") <= GROUP).select("akey", "key", "th", "start", "bytes").repartition("akey").sortWithinPartitions("akey")
    out = out.unionByName(gathered.mapInArrow(lambda it: _indexed_marks(it, length), "key long, th long, start long, size long, least long"))
    hot, done = pieces.where(F.col("kinds") > GROUP).drop("kinds"), []
    if not hot.isEmpty():
        more, done = _refined_marks(hot, length)
        out = out if more is None else out.unionByName(more)
        reclaim(docs.sparkSession)
    out = store(out.distinct(), "dedup-marks")
    for x in (shared, segments, groups, pieces, *done):
        discard(x)
    reclaim(docs.sparkSession)
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """Bytes outside of the ranges (start, size), and the number of maximal ranges."""
    merged: list[list[int]] = []
    for a, n in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], a + n)
        else:
            merged.append([a, a + n])
    parts, at = [], 0
    for a, z in merged:
        parts.append(data[at:a])
        at = z
    parts.append(data[at:])
    return b"".join(parts), len(merged)


def _over(data: bytes, spans: list[tuple[int, int]], words: int) -> int:
    """How many maximal ranges of the spans have over so many words."""
    merged: list[list[int]] = []
    for a, n in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], a + n)
        else:
            merged.append([a, a + n])
    return sum(len(data[a:z].split()) > words for a, z in merged)


def _names(docs: DataFrame) -> list[str]:
    """Names of the key, the text's hash and the ranges, then of the columns that removed() adds; none of them is a column of docs."""
    return [fresh(f"_af_{n}", docs) for n in ("key", "th", "spans", "n_bytes", "n_removed", "n_spans", "n_passages", "kept")]


def removed(docs: DataFrame, length: int = LENGTH, as_text: bool = False, watch: int | None = None) -> DataFrame:
    """docs (with text) plus n_bytes, n_removed, n_spans, n_passages and kept (binary; as text, without bytes of characters cut in two) under the names of _names().

    n_passages: ranges covered by repeated strings of watch bytes (removed or not) with over PASSAGE_WORDS words.
    """
    key, th, spans, *names = _names(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: F.xxhash64(text)})
    texts = keyed.select(F.col(key).alias("key"), F.col(th).alias("th"), "text")
    found = marks(texts, length)
    if watch and watch != length:
        found = found.unionByName(marks(texts, watch))
    by_text = found.groupBy(F.col("key").alias(key), F.col("th").alias(th)).agg(F.collect_list(F.struct("start", "size", "least")).alias(spans))  # bounded by the text's length
    joined = keyed.join(by_text, [key, th], "left")
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("none", object)
        for b in batches:
            data, offsets = _flat(b.column("text"))
            view = memoryview(data)
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            cols: list[list] = [[], [], [], []]
            kept_all: list = []
            lists = b.column(spans)
            marked = lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            start, size, least = (flat.field(n).to_numpy() for n in ("start", "size", "least"))
            for i, (a, z) in enumerate(bounds):
                kept, n, passages = view[a:z].tobytes(), 0, 0
                if marked[i]:
                    at = slice(ends[i - 1] if i else 0, ends[i])
                    every = list(zip(start[at].tolist(), size[at].tolist(), strict=True))
                    passages = _over(kept, every, PASSAGE_WORDS)
                    kept, n = _kept(kept, [x for x, k in zip(every, least[at].tolist(), strict=True) if k == length])
                for c, v in zip(cols, (z - a, z - a - len(kept), n, passages), strict=True):
                    c.append(v)
                kept_all.append(kept.decode("utf-8", "ignore") if as_text else kept)
            rest = [b.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, pa.int64()) for c in cols), pa.array(kept_all, pa.string() if as_text else pa.binary())], [*own, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    results = zip(names, ["long"] * 4 + ["string" if as_text else "binary"], strict=True)
    return joined.select(*docs.columns, spans).mapInArrow(run, ", ".join([schema, *(f"{n} {t}" for n, t in results)]))


def report(docs: DataFrame, length: int = LENGTH, watch: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages."""
    prepare(docs.sparkSession)
    own = take(docs, "doc_id", "text")
    n_bytes, n_removed, n_spans, n_passages, kept = _names(own)[3:]
    out = removed(own, length, watch=watch)
    counts = {"n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans}
    return out.select("doc_id", *(F.col(c).alias(n) for n, c in counts.items()), F.sha2(F.col(kept), 256).alias("kept_sha256"), F.col(n_passages).alias("n_passages"))


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes taken out of text (bytes of characters cut in two are dropped), n_chars following."""
    prepare(docs.sparkSession)
    _, n_removed, *_, kept = _names(docs)[3:]
    same = F.col(n_removed) == 0
    out = removed(docs, length, as_text=True).withColumn("text", F.when(same, F.col("text")).otherwise(F.col(kept)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
