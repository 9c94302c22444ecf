"""Operator 4, packing: neighbours along a Hilbert curve share sequences.

Each document becomes token ids and a closing id. Its hashed token vector (a signed
``HASH_DIMS``-dimensional hash of its ids, averaged) is projected to three dimensions and
gets a Hilbert key. Documents are range-sorted by key and laid end to end along the curve;
the line of tokens is cut every ``length`` tokens, so only the very last sequence is padded.

1. Arrow pass: ids, length and key of every document, stored once in the shared folder.
2. The narrow rows (key, id, length) are range-sorted; ties of the key are split by row id, so
   a hot key spreads over ranges. Each range adds up its lengths; one long per range goes to
   the driver, which is as many as there are partitions.
3. The starts are joined back to the ids by a unique row id, and pieces are cut.

Defined results: null or empty text holds the closing id alone. Repeated doc_ids are packed
once per row. An empty table gives no piece. Extra columns are passed over.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import mix64, prepare, resident, store

LENGTH = 2048
CLOSING_ID = 1
HASH_DIMS = 64
CURVE_DIMS = 3
CURVE_BITS = 16
UNIT = 1 << 20
#: Words in each of the two dictionaries of a Python worker, and rows and bytes of text that it handles at a time (one text at least).
WORD_CACHE = 200_000
ROWS = 2000
BYTES = 6_000_000

_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


#: Letters that lower-case one to one and that NFC leaves alone, and words made of them with one mark at most behind.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = ".,;:!?"
_SIMPLE = f"^[{_LETTERS}]+[{_MARKS}]?$"


class WordTokens:
    """Ids of a tokenizer that drops white space and lower-cases: words between spaces and line feeds are independent, so each distinct one of a batch is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        from admitflow.llm.byte_bpe import byte_alphabet

        self.tok = Tokenizer.from_file(path)
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.spell = {b: c for b, c in enumerate(byte_alphabet())}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part. Two dictionaries of bounded size take turns, so that frequent parts stay."""
        out = list(map(self.young.get, parts))
        known, tokenize = self.old.get, self.tok.model.tokenize
        fresh = {}
        for i in [i for i, x in enumerate(out) if x is None]:
            part = parts[i]
            got = known(part)
            if got is None:
                spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.spell)
                got = array("H", [t.id for t in tokenize(spelt)]).tobytes()
            out[i] = fresh[part] = got
        if len(self.young) + len(fresh) > WORD_CACHE:
            self.old, self.young = self.young, {}
        if len(fresh) <= WORD_CACHE:
            self.young.update(fresh)
        return out

    def _split(self, word: str) -> list[str] | None:
        """The parts of a word; None for words that need the whole tokenizer."""
        plain = word.isascii()
        if word and not plain:
            word = unicodedata.normalize("NFC", word)
            if max(word) > "ɏ" or "İ" in word:
                return None
        low = word.lower()
        if "<|" in word or not word.isprintable():  # a special token, or white space of other kinds
            return None
        return (_PLAIN if plain else self.parts).findall(low)

    def _lists(self, parts: list[bytes]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]) // 2
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<u2")))

    def _distinct(self, words: pa.Array) -> pa.Array:
        """A list of ids for each of the distinct words."""
        simple = pc.match_substring_regex(words, _SIMPLE)
        plain = words.filter(simple)
        core = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(plain, _MARKS)))
        heads = self._lists(self._parts(core.dictionary.to_pylist())).take(core.indices)
        stop = np.frombuffer(plain.buffers()[1], dtype="<i4")[plain.offset + 1 : plain.offset + len(plain) + 1]
        last = np.frombuffer(plain.buffers()[2], dtype=np.uint8)[stop - 1]
        which = np.zeros(256, np.int64)
        which[list(_MARKS.encode())] = np.arange(1, len(_MARKS) + 1)
        tails = self._lists([b"", *self._parts(list(_MARKS))]).take(pa.array(which[last]))
        odd = words.filter(pc.invert(simple)).to_pylist()
        split = [self._split(w) for w in odd]
        hard = [i for i, x in enumerate(split) if x is None]
        flat = iter(self._parts([p for x in split if x for p in x]))
        got = [b"".join([next(flat) for _ in x or ()]) for x in split]
        for i, e in zip(hard, self.tok.encode_batch_fast([odd[i] for i in hard], add_special_tokens=False) if hard else (), strict=True):
            got[i] = np.array(e.ids, dtype="<u2").tobytes()
        # simple words, their marks and odd words are laid out one after another, then put in the order of words
        n, m = len(plain), len(words)
        at = np.empty(m, np.int64)
        flags = simple.to_numpy(zero_copy_only=False)
        at[flags], at[~flags] = np.arange(n), 2 * n + np.arange(m - n)
        every = pa.concat_arrays([heads, tails, self._lists(got)])
        pairs = np.stack([at, np.where(flags, at + n, 2 * n + m - n)], axis=1).ravel()
        every = pa.concat_arrays([every, self._lists([b""])]).take(pa.array(pairs))
        return pa.ListArray.from_arrays(pa.array(every.offsets.to_numpy()[::2]), every.values)

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """texts without nulls -> ids of each distinct word (lists of unsigned 16-bit integers), the words of the texts as places in it, ends of the texts in them."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = pc.dictionary_encode(words.flatten())
        ends = (words.offsets.to_numpy() - words.offsets[0].as_py()).astype(np.int64)
        return self._distinct(coded.dictionary.cast(pa.string())), coded.indices.to_numpy(), ends


def projection(vocabulary: int = 1 << 16) -> np.ndarray:
    """Per id: its signed hash dimension, projected to CURVE_DIMS by a fixed matrix; in units of 1 / UNIT, so that sums don't depend on their order."""
    h = mix64(np.arange(1, vocabulary + 1, dtype=np.uint64))
    matrix = np.random.default_rng(7).standard_normal((HASH_DIMS, CURVE_DIMS))
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    return np.rint(matrix[(h % np.uint64(HASH_DIMS)).astype(int)] * sign[:, None] * UNIT).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, dims), by Gray-code untangling of all rows at once."""
    x = points.astype(np.int64).T.copy()
    dims, top = x.shape[0], 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = top
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _worker(path: str) -> tuple[WordTokens, np.ndarray]:
    return resident(("word tokens", path), lambda: (WordTokens(path), projection()))


def _slices(b: pa.RecordBatch, column: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, and bytes of the column unless one value has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield b.slice(at, stop - at)
        at = stop


def encoded(texts: pa.Array, words: WordTokens, proj: np.ndarray, closing_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """texts without nulls (one at least) -> all ids, how many each text has, Hilbert keys."""
    lists, index, ends = words.encode(texts)
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    held = lists.values.to_numpy()
    sums = np.concatenate([np.zeros((1, CURVE_DIMS), np.int64), np.cumsum(proj[held], axis=0)])
    vector = np.diff(sums[lists.offsets.to_numpy()], axis=0)
    n = np.add.reduceat(size[index], ends[:-1]) + 1
    mean = np.stack([np.add.reduceat(vector[index, k], ends[:-1]) + proj[closing_id, k] for k in range(CURVE_DIMS)], axis=1) / (n[:, None] * float(UNIT))
    ids = np.empty(int(n.sum()), dtype="<u2")
    last = np.cumsum(n) - 1
    inner = np.ones(len(ids), dtype=bool)
    inner[last] = False
    ids[inner] = lists.take(pa.array(index)).flatten().to_numpy()
    ids[last] = closing_id
    grid = np.floor((np.tanh(mean) + 1) / 2 * ((1 << CURVE_BITS) - 1)).astype(np.int64)
    return ids, n, hilbert_keys(grid)


def tokenised(docs: DataFrame, tokenizer_path: str, closing_id: int = CLOSING_ID) -> DataFrame:
    """row_id, doc_id, hkey, n, ids (unsigned 16-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, proj = _worker(tokenizer_path)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for part in _slices(b, "text"):
                ids, n, key = encoded(pc.fill_null(part.column("text"), ""), words, proj, closing_id)
                offsets = np.concatenate(([0], np.cumsum(2 * n)))
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), part.column("doc_id"), pa.array(key), pa.array(n), raw], ["row_id", "doc_id", "hkey", "n", "ids"])
                row += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row_id long, doc_id long, hkey long, n long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    pid, total = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(np.full(len(n), pid, dtype=np.int64)), pa.array(before.astype(np.int64)), b.column("n")], ["row_id", "pid", "before", "n"])


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert_key; one row per piece."""
    spark = docs.sparkSession
    prepare(spark)
    tokens = store(tokenised(docs, tokenizer_path, closing_id), "packing-tokens")
    order = store(
        tokens.select("row_id", "hkey", "doc_id", "n").repartitionByRange("hkey", "doc_id", "row_id").sortWithinPartitions("hkey", "doc_id", "row_id").mapInArrow(_running, "row_id long, pid long, before long, n long"),
        "packing-order",
    )
    totals = sorted((r.pid, r.total) for r in order.groupBy("pid").agg(F.max(F.col("before") + F.col("n")).alias("total")).collect())
    bases, at = [], 0
    for pid, total in totals:
        bases.append((pid, at))
        at += total
    base = spark.createDataFrame(bases, "pid long, base long")
    starts = order.join(F.broadcast(base), "pid").select("row_id", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert_key"]
        resident("none", object)
        for b in batches:
            for part in _slices(b, "ids"):
                at, raw = part.column("at").to_numpy(), part.column("ids")
                lengths = pc.binary_length(raw).to_numpy().astype(np.int64) // 2
                flat = memoryview(np.frombuffer(b"".join(raw.to_pylist()), dtype="<u2").astype("<u4")).cast("B")
                pieces = (at + lengths - 1) // length - at // length + 1
                doc = np.repeat(np.arange(len(at)), pieces)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (at // length)[doc]
                start = np.maximum(seq * length - at[doc], 0)
                n = np.minimum((seq + 1) * length - at[doc], lengths[doc]) - start
                place = 4 * ((np.cumsum(lengths) - lengths)[doc] + start)
                crc = [zlib.crc32(flat[a:z]) for a, z in zip(place.tolist(), (place + 4 * n).tolist(), strict=True)]
                offset = (at[doc] + start) % length
                columns = [part.column("doc_id").take(pa.array(doc)), start, n, pa.array(crc, pa.int64()), lengths[doc], seq, offset, part.column("hkey").take(pa.array(doc))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    out = tokens.select("row_id", "doc_id", "hkey", "ids").join(starts, "row_id")
    return out.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long")


