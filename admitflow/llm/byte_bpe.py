"""Operator 9: byte-level BPE encoding and decoding over Arrow batches.

Encoding uses the tokenizers library with the vocabulary of a rank file. A text is cut at
places where the split pattern always cuts (before a single space, around a single line
feed), so that frequent pieces are encoded once per worker; a text with two neighbouring
white-space characters is encoded whole. Vocabulary entries are written in the library's
printable alphabet; decoding maps them back to bytes through the reversed byte table and
joins bytes before any character is formed, so characters split over tokens come out whole.
Offsets are byte ranges of the tokens; a token that starts inside a character is counted in
n_split_chars.

Defined results: null text is the empty text (0 tokens, hashes of nothing). Special-token
strings in a text are ordinary text. Repeated rows and ids give repeated results. An empty table
gives no rows. Extra columns are passed over. Texts are bounded by the 2 GB of an Arrow batch.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from admitflow.llm.common import prepare, resident

#: Pieces that one worker remembers; later ones are encoded anew in each batch.
PIECE_CACHE = 400_000
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TWO_SPACES = re.compile(r"\s\s")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class _Pieces(dict):
    """Remembered pieces; those of the present batch that are not kept are in rest."""

    rest: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.rest[piece]


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str = PATTERN):
        """ranks_path: lines of base64 token and rank. The merges follow from the ranks. pattern: what is encoded apart; it must not join a space or line feed to what stands before."""
        import base64

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        alphabet = byte_alphabet()
        spell = lambda t: "".join(alphabet[b] for b in t)
        merges = [tuple(map(spell, p)) for t in tokens if len(t) > 1 and (p := self._parts(t))]
        self.tok = Tokenizer(models.BPE({spell(t): r for t, r in self.ranks.items()}, merges))
        parts = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.tok.pre_tokenizer = pre_tokenizers.Sequence([parts, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # decoding: the vocabulary's spelling of each id, through the inverted byte alphabet
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.table = [bytes(byte_of[c] for c in self.tok.id_to_token(i) or "") for i in range(size)]
        self.lengths = np.array([len(t) for t in self.table], dtype=np.int64)
        self.cache = _Pieces({"": b""})

    def _parts(self, token: bytes) -> list[bytes] | None:
        """The two tokens whose merge gives this one: what the lower ranks make of its bytes."""
        rank, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str] | None] = []
        for t in texts:
            whole = "\0" in t or _TWO_SPACES.search(t)
            split.append(None if whole else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))
        cache = self.cache
        new = list({p for s in split if s for p in s if p not in cache})
        extra = dict(zip(new, self._encode(new), strict=True)) if new else {}
        if len(cache) + len(extra) <= PIECE_CACHE:
            cache.update(extra)
        else:
            cache.rest = extra
        out = [b"".join(map(cache.__getitem__, s)) if s else b"" for s in split]
        for i, s in enumerate(split):
            if s is None:
                out[i] = self._encode([texts[i]])[0]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """id, first and last character (exclusive) of each token of a text, by the library's offsets; tokens that hold parts of one character share its place."""
        e = self.tok.encode(text, add_special_tokens=False)
        return [(i, a, z) for i, (a, z) in zip(e.ids, e.offsets, strict=True)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Start byte of each token, and at the end the number of bytes."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))


def worker_bpe(path: str) -> ByteBpe:
    return resident(("byte bpe", path), lambda: ByteBpe(path))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [id_col, "ids", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_bytes: the ids of encode_documents turned back into bytes."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks_path)
        for b in batches:
            got = [bpe.decode(np.frombuffer(x or b"", dtype="<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], [id_col, "text_bytes"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} long, text_bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, returning digests instead of the ids and bytes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows: list[list] = [[], [], [], []]
                for raw in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.frombuffer(raw, dtype="<u4")
                    data = bpe.decode(ids)
                    starts = bpe.offsets(ids)[:-1]
                    inside = (np.frombuffer(data, dtype=np.uint8)[starts] & 0xC0) == 0x80 if len(ids) else np.zeros(0)
                    for r, v in zip(rows, (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(data).hexdigest(), int(inside.sum())), strict=True):
                        r.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_split_chars"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split_chars long")
