"""Operator 7, quality rules: line labelling by a linear-chain CRF.

A text is a sequence of lines. Each line has sparse binary features; a two-label
(content, boilerplate) linear-chain conditional random field, decoded by Viterbi, marks
every line. A text is kept if the fixed base rules pass and content lines hold at least
``MIN_SHARE`` of its code points.

The CRF is fitted here on at most ``MAX_FIT_DOCS`` labelled documents (those with the
smallest hash of their id), on all lines of each. Line labels are weak: in a low-quality
document a line with a junk cue is boilerplate; elsewhere only a line that repeats an
earlier one is. All documents are then judged on their whole texts.

Defined results: null text counts as no text (no words, so base_failed). Null or repeated
doc_ids are kept as rows of their own. Without any labelled row all weights are zero and
ties count as content. Extra columns of the input stay, whatever their names; those named like
a result are replaced by it. A very long text is labelled whole, in one row (its lines one after
another). An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import prepare, resident

MAX_FIT_DOCS = 600
MIN_SHARE = 0.5
MIN_WORDS = 50
#: The share of distinct words falls with length, so it is the mean over consecutive windows of so many words, weighted by their words.
WINDOW = 400
#: Lines that the fit works on at a time.
BLOCK_LINES = 1 << 17
SYMBOLS = "#*$%&|<>"

_SYM = re.compile(r"[#*$%&|<>]")
_ODD = re.compile(r"[#*$%&|<>!@^~=_{}\[\]\\]")
_DIGIT = re.compile(r"[0-9]")
_URL = re.compile(r"https?://|www\.")
_TERMS = re.compile(r"(?i)copyright|cookie|all rights reserved|subscribe|click here|log ?in|terms of")
FEATURES = (
    "bias", "empty", "short", "long", "terminal", "some_symbols", "many_symbols", "all_caps", "few_distinct",
    "very_few_distinct", "digits", "url", "repeats_earlier", "pipes", "site_terms", "first", "last", "odd_words",
)
_JUNK = {FEATURES.index(x) for x in ("some_symbols", "many_symbols", "all_caps", "few_distinct", "very_few_distinct", "pipes")}
_REPEAT = FEATURES.index("repeats_earlier")


def line_features(lines: list[str]) -> list[list[int]]:
    """Indexes into FEATURES of each line."""
    out, seen, last = [], set(), len(lines) - 1
    for i, line in enumerate(lines):
        f = [0]
        words = line.split()
        n, nw = len(line), len(words)
        if not nw:
            f.append(1)
        else:
            if nw < 4:
                f.append(2)
            elif nw >= 12:
                f.append(3)
            if words[-1][-1] in ".!?:;\"')":
                f.append(4)
            odd = len(_ODD.findall(line))
            if odd > 0.02 * n:
                f.append(5)
                if odd > 0.08 * n:
                    f.append(6)
            if nw >= 3 and line.upper() == line and line.lower() != line:
                f.append(7)
            if nw >= 10:
                d = sum(len(set(words[k : k + WINDOW])) for k in range(0, nw, WINDOW)) / nw
                if d < 0.5:
                    f.append(8)
                    if d < 0.25:
                        f.append(9)
            if len(_DIGIT.findall(line)) > 0.2 * n:
                f.append(10)
            if _URL.search(line):
                f.append(11)
            if line in seen:
                f.append(12)
            else:
                seen.add(line)
            if line.count("|") >= 3:
                f.append(13)
            if _TERMS.search(line):
                f.append(14)
            if not 2 <= (n - nw) / nw <= 16:
                f.append(17)
        if i == 0:
            f.append(15)
        if i == last:
            f.append(16)
        out.append(f)
    return out


def coded(feats: list[list[int]]) -> list[int]:
    """The features of each line as the bits of one number."""
    return [sum(1 << k for k in f) for f in feats]


class _Block:
    """Texts, longest first, laid out line by line: the first lines of all texts, then the second lines of those that have one, and so on."""

    def __init__(self, sequences: list[tuple[np.ndarray, np.ndarray]], kinds: np.ndarray):
        sizes = np.array([len(s[0]) for s in sequences])
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        self.kind, self.row, label = (np.empty(self.start[-1], np.int64) for _ in range(3))
        for i, (codes, labels) in enumerate(sequences):
            at = self.start[: len(codes)] + i
            self.kind[at], self.row[at], label[at] = np.searchsorted(kinds, codes), i, labels
        self.last = self.start[sizes - 1] + np.arange(len(sizes))
        self.right = np.arange(self.active[0], self.start[-1])
        self.left = self.right - np.repeat(self.active[:-1], self.active[1:])
        self.gold = np.bincount(self.kind * 2 + label, minlength=2 * len(kinds)).reshape(-1, 2).astype(float)
        self.gold_moves = np.bincount(label[self.left] * 2 + label[self.right], minlength=4).reshape(2, 2).astype(float)

    def expected(self, kind_scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of labels by kind of line, and of moves."""
        e, start, active = kind_scores[self.kind], self.start, self.active
        fwd, bwd = e.copy(), np.zeros_like(e)
        for t in range(1, len(active)):
            k = active[t]
            p = fwd[start[t - 1] : start[t - 1] + k]
            fwd[start[t] : start[t] + k] += np.logaddexp(p[:, :1] + moves[0], p[:, 1:] + moves[1])
        z = np.logaddexp.reduce(fwd[self.last], axis=1)[self.row]
        for t in range(len(active) - 2, -1, -1):
            k = active[t + 1]
            at = slice(start[t + 1], start[t + 1] + k)
            p = e[at] + bwd[at]
            bwd[start[t] : start[t] + k] = np.logaddexp(p[:, :1] + moves[:, 0], p[:, 1:] + moves[:, 1])
        node = np.exp(fwd + bwd - z[:, None])
        edge = np.exp(fwd[self.left][:, :, None] + moves + (e + bwd)[self.right][:, None, :] - z[self.right][:, None, None])
        return np.stack([np.bincount(self.kind, node[:, y], minlength=len(kind_scores)) for y in (0, 1)], axis=1), edge.sum(axis=0)


class LineCrf:
    """Two-label linear-chain CRF; label 0 is content, 1 boilerplate."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((len(FEATURES), 2)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.2, l2: float = 1e-3, block_lines: int = BLOCK_LINES) -> LineCrf:
        """Gradient ascent on the mean conditional log-likelihood, by forward-backward.

        sequences: the coded() lines and the labels of each text. They are laid out in blocks of about block_lines
        lines, so that working space doesn't grow with the number of texts; time grows with the longest text of each block.
        """
        sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
        if not sequences:
            return self
        kinds = np.unique(np.concatenate([s[0] for s in sequences]))
        has = (kinds[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)
        blocks, part, lines = [], [], 0
        for s in sequences:
            if part and lines + len(s[0]) > block_lines:
                blocks.append(_Block(part, kinds))
                part, lines = [], 0
            part.append(s)
            lines += len(s[0])
        blocks.append(_Block(part, kinds))
        total = sum(len(s[0]) for s in sequences)
        gold_w, gold_m = has.T @ sum(b.gold for b in blocks), sum(b.gold_moves for b in blocks)
        moment = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for _ in range(steps):
            kind_scores, node, edge = has @ self.weights, np.zeros((len(kinds), 2)), np.zeros((2, 2))
            for b in blocks:
                for acc, own in zip((node, edge), b.expected(kind_scores, self.moves), strict=True):
                    acc += own
            grads = ((gold_w - has.T @ node) / total - l2 * self.weights, (gold_m - edge) / total - l2 * self.moves)
            for k, g in enumerate(grads):
                moment[k] = 0.9 * moment[k] + g
            self.weights = self.weights + rate * 10 * moment[0]
            self.moves = self.moves + rate * moment[1]
        return self

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        """The best label sequence; ties go to content."""
        w0, w1 = self._w0, self._w1
        (m00, m01), (m10, m11) = self._m
        back, a, b = [], 0.0, 0.0
        for i, f in enumerate(feats):
            e0, e1 = sum([w0[k] for k in f]), sum([w1[k] for k in f])
            if i == 0:
                a, b = e0, e1
                continue
            c0, c1, d0, d1 = a + m00, b + m10, a + m01, b + m11
            back.append((0 if c0 >= c1 else 1, 0 if d0 >= d1 else 1))
            a, b = max(c0, c1) + e0, max(d0, d1) + e1
        label = 0 if a >= b else 1
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return out[::-1] if feats else []

    def ready(self) -> LineCrf:
        self._w0, self._w1 = self.weights[:, 0].tolist(), self.weights[:, 1].tolist()
        self._m = self.moves.tolist()
        return self


def weak_labels(feats: list[list[int]], quality: int) -> list[int]:
    return [int(_REPEAT in f or (quality == 0 and bool(_JUNK.intersection(f)))) for f in feats]


def fit_line_crf(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS) -> LineCrf:
    """Fit on a bounded sample: at most max_docs labelled documents, equally many of each quality."""
    prepare(docs.sparkSession)
    half = max_docs // 2
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    lab = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = lab.where("quality = 1").orderBy(*order).limit(half).unionByName(lab.where("quality = 0").orderBy(*order).limit(half))
    rows = picked.collect()  # at most max_docs small rows
    if not rows:
        return LineCrf().ready()
    spark = docs.sparkSession
    picked = spark.createDataFrame([(r.doc_id, int(r.quality)) for r in rows], "doc_id long, quality int")
    # of rows that repeat an id one is taken, so that no more than max_docs texts come
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats = [line_features(t.split("\n")) for t in b.column("text").to_pylist()]
            marks = [weak_labels(f, q) for f, q in zip(feats, b.column("quality").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([coded(f) for f in feats], pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32()))], ["doc_id", "codes", "marks"])

    got = sample.mapInArrow(features, "doc_id long, codes array<int>, marks array<int>").collect()
    got.sort(key=lambda r: (r.doc_id, len(r.codes)))
    return LineCrf().fit([(np.array(r.codes), np.array(r.marks)) for r in got]).ready()


def _repeated_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    k = len(ids)
    if k < 1 << 20:
        keys = (a[:-2] << 40) | (a[1:-1] << 20) | a[2:]
    else:
        pairs = np.unique(a[:-1] * k + a[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * n + pairs[1:]
    _, inv, cnt = np.unique(keys, return_inverse=True, return_counts=True)
    hit = cnt[inv] > 1
    cover = np.zeros(n, dtype=bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def judge(text: str | None, crf: LineCrf, min_share: float = MIN_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_content_lines, content_share."""
    text = text or ""
    words = text.encode().split()
    n_words = len(words)
    chars = len(b"".join(words).decode())
    lines = text.split("\n")
    feats = line_features(lines)
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeat = _repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeat > 50 * n_words
    marks = crf.viterbi(feats)
    content = sum(len(line) for line, m in zip(lines, marks, strict=True) if not m)
    total = sum(map(len, lines))
    share = content / total if total else 0.0
    return (n_words, chars, len(_SYM.findall(text)), dup, repeat, failed, not failed and share >= min_share, len(lines), len(marks) - sum(marks), share)


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_content_lines long, content_share double"
)
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]


def label_lines(docs: DataFrame, crf: LineCrf, min_share: float = MIN_SHARE) -> DataFrame:
    """All columns of docs, then those of RESULT; one narrow pass, no shuffle."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]
    clash = [c for c in docs.columns if c in names]
    docs = docs.drop(*clash)
    crf_parts = (crf.weights, crf.moves)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("none", object)
        model = LineCrf(*crf_parts).ready()
        for b in batches:
            got = list(zip(*(judge(t.as_py(), model, min_share) for t in b.column("text")), strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, t in zip(got, _TYPES, strict=True))], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
