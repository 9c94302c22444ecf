"""Operator 1, quality classifier: co-training of a text view and a metadata view.

The text view sees hashed words and surface statistics of the whole text; the metadata view
sees language, source and stated size. Each is a ridge-regression classifier whose sufficient
statistics (X'X and X'y) are summed over all documents by partial aggregation, so nothing is
sampled; only these matrices and score histograms, of fixed size, reach the driver.

Labelled documents are split by a hash of their id: ``CALIBRATION`` percent calibrate (Platt's
method on score histograms), the others train. In each round the unlabelled documents that a
view ranks highest and lowest (``SHARE`` of all, divided as the labelled classes are) are
pseudo-labels, of weight ``PSEUDO_WEIGHT``, for the other view. Their target is the calibrated
expectation, so that a view which ranks poorly teaches little; a view that doesn't rank at all
gives none. After the last round the calibrated log-odds
are combined as if the views were independent given the class (their sum less the prior's).

Defined results: null text is empty; null language, source or size are values of their own.
Null labels are ignored; of several labels of an id the least counts. With labels of one class
or none, every score is the prior (0.5 without labels). Rows that repeat a doc_id are scored
each. An empty table gives no rows. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import WordHashes, mix64, prepare, resident, store

HASHED = 64
ROUNDS = 3
SHARE = 0.1
PSEUDO_WEIGHT = 0.3
CALIBRATION = 20
RIDGE = 1.0
THRESHOLD = 0.5
BINS = 400
META = 8 + 32 + 8 + 2
_STATS = 12
TEXT = HASHED + _STATS
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~=_{}[]\\+")] = True


def text_features(text: str | None, words: WordHashes) -> np.ndarray:
    data = (text or "").encode()
    x = np.zeros(TEXT, np.float32)
    x[-1] = 1
    parts = data.lower().split()
    n = len(parts)
    if not n:
        x[HASHED] = 1
        return x
    h = words.of(parts)
    cells = (h & np.uint64(HASHED - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(8)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(cells, weights=sign, minlength=HASHED)
    x[:HASHED] = v / (np.sqrt((v * v).sum()) + 1e-9)
    raw = np.frombuffer(data, np.uint8)
    size = len(raw)
    letters = (((raw | 32) >= 97) & ((raw | 32) <= 122)).sum() + 1
    kinds = len(np.unique(h))
    stats = (
        0.0,
        min(1.0, 20 * _SYMBOL[raw].sum() / size),
        min(1.0, 2 * ((raw >= 65) & (raw <= 90)).sum() / letters),
        min(1.0, 5 * ((raw >= 48) & (raw <= 57)).sum() / size),
        kinds / n,
        min(1.0, 4.0 * (h[1:] == h[:-1]).sum() / n),
        np.log1p(n) / 10,
        min(1.0, 10 * (raw == 33).sum() / n),
        min(1.0, 2 * (raw == 124).sum() / n),
        min(1.0, 5 * ((raw == 46).sum() + (raw == 44).sum()) / n),
        min(2.0, size / n / 10),
    )
    x[HASHED : HASHED + len(stats)] = stats
    return x


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    import xxhash

    x = np.zeros(META, np.float32)
    x[xxhash.xxh3_64_intdigest(lang or "\0") % 8] = 1
    x[8 + xxhash.xxh3_64_intdigest(source or "\0") % 32] = 1
    x[40 + min(7, int(np.log10(max(1, n_chars or 1)) * 1.6))] = 1
    x[48] = np.log1p(max(0, n_chars or 0)) / 10
    x[49] = 1
    return x


@dataclass
class View:
    """A linear score and the Platt line that makes it log-odds."""

    weights: np.ndarray
    slope: float = 0.0
    shift: float = 0.0
    low: float = -np.inf
    high: float = np.inf

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights) + self.shift


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float = 0.0
    pseudo: list[tuple[int, int]] = field(default_factory=list)

    def combined(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text_x), self.meta.logit(meta_x)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, a + b - self.prior))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, tx, mx."""
    have = set(docs.columns)
    cols = [F.col(c) if c in have else F.lit(None).alias(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = resident("words", WordHashes)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                tx = [text_features(t.as_py(), words) for t in part.column(1)]
                mx = [meta_features(*m) for m in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * w), pa.array(np.concatenate(v) if v else np.zeros(0, np.float32))) for v, w in ((tx, TEXT), (mx, META))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["doc_id", "tx", "mx"])

    typed = docs.select(*cols).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return typed.mapInArrow(run, "doc_id long, tx array<float>, mx array<float>")


def _in_calibration(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.view(np.uint64) + np.uint64(17)) % np.uint64(100) < CALIBRATION


def _sums(rows: DataFrame, model: CoTrained | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """X'X and X'y of both views over labelled training rows, and pseudo-labelled ones if there is a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [(np.zeros((w, w)), np.zeros(w)) for w in (TEXT, META)]
        pseudo = [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            xs = (_matrix(b.column("tx"), TEXT), _matrix(b.column("mx"), META))
            y = b.column("quality").to_numpy(zero_copy_only=False).astype(np.float64)
            ids = b.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            known = ~np.isnan(y)
            train = known & ~_in_calibration(ids)
            views = (model.text, model.meta) if model else None
            for v in (0, 1):
                target, weight = np.where(train, 2 * np.nan_to_num(y) - 1, 0.0), train.astype(np.float64)
                if views is not None:
                    other = xs[1 - v] @ views[1 - v].weights
                    sure = ~known & ((other <= views[1 - v].low) | (other >= views[1 - v].high))
                    target[sure], weight[sure] = np.tanh(views[1 - v].logit(xs[1 - v][sure]) / 2), PSEUDO_WEIGHT
                    pseudo[v] += int(sure.sum())
                xw = xs[v] * weight[:, None]
                acc[v][0][:] += xs[v].T @ xw
                acc[v][1][:] += xw.T @ target
        view, i, j, val = [], [], [], []
        for v, (a, c) in enumerate(acc):
            w = len(c)
            view += [v] * (w * w + w + 1)
            i += np.repeat(np.arange(w), w).tolist() + list(range(w)) + [-1]
            j += np.tile(np.arange(w), w).tolist() + [-1] * w + [-1]
            val += a.ravel().tolist() + c.tolist() + [float(pseudo[v])]
        yield pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(val, pa.float64())], ["view", "i", "j", "val"])

    got = rows.mapInArrow(run, "view int, i int, j int, val double").groupBy("view", "i", "j").agg(F.sum("val").alias("val")).collect()
    out, pseudo = [(np.zeros((w, w)), np.zeros(w)) for w in (TEXT, META)], [0, 0]
    for r in got:
        if r.i < 0:
            pseudo[r.view] = int(r.val)
        elif r.j < 0:
            out[r.view][1][r.i] = r.val
        else:
            out[r.view][0][r.i, r.j] = r.val
    return out, pseudo


def _platt(scores: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on binned scores, with smoothed targets."""
    np_, nn = positive.sum(), negative.sum()
    if not np_ or not nn:
        return 0.0, float(np.log((np_ + 1) / (nn + 1)))
    hi, lo = (np_ + 1) / (np_ + 2), 1 / (nn + 2)
    n, t = positive + negative, positive * hi + negative * lo
    a, b = 1.0, float(np.log(np_ / nn))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        g = np.array([((t - n * p) * scores).sum() - 1e-3 * a, (t - n * p).sum()])
        w = n * p * (1 - p)
        hess = np.array([[(w * scores * scores).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _ends(hist: np.ndarray) -> tuple[float, float]:
    """Scores up to which, and from which, unlabelled rows (the last histogram) are confident: SHARE of them, in proportion to the labelled classes; all of a cell or none."""
    bad, good, free = hist[0].sum(), hist[1].sum(), hist[2]
    if not bad or not good or not free.sum():
        return -np.inf, np.inf
    up, down = np.cumsum(free), np.cumsum(free[::-1])
    want = SHARE * free.sum() / (bad + good)
    a = int(np.searchsorted(up, want * bad))
    z = BINS - 1 - int(np.searchsorted(down, want * good))
    if a >= z:
        return -np.inf, np.inf
    edge = lambda k: k / BINS * 4 - 2
    return (edge(a + 1) if a < BINS - 1 else np.inf) - 1e-12, edge(z) if z else -np.inf


def _calibrate(rows: DataFrame, views: list[View]) -> None:
    """Fit each view's Platt line on the calibration rows, through histograms of BINS cells over [-2, 2]; and set the scores beyond which unlabelled rows are confident."""
    weights = [v.weights for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 3, BINS), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            y = np.nan_to_num(b.column("quality").to_numpy(zero_copy_only=False).astype(np.float64), nan=2.0)
            keep = _in_calibration(b.column("doc_id").fill_null(0).to_numpy().astype(np.int64)) | (y == 2)
            for v, (name, width) in enumerate((("tx", TEXT), ("mx", META))):
                s = _matrix(b.column(name), width) @ weights[v]
                cell = np.clip(((s + 2) / 4 * BINS).astype(np.int64), 0, BINS - 1)
                for c in (0, 1, 2):
                    acc[v, c] += np.bincount(cell[keep & (y == c)], minlength=BINS)
        at = np.argwhere(acc)
        yield pa.RecordBatch.from_arrays([*(pa.array(at[:, k], pa.int32()) for k in range(3)), pa.array(acc[tuple(at.T)], pa.int64())], ["view", "cls", "cell", "n"])

    hist = np.zeros((2, 3, BINS))
    for r in rows.mapInArrow(run, "view int, cls int, cell int, n long").groupBy("view", "cls", "cell").agg(F.sum("n").alias("n")).collect():
        hist[r.view, r.cls, r.cell] = r.n
    centres = (np.arange(BINS) + 0.5) / BINS * 4 - 2
    for v, view in enumerate(views):
        view.slope, view.shift = _platt(centres, hist[v, 1], hist[v, 0])
        view.low, view.high = _ends(hist[v])
        if view.slope <= 0:
            view.low, view.high = -np.inf, np.inf


def fit(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """features: doc_id, tx, mx (stored). labels: doc_id, quality."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    rows = store(features.join(known, "doc_id", "left"), "cotraining-rows")
    share = known.agg(F.sum("quality").alias("p"), F.count(F.lit(1)).alias("n")).first()
    prior = float(np.log(((share.p or 0) + 1) / (share.n - (share.p or 0) + 1)))
    model = CoTrained(View(np.zeros(TEXT), 0.0, prior), View(np.zeros(META), 0.0, prior), prior)
    if not share.n or share.p in (0, share.n):
        return model
    for r in range(rounds + 1):
        sums, pseudo = _sums(rows, model if r else None)
        views = [View(np.linalg.solve(a + RIDGE * np.eye(len(c)), c)) for a, c in sums]
        _calibrate(rows, views)
        model = CoTrained(views[0], views[1], prior, [*model.pseudo, tuple(pseudo)])
    return model


def score(features: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_text, p_meta, p_quality, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.combined(_matrix(b.column("tx"), TEXT), _matrix(b.column("mx"), META))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v) for v in p), pa.array(p[2] >= threshold)], ["doc_id", "p_text", "p_meta", "p_quality", "kept"])

    return features.mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    prepare(docs.sparkSession)
    features = store(featured(docs), "cotraining-features")
    return score(features, fit(features, labels, rounds))
