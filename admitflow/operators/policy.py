"""Linear softmax-head policies: masks, sampling, supervised and group-relative training, scoring.

A training step is one pass over all rows: each task adds up the gradient of its rows in a few arrays of the size of
the weights, Spark adds those, and the driver, which holds the weights alone, takes the step. Scoring is a narrow Arrow
pass with the weights in the closure. ``train_supervised`` is the row-after-row form for a bounded list on the driver.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions.python_udfs import hashed_features
from admitflow.operators.metrics import group_advantages
from admitflow.session import discard, ship, store

DECISIONS = ("UPDATE", "HOLD", "IGNORE")
MASKED = -1e9


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class Heads:
    """Weights of the decision, field (max_slots existing ones and a new one) and verification heads."""

    dims: int = 128
    max_slots: int = 8
    decision: np.ndarray = field(default=None)
    slot: np.ndarray = field(default=None)
    verify: np.ndarray = field(default=None)

    def __post_init__(self):
        for name, rows in (("decision", 3), ("slot", self.max_slots + 1), ("verify", 2)):
            if getattr(self, name) is None:
                setattr(self, name, np.zeros((rows, self.dims)))

    def clone(self) -> Heads:
        return Heads(self.dims, self.max_slots, self.decision.copy(), self.slot.copy(), self.verify.copy())

    def probabilities(self, x: np.ndarray, n_slots: int, can_verify: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, v = self.slot @ x, self.verify @ x
        f[n_slots : self.max_slots] = MASKED
        if n_slots >= self.max_slots:
            f[self.max_slots] = MASKED
        if not can_verify:
            v[1] = MASKED
        return softmax(self.decision @ x), softmax(f), softmax(v)

    def choose(self, x: np.ndarray, n_slots: int, can_verify: bool, rng: np.random.Generator | None = None) -> tuple[tuple[int, int, int], float]:
        """Indexes of the heads (greedy: the first largest; else drawn) and the log-probability of those that count."""
        ps = self.probabilities(x, n_slots, can_verify)
        pick = tuple(int(np.argmax(p)) if rng is None else int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, len(p) - 1)) for p in ps)
        return pick, self.log_probability(ps, pick)

    @staticmethod
    def log_probability(ps, pick: tuple[int, int, int]) -> float:
        """Fields count unless the decision is IGNORE, verification only for HOLD."""
        d, f, v = pick
        out = math.log(ps[0][d] + 1e-12)
        if DECISIONS[d] != "IGNORE":
            out += math.log(ps[1][f] + 1e-12)
        if DECISIONS[d] == "HOLD":
            out += math.log(ps[2][v] + 1e-12)
        return out

    def save(self) -> bytes:
        b = io.BytesIO()
        np.savez(b, dims=self.dims, max_slots=self.max_slots, decision=self.decision, slot=self.slot, verify=self.verify)
        return b.getvalue()

    @staticmethod
    def load(data: bytes) -> Heads:
        z = np.load(io.BytesIO(data))
        return Heads(int(z["dims"]), int(z["max_slots"]), z["decision"], z["slot"], z["verify"])


def _push(w: np.ndarray, x: np.ndarray, p: np.ndarray, k: int, rate: float, weight: float, decay: float, limit: float) -> float:
    """One ascent step on log p[k]; the gradient's norm is bounded by limit. Returns the loss."""
    g = -p[:, None] * x
    g[k] += x
    g = weight * g - decay * w
    n = np.sqrt((g * g).sum())
    w += rate * (g if n <= limit else g * (limit / n))
    return -weight * math.log(p[k] + 1e-12)


def train_supervised(heads: Heads, rows: list[tuple[np.ndarray, int, int, int, int]], epochs: int = 20, rate: float = 0.5, decay: float = 1e-4, limit: float = 1.0, class_weights=(1.0, 1.0, 1.0), seed: int = 42) -> list[float]:
    """rows: x, decision, slot (-1: none), verify (-1: none), number of slots. Returns the mean loss of each epoch."""
    rng, losses = np.random.default_rng(seed), []
    for _ in range(epochs):
        total = 0.0
        for i in rng.permutation(len(rows)):
            x, d, f, v, n = rows[i]
            ps, w = heads.probabilities(x, n, True), class_weights[d]
            total += _push(heads.decision, x, ps[0], d, rate, w, decay, limit)
            if f >= 0:
                total += _push(heads.slot, x, ps[1], f, rate, w, decay, limit)
            if v >= 0:
                total += _push(heads.verify, x, ps[2], v, rate, w, decay, limit)
        losses.append(total / max(1, len(rows)))
    return losses


def evaluate_supervised(heads: Heads, rows) -> dict[str, float]:
    """Mean negative log-likelihood over the heads that count, and decision accuracy."""
    nll, heads_n, right = 0.0, 0, 0
    for x, d, f, v, n in rows:
        ps = heads.probabilities(x, n, True)
        right += int(np.argmax(ps[0])) == d
        for p, k in zip(ps, (d, f, v), strict=True):
            if k >= 0:
                nll -= math.log(p[k] + 1e-12)
                heads_n += 1
    return {"nll": nll / max(1, heads_n), "accuracy": right / max(1, len(rows))}


#: Rows of training: x (features), n_slots, can_verify, decision, slot and verify (indexes of what was done; -1: the head doesn't count), weight; old (log-probability when it was done) and advantage for group-relative steps.
TRAINING = "x array<double>, n_slots int, can_verify boolean, decision int, slot int, verify int, weight double"


def _masked(heads: Heads, x: np.ndarray, n_slots: np.ndarray, can_verify: np.ndarray) -> list[np.ndarray]:
    """Probabilities of the three heads for a block of rows."""
    slots, verify = x @ heads.slot.T, x @ heads.verify.T
    place = np.arange(heads.max_slots + 1)
    slots[(place >= n_slots[:, None]) & (place < heads.max_slots)] = MASKED
    slots[n_slots >= heads.max_slots, heads.max_slots] = MASKED
    verify[~can_verify, 1] = MASKED
    out = []
    for z in (x @ heads.decision.T, slots, verify):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        out.append(e / e.sum(axis=1, keepdims=True))
    return out


def _gradients(data: bytes, clip: float | None):
    """Batches of training rows -> one row of a task: n, loss, grad (the three heads one after another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = Heads.load(data)
        parts = [np.zeros_like(w) for w in (heads.decision, heads.slot, heads.verify)]
        n, loss = 0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "x"}
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            ps = _masked(heads, x, col["n_slots"], col["can_verify"].astype(bool))
            picks = [col["decision"], col["slot"], col["verify"]]
            row = np.arange(b.num_rows)
            logs = [np.where(k >= 0, np.log(p[row, np.maximum(k, 0)] + 1e-12), 0.0) for p, k in zip(ps, picks, strict=True)]
            weight = col["weight"].astype(float)
            if clip is not None:
                ratio = np.exp(np.clip(sum(logs) - col["old"], -20, 20))
                gain = col["advantage"]
                held = ((gain >= 0) & (ratio > 1 + clip)) | ((gain < 0) & (ratio < 1 - clip))
                loss -= float(np.minimum(ratio * gain, np.clip(ratio, 1 - clip, 1 + clip) * gain).sum())
                weight = weight * np.where(held, 0.0, gain * ratio)
            else:
                loss -= float((weight * sum(logs)).sum())
            for g, p, k in zip(parts, ps, picks, strict=True):
                step = -p * (weight * (k >= 0))[:, None]
                step[row, np.maximum(k, 0)] += weight * (k >= 0)
                g += step.T @ x
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "loss": pa.array([loss]), "grad": pa.array([np.concatenate([g.ravel() for g in parts])], pa.list_(pa.float64()))})

    return run


def gradient(rows: DataFrame, heads: Heads, clip: float | None = None) -> tuple[int, float, list[np.ndarray]]:
    """Rows, summed loss and summed ascent direction of each head, from one pass; with clip the clipped group-relative objective, else weighted log-likelihood."""
    ship(rows.sparkSession)
    names = [c.split()[0] for c in TRAINING.split(", ")] + (["old", "advantage"] if clip is not None else [])
    sums = rows.select(*names).mapInArrow(_gradients(heads.save(), clip), "n long, loss double, grad array<double>")
    cells = sums.select("n", "loss", F.posexplode("grad").alias("at", "g")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("g").alias("g")).orderBy("at").collect()
    shapes = [w.shape for w in (heads.decision, heads.slot, heads.verify)]
    if not cells:
        return 0, 0.0, [np.zeros(s) for s in shapes]
    flat, out, at = np.array([c.g for c in cells]), [], 0
    for s in shapes:
        out.append(flat[at : at + s[0] * s[1]].reshape(s))
        at += s[0] * s[1]
    return cells[0].n, cells[0].loss, out


def _ascend(heads: Heads, n: int, grads: list[np.ndarray], rate: float, decay: float, limit: float) -> None:
    """A step along the mean gradient, whose norm is bounded by limit for each head."""
    for w, g in zip((heads.decision, heads.slot, heads.verify), grads, strict=True):
        g = g / max(n, 1) - decay * w
        size = np.sqrt((g * g).sum())
        w += rate * (g if size <= limit else g * (limit / size))


def fit_supervised(rows: DataFrame, heads: Heads, epochs: int = 20, rate: float = 4.0, decay: float = 1e-4, limit: float = 1.0) -> list[float]:
    """Full-batch training of heads (in place) on rows (``TRAINING``). Returns the mean loss before each step."""
    stored, losses = store(rows, "policy-rows"), []
    for _ in range(epochs):
        n, loss, grads = gradient(stored, heads)
        losses.append(loss / max(n, 1))
        _ascend(heads, n, grads, rate, decay, limit)
    discard(stored)
    return losses


def fit_group_relative(rows: DataFrame, heads: Heads, group: str, score: str, passes: int = 2, rate: float = 0.3, clip: float = 0.2, limit: float = 1.0) -> list[float]:
    """Steps on recorded trajectories (rows of ``TRAINING`` with old, group and score): advantages within the groups, clipped ratios. Returns the mean loss before each step."""
    told = store(group_advantages(rows, group, score), "policy-rows")
    losses = []
    for _ in range(passes):
        n, loss, grads = gradient(told, heads, clip)
        losses.append(loss / max(n, 1))
        _ascend(heads, n, grads, rate, 0.0, limit)
    discard(told)
    return losses


def score_rows(df: DataFrame, heads: Heads, text: str, key: str) -> DataFrame:
    """key, decision, p_update, p_hold, p_ignore of the hashed text of each row."""
    data = heads.save()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Heads.load(data)
        for pdf in frames:
            x = np.array([hashed_features(t or "", own.dims) for t in pdf[text]]).reshape(-1, own.dims)
            z = x @ own.decision.T
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            yield pd.DataFrame({key: pdf[key], "decision": [DECISIONS[i] for i in p.argmax(axis=1)], "p_update": p[:, 0], "p_hold": p[:, 1], "p_ignore": p[:, 2]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, decision string, p_update double, p_hold double, p_ignore double")
