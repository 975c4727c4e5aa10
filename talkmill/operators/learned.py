"""Small networks over feature arrays: a quality scorer, a tier policy with a value, and their training. Inference runs in Arrow batches.

Training takes a bounded sample of rows on the driver (`SAMPLE`); inference takes any number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a scorer is trained on at most: those whose keys hash lowest.
SAMPLE = 100_000
TIERS = ("small", "medium", "large")


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to 2e-7 (formula 7.1.26 of Abramowitz and Stegun)."""
    a = np.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - tail * np.exp(-a * a))


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The activation and its slope."""
    below = 0.5 * (1 + erf(x / np.sqrt(2)))
    return x * below, below + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Network:
    """Dense layers with GELU between them; the last one is linear. `layers` holds (weights, bias) pairs."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def new(cls, widths: list[int], seed: int = 42) -> Network:
        r = np.random.default_rng(seed)
        if len(widths) < 2 or min(widths) <= 0:
            raise ValueError("a network needs two positive widths at least")
        spread = lambda n: 1 / np.sqrt(n)
        return cls([(r.uniform(-spread(a), spread(a), (a, b)), r.uniform(-spread(a), spread(a), b)) for a, b in zip(widths, widths[1:])])

    def copy(self) -> Network:
        return Network([(w.copy(), b.copy()) for w, b in self.layers])

    def forward(self, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Outputs and what `backward` needs."""
        trace = []
        for i, (w, b) in enumerate(self.layers):
            z = x @ w + b
            if i == len(self.layers) - 1:
                trace.append((x, None))
                return z, trace
            y, slope = gelu(z)
            if drop and rng is not None:
                keep = (rng.random(y.shape) >= drop) / (1 - drop)
                y, slope = y * keep, slope * keep
            trace.append((x, slope))
            x = y
        return x, trace

    def backward(self, trace: list, grad: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The gradient of each layer, from that of the outputs."""
        out = []
        for i in range(len(self.layers) - 1, -1, -1):
            x, _ = trace[i]
            out.append((x.T @ grad, grad.sum(0)))
            if i:
                grad = (grad @ self.layers[i][0].T) * trace[i - 1][1]
        return out[::-1]


@dataclass
class Adam:
    """Adam's steps; decay shrinks the weights apart from the gradient, and clip bounds the gradient's norm."""

    rate: float
    decay: float = 0.0
    clip: float | None = None
    n: int = 0
    moments: list = field(default_factory=list)

    def step(self, network: Network, grads: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.moments = self.moments or [[(np.zeros_like(g), np.zeros_like(g)) for g in pair] for pair in grads]
        norm = np.sqrt(sum((g * g).sum() for pair in grads for g in pair))
        shrink = min(1.0, self.clip / (norm + 1e-6)) if self.clip else 1.0
        self.n += 1
        for (w, b), pair, moments in zip(network.layers, grads, self.moments, strict=True):
            for value, g, (m, s) in zip((w, b), pair, moments, strict=True):
                g = g * shrink
                value *= 1 - self.rate * self.decay
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                value -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(s / (1 - 0.999**self.n)) + 1e-8)


@dataclass
class Fit:
    """What training kept: the network of the best epoch, its error, and every epoch's (loss, validation error)."""

    network: Network
    best_epoch: int
    error: float
    history: list[tuple[float, float]]


def fit_scorer(x: np.ndarray, y: np.ndarray, valid_x: np.ndarray, valid_y: np.ndarray, hidden: list[int], *, rate: float = 1e-3, decay: float = 1e-4, delta: float = 0.1, batch: int = 64, epochs: int = 50, patience: int = 8, drop: float = 0.1, seed: int = 42) -> Fit:
    """A scorer of values in [0, 1] under Huber's loss, stopped when the validation's mean absolute error no longer falls."""
    if min(rate, delta, batch, epochs, patience) <= 0 or decay < 0:
        raise ValueError("training parameters must be positive")
    if not len(x) or not len(valid_x) or x.shape[1] != valid_x.shape[1] or not all(np.isfinite(v).all() for v in (x, y, valid_x, valid_y)):
        raise ValueError("training needs finite rows of one width in both parts")
    if min(y.min(), valid_y.min()) < 0 or max(y.max(), valid_y.max()) > 1:
        raise ValueError("targets must lie in [0, 1]")
    r, network, adam = np.random.default_rng(seed), Network.new([x.shape[1], *hidden, 1], seed), Adam(rate, decay)
    best, history = None, []
    for epoch in range(1, epochs + 1):
        order, loss = r.permutation(len(x)), 0.0
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            z, trace = network.forward(x[rows], drop, r)
            score = sigmoid(z[:, 0])
            off = score - y[rows]
            near = np.abs(off) <= delta
            loss += np.where(near, off * off / 2, delta * (np.abs(off) - delta / 2)).sum()
            slope = np.where(near, off, delta * np.sign(off)) * score * (1 - score) / len(rows)
            adam.step(network, network.backward(trace, slope[:, None]))
        error = float(np.abs(scores(network, valid_x) - valid_y).mean())
        history.append((loss / len(x), error))
        if best is None or error < best.error - 1e-8:
            best = Fit(network.copy(), epoch, error, history)
        elif epoch - best.best_epoch >= patience:
            break
    return best


def scores(network: Network, x: np.ndarray) -> np.ndarray:
    """A scorer's values in [0, 1]."""
    return sigmoid(network.forward(x)[0][:, 0])


def fit_rows(rows: DataFrame, features: str, target: str, held_out: str, key: str, hidden: list[int], **settings) -> Fit:
    """fit_scorer on rows: features (array), target, held_out (boolean: validation). At most SAMPLE rows, by the key's hash; nulls are skipped."""
    kept = rows.where(F.col(features).isNotNull() & F.col(target).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    got = kept.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), F.col(held_out).alias("h")).toPandas()
    x, y, h = np.array(got["x"].tolist(), float).reshape(len(got), -1), got["y"].to_numpy(float), got["h"].to_numpy(bool)
    return fit_scorer(x[~h], y[~h], x[h], y[h], hidden, **settings)


def with_scores(rows: DataFrame, network: Network, features: str, name: str = "predicted_quality") -> DataFrame:
    """rows and the scorer's value of their features; null features give null. A column of that name gives way."""
    held = rows.sparkSession.sparkContext.broadcast(network.layers)

    def score(column: pd.Series) -> pd.Series:
        out, known = np.full(len(column), np.nan), column.notna().to_numpy()
        if known.any():
            out[known] = scores(Network(held.value), np.stack(column[known].to_list()).astype(float))
        return pd.Series(out)

    kept = rows.select(*[c for c in rows.columns if c != name or c == features])
    made = F.pandas_udf(score, "double")(F.col(features).cast("array<double>"))
    return kept.withColumn(name, F.when(F.col(features).isNotNull(), made))


def tier_logits(network: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each tier, value) of each row; the network has one output for each tier and one for the value."""
    z = network.forward(x)[0]
    logits = z[:, :-1]
    return logits - np.logaddexp.reduce(logits, axis=1, keepdims=True), z[:, -1]


def with_tier(rows: DataFrame, network: Network, features: str, name: str = "tier") -> DataFrame:
    """rows and the policy's likeliest tier; ties go to the cheaper one, null features give null."""
    held = rows.sparkSession.sparkContext.broadcast(network.layers)

    def choose(column: pd.Series) -> pd.Series:
        out, known = np.full(len(column), None, object), column.notna().to_numpy()
        if known.any():
            out[known] = np.array(TIERS, object)[tier_logits(Network(held.value), np.stack(column[known].to_list()).astype(float))[0].argmax(1)]
        return pd.Series(out)

    return rows.select(*[c for c in rows.columns if c != name or c == features]).withColumn(name, F.pandas_udf(choose, "string")(F.col(features).cast("array<double>")))


@dataclass
class ActorCritic:
    """A policy trained by the advantage of its drawn tiers, under a budget whose price (`multiplier`) rises while it is exceeded."""

    network: Network
    budget: float
    rate: float = 3e-4
    price_rate: float = 1e-2
    value_weight: float = 0.5
    entropy_weight: float = 0.01
    clip: float = 1.0
    seed: int = 42
    multiplier: float = 0.0

    def __post_init__(self):
        self.rng, self.adam = np.random.default_rng(self.seed), Adam(self.rate, clip=self.clip)

    def step(self, x: np.ndarray, evaluate: Callable[[list[str]], tuple[float, float]]) -> dict:
        """One episode: draws a tier for each row, has their quality and cost told by evaluate, and learns from the reward."""
        z, trace = self.network.forward(x)
        logits, value = z[:, :-1], z[:, -1]
        log_p = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
        p = np.exp(log_p)
        drawn = np.minimum((p.cumsum(1) < self.rng.random((len(x), 1))).sum(1), len(TIERS) - 1)
        tiers = [TIERS[i] for i in drawn]
        quality, cost = evaluate(tiers)
        reward = quality - self.multiplier * (cost - self.budget)
        advantage = reward - value
        grad = np.zeros_like(z)
        grad[:, :-1] = (p - np.eye(len(TIERS))[drawn]) * advantage[:, None]
        entropy = -(p * log_p).sum(1, keepdims=True)
        grad[:, :-1] += self.entropy_weight * p * (log_p + entropy)
        grad[:, -1] = -2 * self.value_weight * advantage
        self.adam.step(self.network, self.network.backward(trace, grad / len(x)))
        self.multiplier = max(0.0, self.multiplier + self.price_rate * (cost - self.budget))
        return {"quality": quality, "cost": cost, "reward": reward, "multiplier": self.multiplier, "tiers": tiers}
