"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.training_rows import held_out, known_labels
from folio.plans.lineage import store
from folio.plans.prefix import running_total
from folio.plans.sizes import small

#: Class of each ASCII character: 0 blank, 1 newline, 2 lower, 3 upper, 4 digit, 5 sentence mark, 6 other mark; 7 beyond ASCII.
KIND = np.full(129, 6, dtype=np.int64)
KIND[[9, 11, 12, 13, 32]] = 0
KIND[10] = 1
KIND[97:123] = 2
KIND[65:91] = 3
KIND[48:58] = 4
KIND[[33, 34, 39, 44, 46, 58, 59, 63]] = 5
KIND[128] = 7


def features(text: str | None) -> list[float]:
    """Shape of one whole text: sizes, character classes and repetition; null is the empty text.

    Cost is linear in the text; repetition is taken from its words, word pairs and lines.
    """
    text = text or ""
    words = text.split()
    n, n_words = max(len(text), 1), max(len(words), 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(KIND[np.minimum(codes, 128)], minlength=8) / n
    lines = [x for x in text.split("\n") if x]
    counted, n_lines = Counter(lines), max(len(lines), 1)
    repeated = sum(len(k) * (c - 1) for k, c in counted.items())
    alone = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-2:-1] and not w[-2].isalnum())
    bare = sum(1 for w in words if not any(map(str.isalnum, w[:3])))
    return [
        np.log1p(len(words)), len(text) / n_words / 10, len(alone) / n_words, pairs / max(n_words - 1, 1),
        max(alone.values(), default=0) / n_words, *kinds, repeated / n, len(counted) / n_lines,
        np.log1p(n / n_lines), marked / n_words, bare / n_words,
        min(1.0, text.count("http") * 20 / n), float(not words),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Weights over standardised features and their squares, and the map from ranks to scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at_cut: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Bradley-Terry strengths: a beats b with probability sigmoid(raw(a) - raw(b))."""
        return expand(rows, self.mean, self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Strengths mapped into (0, 1), with the quantile cut at ``at_cut``."""
        z = self.slope * (self.raw(rows) - self.cut) + np.log(self.at_cut / (1 - self.at_cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((rows - mean) / scale, -6, 6)
    return np.hstack([z, z * z - 1])


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float, steps: int = 40) -> np.ndarray:
    """Damped Newton steps to the least loss, of which ``sums`` gives the gradient and the curvature at some weights."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curve = sums(w)
        step = np.linalg.solve(curve + ridge * np.eye(width), gradient + ridge * w)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted logistic loss without intercept."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - y)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


def descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    """Weighted logistic regression without intercept by damped Newton steps."""
    return newton(lambda w: logistic(x, y, weight, w), x.shape[1], ridge, steps)


def fit(
    rows: np.ndarray, labels: np.ndarray, counts: dict[int, int], at_cut: float = 0.3, pairs: int = 40_000, ridge: float = 1.0, seed: int = 7
) -> QualityModel:
    """Learn from pairs (good, bad) drawn from the sample; without both classes every score is the same.

    The cut is the strength below which lies the share of bad documents among all labelled ones,
    each sampled row weighing as many as its class has rows for it. The slope is fitted by logistic loss
    on the same rows.
    """
    d = 2 * rows.shape[1] if rows.size else 2 * len(features(""))
    good, bad = (np.flatnonzero(labels == k) for k in (1, 0))
    if not len(good) or not len(bad):
        zero = np.zeros(d // 2)
        share = 1 - 1e-3 if not len(bad) else 1e-3
        return QualityModel(zero, zero + 1, np.zeros(d), 0.0, 0.0, share)
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    x = expand(rows, mean, scale)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    sign = np.where(rng.random(pairs) < 0.5, 1.0, -1.0)
    difference = (x[better] - x[worse]) * sign[:, None]
    weights = descend(difference, (sign > 0).astype(float), np.ones(pairs), ridge)
    strength = x @ weights
    weigh = np.where(labels == 1, counts[1] / len(good), counts[0] / len(bad))
    order = np.argsort(strength, kind="stable")
    below = np.cumsum(weigh[order]) / weigh.sum()
    share = weigh[labels == 0].sum() / weigh.sum()
    cut = float(strength[order][min(np.searchsorted(below, share), len(order) - 1)])
    slope = float(max(0.05, descend((strength - cut)[:, None], (labels == 1).astype(float), weigh, 1e-3)[0]))
    return QualityModel(mean, scale, weights, cut, slope, at_cut)


def _summed(rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over all batches, each task's added up where its rows lie."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                own = part(frame)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "s": [total.tolist()]})

    got = rows.mapInPandas(run, "at int, s array<double>").toPandas().sort_values("at")
    return np.array(got["s"].tolist()).sum(axis=0)


def _stacked(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy())


def _descend_rows(rows: DataFrame, xy: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], width: int, ridge: float) -> np.ndarray:
    """``descend`` over rows that stay on the executors; the driver sees a gradient and a curvature of each task a step."""

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(frame: pd.DataFrame) -> np.ndarray:
            x, y = xy(frame)
            gradient, curve = logistic(x, y, np.ones(len(y)), w)
            return np.concatenate([gradient, curve.ravel()])

        got = _summed(rows, part)
        return got[:width], got[width:].reshape(width, width)

    return newton(sums, width, ridge)


def _nth(rows: DataFrame, n: int) -> float:
    """The ``n``-th smallest value of column ``s``, by histograms of ever narrower ranges."""
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    for _ in range(5):
        edges = np.linspace(low, high, 1025)
        below = np.cumsum(_summed(rows, lambda frame: np.bincount(np.searchsorted(edges, frame["s"]), minlength=1026)))  # noqa: B023
        k = int(np.searchsorted(below, n))
        low, high = float(edges[max(k - 1, 0)]), float(edges[min(k, 1024)])
        if high <= low:
            break
    return high


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", at_cut: float = 0.3, pairs: int = 40_000, ridge: float = 1.0) -> QualityModel:
    """Fit on all labelled rows that may be learned from; features, pairs and sums stay on the executors.

    Rows of each class are numbered by a hash of their id; each row of the larger class meets one of the smaller, going round, or as many more as
    make ``pairs`` pairs, so every row is in some pair. The cut is the strength below which as many rows lie as are bad, and the slope is
    fitted by logistic loss on all rows. Without both classes every score is the same.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in features(t)] for t in texts])

    known = known_labels(labels, label_col, id_col).where("_label in (0, 1)")
    measured = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), measure(F.col(text_col)).alias("x"))
    rows = store(measured.join(small(known), "_id"), "measured-labels")
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    width = len(features(""))
    if len(counts) < 2:
        zero = np.zeros(width)
        return QualityModel(zero, zero + 1, np.zeros(2 * width), 0.0, 0.0, 1e-3 if 0 in counts else 1 - 1e-3)
    n = counts[0] + counts[1]
    mean = _summed(rows, lambda frame: _stacked(frame["x"]).sum(axis=0)) / n
    scale = np.sqrt(_summed(rows, lambda frame: ((_stacked(frame["x"]) - mean) ** 2).sum(axis=0)) / n) + 1e-6

    hashed = rows.withColumn("_h", F.xxhash64("_id"))
    numbered = store(running_total(hashed, ["_label"], F.shiftright("_h", 54), ["_h", "_id", "x"], F.lit(1), "_i").select("_label", "_i", "x"), "numbered-labels")
    many, few = (1, 0) if counts[1] >= counts[0] else (0, 1)
    rounds = min(max(1, -(-pairs // counts[many])), counts[few])
    asks = numbered.where(F.col("_label") == many).select(F.col("x").alias("u"), F.explode(F.sequence(F.col("_i"), F.col("_i") + rounds - 1)).alias("_k"))
    other = numbered.where(F.col("_label") == few).select(F.col("_i").alias("_k"), F.col("x").alias("v"))
    met = store(asks.withColumn("_k", F.col("_k") % counts[few]).join(small(other), "_k").select("u", "v"), "quality-pairs")
    side = 1.0 if many == 1 else -1.0

    def difference(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        u, v = (expand(_stacked(frame[c]), mean, scale) for c in "uv")
        return side * (u - v), np.ones(len(frame))

    weights = np.round(_descend_rows(met, difference, 2 * width, ridge), 9)

    def strong(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"s": expand(_stacked(frame["x"]), mean, scale) @ weights if len(frame) else [], "y": frame["_label"]})

    strength = store(rows.mapInPandas(strong, "s double, y int"), "strengths")
    cut = _nth(strength, counts[0])
    slope = _descend_rows(strength, lambda frame: (frame[["s"]].to_numpy() - cut, frame["y"].to_numpy(dtype=float)), 1, 1e-3)[0]
    return QualityModel(mean, scale, weights, cut, float(max(0.05, round(slope, 9))), at_cut)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with column ``name``, 0 to 1, of every whole text; nulls score as the empty text, rows stay as they are."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(features("")))
            yield pd.Series(model.score(x) if len(x) else [], dtype=float)

    return docs.withColumn(name, scored(F.col(text_col)))


def quality(docs: DataFrame, labels: DataFrame, at_cut: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    slim = docs.select("doc_id", "text")
    scored = score(slim, learn(slim, labels, at_cut=at_cut))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at_cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, at_cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``at_cut`` or more, columns unchanged."""
    scored = score(docs, learn(docs, labels, at_cut=at_cut), name="_quality_score")
    return scored.where(F.col("_quality_score") >= at_cut).select(*docs.columns)
