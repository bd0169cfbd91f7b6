"""Quality classifier: Bradley-Terry pairwise ranking.

Documents are described by byte and word statistics of their whole text.  A linear score is learned
from preference pairs (a document labelled 1 beats one labelled 0) by logistic loss on the
difference of their features.  The score is cut at the quantile of the labelled scores that separates the labels
best; a logistic curve through the cut turns it into a value from 0 to 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many labelled rows (those with the least id hash) are used for fitting.
MAX_LABELLED = 20_000
MAX_PAIRS = 30_000
#: Where the cut lies on the scale from 0 to 1.
CUT = 0.3
N_FEATURES = 128 + 7


def text_features(data: bytes | None) -> np.ndarray:
    """Square roots of byte shares (ASCII; all others together) and ratios over words and lines; zeros for no text."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    out[:128] = np.sqrt(counts[:128] / len(data))
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    if n:
        out[128] = np.sqrt(counts[128:].sum() / len(data))
        out[129] = len(set(words)) / n
        out[130] = len(set(zip(words, words[1:]))) / max(1, n - 1)
        out[131] = min(1.0, (len(data) - counts[32]) / n / 20)
        out[132] = len(set(lines)) / len(lines)
        out[133] = np.sqrt(counts[65:91].sum() / max(1, counts[65:91].sum() + counts[97:123].sum()))
        out[134] = min(1.0, np.log1p(n) / 10)
    return out


@dataclass
class RankModel:
    """A fitted score: centre and scale of the features, weights, cut and slope."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(features) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(features: np.ndarray, labels: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1.0) -> RankModel:
    """Fit by Newton steps on the logistic loss of pair differences.

    Every document of the rarer label meets several of the other one, drawn with a fixed seed.  Without both labels
    the score is constant and passes everything.
    """
    mean, scale = features.mean(axis=0) if len(features) else np.zeros(N_FEATURES), np.ones(N_FEATURES)
    if len(features):
        scale = features.std(axis=0) + 0.01
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    weights = np.zeros(features.shape[1] if features.ndim == 2 else N_FEATURES)
    if not len(good) or not len(bad):
        return RankModel(mean, scale, weights, -1.0, 1.0)
    x = ((features - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(7)
    rounds = max(1, min(max_pairs // max(len(good), len(bad)), 8))
    many = max(len(good), len(bad))
    left = np.concatenate([np.resize(rng.permutation(good), many) for _ in range(rounds)])[:max_pairs]
    right = np.concatenate([np.resize(rng.permutation(bad), many) for _ in range(rounds)])[:max_pairs]
    diff = x[left] - x[right]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(diff @ weights, -30, 30)))
        gradient = diff.T @ (p - 1) + ridge * weights
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break
    return RankModel(mean, scale, weights, *quantile_cut(x @ weights, labels))


def quantile_cut(strength: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The cut between two neighbouring scores, at the quantile with the best balanced accuracy, and a slope."""
    order = np.argsort(strength, kind="stable")
    s, y = strength[order], labels[order]
    bad_below = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    good_above = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    value = bad_below + good_above
    best = np.flatnonzero(value >= value.max() - 1e-12)
    # Of equally good quantiles, the widest gap between neighbours.
    gaps = np.concatenate([[0], s[1:] - s[:-1], [0]])
    at = best[np.argmax(gaps[best])]
    return float(edges[at]), 4 / max(1e-6, float(s.std()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED) -> RankModel:
    """Learn from the labelled rows of *labels* that occur in *docs*.

    At most *max_labelled* rows with the least id hash are used (a bound of the fit, not of what is scored).  Several
    labels of one id count as their least; null ids and labels are ignored, repeated documents are used as they are.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(
        F.broadcast(chosen), "_id").select("_label", "_text")

    def features(batches):
        for batch in batches:
            found = [text_features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in found], pa.binary())], ["label", "features"])

    got = rows.mapInArrow(features, "label int, features binary").limit(4 * max_labelled).collect()
    x = np.stack([np.frombuffer(r.features, dtype=np.float32) for r in got]) if got else np.zeros((0, N_FEATURES), np.float32)
    return fit_pairs(x, np.array([r.label for r in got], dtype=np.int64))


def score_documents(docs: DataFrame, model: RankModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add *out* (double) to every row: the score of its whole text; null texts count as empty."""
    carried = [c for c in docs.columns if c != out]
    frame = docs.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text_bytes"))
    schema = docs.select(*[F.col(f"`{c}`") for c in carried]).schema.add(out, "double")

    def score(batches):
        for batch in batches:
            text = batch.column(len(carried))
            found = np.stack([text_features(x.as_py()) for x in text]) if len(text) else np.zeros((0, N_FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carried)], pa.array(model.score(found), pa.float64())],
                                             names=[*batch.schema.names[:len(carried)], out])

    return frame.mapInArrow(score, schema)


def drop_rejected(docs: DataFrame, model: RankModel, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the cut, with the columns of *docs*."""
    scored = score_documents(docs, model, text_col, "_score_of_text")
    return scored.filter(F.col("_score_of_text") >= CUT).drop("_score_of_text")
