"""Quality classification: naive Bayes features under a linear hinge-loss model (NB-SVM)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, held_out, lean, small_batches
from quillon.llm.grams import Grams, fitted, labelled_sample

SAMPLE_ROWS = 6000  # the bound of the labelled sample


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of (share of the indicator in class 1 / share in class 0); 0 where the sample never has it."""
    counts = [np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(r for r, c in zip(rows, y, strict=True) if c == k)]), minlength=size) for k in (0, 1)]
    zero, one = ((c + smooth) / (c.sum() + smooth * size) for c in counts)
    return np.where(counts[0] + counts[1] > 0, np.log(one / zero), 0.0)


def hinge_fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM on indicators scaled by ``scale``, by dual coordinate descent.

    Each step solves one dual variable between 0 and its class's cost; costs are balanced between classes.
    Rows have length one after scaling, so that long texts don't weigh more.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = {s: len(y) / (2 * max(1, (sign == s).sum())) for s in (1.0, -1.0)}
    values = [scale[r] / max(1e-9, float(np.sqrt((scale[r] ** 2).sum()))) for r in rows]
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, v, s = rows[i], values[i], sign[i]
            gradient = s * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost * share[s])  # a row's length is 1, and 1 for the bias
            if (step := (new - alpha[i]) * s) != 0:
                alpha[i] = new
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps with smoothed targets."""
    n1 = float(y.sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        k = p * (1 - p) + 1e-9
        h = np.array([[(k * margins**2).sum() + 1e-3, (k * margins).sum()], [(k * margins).sum(), k.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(a), float(b)


@dataclass
class QualityModel:
    """Weights by indicator (already times the ratios), squared ratios, and the curve that makes a margin a probability.

    ``prior`` is the only score of a sample without both classes.
    """

    grams: Grams
    weights: np.ndarray
    lengths: np.ndarray
    bias: float
    curve: tuple[float, float]
    prior: float | None

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / max(1e-9, float(np.sqrt(self.lengths[found].sum()))) + self.bias

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(self.grams.of(text)) + b, -30, 30))))

    def plain(self) -> dict:
        """Numbers and arrays alone, without the zeros: it can travel where this class isn't."""
        at = np.flatnonzero(self.lengths).astype(np.int32)
        return {"grams": (self.grams.bits, self.grams.order, self.grams.shapes), "at": at, "weights": self.weights[at], "lengths": self.lengths[at], "bias": self.bias, "curve": self.curve, "prior": self.prior}

    @classmethod
    def of_plain(cls, plain: dict) -> QualityModel:
        grams = Grams(*plain["grams"])
        weights, lengths = (np.zeros(1 << grams.bits, dtype=np.float32) for _ in range(2))
        weights[plain["at"]], lengths[plain["at"]] = plain["weights"], plain["lengths"]
        return cls(grams, weights, lengths, plain["bias"], plain["curve"], plain["prior"])


def fit(rows: list[np.ndarray], y: np.ndarray, grams: Grams, folds: int = 3) -> QualityModel:
    """NB-SVM with its curve fitted on out-of-fold margins.

    Without ``folds`` rows of both classes every score is the smoothed share of class 1 (0.5 without any rows).
    """
    size = 1 << grams.bits
    if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < folds:
        return QualityModel(grams, np.zeros(1, dtype=np.float32), np.zeros(1, dtype=np.float32), 0.0, (1.0, 0.0), float((y.sum() + 1) / (len(y) + 2)))

    def train(chosen: np.ndarray) -> QualityModel:
        own = [rows[i] for i in chosen]
        ratio = log_count_ratios(own, y[chosen], size)
        w, bias = hinge_fit(own, y[chosen], ratio)
        return QualityModel(grams, (w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, (1.0, 0.0), None)

    margins, part = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        model = train(np.flatnonzero(part != k))
        for i in np.flatnonzero(part == k):
            margins[i] = model.margin(rows[i])
    model = train(np.arange(len(y)))
    model.curve = platt(margins, y)
    return model


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """The plain model of ``labels.quality`` on at most ``rows`` labelled documents outside the held-out fold."""
    grams = Grams(bits=20, order=2, shapes=True)
    return fitted(labelled_sample(docs, labels, ["quality"], rows), grams, ["quality"], lambda found, y: fit(found, (y[:, 0] > 0).astype(int), grams).plain())


def scored(docs: DataFrame, model: dict, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of its whole text, null and empty texts too. Rows are never joined or shuffled.

    A column that is called like the score already stays as it is; the new one gets underscores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each indicator of the sample, 2 ** bits at most

    @F.pandas_udf("double")
    @lean
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = QualityModel.of_plain(shared.value)
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return small_batches(docs).withColumn(fresh(docs, score), of(F.col(text)))


def report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    A null or empty text has the score of a text without indicators. A null id is in no fold and no sample.
    Repeated rows stay rows; an empty table gives no rows; empty or one-sided labels give every row the same
    score. Other columns are ignored, whatever their names. Texts of any length are read whole.
    """
    own = docs.select("doc_id", "text")
    return scored(own, trained(docs, labels, rows)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
