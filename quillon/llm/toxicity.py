"""Toxicity by a chain of classifiers: each category's model also sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, held_out, lean, small_batches
from quillon.llm.grams import Stems, fitted, labelled_sample

SAMPLE_ROWS = 6000  # the bound of the labelled sample
THRESHOLD = 0.5
GROUPS = 2  # kinds of toxic texts that the labelled sample is divided into
CHAIN = (*(f"kind_{k + 1}" for k in range(GROUPS)), "toxic")


@dataclass
class Link:
    """One category: the indicators it looks at, their weights, the weights of earlier probabilities, and its bias."""

    columns: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, found: np.ndarray, before: list[float]) -> float:
        at = np.searchsorted(self.columns, found)
        hit = self.columns[np.minimum(at, len(self.columns) - 1)] == found if len(self.columns) else np.zeros(len(found), dtype=bool)
        z = self.weights[at[hit]].sum() + (self.earlier @ np.array(before) if before else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Chain:
    grams: Stems
    names: tuple[str, ...]
    links: list[Link]

    def probabilities(self, text: str | None) -> list[float]:
        found, out = self.grams.of(text), []
        for link in self.links:
            out.append(link.probability(found, out))
        return out

    def plain(self) -> dict:
        """Numbers and arrays alone: it can travel where these classes aren't."""
        return {"grams": (self.grams.bits, self.grams.lengths), "names": self.names, "links": [(x.columns, x.weights, x.earlier, x.bias) for x in self.links]}

    @classmethod
    def of_plain(cls, plain: dict) -> Chain:
        return cls(Stems(*plain["grams"]), plain["names"], [Link(*x) for x in plain["links"]])


def _telling(rows: list[np.ndarray], y: np.ndarray, size: int, least: float = 20.0, most: int = 300) -> np.ndarray:
    """The indicators whose presence and the class depend on each other most, by chi-square; at least ``least``."""
    ones, every = (np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *chosen]), minlength=size).astype(float) for chosen in ([r for r, c in zip(rows, y, strict=True) if c], rows))
    n, n1 = len(y), float(y.sum())
    expected = every * n1 / n
    spread = every * (n - every) * n1 * (n - n1) / n**3
    chi = np.where(spread > 0, (ones - expected) ** 2 / np.maximum(spread, 1e-9), 0.0)
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] >= least])


def _present(rows: list[np.ndarray], columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` with a 1 wherever a row has the indicator of one of the first columns. Both lists ascend."""
    for i, r in enumerate(rows if len(columns) else ()):
        at = np.searchsorted(columns, r)
        hit = columns[np.minimum(at, len(columns) - 1)] == r
        x[i, at[hit]] = 1
    return x


def kinds(rows: list[np.ndarray], toxic: np.ndarray, size: int, groups: int = GROUPS, steps: int = 20) -> np.ndarray:
    """A column of 0 and 1 for each kind of toxic text, the largest first.

    Toxic texts are divided by the indicators that tell them from the others, by spherical k-means from
    far-off starts. Texts without such an indicator, and all that aren't toxic, are of no kind.
    """
    out = np.zeros((len(rows), groups))
    columns = _telling(rows, toxic, size) if 0 < toxic.sum() < len(toxic) else np.zeros(0, dtype=np.int64)
    if not len(columns):
        return out
    x = _present(rows, columns, np.zeros((len(rows), len(columns))))
    columns = x[toxic > 0].mean(axis=0) > x[toxic == 0].mean(axis=0)
    own = np.flatnonzero((toxic > 0) & x[:, columns].any(axis=1))
    x = x[own][:, columns]
    if not len(own):
        return out
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = [x[(x @ x.mean(axis=0)).argmax()]]
    while len(centres) < groups:
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    at = np.zeros(len(x), dtype=int)
    for _ in range(steps):
        at = (x @ np.array(centres).T).argmax(axis=1)
        sums = [x[at == k].sum(axis=0) for k in range(groups)]
        centres = [s / max(float(np.linalg.norm(s)), 1e-9) for s in sums]
    order = np.argsort(-np.bincount(at, minlength=groups), kind="stable")
    for k in range(groups):
        out[own[at == order[k]], k] = 1
    return out


def fit_link(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, size: int, penalty: float = 0.005, steps: int = 200) -> Link:
    """Logistic regression by accelerated gradient steps on the telling indicators and the earlier probabilities."""
    if y.sum() in (0, len(y)):
        bias = -30.0 if y.sum() == 0 else float(np.log(len(y) + 1))  # without an example, never
        return Link(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(before.shape[1]), bias)
    columns = _telling(rows, y, size)
    x = _present(rows, columns, np.zeros((len(rows), len(columns) + before.shape[1] + 1)))
    x[:, len(columns) : -1], x[:, -1] = before, 1
    ridge = np.full(x.shape[1], penalty / np.sqrt(len(y)))
    ridge[-1] = 0
    rate = 1.0 / (0.25 * float(np.linalg.norm(x, 2)) ** 2 / len(y) + float(ridge.max()))
    w = momentum = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ momentum, -30, 30)))
        ahead = momentum - rate * (x.T @ (p - y) / len(y) + ridge * momentum)
        momentum = ahead + k / (k + 3) * (ahead - w)
        w = ahead
    n = len(columns)
    return Link(columns, w[:n].astype(float), w[n:-1].astype(float), float(w[-1]))


def fit(rows: list[np.ndarray], y: np.ndarray, names: tuple[str, ...], grams: Stems, folds: int = 3) -> Chain:
    """The chain over the columns of ``y``. What a later model learns from are out-of-fold probabilities.

    A category without examples of both kinds gets a constant, and the chain goes on.
    """
    size, part = 1 << grams.bits, np.arange(len(rows)) % folds
    before, links = np.zeros((len(rows), 0)), []
    for c in range(len(names)):
        own = np.zeros(len(rows))
        for k in range(folds if c < len(names) - 1 else 0):  # nothing comes after the last
            learn, test = np.flatnonzero(part != k), np.flatnonzero(part == k)
            link = fit_link([rows[i] for i in learn], before[learn], y[learn, c], size)
            own[test] = [link.probability(rows[i], list(before[i])) for i in test]
        links.append(fit_link(rows, before, y[:, c], size))
        before = np.column_stack([before, own])
    return Chain(grams, names, links)


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """The plain chain (kinds of toxic texts, then toxic) on at most ``rows`` labelled documents outside the held-out fold."""
    grams = Stems()

    def chain(found: list[np.ndarray], y: np.ndarray) -> dict:
        toxic = (y[:, 0] > 0).astype(float)
        return fit(found, np.column_stack([kinds(found, toxic, 1 << grams.bits), toxic]), CHAIN, grams).plain()

    return fitted(labelled_sample(docs, labels, ["toxic"], rows), grams, ["toxic"], chain)


def scored(docs: DataFrame, chain: dict, text: str = "text", prefix: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of one probability for each category of the whole text; null and empty texts too.

    A column that is called like the struct already stays as it is; the new one gets underscores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 300 weights a category at most
    names = chain["names"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    @lean
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = Chain.of_plain(shared.value)
        for batch in batches:
            yield pd.DataFrame([chain.probabilities(t) for t in batch], columns=list(names), dtype="float64")

    return small_batches(docs).withColumn(fresh(docs, prefix), of(F.col(text)))


def report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, p_<category>..., toxic) for every row of ``docs``; toxic from 0.5 on.

    A null or empty text has the probabilities of a text without indicators. A null id is in no fold and no
    sample. Repeated rows stay rows; an empty table gives no rows; without toxic labels nothing is toxic. Other
    columns are ignored, whatever their names. Texts of any length are read whole.
    """
    own = docs.select("doc_id", "text")
    found = scored(own, trained(docs, labels, rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *[F.col(f"toxicity.{n}").alias(f"p_{n}") for n in CHAIN], (F.col("toxicity.toxic") >= THRESHOLD).alias("toxic"))
