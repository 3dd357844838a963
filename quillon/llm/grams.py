"""Hashed n-gram indicators of whole texts, and the bounded labelled sample on which classifiers are fitted."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import held_out, lean, small_batches

WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHED = 120_000  # words whose numbers are kept; bounds memory, changes nothing


@dataclass
class Grams:
    """Which indicators a text has, as ascending numbers under 2 ** bits.

    Words are lower-cased and hashed; ``order`` neighbours make an n-gram. With ``shapes`` each token also
    has a shape (capitals, digits, the mark itself, the same as the token before, other) and runs of one to
    four shapes are indicators too. Null is empty; no text is cut.
    """

    bits: int = 20
    order: int = 2
    shapes: bool = False
    cache: dict[str, tuple[int, int]] = field(default_factory=dict, repr=False)

    def _code(self, token: str) -> tuple[int, int]:
        if len(self.cache) > CACHED:
            self.cache.clear()
        word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
        if token[0].isalnum() or token[0] == "_":
            shape = 1 if token.isdigit() else 2 if len(token) > 1 and token.isupper() else 3
        else:
            shape = 8 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % 1000003
        self.cache[token] = word, shape
        return word, shape

    def of(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(0, dtype=np.int64)
        get = self.cache.get
        codes = np.array([get(t) or self._code(t) for t in tokens], dtype=np.uint64)
        words, mask = codes[:, 0], np.uint64((1 << self.bits) - 1)
        mix = np.uint64(0x9E3779B97F4A7C15)
        found, gram = [words * mix >> np.uint64(64 - self.bits)], words
        for n in range(1, self.order):
            gram = gram[:-1] * mix + words[n:]
            found.append(gram * mix >> np.uint64(64 - self.bits))
        if self.shapes:
            shape = codes[:, 1].copy()
            shape[1:][words[1:] == words[:-1]] = 4
            run = shape + np.uint64(77)
            for n in range(4):
                if n:
                    run = run[:-1] * mix + shape[n:]
                found.append(run * mix >> np.uint64(64 - self.bits))
        return np.unique(np.concatenate(found) & mask).astype(np.int64)


@dataclass
class Stems:
    """Which words and word beginnings a text has, as ascending numbers under 2 ** bits; a beginning keeps inflected forms together."""

    bits: int = 20
    lengths: tuple[int, ...] = (3, 4, 5)
    cache: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def of(self, text: str | None) -> np.ndarray:
        cache, mask, out = self.cache, (1 << self.bits) - 1, []
        if len(cache) > CACHED:
            cache.clear()
        for word in set(WORD.findall((text or "").lower())):
            if (found := cache.get(word)) is None:
                names = [word, *("^" + word[:n] for n in self.lengths if len(word) >= n)]
                found = cache[word] = [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]
            out += found
        return np.unique(np.array(out, dtype=np.int64))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: list[str], rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, *target) of at most ``rows`` labelled documents outside the held-out fold.

    Which ones depends on a hash of the id alone. Labels with a null id or a null target don't count; a
    repeated label counts with its largest values. The ids, ``rows`` of them at most, are broadcast, so
    no text is shuffled.
    """
    known = labels.select(F.col("doc_id").alias("__doc"), *target).dropna().where(~held_out(F.col("__doc"))).groupBy("__doc").agg(*[F.max(t).alias(t) for t in target])
    chosen = known.orderBy(F.xxhash64("__doc"), "__doc").limit(rows)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc")).drop("__doc")


def fitted(sample: DataFrame, grams: Grams | Stems, target: list[str], fit: Callable[[list[np.ndarray], np.ndarray], dict]) -> dict:
    """What ``fit(indicators, targets)`` makes of a bounded sample: plain numbers and arrays, fitted in one task.

    Of a repeated id one row counts, so the task gets as many rows as the sample has ids; the driver gets the
    result alone.
    """

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grams": [grams.of(t).astype(np.int32).tobytes() for t in batch["text"]]} | {t: batch[t].astype("float64") for t in target})
        grams.cache.clear()  # a worker outlives its task

    @lean
    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            rows += [np.frombuffer(g, dtype=np.int32).astype(np.int64) for g in batch.column("grams").to_pylist()]
            y += zip(*(batch.column(t).to_pylist() for t in target), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, np.array(y).reshape(-1, len(target))))], pa.binary())], names=["model"])

    schema = "doc_id long, grams binary, " + ", ".join(f"{t} double" for t in target)
    one_each = small_batches(sample).mapInPandas(run, schema).groupBy("doc_id").agg(F.min(F.struct("grams", *target)).alias("s")).select("doc_id", "s.*")
    found = one_each.repartition(1).sortWithinPartitions("doc_id").mapInArrow(model, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros((0, len(target))))
