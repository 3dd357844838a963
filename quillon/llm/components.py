"""Connected components: local forests first, then alternating star contraction in joins and keyed aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, looked_up, settled

ONE_TASK = 1_000_000  # links, of 16 bytes each, that one task may finish; more are contracted by stars


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that isn't its component's smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        for ends in (x, y, low[x], low[y]):  # roots are hooked too, so that a long chain takes few turns
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def _forests(links: DataFrame) -> DataFrame:
    """The same components with fewer links: a star for each component of every ``ONE_TASK`` links of a partition."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            node, root = forest(*(np.concatenate([np.zeros(0, dtype=np.int64), *(h[k] for h in held)]) for k in (0, 1)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
            if sum(len(h[0]) for h in held) >= ONE_TASK:
                yield stars()
        yield stars()

    return links.mapInArrow(run, "a long, b long")


def _nearest(edges: DataFrame) -> DataFrame:
    """(a, low, many): the smallest neighbour of each a. Aggregated before the shuffle, so a hub is no hot key."""
    return edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("many"))


def _with_nearest(edges: DataFrame) -> DataFrame:
    """(a, b, low) for every edge; a hub's edges stay where they are."""
    return looked_up(edges, settled(_nearest(edges)), "a", "many")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_nearest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Here a > b holds for every edge."""
    met = _with_nearest(edges).select("b", "low", "a")
    return met.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").unionByName(met.select("a", F.col("low").alias("b"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 100, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node with a link to another one; root is the smallest node of its component.

    Links (long, long) to oneself, repeated links and nulls are ignored; no link gives no row. Each partition
    first replaces its links by stars. If ``one_task`` links or fewer are left, one task finishes them in some
    tens of MB; else alternating stars contract them, each round written to the checkpoint folder, until
    no edge changes. That takes some log squared of the nodes in rounds; ``max_rounds`` without an end is an error, never a
    result.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = settled(_forests(edges))
    if edges.count() <= one_task:
        return _rooted(settled(_forests(edges.coalesce(1))))
    edges, mark = settled(edges.distinct()), None
    for _ in range(max_rounds):
        edges = settled(_small_star(settled(_large_star(edges))))
        # the same edges give the same count and the same sums
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == mark:
            return _rooted(edges)
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _rooted(edges: DataFrame) -> DataFrame:
    """Here every edge points at a root."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
