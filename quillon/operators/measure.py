"""Measuring the engine itself: passes, growth, phases and jobs. Every pass builds its frame anew."""

from __future__ import annotations

import math
import statistics
import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import classify, kanon, sampling
from quillon.sources.catalog import quoted


@dataclass(frozen=True)
class Timing:
    label: str
    seconds: tuple[float, ...]

    @property
    def median(self) -> float:
        return statistics.median(self.seconds)

    @property
    def spread(self) -> float:
        return max(self.seconds) - min(self.seconds)


def timed(label: str, make: Callable[[], DataFrame], passes: int = 3) -> Timing:
    """Runs a frame made anew for each pass into nothing; the first pass, which compiles, doesn't count."""
    seconds = []
    for _ in range(passes + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return Timing(label, tuple(seconds[1:]))


def speedup(slow: Timing, fast: Timing) -> float | None:
    """How many times faster by the medians; None where the ranges overlap, which is no result."""
    if max(fast.seconds) >= min(slow.seconds) and max(slow.seconds) >= min(fast.seconds):
        return None
    return slow.median / fast.median


def growth(sizes: list[int], costs: list[float]) -> float:
    """The exponent of cost by size, by least squares on logarithms."""
    x, y = [math.log(s) for s in sizes], [math.log(c) for c in costs]
    mx, my = statistics.fmean(x), statistics.fmean(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)


def phases(df: DataFrame) -> dict[str, float]:
    """Seconds of analysis, optimization, planning and execution of one run."""
    execution = df._jdf.queryExecution()
    execution.executedPlan()
    tracked = execution.tracker().phases()
    out = {name: tracked.apply(name).durationMs() / 1000 for name in ("analysis", "optimization", "planning") if tracked.contains(name)}
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return out | {"execution": time.perf_counter() - start}


def share(parts: dict[str, float], part: str) -> float:
    """A phase's share of all of them; 0 where nothing took any time."""
    total = sum(parts.values())
    return parts[part] / total if total else 0.0


def sample_counts(df: DataFrame, passes: int = 3) -> tuple[Timing, Timing]:
    """Counting a sample of a table column by column, and all columns at once."""
    each = lambda: reduce(DataFrame.unionByName, [sampling.counts(sampling.window(df.select(quoted(c)), None)) for c in df.columns])
    return timed("column by column", each, passes), timed("all at once", lambda: sampling.counts(sampling.window(df, None)), passes)


def arm_cost(profile: DataFrame, evidence: DataFrame, upstream: DataFrame) -> DataFrame:
    """(columns, rescued_tables, rescued_columns, memoised, repeated, wasted_share): how often arms run over a column when round
    two keeps the evidence, and when it gathers that of the rescued tables again."""
    saved = classify.rescued(classify.warehouse(profile, evidence), upstream)
    again = profile.join(saved, "table", "left_semi").agg(F.countDistinct("table").alias("rescued_tables"), F.count("*").alias("rescued_columns"))
    out = profile.agg(F.count("*").alias("columns")).join(F.broadcast(again))  # one row each
    out = out.withColumn("memoised", F.col("columns")).withColumn("repeated", F.col("columns") + F.col("rescued_columns"))
    return out.withColumn("wasted_share", F.coalesce(F.try_divide("rescued_columns", "repeated"), F.lit(0.0)))


def grain_cost(names: Iterable[str], weights: dict[str, str], saved: Iterable[str]) -> dict[str, int]:
    """What is asked of a database to measure the grain of all tables, and of the rescued ones alone."""
    names, saved = list(names), list(saved)
    eager, lazy = (len(kanon.asked(of, weights)) for of in (names, saved))
    return {"eager_tables": len(names), "lazy_tables": len(saved), "eager": eager, "lazy": lazy, "saved": eager - lazy}


@contextmanager
def jobs(spark: SparkSession, group: str):
    """Counts the jobs started inside: the number of statements that reached the cluster."""
    context, found = spark.sparkContext, []
    context.setJobGroup(group, group)
    try:
        yield found
    finally:
        found += context.statusTracker().getJobIdsForGroup(group)
        context.setLocalProperty("spark.jobGroup.id", None)
