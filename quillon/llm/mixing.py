"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import settled

WORD = r"[^\x20\x09-\x0D]+"


def offset(seed: int) -> float:
    """The one random offset of a mix, away from both ends so that rounding never adds a copy."""
    return round(0.05 + 0.9 * random.Random(seed).random(), 6)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Eight classes for each power of two, ascending with the size."""
    log = F.length(F.bin(size)) - 1
    return (log * 8 + F.expr("shiftright(__size, greatest(length(bin(__size)) - 4, 0))").bitwiseAND(F.lit(7))).cast("int")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(__named, __source, __source_size, __target) for each source of ``sized``.

    Sources take their weights in code point order, null last. A target that reaches ``cap`` times its
    source's size stops there, and the rest is dealt out again: the sources with the smallest size for
    their weight are capped first, so one ordered pass finds the level at which the others stand.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("__named").desc(), "__source")
    filling = Window.orderBy(F.col("__source_size") / F.col("__weight"), F.col("__named").desc(), "__source")
    sources = (
        sized.groupBy("__named", "__source").agg(F.sum("__size").alias("__source_size"))
        .withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("__all", F.sum("__source_size").over(every))
        .withColumn("__before", F.coalesce(F.sum(F.col("__source_size") * cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__left", F.sum("__weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__full", (F.col("__all") * share - F.col("__before")) * F.col("__weight") >= F.col("__source_size") * cap * F.col("__left"))
        .withColumn("__used", F.sum(F.when(F.col("__full"), F.col("__source_size") * cap).otherwise(0)).over(every))
        .withColumn("__open", F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__weight"))).over(every))
    )
    level = F.col("__weight") * (F.col("__all") * share - F.col("__used")) / F.col("__open")
    return sources.select("__named", "__source", "__source_size", F.when(F.col("__full"), (F.col("__source_size") * cap).cast("double")).otherwise(level).alias("__target"))


CELL = ["__named", "__source", "__class", "__spread"]


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("__row")
    return docs.select(own, F.col(doc_id).alias("__id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__mark"), F.col(source).isNotNull().cast("int").alias("__named"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), word_count(F.col(text)).alias("__size"))


def _celled(rows: DataFrame, spreads: int) -> DataFrame:
    spread = F.expr(f"cast(pmod(pmod(coalesce(__id, -1), 1000003) * 7919 + cast(conv(substr(__mark, 1, 7), 16, 10) as bigint), {spreads}) as int)")
    return rows.withColumn("__class", _size_class(F.col("__size"))).withColumn("__spread", spread)


def _stepped(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], share: float, cap: int, seed: int) -> DataFrame:
    """``rows`` with __source_size, __target and __copies. ``sized`` has the same rows without their texts."""
    spreads = 16 + sized.count() // 20_000
    earlier = Window.partitionBy("__named", "__source").orderBy("__class", "__spread").rowsBetween(Window.unboundedPreceding, -1)
    cells = _celled(sized, spreads).groupBy(*CELL).agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    plan = cells.join(source_targets(sized, weights, share, cap), ["__named", "__source"])
    rank = F.col("__base") + F.row_number().over(Window.partitionBy(*CELL).orderBy("__id", "__size", "__mark"))
    rate = F.coalesce(F.try_divide(F.col("__target"), F.col("__source_size").cast("double")), F.lit(0.0))
    ranked = _celled(rows, spreads).join(plan, CELL).withColumn("__rank", rank).withColumn("__rate", rate)
    crossed = f"floor(__rate * __rank + {offset(seed)}D) - floor(__rate * (__rank - 1) + {offset(seed)}D)"
    return ranked.withColumn("__copies", F.expr(crossed).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 42) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Within its source each document expects target / size copies. The prefix sums of these run over the
    documents in order of size class and then of a spread of ids and texts; with one random offset added, a
    document is taken once for each integer that its own step crosses: never more than ``cap`` times,
    and, as the classes follow one another by size, the taken words stay near the target.

    The prefix sums have two levels: counts of cells (source, size class, spread) are summed over the
    cells of a source, rows are numbered inside their cell. So no task holds a source; the number of
    spreads grows with the rows.

    Null text has size 0 and a null source is a source of its own. A null id counts as -1. Repeated rows
    are rows of their own; equal ids are ordered by size and by the MD5 of the text, so that the result depends
    on the rows alone. Only rows with the same id, source and text may stand for one another. An empty table
    gives an empty result. All columns of ``docs`` are kept as they are, whatever their names.
    """
    keyed = _keyed(docs, doc_id, text, source)
    taken = _stepped(keyed, settled(keyed.drop("__row")), weights, share, cap, seed).where("__copies > 0")
    return taken.select("__row", F.explode(F.expr("sequence(1, __copies)"))).select("__row.*")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 42) -> DataFrame:
    """What ``mix`` does with each row: doc_id, size, source_size, target (its source's), copies, taken (words)."""
    sized = settled(_keyed(docs, doc_id, text, source).drop("__row"))
    steps = _stepped(sized, sized, weights, share, cap, seed)
    return steps.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def oracle(documents: str = "documents", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 42, copies_only: bool = False) -> str:
    """``mix_report`` over the table ``documents`` for DuckDB."""
    steps = "CAST(floor(rate * rnk + {u}) AS BIGINT) - CAST(floor(rate * (rnk - 1) + {u}) AS BIGINT)".replace("{u}", f"CAST({offset(seed)} AS DOUBLE)")
    return f"""
WITH sized AS (
  SELECT doc_id AS id, md5(coalesce(text, '')) AS mark, (source IS NOT NULL)::INT AS named, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM {documents}),
sources AS (SELECT named, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, list_value({', '.join(map(str, weights))})[((row_number() OVER (ORDER BY named DESC, src) - 1) % {len(weights)} + 1)::INT]::BIGINT AS weight,
         sum(source_size) OVER ()::BIGINT AS total FROM sources),
filling AS (
  SELECT *, coalesce(sum(source_size * {cap}) OVER (ORDER BY source_size / weight, named DESC, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (ORDER BY source_size / weight, named DESC, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS remaining FROM weighed),
judged AS (SELECT *, (total * CAST({share} AS DOUBLE) - before) * weight >= source_size * {cap} * remaining AS capped FROM filling),
levels AS (
  SELECT *, sum(CASE WHEN capped THEN source_size * {cap} ELSE 0 END) OVER ()::BIGINT AS used,
         sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()::BIGINT AS open FROM judged),
targets AS (
  SELECT named, src, source_size, CASE WHEN capped THEN (source_size * {cap})::DOUBLE ELSE weight * (total * CAST({share} AS DOUBLE) - used) / open END AS target FROM levels),
binned AS (SELECT *, length(bin(size)) - 1 AS lg, 16 + (count(*) OVER ()) // 20000 AS spreads FROM sized),
celled AS (
  SELECT *, lg * 8 + ((size >> greatest(lg - 3, 0)) & 7) AS class,
         ((((coalesce(id, -1) % 1000003) + 1000003) % 1000003) * 7919 + ('0x' || substr(mark, 1, 7))::BIGINT) % spreads AS spread FROM binned),
ranked AS (
  SELECT c.id, c.size, t.source_size, t.target, coalesce(CASE WHEN t.source_size > 0 THEN t.target / t.source_size END, 0.0) AS rate,
         row_number() OVER (PARTITION BY c.named, c.src ORDER BY class, spread, c.id NULLS FIRST, c.size, mark) AS rnk
  FROM celled c JOIN targets t USING (named, src)),
stepped AS (SELECT *, {steps} AS copies FROM ranked)
SELECT id AS doc_id, size, source_size, target, {"copies" if copies_only else "copies, copies * size AS taken"} FROM stepped"""
