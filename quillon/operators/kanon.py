"""How alone people are: group sizes, uniqueness, grain and population floors."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans import rules
from quillon.sources.catalog import quoted


def residual(df: DataFrame, keys: list[Column], weight: str | None = None) -> DataFrame:
    """(k, groups, singletons, population, alone_share) of the groups by ``keys``; null is a value. With ``weight``, rows
    stand for that many people. One shuffle, after partial sums."""
    if not keys:
        raise ValueError("without a quasi identifier there is no group to measure")
    size = F.count("*") if weight is None else F.sum(F.col(quoted(weight)))
    groups = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(size.cast("long").alias("s"))
    out = groups.agg(F.min("s").alias("k"), F.count("*").alias("groups"), F.coalesce(F.sum((F.col("s") == 1).cast("long")), F.lit(0)).alias("singletons"), F.coalesce(F.sum("s"), F.lit(0)).alias("population"))
    return out.withColumn("alone_share", F.try_divide("singletons", "population"))


def meets(residuals: DataFrame, target: int = 2) -> DataFrame:
    if target < 1:
        raise ValueError("a target under 1 is no threshold")
    return residuals.withColumn("meets", F.col("k") >= target)


def compliant_but_identifiable(residuals: DataFrame, target: int = 2) -> DataFrame:
    """Masked tables in which somebody can still be picked out: all was generalised as permitted, and k is under the target."""
    return meets(residuals, target).where(~F.col("meets")).drop("meets")


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values): distinct values, null among them."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("v")) for c in columns])
    return df.select(F.explode(each).alias("x")).select("x.*").distinct().groupBy("column").agg(F.count("*").alias("values"))


def uniform_share(rows: Column, product: Column) -> Column:
    """The share of rows expected to be alone if all combinations were equally likely; 0 without rows."""
    return F.when(rows == 0, 0.0).otherwise(F.pow(1 - 1 / product, rows - 1))


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, combinations, unique_rows, k, measured, cells, uniform, shape_effect) of a set of columns; null is a value."""
    return sweep(df, columns, [len(columns)]).drop("columns")


def sweep(df: DataFrame, columns: list[str], lengths: list[int] | None = None) -> DataFrame:
    """The same for each prefix of the columns, with ``columns`` their number.

    All prefixes come from one ROLLUP: the rows are counted by all columns before the shuffle and each
    prefix is a grouping of those counts; grouping_id tells a rolled-up column from a null.
    """
    spark, names = df.sparkSession, [f"c{i}" for i in range(len(columns))]
    counted = df.groupBy(*[F.col(quoted(c)).cast("string").alias(n) for c, n in zip(columns, names, strict=True)]).agg(F.count("*").alias("n"))
    rolled = counted.rollup(*names).agg(F.sum("n").alias("s"), F.grouping_id().alias("gid"))
    level = F.lit(len(columns)) - F.bit_count("gid")
    groups = rolled.select(level.alias("columns"), "s").where("columns > 0")
    by = groups.groupBy("columns").agg(F.sum("s").alias("rows"), F.count("*").alias("combinations"), F.count_if(F.col("s") == 1).alias("unique_rows"), F.min("s").alias("k"))
    values = counted.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.col(n).alias("v")) for i, n in enumerate(names)])).alias("x")).select("x.*").distinct().groupBy("i").agg(F.count("*").alias("values"))
    upto = spark.range(1, len(columns) + 1).select(F.col("id").cast("int").alias("columns"))
    products = upto.join(values, F.col("i") <= F.col("columns")).groupBy("columns").agg(F.product("values").alias("cells"))
    out = by.join(products, "columns").withColumn("measured", F.col("unique_rows") / F.col("rows")).withColumn("uniform", uniform_share(F.col("rows"), F.col("cells")))
    out = out.withColumn("shape_effect", F.col("measured") - F.col("uniform"))
    return out if lengths is None else out.where(F.col("columns").isin(lengths))


def null_effect(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, complete, measured_all, measured_complete, flattery): what leaving incomplete rows out does to the share of unique rows."""
    names = [f"c{i}" for i in range(len(columns))]
    groups = df.groupBy(*[F.col(quoted(c)).cast("string").alias(n) for c, n in zip(columns, names, strict=True)]).agg(F.count("*").alias("s"))
    # the groups of complete rows are those without a null in their keys, so one grouping serves both
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    alone = F.col("s") == 1
    out = groups.withColumn("whole", whole).agg(
        F.sum("s").alias("rows"), F.coalesce(F.sum(F.when(F.col("whole"), F.col("s"))), F.lit(0)).alias("complete"),
        F.try_divide(F.count_if(alone), F.sum("s")).alias("measured_all"),
        F.try_divide(F.count_if(alone & F.col("whole")), F.sum(F.when(F.col("whole"), F.col("s")))).alias("measured_complete"),
    )
    return out.withColumn("flattery", F.col("measured_complete") - F.col("measured_all"))


def changes_sign(effects: DataFrame) -> DataFrame:
    """(changes): whether leaving incomplete rows out flatters some measurements and not others; no effect is no direction."""
    sign = F.signum("flattery")
    return effects.agg(F.coalesce((F.min(sign) < 0) & (F.max(sign) > 0), F.lit(False)).alias("changes"))


def postal_floor(df: DataFrame, column: str, floor: int = rules.POSTAL_FLOOR) -> DataFrame:
    """(areas, smallest, largest, meeting, applies): whether every area of three characters holds more people than the floor."""
    areas = df.groupBy(F.substring(F.col(quoted(column)).cast("string"), 1, 3).alias("area")).agg(F.count("*").alias("n"))
    out = areas.agg(F.count("*").alias("areas"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count_if(F.col("n") > floor).alias("meeting"))
    return out.withColumn("applies", (F.col("areas") > 0) & (F.col("areas") == F.col("meeting")))


def grain(df: DataFrame, weight: str | None = None) -> DataFrame:
    """(rows, population, k, singleton_rows, singleton_share, factor): how many people a row stands for.

    The factor is what dates of the table are worth as evidence of a person: 1 for ungrouped tables.
    """
    if weight is not None and weight not in df.columns:
        raise ValueError(f"the weight column {weight} is not in the table")
    size = F.lit(1) if weight is None else F.col(quoted(weight))
    out = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("population"), F.coalesce(F.min(size), F.lit(1)).cast("long").alias("k"), F.coalesce(F.sum((size == 1).cast("long")), F.lit(0)).alias("singleton_rows"))
    out = out.withColumn("singleton_share", F.when(F.col("rows") == 0, 0.0).otherwise(F.col("singleton_rows") / F.col("rows")))
    return out.withColumn("factor", F.lit(1.0) if weight is None else F.col("singleton_share"))


def rescue_floor(strength: float = rules.TEMPORAL_TYPE_STRENGTH) -> float:
    """The least factor at which a date of that strength still reaches review."""
    return rules.weakest(strength)


def asked(names: Iterable[str], weights: dict[str, str]) -> list[tuple[str, str]]:
    """What the grain of these tables asks of a database: whether a weight column is there, and the grain itself."""
    return [q for name in names for q in ([("column", name)] if name in weights else []) + [("grain", name)]]


def confidences(tables: dict[str, DataFrame], weights: dict[str, str], names: Iterable[str]) -> DataFrame:
    """(table, factor) of the named tables, in one plan; ``weights`` has the column that counts people where there is one."""
    found = [grain(tables[name], weights.get(name)).select(F.lit(name).alias("table"), "factor") for name in names]
    if not found:
        raise ValueError("no table to measure")
    return reduce(DataFrame.unionByName, found)


def separates(rows: DataFrame, by: str) -> DataFrame:
    """(separates): whether each value of ``by`` has a single band."""
    return rows.groupBy(by).agg(F.countDistinct("band").alias("bands")).agg(F.bool_and(F.col("bands") == 1).alias("separates"))
