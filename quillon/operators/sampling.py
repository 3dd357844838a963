"""The sampling arm: shapes and checksums of a bounded window of values, counted inside the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.operators.profile import distinct_ratio, support
from quillon.plans import rules
from quillon.sources.catalog import quoted, sql_type


def window(df: DataFrame, order_by: list[str] | None, limit: int = rules.SAMPLE_LIMIT) -> DataFrame:
    """(column, sql_type, v): every column of the first rows. One bounded scan serves all columns; without an order, any rows."""
    rows = (df.orderBy(*order_by) if order_by else df).limit(limit)
    each = [F.struct(F.lit(f.name).alias("column"), F.lit(sql_type(f.dataType)).alias("sql_type"), values.as_text(quoted(f.name), f.dataType).alias("v")) for f in df.schema]
    return rows.select(F.inline(F.array(*each)))


def counts(sampled: DataFrame) -> DataFrame:
    """(column, read, non_null, distinct) of a window."""
    return sampled.groupBy("column").agg(F.count("*").alias("read"), F.count("v").alias("non_null"), F.countDistinct("v").alias("distinct"))


def shapes(sampled: DataFrame) -> DataFrame:
    """(column, shape, n): how often each shape occurs among the values of a window."""
    return sampled.where("v is not null").groupBy("column", values.shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n"))


def dominant(shape_counts: DataFrame) -> DataFrame:
    """(column, shape, n): the most frequent shape of each column, the smallest among equals."""
    first = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "shape"))
    return shape_counts.withColumn("first", first).where("first = 1").drop("first")


def checksums(sampled: DataFrame) -> DataFrame:
    """(column, candidates, valid): values with 13 to 19 digits, and those that pass the card checksum."""
    number = values.digits(F.col("v"))
    card = F.length(number).between(*rules.LUHN_DIGITS)
    return sampled.groupBy("column").agg(F.count_if(card).alias("candidates"), F.count_if(card & values.luhn(number)).alias("valid"))


def samples(sampled: DataFrame) -> DataFrame:
    """One row for each column: sql_type, read, non_null, distinct, shape_counts, shape, shape_n, candidates, valid."""
    counted = sampled.groupBy("column", "sql_type").agg(F.count("*").alias("read"), F.count("v").alias("non_null"), F.countDistinct("v").alias("distinct"))
    found = shapes(sampled)
    maps = found.groupBy("column").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("shape", "n")))).alias("shape_counts"))  # as many entries as a window has rows at most
    best = dominant(found).select("column", "shape", F.col("n").alias("shape_n"))
    return counted.join(maps, "column", "left").join(best, "column", "left").join(checksums(sampled), "column")


def looks_like_a_code(concentration: float = rules.CODE_CONCENTRATION, distinct: float = rules.CODE_DISTINCT, length: tuple[int, int] = rules.CODE_LENGTH, digits: int = rules.CODE_DIGITS):
    """A column of ``samples`` whose dominant shape reads as an identifier: not a date, mostly distinct, of digits or letters with digits."""
    shape = F.col("shape")
    temporal = F.col("sql_type").rlike("^(DATE|TIME)")
    enough = shape.contains("A") | (F.length(F.regexp_replace(shape, "[^9]", "")) >= digits)
    share = F.try_divide(F.col("shape_n"), F.col("non_null"))
    code = ~temporal & ~shape.isin(rules.DATE_SHAPES) & shape.contains("9") & ~shape.contains("?") & F.length(shape).between(*length) & (distinct_ratio() >= distinct) & enough & (share >= concentration)
    return F.coalesce(code, F.lit(False))


def signals(table: str, sampled: DataFrame, **thresholds) -> DataFrame:
    """The sampling arm's evidence: (table, column, arm, category, strength, support, detail)."""
    rate = F.try_divide(F.col("valid"), F.col("candidates"))
    share = F.try_divide(F.col("shape_n"), F.col("non_null"))
    card = F.when((F.col("non_null") > 0) & (rate >= rules.LUHN_CONCENTRATION), F.struct(F.lit("payment_card").alias("category"), (rules.LUHN_STRENGTH * rate).alias("strength"), F.format_string("%d of %d sampled values pass the card checksum", "valid", "candidates").alias("detail")))
    code = F.when(looks_like_a_code(**thresholds), F.struct(F.lit("unknown_identifier").alias("category"), (rules.CODE_STRENGTH * share).alias("strength"), F.format_string("%d of %d sampled values have the shape %s", "shape_n", "non_null", "shape").alias("detail")))
    rows = samples(sampled).withColumn("x", F.explode(F.array_compact(F.array(card, code))))
    return rows.select(F.lit(table).alias("table"), "column", F.lit("sample").alias("arm"), "x.category", "x.strength", support("read").alias("support"), "x.detail")


def unsafe_shapes(sampled: DataFrame) -> DataFrame:
    """Shapes with a character that could be part of a value; there should be none."""
    return shapes(sampled).where(F.col("shape").rlike(r"[^A9?\-./:+()@,#_ ]"))


def cliff(sweep: DataFrame, shipped: float = rules.CODE_CONCENTRATION) -> DataFrame:
    """(cliff): coming down from the shipped concentration, the first one of a sweep (concentration, found) that reads
    otherwise; 0 where none does or the shipped one isn't there."""
    base = sweep.where(F.col("concentration") == shipped).select(F.col("found").alias("base"))
    other = sweep.where(F.col("concentration") < shipped).join(F.broadcast(base)).where("found <> base")  # one row
    return other.agg(F.coalesce(F.max("concentration"), F.lit(0.0)).alias("cliff"))
