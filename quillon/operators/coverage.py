"""What is covered: the clause list against the taxonomy, the floor classifier, and verdicts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.plans import rules
from quillon.sources.catalog import quoted


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.TAXONOMY, "category string, identifiability string, regimes array<string>, identifies_at string")


def clauses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.SAFE_HARBOR, "letter string, maps_to array<string>")


def gaps(spark: SparkSession) -> DataFrame:
    """(side, name): clauses without a category, and categories of the regime that no clause reaches."""
    unmapped = clauses(spark).where(F.size("maps_to") == 0).select(F.lit("clause").alias("side"), F.col("letter").alias("name"))
    reached = clauses(spark).select(F.explode("maps_to").alias("category"))
    tagged = taxonomy(spark).where(F.array_contains("regimes", "hipaa")).join(reached, "category", "left_anti")
    return unmapped.unionByName(tagged.select(F.lit("category").alias("side"), F.col("category").alias("name")))


def floor_by_name(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(part), F.lit(key)) for part, key in rules.FLOOR_NAMES])


def floor(df: DataFrame, order_by: list[str], limit: int = 50) -> DataFrame:
    """(column, by_name, by_value, category) of the floor: the first name part that fits, else the first pattern that two
    thirds of the first rows' values match, else not personal. Nulls and empty values don't count."""
    rows = df.orderBy(*order_by).limit(limit)
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), values.as_text(quoted(f.name), f.dataType).alias("v")) for f in df.schema])))
    there = F.col("v").isNotNull() & (F.col("v") != "")
    by = each.groupBy("column").agg(F.count_if(there).alias("n"), *[F.count_if(there & F.col("v").rlike(pattern)).alias(key) for key, pattern in rules.FLOOR_VALUES])
    by_value = F.coalesce(*[F.when((F.col("n") > 0) & (F.col(key) * 3 >= F.col("n") * 2), F.lit(key)) for key, _ in rules.FLOOR_VALUES])
    out = by.select("column", floor_by_name(F.col("column")).alias("by_name"), by_value.alias("by_value"))
    return out.withColumn("category", F.coalesce("by_name", "by_value", F.lit("not_personal")))


def graded(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts against labels (table, column, label): in_scope, missed, false_alarm, wrong_category.

    In scope are the categories that the clause list maps to.
    """
    scope = sorted({k for _, keys in rules.SAFE_HARBOR for k in keys})
    met = labels.join(verdicts.select("table", "column", "category"), ["table", "column"], "left").withColumn("category", F.coalesce("category", F.lit("not_personal")))
    personal, truly = F.col("category") != "not_personal", F.col("label") != "not_personal"
    return met.select("table", "column", "label", "category", F.col("label").isin(scope).alias("in_scope"), (F.col("label").isin(scope) & ~personal).alias("missed"), (personal & ~truly).alias("false_alarm"), (personal & truly & (F.col("category") != F.col("label"))).alias("wrong_category"))


def recall(grades: DataFrame) -> DataFrame:
    """(identifiability, in_scope, found) for each level of the labels."""
    level = F.create_map(*[x for k, v in rules.IDENTIFIABILITY.items() for x in (F.lit(k), F.lit(v))])[F.col("label")]
    return grades.where("in_scope").groupBy(level.alias("identifiability")).agg(F.count("*").alias("in_scope"), F.count_if(~F.col("missed")).alias("found"))


def headline(grades: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(in_scope, found, auto_masked, false_alarms): columns of the clause list, how many of them are flagged, how many
    without a person's help, and what is flagged that is nobody's."""
    met = grades.join(verdicts.select("table", "column", "band"), ["table", "column"])
    flagged, scope = F.col("band") != "ignore", F.col("in_scope")
    return met.agg(F.count_if(scope).alias("in_scope"), F.count_if(scope & flagged).alias("found"), F.count_if(scope & (F.col("band") == "accept")).alias("auto_masked"), F.count_if(flagged & (F.col("label") == "not_personal")).alias("false_alarms"))


def unlabelled(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """(table, column, problem): columns without a label, labels without a column, and what is labelled twice."""
    address = ["table", "column"]
    missing = columns.join(labels, address, "left_anti").select(*address, F.lit("no label").alias("problem"))
    loose = labels.join(columns, address, "left_anti").select(*address, F.lit("no column").alias("problem"))
    twice = labels.groupBy(*address).count().where("count > 1").select(*address, F.lit("two labels").alias("problem"))
    return missing.unionByName(loose).unionByName(twice)


def identifying_quasi(labels: DataFrame) -> DataFrame:
    """(table, column, label, observed): quasi identifiers that are fine enough to identify."""
    rows = [(k, lv, place) for k, lv, place in ((k, rules.THRESHOLD.get(k), rules.FINENESS.get(rules.THRESHOLD.get(k, ""), (None, None))[1]) for k, v in rules.IDENTIFIABILITY.items() if v == "quasi")]
    least = F.create_map(*[x for k, _, place in rows for x in (F.lit(k), F.lit(place).cast("int"))])[F.col("label")]
    place = F.create_map(*[x for g, (_, at) in rules.FINENESS.items() for x in (F.lit(g), F.lit(at))])[F.col("observed")]
    return labels.where(F.col("label").isin([k for k, *_ in rows]) & (least.isNull() | (place >= least))).select("table", "column", "label", "observed")


def planted_as(labels: DataFrame, category: str) -> DataFrame:
    return labels.where(F.col("label") == category).select("table", "column")


def sampling_grade(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """(table, column, label, grade, band): what the sampling arm changes. A personal column is recovered, still missed or
    was found before; another one is a false alarm if only sampling flags it; else it is unchanged."""
    met = labels.join(before.select("table", "column", F.col("band").alias("b")), ["table", "column"]).join(after.select("table", "column", "band"), ["table", "column"])
    was, now, truly = F.col("b") != "ignore", F.col("band") != "ignore", F.col("label") != "not_personal"
    grade = F.when(truly & ~was & now, "recovered").when(truly & ~now, "still missed").when(~truly & ~was & now, "false alarm").otherwise("unchanged")
    return met.select("table", "column", "label", grade.alias("grade"), "band")


def planted_summary(labels: DataFrame) -> DataFrame:
    """(identifiability, columns) of an answer key."""
    level = F.create_map(*[x for k, v in rules.IDENTIFIABILITY.items() for x in (F.lit(k), F.lit(v))])[F.col("label")]
    return labels.groupBy(level.alias("identifiability")).agg(F.count("*").alias("columns"))


def under_regime(spark: SparkSession, regime: str) -> DataFrame:
    return taxonomy(spark).where(F.array_contains("regimes", regime)).select("category")
