"""The profile counts values in their own type, and says the same as one aggregate over texts."""

import re

from pyspark.sql import functions as F

from quillon.functions import values
from quillon.operators import profile
from quillon.sources.catalog import Table

SCHEMA = "at long, v int, n short, x double, y float, d date, t timestamp, z timestamp_ntz, b boolean, m decimal(9,2), s string, l array<double>"


def rows(spark):
    made = spark.range(300).select(
        F.col("id").alias("at"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("n"), (F.col("id") % 4 / 1e7).alias("x"), (F.col("id") % 9 / 8).alias("y"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 11).cast("int")).alias("d"), F.timestamp_seconds(F.col("id") % 13).alias("t"), F.timestamp_seconds(F.col("id") % 13).alias("z"), F.col("id") % 2 == 0,
        (F.col("id") % 6 / 4).alias("m"), F.when(F.col("id") % 8 > 0, F.repeat(F.concat(F.col("id") % 12, F.lit("@x.org ")), F.when(F.col("id") % 2 == 0, 1).otherwise(20))), F.array(F.col("id") % 3, F.lit(None)),
    )
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return made.toDF(*names).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in SCHEMA.split(", ")])


def test_numbers_are_shuffled_as_numbers(spark):
    plan = profile.measured(rows(spark).select("at", "v", "x"))._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(at#\d+, v#\d+L", plan), "text was shuffled"


def test_every_type_agrees_with_one_aggregate(spark):
    df = rows(spark)
    odd = df.unionByName(df.limit(3).withColumn("x", F.expr("double('NaN')")).withColumn("y", F.expr("float('-0.0')")))
    for each in (df, odd, df.where("at < 0")):
        assert profile.disagreements(profile.measured(each), profile.measured_wide(each)).collect() == []
    found = {r["column"]: r for r in profile.measured(df).collect()}
    assert found["x"]["distinct"] == 1 and found["at"]["distinct"] == 300  # four numbers have one text
    assert profile.profiled(Table("t", df, ("at",))).where("table = 't' and rows = 300").count() == len(df.columns)


def test_patterns_at_their_least_and_greatest_lengths(spark):
    made = ["a@b.co", "@b.co", "1.1.1.1", "255.255.255.255", "1.1.1", "123-45-6789", "123-45-678", "123456789", "1234567890", "+123456789012345", "123456789012", "1234567890123", "- 1234567890123456789 -", ""]
    found = spark.createDataFrame([(v,) for v in made], "v string").select("v", *[p(F.col("v")).alias(k) for k, p, _ in values.PREDICATES]).collect()
    hit = {k: [r["v"] for r in found if r[k]] for k, _, _ in values.PREDICATES}
    assert hit["email"] == ["a@b.co"] and hit["national_id"] == ["123-45-6789"] and hit["ip_address"] == ["1.1.1.1", "255.255.255.255"]
    assert hit["phone"] == ["255.255.255.255", "1234567890", "+123456789012345", "123456789012", "1234567890123"] and hit["payment_card"] == ["1234567890123", "- 1234567890123456789 -"]
