"""The star schema and its neighbours as a catalog, with declared keys and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.catalog import Catalog, Reference, Table

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",),
    "conversations": ("conv_id", "turn"), "labels": (), "lineitem": (), "embeddings": ("vec_id",),
}
REFERENCES = {
    "nation": (Reference(("n_regionkey",), "region", ("r_regionkey",)),),
    "customer": (Reference(("c_nationkey",), "nation", ("n_nationkey",)),),
    "supplier": (Reference(("s_nationkey",), "nation", ("n_nationkey",)),),
    "orders": (Reference(("o_custkey",), "customer", ("c_custkey",)),),
    "lineitem": (Reference(("l_orderkey",), "orders", ("o_orderkey",)), Reference(("l_partkey",), "part", ("p_partkey",))),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, names: list[str] | None = None, references: bool = True) -> Catalog:
    found = Catalog(spark)
    for name in names or list(KEYS):
        found.add(Table(name, load(spark, sf_dir, name), KEYS[name], references=REFERENCES.get(name, ()) if references else ()))
    return found


#: The marts: their key expressions over orders o and customer c, and the names of the keys.
MARTS = {
    "daily": (["CAST(o_orderdate AS DATE)", "c_mktsegment", "c_nationkey"], ["day", "segment", "nation"]),
    "day_segment": (["CAST(o_orderdate AS DATE)", "c_mktsegment"], ["day", "segment"]),
    "month_segment": (["CAST(date_trunc('month', o_orderdate) AS DATE)", "c_mktsegment"], ["day", "segment"]),
}


def mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the marts: orders with their customers, grouped and counted. Prices are summed in whole cents, so that the
    mean doesn't depend on the order of the rows."""
    expressions, keys = MARTS[name]
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(*[F.expr(e).alias(k) for e, k in zip(expressions, keys, strict=True)]).agg(F.count("*").alias("orders"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("o_totalprice") / 100).alias("mean_price"))


def mart_insert(name: str) -> str:
    """The statement that builds a mart, for the lineage reader."""
    expressions, keys = MARTS[name]
    places = {"o_orderdate": "o.o_orderdate", "c_mktsegment": "c.c_mktsegment", "c_nationkey": "c.c_nationkey"}
    items = []
    for expression, key in zip(expressions, keys, strict=True):
        for column, full in places.items():
            expression = expression.replace(column, full)
        items.append(f"{expression} AS {key}")
    grouped = ", ".join(str(i + 1) for i in range(len(keys)))
    return f"INSERT INTO mart.{name} SELECT {', '.join(items)}, count(*) AS orders, avg(o.o_totalprice) AS mean_price FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY {grouped}"


def with_nulls(df: DataFrame) -> DataFrame:
    """Orders with nulls put in, as the tables have none of their own."""
    return df.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")))


def card_numbers(df: DataFrame) -> DataFrame:
    """Sixteen digits made of order keys, a tenth of which pass the card checksum by chance."""
    return df.select("o_orderkey", F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 15, "7")).alias("number"))


