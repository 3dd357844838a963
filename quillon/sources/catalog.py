"""The catalog: tables, their columns, keys and references, as DataFrames.

Parquet tables keep no constraints, so keys, references and what may be null are declared here and
checked against the data (``nullability``, ``orphans``) instead of believed.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENGINE_SCHEMAS = {"information_schema", "pg_catalog", "sys", "system"}


def quoted(*parts: str) -> str:
    """A name for SQL text, each part in backticks, backticks doubled. Empty parts and NUL are refused."""
    for part in parts:
        if not part or "\0" in part:
            raise ValueError(f"not a name: {part!r}")
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def sql_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.ArrayType):
        return sql_type(dtype.elementType) + "[]"
    names = {T.StringType: "VARCHAR", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.DateType: "DATE", T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP", T.BooleanType: "BOOLEAN"}
    return names.get(type(dtype), dtype.simpleString().upper())


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    table: str
    parent: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    """A table under its two-part name. Key columns can't be declared nullable."""

    name: str
    data: DataFrame
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    references: tuple[Reference, ...] = ()

    def __post_init__(self) -> None:
        missing = {*self.key, *self.not_null, *(c for r in self.references for c in r.columns)} - set(self.data.columns)
        if missing or len(set(self.data.columns)) != len(self.data.columns):
            raise ValueError(f"{self.name}: columns {sorted(missing)} are missing, or a name stands twice")

    def nullable(self, column: str) -> bool:
        return column not in self.key and column not in self.not_null


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)

    def add(self, *tables: Table) -> Catalog:
        for t in tables:
            if t.name.split(".")[0] not in ENGINE_SCHEMAS:
                self.tables[t.name] = t
        return self

    def columns(self) -> DataFrame:
        """(table, column, position, sql_type, nullable, is_key), one row for each column; from schemas alone, no data is read."""
        rows = [(t.name, f.name, i, sql_type(f.dataType), t.nullable(f.name), f.name in t.key) for t in self.tables.values() for i, f in enumerate(t.data.schema)]
        return self.spark.createDataFrame(rows, "table string, column string, position int, sql_type string, nullable boolean, is_key boolean")

    def references(self) -> DataFrame:
        """(table, column, parent_table, parent_column)."""
        rows = [(t.name, c, r.table, p) for t in self.tables.values() for r in t.references for c, p in zip(r.columns, r.parent, strict=True)]
        return self.spark.createDataFrame(rows, "table string, column string, parent_table string, parent_column string")

    def fingerprint(self) -> str:
        """Twelve hex digits over the tables in order of their names and the columns in their own order."""
        rows = [[t.name, [[f.name, sql_type(f.dataType), t.nullable(f.name), f.name in t.key, i] for i, f in enumerate(t.data.schema)]] for t in sorted(self.tables.values(), key=lambda t: t.name)]
        return hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()[:12]

    def nullability(self) -> DataFrame:
        """(table, column, nullable, nulls, verdict): contradicted where a null stands in a column declared without, else
        exercised or unexercised for nullable columns, kept for others. One scan and one row for each table."""
        parts = []
        for t in self.tables.values():
            counts = t.data.agg(*[F.coalesce(F.sum(F.col(quoted(c)).isNull().cast("long")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(t.data.columns)])
            each = F.array(*[F.struct(F.lit(t.name).alias("table"), F.lit(c).alias("column"), F.lit(t.nullable(c)).alias("nullable"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(t.data.columns)])
            parts.append(counts.select(F.inline(each)))
        verdict = F.when(~F.col("nullable") & (F.col("nulls") > 0), "contradicted").when(~F.col("nullable"), "kept").when(F.col("nulls") > 0, "exercised").otherwise("unexercised")
        return reduce(DataFrame.unionByName, parts).withColumn("verdict", verdict)

    def orphans(self) -> DataFrame:
        """(table, column, parent_table, rows, orphans): how far the declared references hold. Null references are not orphans."""
        parts = []
        for t in self.tables.values():
            for r in t.references:
                child = t.data.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(r.columns)]).dropna()
                parent = self.tables[r.table].data.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(r.parent)]).distinct().withColumn("there", F.lit(1))
                counted = child.join(parent, [f"k{i}" for i in range(len(r.columns))], "left").agg(F.count("*").alias("rows"), F.count_if(F.col("there").isNull()).alias("orphans"))
                parts.append(counted.select(F.lit(t.name).alias("table"), F.lit(",".join(r.columns)).alias("column"), F.lit(r.table).alias("parent_table"), "rows", "orphans"))
        return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Declared:
    """What a CREATE TABLE says: name, columns in order, key, columns without null, references."""

    name: str
    columns: tuple[str, ...]
    key: tuple[str, ...]
    not_null: tuple[str, ...]
    references: tuple[Reference, ...]

    def table(self, data: DataFrame) -> Table:
        return Table(self.name, data, self.key, tuple(c for c in self.not_null if c not in self.key), self.references)


def read_ddl(spark: SparkSession, text: str) -> Declared:
    """Keys and references from the constraints of a CREATE TABLE, as Spark's own parser reads them; never from names."""
    plain = re.sub(r"\bVARCHAR\b(?!\s*\()", "STRING", text)  # without a length it is no type of Spark's
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(plain)
    if plan.getClass().getSimpleName() != "CreateTable":
        raise ValueError("not a CREATE TABLE")
    each = lambda values: [values.apply(i) for i in range(values.size())]
    key, references = (), []
    for c in each(plan.tableSpec().constraints()):
        kind = c.getClass().getSimpleName()
        if kind == "PrimaryKeyConstraint":
            key = tuple(map(str, each(c.columns())))
        elif kind == "ForeignKeyConstraint":
            references.append(Reference(tuple(map(str, each(c.childColumns()))), ".".join(map(str, each(c.parentTableId()))), tuple(map(str, each(c.parentColumns())))))
    columns = each(plan.columns())
    name = ".".join(map(str, each(plan.name().nameParts())))
    return Declared(name, tuple(c.name() for c in columns), key, tuple(c.name() for c in columns if not c.nullable()), tuple(references))


def recovered(declared: Catalog, found: Catalog) -> bool:
    """Whether a catalog that was read again is the one that was declared."""
    return declared.fingerprint() == found.fingerprint()


def compared(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(table, column, difference) between two ``Catalog.columns()``, either way round, order included."""
    a, b = declared.alias("a"), found.alias("b")
    both = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.column") == F.col("b.column")), "full_outer")
    differs = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("sql_type", "nullable", "is_key", "position")]
    what = F.when(F.col("b.table").isNull(), F.lit("missing")).when(F.col("a.table").isNull(), F.lit("unexpected")).otherwise(F.concat_ws(",", *differs))
    return both.select(F.coalesce("a.table", "b.table").alias("table"), F.coalesce("a.column", "b.column").alias("column"), what.alias("difference")).where("difference <> ''")
