"""Column profiles: counts, lengths and pattern hits of every column, in one pass over a table."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import values
from quillon.sources.catalog import Catalog, Table, quoted, sql_type

HITS = [key for key, _, _ in values.PREDICATES]
FIELDS = ["table", "column", "sql_type", "nullable", "is_key", "rows", "non_null", "distinct", "mean_length", "pattern_hits"]
LONG_VALUE = 64
MEASURED = "table string, column string, rows long, non_null long, distinct long, mean_length double, pattern_hits map<string, bigint>"


def _kind(dtype: T.DataType) -> str:
    """The type in which a column's values are counted; what has none of its own is counted as text."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return dtype.simpleString() if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def _values(table: Table, fields: list[T.StructField], kind: str, first: int) -> DataFrame:
    """(at, v): each value of columns of one kind; ``at`` numbers the columns from ``first``."""
    value = lambda f: values.as_text_sql(quoted(f.name), f.dataType) if kind == "string" else f"cast({quoted(f.name)} as {kind})"
    return table.data.selectExpr(f"posexplode(array({', '.join(map(value, fields))})) AS (at, v)").select((F.col("at") + first).alias("at"), "v")


def _hits(v: Column) -> list[Column]:
    return [F.coalesce(p(v), F.lit(False)).alias(k) for k, p, _ in values.PREDICATES]


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """(at, n, there, length, and a boolean for each pattern) of each different text of each column, from (at, v).

    Equal values are counted in their own type before the shuffle, and only different ones are written out. Numbers
    and times may be different and have one text, so their texts are counted once more.
    """
    if kind == "string":
        bits = reduce(Column.bitwiseOR, [F.when(hit, 1 << i).otherwise(0) for i, hit in enumerate(_hits(F.col("v")))])
        long = F.length("v") > LONG_VALUE
        far = F.when(long, F.length("v").cast("long") * (1 << len(HITS)) + bits).otherwise(-1)
        counted = rows.select("at", F.when(long, F.md5("v")).otherwise(F.col("v")).alias("v"), far.alias("far")).groupBy("at", "v", "far").agg(F.count("*").alias("n"))
        of_far = F.expr(f"shiftright(far, {len(HITS)})").cast("int")
        hits = [F.when(F.col("far") < 0, hit).otherwise(F.col("far").bitwiseAND(1 << i) != 0).alias(k) for (i, k), hit in zip(enumerate(HITS), _hits(F.col("v")), strict=True)]
        return counted.select("at", "n", F.col("v").isNotNull().alias("there"), F.when(F.col("far") < 0, F.length("v")).otherwise(of_far).alias("length"), *hits)
    counted = rows.groupBy("at", "v").agg(F.count("*").alias("n")).select("at", values.as_text("v", T.DoubleType() if kind == "double" else T.StringType()).alias("v"), "n")
    if kind not in ("bigint", "date"):
        counted = counted.groupBy("at", "v").agg(F.sum("n").alias("n"))
    return counted.select("at", "n", F.col("v").isNotNull().alias("there"), F.length("v").alias("length"), *_hits(F.col("v")))


def _measured(tables: list[Table]) -> DataFrame:
    """The counts of all columns of all tables, in a few shuffles for any number of tables and columns.

    Columns of one type are unpivoted together, so that a table is read once for each type that it has, other columns
    left out. Values are counted by column before the shuffle, so that equal values meet there, distinct
    values are counted without an expand, and short values are tested once each. Texts of more than 64
    characters are shuffled as a 128-bit digest with their length and hits, so that they never travel.
    Counts are exact but for digests that meet. A table without rows has a profile too, one without columns gives no rows.
    """
    names, parts = [], {}
    for t in tables:
        fields: dict[str, list] = {}
        for f in t.data.schema:
            fields.setdefault(_kind(f.dataType), []).append(f)
        for kind, own in fields.items():
            parts.setdefault(kind, []).append((_values(t, own, kind, len(names)), range(len(names), len(names) + len(own))))
            names += [(t.name, f.name) for f in own]
    if not names:
        return tables[0].data.sparkSession.createDataFrame([], MEASURED)
    spark, found = tables[0].data.sparkSession, []
    filled = F.sum(F.when(F.col("there"), F.col("n")).otherwise(0))
    sums = [F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias(k) for k in HITS]
    for kind, own in parts.items():
        seeds = spark.range(1).select(F.explode(F.lit([at for _, ats in own for at in ats])).alias("at"), F.lit(0).alias("n"), F.lit(False).alias("there"), F.lit(None).cast("int").alias("length"), *[F.lit(False).alias(k) for k in HITS])
        counted = _counted(reduce(DataFrame.unionByName, [rows for rows, _ in own]), kind)
        found.append(counted.unionByName(seeds).groupBy("at").agg(
            F.sum("n").alias("rows"), filled.alias("non_null"), F.count_if("there").alias("distinct"),
            F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("length")), filled), F.lit(0.0)).alias("mean_length"), *sums,
        ))
    hit_map = F.create_map(*[x for k in HITS for x in (F.lit(k), F.col(k))])
    name = lambda i: F.lit([n[i] for n in names])[F.col("at")]
    return reduce(DataFrame.unionByName, found).select(name(0).alias("table"), name(1).alias("column"), "rows", "non_null", "distinct", "mean_length", hit_map.alias("pattern_hits"))


def measured(df: DataFrame) -> DataFrame:
    """(column, rows, non_null, distinct, mean_length, pattern_hits) of every column of one table."""
    return _measured([Table("t", df)]).drop("table")


def measured_wide(df: DataFrame) -> DataFrame:
    """The same by one aggregate with a column for each count: what the unpivoted form is held against."""
    columns = list(df.schema)
    aggregates = [F.count("*").alias("rows")]
    for i, f in enumerate(columns):
        v = values.as_text(quoted(f.name), f.dataType)
        aggregates += [F.count(v).alias(f"n{i}"), F.countDistinct(v).alias(f"d{i}"), F.coalesce(F.avg(F.length(v)), F.lit(0.0)).alias(f"l{i}")]
        aggregates += [F.count_if(p(v)).alias(f"{k}{i}") for k, p, _ in values.PREDICATES]
    hit_map = lambda i: F.create_map(*[x for k in HITS for x in (F.lit(k), F.col(f"{k}{i}"))])
    each = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col("rows"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct"), F.col(f"l{i}").alias("mean_length"), hit_map(i).alias("pattern_hits")) for i, f in enumerate(columns)])
    return df.agg(*aggregates).select(F.inline(each))


def profiled(table: Table) -> DataFrame:
    """The profile of a table with what the catalog says of its columns: ``FIELDS``. Counts only, no values."""
    return warehouse_profile(Catalog(table.data.sparkSession).add(table))


def warehouse_profile(catalog: Catalog) -> DataFrame:
    """The profiles of all tables, in one plan; see ``_measured``."""
    found = _measured(list(catalog.tables.values()))
    known = {f"{t.name}\x1f{f.name}": {"sql_type": sql_type(f.dataType), "nullable": t.nullable(f.name), "is_key": f.name in t.key} for t in catalog.tables.values() for f in t.data.schema}
    facts = F.from_json(F.lit(json.dumps(known)), "map<string, struct<sql_type: string, nullable: boolean, is_key: boolean>>")
    return found.withColumn("fact", facts[F.concat_ws("\x1f", "table", "column")]).select("*", "fact.*").select(*FIELDS)


class Store:
    """Profiles that have been measured, one for each table's state, as rows on the driver: a few for each column.

    A table is measured again when its files have changed (their number, their bytes or the time of their
    folder), when its catalog entry has, or when it isn't read from files as it is; all tables that are due
    are measured in one plan.
    """

    def __init__(self) -> None:
        self.rows: dict[tuple, list] = {}

    @staticmethod
    def state(table: Table) -> tuple | None:
        """What a table's profile depends on; None for a frame that isn't read from files as it is."""
        spark = table.data.sparkSession
        plan = table.data._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        roots, conf, found = plan.relation().location().rootPaths(), spark.sparkContext._jsc.hadoopConfiguration(), []
        for i in range(roots.size()):
            files = roots.apply(i).getFileSystem(conf)
            size = files.getContentSummary(roots.apply(i))
            found.append((roots.apply(i).toString(), size.getLength(), size.getFileCount(), files.getFileStatus(roots.apply(i)).getModificationTime()))
        return (table.name, spark.sparkContext.applicationId, tuple(found), table.data.schema.simpleString(), table.key, table.not_null)

    def profile(self, catalog: Catalog) -> DataFrame:
        states = {name: self.state(t) for name, t in catalog.tables.items()}
        due = Catalog(catalog.spark)
        due.tables = {name: t for name, t in catalog.tables.items() if states[name] is None or states[name] not in self.rows}
        out: list = []
        schema = None
        if due.tables:
            measured = warehouse_profile(due)
            schema, made = measured.schema, {}
            for row in measured.collect():
                made.setdefault(row["table"], []).append(row)
            for name, rows in made.items():
                if states[name] is None:
                    out += rows
                else:
                    self.rows[states[name]] = rows
        out += [row for state in states.values() if state is not None for row in self.rows.get(state, [])]
        return catalog.spark.createDataFrame(out, schema or PROFILE).coalesce(1)


PROFILE = "table string, column string, sql_type string, nullable boolean, is_key boolean, rows long, non_null long, distinct long, mean_length double, pattern_hits map<string, bigint>"


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, field) where two profiles differ; mean lengths may differ by 1e-9."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col("x.column") == F.col("y.column"), "full_outer")
    near = F.abs(F.col("x.mean_length") - F.col("y.mean_length")) <= 1e-9
    checks = [F.when(~F.coalesce(near, F.lit(False)), F.lit("mean_length"))]
    checks += [F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in ("rows", "non_null", "distinct")]
    checks += [F.when(~F.col("x.pattern_hits")[k].eqNullSafe(F.col("y.pattern_hits")[k]), F.lit(k)) for k in HITS]
    return both.select(F.coalesce("x.column", "y.column").alias("column"), F.explode(F.array_compact(F.array(*checks))).alias("field"))


def leaks(profile: DataFrame) -> list[str]:
    """Fields of a profile beyond the allowed counts; anything here could carry values."""
    return [c for c in profile.columns if c not in FIELDS]


def support(rows: str = "rows", non_null: str = "non_null") -> Column:
    return F.when(F.col(rows) == 0, 0.0).otherwise(F.col(non_null) / F.col(rows))


def distinct_ratio() -> Column:
    return F.when(F.col("non_null") == 0, 0.0).otherwise(F.col("distinct") / F.col("non_null"))


def null_rates(profile: DataFrame) -> DataFrame:
    return profile.select("table", "column", (F.lit(1.0) - support()).alias("null_rate"))


def flat(profile: DataFrame) -> DataFrame:
    """The profile with a column for each pattern in place of the map."""
    return profile.select(*[c for c in FIELDS if c != "pattern_hits"], *[F.col("pattern_hits")[k].alias(f"{k}_hits") for k in HITS])
