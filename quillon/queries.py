"""The queries of the privacy engine by name, and the SQL that says the same where there is one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.operators import access, classify, coverage, kanon, lineage, masking, measure, profile, report, review, sampling
from quillon.plans import access_log, oracle, rules
from quillon.sources import tables, warehouse
from quillon.sources.catalog import Table, compared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# -- profiles ---------------------------------------------------------------------------------------


def _rounded(p: DataFrame) -> DataFrame:
    return profile.flat(p).withColumn("mean_length", F.round("mean_length", 6))


for _name in tables.KEYS:
    query(f"profile_{_name}", oracle.profile(_name, tables.KEYS[_name]))(lambda spark, d, n=_name: _rounded(profile.profiled(tables.catalog(spark, d, [n], references=False).tables[n])))

NULLED = "(SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders)"


def _nulled(spark: SparkSession, d: str) -> Table:
    return Table("orders", tables.with_nulls(tables.load(spark, d, "orders")), ("o_orderkey",), ("o_orderstatus",))


@query("profile_with_nulls", oracle.profile("orders", ("o_orderkey", "o_orderstatus"), NULLED).replace("'o_orderstatus' AS \"column\", 'VARCHAR' AS sql_type, false AS nullable, true AS is_key", "'o_orderstatus' AS \"column\", 'VARCHAR' AS sql_type, false AS nullable, false AS is_key"))
def _(spark, d):
    return _rounded(profile.profiled(_nulled(spark, d)))


@query("profile_no_rows", oracle.profile("orders", ("o_orderkey",), "(SELECT * FROM orders WHERE o_orderkey < 0)"))
def _(spark, d):
    return _rounded(profile.profiled(Table("orders", tables.load(spark, d, "orders").where("o_orderkey < 0"), ("o_orderkey",))))


@query("profile_wide_disagreements", "SELECT '' AS \"column\", '' AS field WHERE false")
def _(spark, d):
    t = tables.load(spark, d, "orders")
    return profile.disagreements(profile.measured(t), profile.measured_wide(t))


@query("profile_disagreements", "SELECT 'o_orderstatus' AS \"column\", unnest(['non_null', 'distinct']) AS field UNION ALL SELECT 'o_orderpriority', 'non_null'")
def _(spark, d):
    t = tables.load(spark, d, "orders")
    return profile.disagreements(profile.measured(t), profile.measured(tables.with_nulls(t))).where("field <> 'mean_length'")


@query("null_rates", "SELECT 'orders' AS \"table\", \"column\", 1 - non_null / rows AS null_rate FROM (" + oracle.profile("orders", (), NULLED) + ")")
def _(spark, d):
    return profile.null_rates(profile.profiled(_nulled(spark, d)))


@query("nullability", " UNION ALL ".join(f"SELECT 'orders' AS \"table\", '{c}' AS \"column\", {oracle.literal(c not in ('o_orderkey', 'o_orderstatus'))} AS nullable, count(*) - count({c}) AS nulls, CASE WHEN {oracle.literal(c in ('o_orderkey', 'o_orderstatus'))} THEN CASE WHEN count(*) > count({c}) THEN 'contradicted' ELSE 'kept' END WHEN count(*) > count({c}) THEN 'exercised' ELSE 'unexercised' END AS verdict FROM {NULLED}" for c, _ in oracle.columns_of("orders")))
def _(spark, d):
    return tables.Catalog(spark).add(_nulled(spark, d)).nullability()


# -- catalog ----------------------------------------------------------------------------------------


@query("catalog_columns", oracle.values([(t, c, i, k, c not in tables.KEYS[t], c in tables.KEYS[t]) for t in oracle.COLUMNS for i, (c, k) in enumerate(oracle.columns_of(t))], '"table", "column", position, sql_type, nullable, is_key')[1:-1])
def _(spark, d):
    return tables.catalog(spark, d).columns()


@query("catalog_references", oracle.values([(t, c, r.table, p) for t, rs in tables.REFERENCES.items() for r in rs for c, p in zip(r.columns, r.parent, strict=True)], '"table", "column", parent_table, parent_column')[1:-1])
def _(spark, d):
    return tables.catalog(spark, d).references()


@query("reference_orphans", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{r.columns[0]}' AS \"column\", '{r.table}' AS parent_table, count({r.columns[0]}) AS rows, count(*) FILTER ({r.columns[0]} IS NOT NULL AND {r.columns[0]} NOT IN (SELECT {r.parent[0]} FROM {r.table})) AS orphans FROM {t}" for t, rs in tables.REFERENCES.items() for r in rs))
def _(spark, d):
    return tables.catalog(spark, d).orphans()


@query("schema_differences", oracle.values([("customer", "c_name", "missing"), ("customer", "c_nationkey", "sql_type,position"), ("customer", "c_acctbal", "nullable,position"), ("customer", "c_mktsegment", "position"), ("customer", "extra", "unexpected")], '"table", "column", difference')[1:-1])
def _(spark, d):
    t = tables.load(spark, d, "customer")
    other = t.drop("c_name").withColumn("c_nationkey", F.col("c_nationkey").cast("long")).withColumn("extra", F.lit(1))
    found = tables.Catalog(spark).add(Table("customer", other, ("c_custkey",), ("c_acctbal",)))
    return compared(tables.Catalog(spark).add(Table("customer", t, ("c_custkey",))).columns(), found.columns())


# -- scalar functions -------------------------------------------------------------------------------

F7 = ["ada.lovelace@example.org", "b.c@x.co.uk", "a@b.co", "a@b.co\n", "a b@c.org", "123-45-6789", "000-11-2222", "10.0.0.1", "192.168.1.254", "999.1.1.1", "+15551234567", "555 123 4567", "4111111111111111", "4111 1111 1111 1111", "M", "female", "2026-01-05", "", "a b@c.org", None]


@query("predicates", "SELECT v, " + ", ".join(f"{p} AS {k}" for k, p in oracle.PREDICATES.items()) + " FROM " + oracle.values([(v,) for v in F7], "v"))
def _(spark, d):
    rows = spark.createDataFrame([(v,) for v in F7], "v string")
    return rows.select("v", *[p(F.col("v")).alias(k) for k, p, _ in values.PREDICATES])


@query("shapes", "SELECT DISTINCT c_mktsegment AS v, regexp_replace(regexp_replace(regexp_replace(c_mktsegment, '[^\\p{L}\\p{Nd}\\-./:+()@,#_ ]', '?', 'g'), '\\p{L}', 'A', 'g'), '\\p{Nd}', '9', 'g') AS shape FROM customer UNION SELECT c_name, regexp_replace(regexp_replace(regexp_replace(c_name, '[^\\p{L}\\p{Nd}\\-./:+()@,#_ ]', '?', 'g'), '\\p{L}', 'A', 'g'), '\\p{Nd}', '9', 'g') FROM customer")
def _(spark, d):
    t = tables.load(spark, d, "customer")
    v = t.select(F.col("c_mktsegment").alias("v")).union(t.select("c_name")).distinct()
    return v.select("v", values.shape(F.col("v")).alias("shape"))


LUHN = "list_sum(list_transform(range(1, length(number) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(number)[i] AS INT) WHEN CAST(reverse(number)[i] AS INT) > 4 THEN CAST(reverse(number)[i] AS INT) * 2 - 9 ELSE CAST(reverse(number)[i] AS INT) * 2 END)) % 10 = 0"
CARDS = "(SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 15, '7') AS number FROM orders)"


@query("luhn", f"SELECT o_orderkey, {LUHN} AS valid FROM {CARDS}")
def _(spark, d):
    return tables.card_numbers(tables.load(spark, d, "orders")).select("o_orderkey", values.luhn(F.col("number")).alias("valid"))


@query("generalised", "SELECT o_orderkey, year(o_orderdate) AS y, substr(CAST(o_orderkey AS VARCHAR), 1, 3) AS p3, substr(lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), 1, 3) || '****' AS padded, date_diff('minute', o_orderdate, o_orderdate + INTERVAL 90 SECOND) AS minutes FROM orders")
def _(spark, d):
    t = tables.load(spark, d, "orders")
    padded = values.postal_padded(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), 3)
    minutes = values.minutes_between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 90 seconds"))
    return t.select("o_orderkey", values.year(F.col("o_orderdate")).alias("y"), values.postal_3(F.col("o_orderkey")).alias("p3"), padded.alias("padded"), minutes.alias("minutes"))


@query("name_words", "SELECT * FROM " + oracle.values([("firstName", "first name"), ("home_postal-Code2", "home postal code2"), ("SSN", "ssn"), ("__x", "x")], "name, words"))
def _(spark, d):
    rows = spark.createDataFrame([("firstName",), ("home_postal-Code2",), ("SSN",), ("__x",)], "name string")
    return rows.select("name", F.array_join(values.tokens(F.col("name")), " ").alias("words"))


# -- sampling ---------------------------------------------------------------------------------------

SAMPLED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS sql_type, {oracle.as_text(c, k)} AS v FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT {rules.SAMPLE_LIMIT})" for c, k in oracle.columns_of("customer"))
SHAPED = f"SELECT \"column\", regexp_replace(regexp_replace(regexp_replace(v, '[^\\p{{L}}\\p{{Nd}}\\-./:+()@,#_ ]', '?', 'g'), '\\p{{L}}', 'A', 'g'), '\\p{{Nd}}', '9', 'g') AS shape, count(*) AS n FROM ({SAMPLED}) WHERE v IS NOT NULL GROUP BY ALL"


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return sampling.window(tables.load(spark, d, "customer"), ["c_custkey"])


@query("sample_counts", f"SELECT \"column\", count(*) AS read, count(v) AS non_null, count(DISTINCT v) AS \"distinct\" FROM ({SAMPLED}) GROUP BY ALL")
def _(spark, d):
    return sampling.counts(_sampled(spark, d))


@query("sample_shapes", SHAPED)
def _(spark, d):
    return sampling.shapes(_sampled(spark, d))


@query("sample_dominant_shape", f"SELECT \"column\", shape, n FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, shape) AS r FROM ({SHAPED})) WHERE r = 1")
def _(spark, d):
    return sampling.dominant(sampling.shapes(_sampled(spark, d)))


@query("sample_checksums", f"SELECT 'number' AS \"column\", count(*) AS candidates, count(*) FILTER ({LUHN}) AS valid FROM (SELECT * FROM {CARDS} ORDER BY o_orderkey LIMIT 500)")
def _(spark, d):
    return sampling.checksums(sampling.window(tables.card_numbers(tables.load(spark, d, "orders")), ["o_orderkey"])).where("column = 'number'")


@query("sample_signals", "SELECT 'codes' AS \"table\", 'code' AS \"column\", 'sample' AS arm, 'unknown_identifier' AS category, CAST(0.55 AS DOUBLE) AS strength, CAST(1 AS DOUBLE) AS support")
def _(spark, d):
    t = tables.load(spark, d, "orders").select(F.format_string("AB%07d", "o_orderkey").alias("code"), "o_orderstatus", "o_orderdate")
    return sampling.signals("codes", sampling.window(t, ["code"])).drop("detail")


@query("unsafe_shapes", "SELECT '' AS \"column\", '' AS shape, CAST(0 AS BIGINT) AS n WHERE false")
def _(spark, d):
    return sampling.unsafe_shapes(_sampled(spark, d))


CONCENTRATIONS = [0.5, 0.7, 0.9, 0.95]


@query("concentration_sweep", "SELECT * FROM " + oracle.values([(c, c <= 0.75) for c in CONCENTRATIONS], "concentration, found"))
def _(spark, d):
    # three quarters of the codes have one shape
    t = spark.range(400).select(F.when(F.col("id") % 4 != 0, F.format_string("AB%06d", "id")).otherwise(F.format_string("%08d-X", "id")).alias("code"))
    s = sampling.samples(sampling.window(t, ["code"]))
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("concentration"), sampling.looks_like_a_code(concentration=c).alias("found")) for c in CONCENTRATIONS])))


@query("concentration_cliff", "SELECT max(c) AS cliff FROM (VALUES (CAST(0.5 AS DOUBLE)), (0.7)) t(c)")
def _(spark, d):
    return sampling.cliff(QUERIES["concentration_sweep"](spark, d), 0.9)


# -- group sizes ------------------------------------------------------------------------------------

ORDERED = "(SELECT *, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS dy FROM orders)"


def _residual(name: str, sql: str, table: str, keys: Callable[[], list]) -> None:
    query(name, sql)(lambda spark, d: kanon.residual(tables.load(spark, d, table), keys()))


_residual("residual_customer", oracle.residual("customer", ["c_nationkey", "c_mktsegment"]), "customer", lambda: [F.col("c_nationkey"), F.col("c_mktsegment")])
_residual("residual_orders_day", oracle.residual(ORDERED, ["dy", "o_orderpriority"]), "orders", lambda: [F.to_date("o_orderdate"), F.col("o_orderpriority")])
_residual("residual_orders_year", oracle.residual(ORDERED, ["y", "o_orderpriority"]), "orders", lambda: [values.year(F.col("o_orderdate")), F.col("o_orderpriority")])
_residual("residual_events", oracle.residual("events", ["user_id", "event_type", "CAST(ts AS DATE)"]), "events", lambda: [F.col("user_id"), F.col("event_type"), F.to_date("ts")])


def _mart_sql(name: str) -> str:
    expressions, keys = tables.MARTS[name]
    return f"(SELECT {', '.join(f'{e} AS {k}' for e, k in zip(expressions, keys, strict=True))}, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT / count(o_totalprice) / 100 AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY {', '.join(expressions)})"


for _name in tables.MARTS:
    _keys = tables.MARTS[_name][1]
    query(f"mart_{_name}", f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM {_mart_sql(_name)}")(lambda spark, d, n=_name: tables.mart(spark, d, n).withColumn("day", F.col("day").cast("string")))
    query(f"grain_{_name}", f"SELECT *, singleton_rows / rows AS singleton_share, singleton_rows / rows AS factor FROM (SELECT count(*) AS rows, coalesce(sum(orders), 0)::BIGINT AS population, coalesce(min(orders), 1) AS k, count(*) FILTER (orders = 1) AS singleton_rows FROM {_mart_sql(_name)})")(lambda spark, d, n=_name: kanon.grain(tables.mart(spark, d, n), "orders"))
    query(f"residual_weighted_{_name}", oracle.residual(_mart_sql(_name), ["day", "segment"], "orders"))(lambda spark, d, n=_name: kanon.residual(tables.mart(spark, d, n), [F.col("day"), F.col("segment")], "orders"))


@query("grain_ungrouped", "SELECT count(*) AS rows, count(*) AS population, CAST(1 AS BIGINT) AS k, count(*) AS singleton_rows, CAST(1 AS DOUBLE) AS singleton_share, CAST(1 AS DOUBLE) AS factor FROM customer")
def _(spark, d):
    return kanon.grain(tables.load(spark, d, "customer"))


@query("mart_singletons", f"SELECT count(*) AS rows, count(*) FILTER (orders = 1) AS singles, min(orders) AS least, max(orders) AS most FROM {_mart_sql('daily')}")
def _(spark, d):
    return tables.mart(spark, d, "daily").agg(F.count("*").alias("rows"), F.count_if(F.col("orders") == 1).alias("singles"), F.min("orders").alias("least"), F.max("orders").alias("most"))


SWEPT = ["c_mktsegment", "c_nationkey", "c_acctbal"]


def _shares(df: DataFrame) -> DataFrame:
    """Shares to twelve decimals: the engines' powers differ in the last bit."""
    return df.withColumns({c: F.round(c, 12) + F.lit(0.0) for c in ("measured", "uniform", "shape_effect")})


@query("uniqueness_sweep", " UNION ALL ".join(oracle.uniqueness("customer", SWEPT[: i + 1]) for i in range(3)))
def _(spark, d):
    return _shares(kanon.sweep(tables.load(spark, d, "customer"), SWEPT))


@query("uniqueness_with_nulls", oracle.uniqueness(NULLED, ["o_orderstatus", "o_orderpriority"]).replace("2 AS columns, ", "").replace("SELECT *, measured", "SELECT *, measured"))
def _(spark, d):
    return _shares(kanon.uniqueness(tables.with_nulls(tables.load(spark, d, "orders")), ["o_orderstatus", "o_orderpriority"]))


@query("cardinalities", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"values\" FROM (SELECT DISTINCT {c} FROM {NULLED})" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")))
def _(spark, d):
    return kanon.cardinalities(tables.with_nulls(tables.load(spark, d, "orders")), ["o_orderstatus", "o_orderpriority", "o_custkey"])


ALONE = "(SELECT sum(s) AS n, count(*) FILTER (s = 1) / sum(s) AS m FROM (SELECT count(*) AS s FROM {} GROUP BY o_custkey, o_orderstatus, o_orderpriority))"


@query("null_effect", f"SELECT CAST(a.n AS BIGINT) AS rows, CAST(c.n AS BIGINT) AS complete, a.m AS measured_all, c.m AS measured_complete, c.m - a.m AS flattery FROM {ALONE.format(NULLED)} a, {ALONE.format('(SELECT * FROM ' + NULLED + ' WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL)')} c")
def _(spark, d):
    return kanon.null_effect(tables.with_nulls(tables.load(spark, d, "orders")), ["o_custkey", "o_orderstatus", "o_orderpriority"])


SIGNS = {"o_custkey": ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderdate": ["o_orderstatus", "o_orderpriority"]}


@query("null_effect_sign", "SELECT bool_or(f > 0) AND bool_or(f < 0) AS changes FROM (" + " UNION ALL ".join(f"SELECT c.m - a.m AS f FROM (SELECT count(*) FILTER (s = 1) / sum(s) AS m FROM (SELECT count(*) AS s FROM {NULLED} GROUP BY {', '.join(cs)})) a, (SELECT count(*) FILTER (s = 1) / sum(s) AS m FROM (SELECT count(*) AS s FROM {NULLED} WHERE {' AND '.join(c + ' IS NOT NULL' for c in cs)} GROUP BY {', '.join(cs)})) c" for cs in SIGNS.values()) + ")")
def _(spark, d):
    rows = tables.with_nulls(tables.load(spark, d, "orders"))
    return kanon.changes_sign(reduce(DataFrame.unionByName, [kanon.null_effect(rows, cs) for cs in SIGNS.values()]))


@query("postal_floor", f"SELECT *, areas > 0 AND areas = meeting AS applies FROM (SELECT count(*) AS areas, min(n) AS smallest, max(n) AS largest, count(*) FILTER (n > {rules.POSTAL_FLOOR}) AS meeting FROM (SELECT count(*) AS n FROM orders GROUP BY substr(lpad(CAST(o_custkey AS VARCHAR), 7, '0'), 1, 3)))")
def _(spark, d):
    return kanon.postal_floor(tables.load(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("area")), "area")


# -- classification ---------------------------------------------------------------------------------

WAREHOUSE = oracle.warehouse(tables.KEYS)
EVIDENCE = "WITH " + oracle.evidence(WAREHOUSE)
SETTLED = f"{EVIDENCE}, {oracle.settled()}"
POLICIES = f"{SETTLED}, {oracle.policies()}"


STORE = profile.Store()


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """Measured once for each state of the tables; what follows starts from its rows."""
    return STORE.profile(tables.catalog(spark, d, references=False))


def _kept(df: DataFrame) -> DataFrame:
    """A frame with a few rows for each column of the catalog, read once by the driver: what follows starts from its rows
    and not from the tables again. It grows with the schema, not with the data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


def _verdicts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, evidence, verdicts), each a row or a few for each column."""
    found = _profile(spark, d)
    evidence = _kept(classify.signals(found))
    return found, evidence, _kept(classify.warehouse(found, evidence))


@query("evidence", f"{EVIDENCE} SELECT \"table\", \"column\", arm, category, round(strength, 9) AS strength, round(support, 9) AS support FROM evidence")
def _(spark, d):
    return classify.signals(_profile(spark, d)).drop("detail").withColumn("strength", F.round("strength", 9)).withColumn("support", F.round("support", 9))


@query("evidence_of_names", f"{EVIDENCE} SELECT \"table\", \"column\", category, strength FROM evidence WHERE arm = 'name'")
def _(spark, d):
    return classify.name_signals(tables.catalog(spark, d).columns()).select("table", "column", "category", "strength")


@query("verdicts_alone", f"{EVIDENCE}, {oracle.verdicts('evidence', 'alone')} SELECT * FROM alone")
def _(spark, d):
    found = _profile(spark, d)
    return classify.decided(found, classify.signals(found))


@query("verdicts", f"{SETTLED} SELECT * FROM settled")
def _(spark, d):
    return _verdicts(spark, d)[2]


@query("person_linked", f"{SETTLED} SELECT * FROM linked")
def _(spark, d):
    found = _profile(spark, d)
    return classify.person_linked(classify.decided(found, classify.signals(found)))


@query("band_counts", f"{SETTLED} SELECT band, count(\"table\") AS columns FROM (VALUES ('accept'), ('review'), ('ignore')) b(band) LEFT JOIN settled USING (band) GROUP BY ALL")
def _(spark, d):
    return classify.band_counts(_verdicts(spark, d)[2])


def _ablation_sql() -> str:
    sets = []
    for i, (label, arms) in enumerate(classify.ARM_SETS):
        sets.append(f"chosen{i} AS (SELECT * FROM evidence WHERE arm IN ({', '.join(map(oracle.literal, arms))})), {oracle.verdicts(f'chosen{i}', f'alone{i}')}, linked{i} AS (SELECT \"table\", coalesce(bool_or(identifiability = 'direct' AND confidence >= {rules.REVIEW_AT}), false) AS linked FROM alone{i} GROUP BY ALL), kept{i} AS (SELECT e.* FROM chosen{i} e JOIN linked{i} USING (\"table\") WHERE linked OR category <> 'event_date'), {oracle.verdicts(f'kept{i}', f'set{i}')}")
    moved = " UNION ALL ".join(f"SELECT {oracle.literal(label)} AS arms, s.\"table\", s.\"column\", a.band AS band_before, s.band AS band_after FROM set{i} s JOIN set0 a USING (\"table\", \"column\") WHERE s.band <> a.band" for i, (label, _) in enumerate(classify.ARM_SETS))
    return f"{EVIDENCE}, {', '.join(sets)} {moved}"


@query("ablation", _ablation_sql())
def _(spark, d):
    found = _profile(spark, d)
    return classify.ablation(found, classify.signals(found))


THRESHOLDS = [0.35, 0.5, 0.65, 0.75, 0.9]


def _moves_sql() -> str:
    """Like ``ablation``, with both verdicts."""
    moved = " UNION ALL ".join(f"SELECT {oracle.literal(label)} AS arms, s.\"table\", s.\"column\", a.band AS b0, a.confidence AS c0, a.category AS k0, s.band AS b1, s.confidence AS c1, s.category AS k1 FROM set{i} s JOIN set0 a USING (\"table\", \"column\") WHERE s.band <> a.band" for i, (label, _) in enumerate(classify.ARM_SETS))
    return f"{_ablation_sql().partition(' SELECT ' + oracle.literal(classify.ARM_SETS[0][0]) + ' AS arms')[0]}, moved AS ({moved})"


@query("ablation_texts", f"{_moves_sql()} SELECT arms, printf('%s.%s: %s %s at %.4f, then %s %s at %.4f', \"table\", \"column\", b0, k0, c0, b1, k1, c1) AS text FROM moved")
def _(spark, d):
    found = _profile(spark, d)
    return classify.move_texts(classify.moves(found, classify.signals(found)))


@query("ablation_decides_nothing", f"{_moves_sql()} SELECT arm FROM (VALUES ('name'), ('value'), ('structure')) a(arm) WHERE 'without ' || arm NOT IN (SELECT arms FROM moved)")
def _(spark, d):
    found = _profile(spark, d)
    return classify.decides_nothing(classify.moves(found, classify.signals(found)))


@query("threshold_sweep", f"{SETTLED} SELECT threshold, count(*) FILTER (category <> 'not_personal' AND confidence >= threshold) AS masked FROM settled, (SELECT unnest({oracle.literal(THRESHOLDS)}) AS threshold) GROUP BY ALL")
def _(spark, d):
    return classify.threshold_sweep(_verdicts(spark, d)[2], THRESHOLDS)


@query("bar_sweep", f"{SETTLED} SELECT bar, count(*) FILTER (linked) AS linked FROM (SELECT bar, \"table\", bool_or(identifiability = 'direct' AND confidence >= bar) AS linked FROM settled, (SELECT unnest({oracle.literal(THRESHOLDS)}) AS bar) GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    return classify.bar_sweep(_verdicts(spark, d)[2], THRESHOLDS)


def _texts_sql() -> str:
    """The evidence once more, with its details, as lines."""
    needles = "list_filter(needles, lambda n: list_contains(words, n) OR n = array_to_string(words, ''))[1]"
    by_value = " UNION ALL ".join(f"SELECT \"table\", \"column\", 'value' AS arm, '{k}' AS category, CAST({s} AS DOUBLE) * ({k}_hits / non_null) * (non_null / rows) AS w, printf('%d of %d values match', {k}_hits, non_null) AS detail FROM profile WHERE non_null > 0 AND {k}_hits / non_null >= {rules.VALUE_FLOOR}" for k, s in oracle.STRENGTHS.items())
    return f"""{SETTLED}, told AS (
SELECT "table", "column", 'name' AS arm, category, CAST(strength AS DOUBLE) AS w, 'word ' || {needles} AS detail FROM words, name_rules WHERE {needles} IS NOT NULL
UNION ALL SELECT "table", "column", 'name', 'event_date', CAST({rules.TEMPORAL_NAME_STRENGTH} AS DOUBLE), 'ends in ' || words[len(words)] FROM words WHERE words[len(words)] IN ({', '.join(map(oracle.literal, rules.TEMPORAL_SUFFIXES))})
UNION ALL {by_value}
UNION ALL SELECT "table", "column", 'value', 'free_text_clinical', CAST({rules.FREE_TEXT_STRENGTH} AS DOUBLE) * (non_null / rows), printf('mean length %.0f', mean_length) FROM profile WHERE non_null > 0 AND mean_length >= {rules.FREE_TEXT_LENGTH} AND "distinct" / non_null >= {rules.FREE_TEXT_DISTINCT}
UNION ALL SELECT "table", "column", 'structure', 'event_date', CAST({rules.TEMPORAL_TYPE_STRENGTH} AS DOUBLE), 'type ' || sql_type FROM profile WHERE NOT is_key AND sql_type IN ({', '.join(map(oracle.literal, rules.TEMPORAL_TYPES))})),
lines AS (SELECT "table", "column", round(w, 4) AS w, printf('    %-9s %-22s %.4f  %s', arm, category, round(w, 4), detail) AS line FROM told),
joined AS (SELECT "table", "column", string_agg(line, chr(10) ORDER BY -w, line) AS lines FROM lines GROUP BY ALL)
SELECT "table", "column", concat_ws(chr(10), printf('%s.%s -> %s at %.4f (%s)', "table", "column", category, confidence, band), coalesce(lines, ''), CASE WHEN runner_up IS NOT NULL THEN printf('    runner up %s at %.4f', runner_up, runner_up_score) END) AS text FROM settled LEFT JOIN joined USING ("table", "column")"""


@query("verdict_flags", f"{SETTLED} SELECT \"table\", \"column\", confidence >= {rules.REVIEW_AT} AND category <> 'not_personal' AS flagged, confidence >= {rules.ACCEPT_AT} AND category <> 'not_personal' AS auto_masked FROM settled")
def _(spark, d):
    return classify.flags(_verdicts(spark, d)[2])


@query("verdict_texts", _texts_sql())
def _(spark, d):
    _, evidence, verdicts = _verdicts(spark, d)
    return classify.explained(verdicts, evidence)


_BY_NAME, _BY_VALUE = {k for _, k, _ in rules.NAME_RULES} | {"event_date"}, set(oracle.STRENGTHS) | {"free_text_clinical"}
_BY_SAMPLE = {"unknown_identifier", "payment_card"}


@query("rule_coverage", oracle.values([(k, k in _BY_NAME, k in _BY_VALUE, k in _BY_SAMPLE, k in _BY_NAME | _BY_VALUE | _BY_SAMPLE) for k in rules.IDENTIFIABILITY], "category, by_name, by_value, by_sample, reachable")[1:-1])
def _(spark, d):
    return classify.rule_coverage(spark)


# round two: marts take the evidence of their tables' dates, by how many people a row stands for

MART_COLUMNS = [("mart.daily", "day", "DATE"), ("mart.daily", "segment", "VARCHAR"), ("mart.daily", "nation", "INTEGER"), ("mart.daily", "orders", "BIGINT"), ("mart.daily", "mean_price", "DOUBLE"), ("people", "email", "VARCHAR"), ("people", "joined_at", "TIMESTAMP")]
UPSTREAM = [("mart.daily", "people")]


def _rescue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    columns = spark.createDataFrame([(t, c, k, False) for t, c, k in MART_COLUMNS], "table string, column string, sql_type string, is_key boolean")
    evidence = classify.name_signals(columns).unionByName(classify.structure_signals(columns))
    factor = kanon.grain(tables.mart(spark, d, "daily"), "orders").select(F.lit("mart.daily").alias("table"), "factor")
    return columns, evidence, factor


@query("verdicts_round_two", f"""WITH grain AS (SELECT count(*) FILTER (orders = 1) / count(*) AS factor FROM {_mart_sql('daily')}),
cols AS (SELECT * FROM {oracle.values(MART_COLUMNS, '"table", "column", sql_type')}),
evidence AS (SELECT * FROM {oracle.values([('mart.daily', 'day', 'event_date', 0.45), ('people', 'email', 'email', 0.9), ('people', 'joined_at', 'event_date', 0.5), ('people', 'joined_at', 'event_date', 0.45)], '"table", "column", category, weight')}),
final AS (SELECT "table", "column", category, CASE WHEN "table" = 'mart.daily' THEN weight * factor ELSE weight END AS strength, CAST(1 AS DOUBLE) AS support FROM evidence, grain),
{oracle.verdicts('final', 'v', 'cols')} SELECT * FROM v""")
def _(spark, d):
    columns, evidence, factor = _rescue(spark, d)
    return classify.warehouse(columns, evidence, spark.createDataFrame(UPSTREAM, "table string, source string"), factor)


@query("rescued_tables", "SELECT 'mart.daily' AS \"table\"")
def _(spark, d):
    columns, evidence, _ = _rescue(spark, d)
    return classify.rescued(classify.warehouse(columns, evidence), spark.createDataFrame(UPSTREAM, "table string, source string"))


@query("derived_linked", "SELECT 'mart.daily' AS \"table\", 'people' AS source")
def _(spark, d):
    columns, evidence, _ = _rescue(spark, d)
    return classify.derived_linked(classify.warehouse(columns, evidence), spark.createDataFrame(UPSTREAM, "table string, source string"))


@query("floors", "SELECT CAST(0.35 AS DOUBLE) / 0.55 AS concentration, CAST(0.35 AS DOUBLE) / 0.45 AS grain")
def _(spark, d):
    return spark.createDataFrame([(rules.weakest(rules.CODE_STRENGTH), kanon.rescue_floor())], "concentration double, grain double")


@query("rescue_bands", " UNION ALL ".join(f"SELECT '{n}' AS mart, round(factor, 6) AS factor, {oracle.band(repr('event_date'), f'round({rules.TEMPORAL_TYPE_STRENGTH} * factor, 4)')} AS band FROM (SELECT count(*) FILTER (orders = 1) / count(*) AS factor FROM {_mart_sql(n)})" for n in tables.MARTS))
def _(spark, d):
    out = None
    for n in tables.MARTS:
        row = kanon.grain(tables.mart(spark, d, n), "orders").select(F.lit(n).alias("mart"), F.round("factor", 6).alias("factor"), classify.band(F.lit("event_date"), F.round(rules.TEMPORAL_TYPE_STRENGTH * F.col("factor"), 4)).alias("band"))
        out = row if out is None else out.unionByName(row)
    return out


@query("sampling_grades", oracle.values([("bench.outside", "row_id", "not_personal", "unchanged", "ignore"), ("bench.outside", "travel_doc_ref", "unknown_identifier", "recovered", "review"), ("bench.outside", "payer_ref", "payment_card", "recovered", "accept"), ("bench.outside", "site_patient_ref", "unknown_identifier", "still missed", "ignore"), ("bench.outside", "request_ref", "not_personal", "false alarm", "review")], '"table", "column", label, grade, band')[1:-1])
def _(spark, d):
    table = warehouse.outside(spark)
    found = _kept(profile.profiled(table))
    sampled = sampling.signals(table.name, sampling.window(table.data, ["row_id"]))
    before = classify.decided(found, classify.signals(found))
    after = classify.decided(found, classify.signals(found, (*classify.ARMS, "sample"), sampled))
    labels = spark.createDataFrame([(table.name, c, k) for c, k in warehouse.OUTSIDE.items()], "table string, column string, label string")
    return coverage.sampling_grade(before, after, labels)


# the planted warehouse: its verdicts with both rounds, its recall and its access to the mart


def _planted(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    found = warehouse.planted(spark)
    g = lineage.Graph.of(spark, [lineage.read(spark, warehouse.MART)], found.references())
    rows = _kept(profile.warehouse_profile(found))
    data = {n: t.data for n, t in found.tables.items()}
    grain = lambda names: kanon.confidences(data, {n: w for n in names if (w := lineage.weight_column(g, n))}, names)  # noqa: E731  only what is rescued is measured
    return rows, classify.warehouse(rows, _kept(classify.signals(rows)), lineage.upstream_tables(g), grain)


@query("planted_verdicts")
def _(spark, d):
    return _planted(spark)[1]


# what is published for this warehouse: 20 columns in scope, all found, 12 without a person, 2 false alarms
@query("planted_recall", "SELECT * FROM (VALUES ('direct', 11, 11), ('quasi', 9, 9)) t(identifiability, in_scope, found)")
def _(spark, d):
    return coverage.recall(coverage.graded(_planted(spark)[1], warehouse.labels(spark)))


@query("planted_headline", "SELECT 20 AS in_scope, 20 AS found, 12 AS auto_masked, 2 AS false_alarms")
def _(spark, d):
    verdicts = _planted(spark)[1]
    return coverage.headline(coverage.graded(verdicts, warehouse.labels(spark)), verdicts)


@query("planted_labels", "SELECT * FROM (VALUES ('direct', 11), ('quasi', 10), ('sensitive', 2), ('none', 19)) t(identifiability, columns)")
def _(spark, d):
    return coverage.planted_summary(warehouse.labels(spark))


@query("planted_identifying_quasi", """SELECT l.tbl AS "table", col AS "column", label, observed FROM (VALUES
  ('raw.patient', 'city', 'postal_code', 'postal_3'), ('raw.patient', 'postal_code', 'postal_code', 'postal_5'), ('raw.patient', 'birth_date', 'birth_date', 'day'), ('raw.patient', 'sex', 'sex', NULL),
  ('raw.encounter', 'admitted_at', 'event_date', 'second'), ('raw.encounter', 'discharged_at', 'event_date', 'second'), ('raw.claim', 'submitted_on', 'event_date', 'day'),
  ('raw.device_reading', 'taken_at', 'event_date', 'second'), ('analytics.encounter_daily', 'day', 'event_date', 'day'), ('analytics.encounter_daily', 'postal_code', 'postal_code', 'postal_5')) l(tbl, col, label, observed)
WHERE coalesce(observed, '') <> 'postal_3'""")
def _(spark, d):
    return coverage.identifying_quasi(warehouse.labels(spark))


@query("planted_as_event_date", "SELECT * FROM (VALUES ('raw.encounter', 'admitted_at'), ('raw.encounter', 'discharged_at'), ('raw.claim', 'submitted_on'), ('raw.device_reading', 'taken_at'), ('analytics.encounter_daily', 'day')) t(\"table\", \"column\")")
def _(spark, d):
    return coverage.planted_as(warehouse.labels(spark), "event_date")


@query("planted_totality", "SELECT '' AS \"table\", '' AS \"column\", '' AS problem WHERE false")
def _(spark, d):
    return coverage.unlabelled(warehouse.planted(spark).columns(), warehouse.labels(spark))


@query("regime_categories", "SELECT * FROM (VALUES ('biometric'), ('face_photo'), ('health_condition'), ('free_text_clinical')) t(category)")
def _(spark, d):
    return coverage.under_regime(spark, "gdpr_special")


# round two over a synthetic warehouse: what it costs, and that keeping evidence changes nothing


def _round_two(spark: SparkSession, total: int, marts: int):
    found, edges = warehouse.round_two(spark, total, marts)
    graph = lineage.Graph(spark, spark.createDataFrame(edges, lineage.EDGES), spark.createDataFrame([], lineage.REFUSALS))
    return found, graph, lineage.upstream_tables(graph)


@query("round_two_arms", "SELECT 25 AS tables, 51 AS columns, 24 AS rescued_tables, 48 AS rescued_columns, 51 AS memoised, 99 AS repeated, CAST(48 AS DOUBLE) / 99 AS wasted_share")
def _(spark, d):
    found, _, upstream = _round_two(spark, 25, 24)
    columns = found.columns()
    evidence = classify.name_signals(columns).unionByName(classify.structure_signals(columns))
    return measure.arm_cost(columns.select("table", "column"), evidence, upstream).select(F.lit(25).alias("tables"), "*")


@query("round_two_grain", "SELECT * FROM (VALUES (5, 3, 8, 6, 2), (25, 3, 28, 6, 22), (400, 3, 403, 6, 397)) t(eager_tables, lazy_tables, eager, lazy, saved)")
def _(spark, d):
    out = []
    for total in (5, 25, 400):
        names = ["bench.person", *[f"bench.mart_{i}" for i in range(3)], *[f"bench.ref_{i}" for i in range(total - 4)]]
        weights = {f"bench.mart_{i}": "encounters" for i in range(3)}
        out.append(measure.grain_cost(names, weights, weights))
    return spark.createDataFrame([tuple(r.values()) for r in out], "eager_tables int, lazy_tables int, eager int, lazy int, saved int")


@query("round_two_disagreements", "SELECT '' AS \"table\", '' AS \"column\" WHERE false")
def _(spark, d):
    found, graph, upstream = _round_two(spark, 6, 3)
    rows, weights = _kept(profile.warehouse_profile(found)), {f"bench.mart_{i}": "encounters" for i in range(3)}
    grain = lambda names: kanon.confidences({n: t.data for n, t in found.tables.items()}, weights, names)
    kept = classify.warehouse(rows, _kept(classify.signals(rows)), upstream, grain)
    return kept.exceptAll(classify.reprofiled(rows, upstream, grain)).select("table", "column")


# -- floor, clauses, labels -------------------------------------------------------------------------

RE2_FLOOR = {k: p.replace(r"\s", "[:space:]") for k, p in rules.FLOOR_VALUES}


def _floor_sql(table: str, key: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {oracle.as_text(c, k)} AS v FROM (SELECT * FROM {table} ORDER BY {key} LIMIT 50)" for c, k in oracle.columns_of(table))
    hits = ", ".join(f"count(*) FILTER (v <> '' AND regexp_matches(v, '{p}')) AS {k}" for k, p in RE2_FLOOR.items())
    by_value = "CASE " + " ".join(f"WHEN n > 0 AND {k} * 3 >= n * 2 THEN '{k}'" for k in RE2_FLOOR) + " END"
    by_name = "CASE " + " ".join(f"WHEN contains(lower(\"column\"), '{p}') THEN '{k}'" for p, k in rules.FLOOR_NAMES) + " END"
    return f"SELECT *, coalesce(by_name, by_value, 'not_personal') AS category FROM (SELECT \"column\", {by_name} AS by_name, {by_value} AS by_value FROM (SELECT \"column\", count(*) FILTER (v <> '') AS n, {hits} FROM ({each}) GROUP BY ALL))"


for _name, _key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("events", "event_id")):
    query(f"floor_{_name}", _floor_sql(_name, _key))(lambda spark, d, n=_name, k=_key: coverage.floor(tables.load(spark, d, n), [k]))

LABELS = [("customer", "c_name", "person_name"), ("customer", "c_acctbal", "not_personal"), ("customer", "c_custkey", "account_number"), ("documents", "text", "free_text_clinical"), ("orders", "o_orderdate", "event_date"), ("events", "ts", "event_date")]


@query("grades", f"{SETTLED}, labels_(t, c, label) AS (SELECT * FROM {oracle.values(LABELS, 't, c, label')}), met AS (SELECT t AS \"table\", c AS \"column\", label, coalesce(category, 'not_personal') AS category, label IN ({', '.join(sorted({repr(k) for _, ks in rules.SAFE_HARBOR for k in ks}))}) AS in_scope FROM labels_ LEFT JOIN settled ON t = \"table\" AND c = \"column\") SELECT *, in_scope AND category = 'not_personal' AS missed, category <> 'not_personal' AND label = 'not_personal' AS false_alarm, category <> 'not_personal' AND label <> 'not_personal' AND category <> label AS wrong_category FROM met")
def _(spark, d):
    return coverage.graded(_verdicts(spark, d)[2], spark.createDataFrame(LABELS, "table string, column string, label string"))


@query("recall", f"{SETTLED}, labels_(t, c, label) AS (SELECT * FROM {oracle.values(LABELS, 't, c, label')}), met AS (SELECT label, coalesce(category, 'not_personal') AS category FROM labels_ LEFT JOIN settled ON t = \"table\" AND c = \"column\" WHERE label IN ({', '.join(sorted({repr(k) for _, ks in rules.SAFE_HARBOR for k in ks}))})) SELECT {oracle.level('label')} AS identifiability, count(*) AS in_scope, count(*) FILTER (category <> 'not_personal') AS found FROM met GROUP BY ALL")
def _(spark, d):
    return coverage.recall(coverage.graded(_verdicts(spark, d)[2], spark.createDataFrame(LABELS, "table string, column string, label string")))


@query("clause_gaps", oracle.values([("clause", "E"), ("clause", "R")], "side, name")[1:-1])
def _(spark, d):
    return coverage.gaps(spark)


@query("taxonomy", oracle.values([(k, lv, ",".join(r), i) for k, lv, r, i in rules.TAXONOMY], "category, identifiability, regimes, identifies_at")[1:-1])
def _(spark, d):
    return coverage.taxonomy(spark).withColumn("regimes", F.array_join("regimes", ","))


@query("threshold_disagreements", oracle.values([("temporal", "month", "year")], "family, allowed, permitted")[1:-1])
def _(spark, d):
    return spark.createDataFrame(rules.threshold_disagreements(), "family string, allowed string, permitted string")


# -- policies ---------------------------------------------------------------------------------------


@query("policies", f"{POLICIES} SELECT * FROM policies")
def _(spark, d):
    return masking.policies(_verdicts(spark, d)[2])


@query("action_counts", f"{POLICIES} SELECT action, count(\"table\") AS columns FROM (VALUES ('redact'), ('generalise'), ('retain'), ('review')) a(action) LEFT JOIN policies USING (action) GROUP BY ALL")
def _(spark, d):
    return masking.action_counts(masking.policies(_verdicts(spark, d)[2]))


@query("retained_on_absence", f"{POLICIES} SELECT \"table\", \"column\" FROM policies WHERE evidence_only")
def _(spark, d):
    return masking.retained_on_absence(masking.policies(_verdicts(spark, d)[2]))


MASKED = [("customer", "c_name", "person_name", 0.9, "redact", None, False), ("customer", "c_mktsegment", "sex", 0.9, "retain", None, False), ("customer", "c_custkey", "postal_code", 0.8, "generalise", "postal_3", False), ("customer", "c_nationkey", "occupation", 0.9, "retain", None, False)]
POLICY = "table string, column string, category string, confidence double, action string, target string, evidence_only boolean"


@query("masked_customer", "SELECT substr(CAST(c_custkey AS VARCHAR), 1, 3) AS c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    return masking.masked(tables.load(spark, d, "customer"), "customer", spark.createDataFrame(MASKED, POLICY))


@query("masked_residual", oracle.residual("customer", ["substr(CAST(c_custkey AS VARCHAR), 1, 3)", "c_nationkey", "c_mktsegment"]))
def _(spark, d):
    return masking.residual(tables.load(spark, d, "customer"), "customer", spark.createDataFrame(MASKED, POLICY))


_BEFORE, _AFTER = ["c_custkey", "c_nationkey", "c_mktsegment"], ["substr(CAST(c_custkey AS VARCHAR), 1, 3)", "c_nationkey", "c_mktsegment"]


@query("masked_before_after", f"SELECT 'before' AS stage, * FROM ({oracle.residual('customer', _BEFORE)}) UNION ALL SELECT 'after', * FROM ({oracle.residual('customer', _AFTER)})")
def _(spark, d):
    customer = tables.load(spark, d, "customer")
    before = kanon.residual(customer, [F.col(c) for c in _BEFORE]).select(F.lit("before").alias("stage"), "*")
    return before.unionByName(masking.residual(customer, "customer", spark.createDataFrame(MASKED, POLICY)).select(F.lit("after").alias("stage"), "*"))


@query("compliant_but_identifiable", f"SELECT * FROM (SELECT 'customer' AS \"table\", * FROM ({oracle.residual('customer', _AFTER)}) UNION ALL SELECT 'orders', * FROM ({oracle.residual(ORDERED, ['y', 'o_orderpriority'])})) WHERE k < 2")
def _(spark, d):
    customer = masking.residual(tables.load(spark, d, "customer"), "customer", spark.createDataFrame(MASKED, POLICY)).select(F.lit("customer").alias("table"), "*")
    orders = kanon.residual(tables.load(spark, d, "orders"), [values.year(F.col("o_orderdate")), F.col("o_orderpriority")]).select(F.lit("orders").alias("table"), "*")
    return kanon.compliant_but_identifiable(customer.unionByName(orders))


@query("policies_resolved", f"{POLICIES}, first_review AS (SELECT \"table\", \"column\" FROM policies WHERE action = 'review' ORDER BY 1, 2 LIMIT 1) SELECT p.* REPLACE (CASE WHEN f.\"column\" IS NOT NULL THEN 'retain' ELSE p.action END AS action, CASE WHEN f.\"column\" IS NOT NULL THEN 'not_personal' ELSE p.category END AS category) FROM policies p LEFT JOIN first_review f USING (\"table\", \"column\")")
def _(spark, d):
    found = masking.policies(_verdicts(spark, d)[2]).cache()
    first = found.where("action = 'review'").orderBy("table", "column").limit(1).select("table", "column", F.lit(False).alias("personal"))
    return masking.resolved(found, first)


# -- lineage ----------------------------------------------------------------------------------------

EDGE_ROWS = [
    ("orders", "o_orderdate", "mart.daily", "day", "cast", "cast to DATE, key of the groups"), ("customer", "c_mktsegment", "mart.daily", "segment", "grouped", "key of the groups"),
    ("customer", "c_nationkey", "mart.daily", "nation", "grouped", "key of the groups"), ("orders", "*", "mart.daily", "orders", "aggregate", "counts the joined rows"),
    ("customer", "*", "mart.daily", "orders", "aggregate", "counts the joined rows"), ("orders", "o_totalprice", "mart.daily", "mean_price", "aggregate", "avg of each group"),
    ("mart.daily", "segment", "mart.segments", "segment", "grouped", "key of the groups"), ("mart.daily", "day", "mart.segments", "day", "cast", "cast to DATE, key of the groups"),
    ("mart.daily", "orders", "mart.segments", "total", "aggregate", "sum of each group"), ("mart.daily", "mean_price", "mart.segments", "twice", "transform", "expression, key of the groups"),
]
EDGE_NAMES = "source_table, source_column, target_table, target_column, kind, detail"


def _graph(spark: SparkSession) -> lineage.Graph:
    texts = [tables.mart_insert("daily"), *access_log.STATEMENTS]
    return lineage.Graph.of(spark, [lineage.read(spark, t) for t in texts])


@query("lineage_edges", oracle.values(EDGE_ROWS, EDGE_NAMES)[1:-1])
def _(spark, d):
    return _graph(spark).edges


@query("lineage_refusals", oracle.values([("star expansion", "mart.broken"), ("shorthand cast", "mart.broken"), ("scalar subquery", "mart.broken"), ("unknown qualifier", "mart.broken"), ("unsupported: over", "")], 'what, "table"')[1:-1])
def _(spark, d):
    return _graph(spark).refusals.select("what", "table")


EDGES_SQL = f"SELECT source_table || '.' || source_column AS source, target_table || '.' || target_column AS target, kind, detail FROM {oracle.values(EDGE_ROWS, EDGE_NAMES)}"


@query("lineage_into", f"{EDGES_SQL} WHERE target_table = 'mart.segments' AND target_column = 'total'")
def _(spark, d):
    return _graph(spark).into("mart.segments.total")


@query("lineage_out_of", f"{EDGES_SQL} WHERE source_table = 'mart.daily' AND source_column = 'day'")
def _(spark, d):
    return _graph(spark).out_of("mart.daily.day")


@query("lineage_refusals_attributed", "SELECT * FROM (VALUES ('mart.broken', 4), ('', 1)) t(\"table\", refusals)")
def _(spark, d):
    g = _graph(spark)
    return g.refusals_for("mart.broken").unionByName(g.unattributed()).groupBy("table").agg(F.count("*").alias("refusals"))


@query("lineage_roots", "SELECT 'orders' AS \"table\", 'o_orderdate' AS \"column\" UNION ALL SELECT 'customer', 'c_mktsegment'")
def _(spark, d):
    columns = spark.createDataFrame([r[:2] for r in UP], "table string, column string")
    return lineage.roots(_graph(spark), columns)


WALK = f"WITH RECURSIVE e AS (SELECT source_table || '.' || source_column AS s, target_table || '.' || target_column AS t, kind FROM {oracle.values(EDGE_ROWS, EDGE_NAMES)})"
STARTS = [("customer.c_mktsegment",), ("orders.o_orderdate",), ("orders.o_totalprice",)]


@query("lineage_carriers", f"{WALK}, w(origin, node) AS (SELECT v, v FROM {oracle.values(STARTS, 'v')} UNION SELECT origin, t FROM w JOIN e ON s = node WHERE kind IN ('copy', 'cast', 'grouped', 'transform')) SELECT * FROM w WHERE origin <> node")
def _(spark, d):
    return lineage.carriers(_graph(spark), spark.createDataFrame(STARTS, "node string"))


@query("lineage_sources", f"{WALK}, w(origin, node) AS (SELECT DISTINCT t, t FROM e UNION SELECT origin, s FROM w JOIN e ON t = node) SELECT * FROM w WHERE origin <> node")
def _(spark, d):
    g = _graph(spark)
    return lineage.column_sources(g, g.addressed().select(F.col("target").alias("node")))


@query("lineage_upstream_tables", f"WITH RECURSIVE e AS (SELECT * FROM {oracle.values(EDGE_ROWS, EDGE_NAMES)} WHERE kind IN ('copy', 'cast', 'grouped') AND source_column <> '*'), w(\"table\", source) AS (SELECT target_table, source_table FROM e UNION SELECT w.\"table\", e.source_table FROM w JOIN e ON e.target_table = w.source) SELECT * FROM w")
def _(spark, d):
    return lineage.upstream_tables(_graph(spark))


UP = [("orders", "o_orderdate", "event_date", 0.7, True), ("customer", "c_mktsegment", "occupation", 0.8, False), ("mart.daily", "day", "not_personal", 0.0, False), ("mart.daily", "segment", "not_personal", 0.0, True), ("mart.daily", "orders", "not_personal", 0.0, False), ("mart.daily", "nation", "not_personal", 0.0, True)]


@query("lineage_propagation", oracle.values([("orders", "o_orderdate", "event_date", None, "no column feeds it", False, False), ("customer", "c_mktsegment", "occupation", None, "no column feeds it", False, False), ("mart.daily", "day", "not_personal", "event_date", "cast from orders.o_orderdate, kept to the day", True, True), ("mart.daily", "segment", "not_personal", "occupation", "grouped from customer.c_mktsegment", True, True), ("mart.daily", "orders", "not_personal", "not_personal", "only by aggregate, which keeps no value", False, False), ("mart.daily", "nation", "not_personal", None, "what feeds it has no verdict", False, False)], '"table", "column", category, inherited, rule, disagrees, upgrade')[1:-1])
def _(spark, d):
    verdicts = spark.createDataFrame([r[:4] for r in UP], "table string, column string, category string, confidence double")
    return lineage.propagated(_graph(spark), verdicts)


@query("lineage_nullable_breaches", oracle.values([("orders.o_orderdate", "mart.daily.day", "cast")], "source, target, kind")[1:-1])
def _(spark, d):
    columns = spark.createDataFrame([(t, c, n) for t, c, _, _, n in UP], "table string, column string, nullable boolean")
    return lineage.nullable_breaches(_graph(spark), columns)


@query("lineage_states", oracle.values([("mart.daily", "read"), ("customer", "not_derived")], '"table", state')[1:-1])
def _(spark, d):
    g = lineage.Graph.of(spark, [lineage.read(spark, tables.mart_insert("daily"))])
    return lineage.derivation_state(g, spark.createDataFrame([("mart.daily",), ("customer",)], "table string"))


# -- access -----------------------------------------------------------------------------------------

LOG = access_log.query_log()
START, END = dt.date(2026, 7, 1), dt.date(2026, 9, 1)


def _log(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(access_log.GRANTS, "role string, table string, privilege string"), spark.createDataFrame(access_log.MEMBERS, "user string, role string"),
        spark.createDataFrame(LOG, "query_id string, user string, at date, tables array<string>, columns array<string>, select_star boolean"),
    )


def _exposures(spark: SparkSession) -> DataFrame:
    addresses = spark.createDataFrame([(a,) for a in access_log.ADDRESSES], "address string")
    grants, members, events = _log(spark)
    carried = lineage.carriers(_graph(spark), addresses.select(F.col("address").alias("node")))
    return access.exposures(addresses, grants, members, events, carried, START, END)


def _events_sql() -> str:
    return oracle.values([(q, u, str(at), t, c, s) for q, u, at, t, c, s in LOG], 'query_id, "user", "at", tables, columns, select_star')


_SETS = f"""{WALK},
w(origin, node) AS (SELECT v, v FROM {oracle.values([(a,) for a in access_log.ADDRESSES], 'v')} UNION SELECT origin, t FROM w JOIN e ON s = node WHERE kind IN ('copy', 'cast', 'grouped', 'transform')),
c AS (SELECT * FROM w WHERE origin <> node), a AS (SELECT DISTINCT origin AS address, regexp_replace(origin, '\\.[^.]*$', '') AS tbl FROM w),
ct AS (SELECT origin AS address, list(DISTINCT regexp_replace(node, '\\.[^.]*$', '')) AS tables, list_sort(list(node)) AS carriers FROM c GROUP BY ALL),
h AS (SELECT a.address, a.tbl, coalesce(ct.tables, []) AS ctables, coalesce(ct.carriers, []) AS carriers FROM a LEFT JOIN ct USING (address)),
g AS (SELECT gr."table" AS tbl, m."user" AS u FROM {oracle.values(access_log.GRANTS, 'role, "table", privilege')} gr JOIN {oracle.values(access_log.MEMBERS, '"user", role')} m USING (role) WHERE privilege IN ('select', 'all')),
ev AS (SELECT * FROM {_events_sql()} WHERE CAST("at" AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'),
k AS (SELECT address, "user" AS u, CASE WHEN list_contains(columns, address) THEN 1 WHEN list_has_any(columns, carriers) THEN 2 WHEN select_star AND (list_contains(tables, tbl) OR list_has_any(tables, ctables)) THEN 3 END AS r FROM h, ev),
dset AS (SELECT address, list_sort(list(DISTINCT g.u)) AS direct FROM h JOIN g USING (tbl) GROUP BY ALL),
cset AS (SELECT address, list_sort(list(DISTINCT g.u)) AS every FROM h JOIN g ON list_contains(ctables, g.tbl) GROUP BY ALL),
x AS (SELECT h.address, coalesce(direct, CAST([] AS VARCHAR[])) AS direct, list_sort(list_filter(coalesce(every, CAST([] AS VARCHAR[])), lambda u: NOT list_contains(coalesce(direct, []), u))) AS through_a_carrier,
  coalesce((SELECT list_sort(list(DISTINCT u)) FROM k WHERE k.address = h.address AND r = 1), CAST([] AS VARCHAR[])) AS named_the_column,
  coalesce((SELECT list_sort(list(DISTINCT u)) FROM k WHERE k.address = h.address AND r = 2), CAST([] AS VARCHAR[])) AS named_a_carrier,
  coalesce((SELECT list_sort(list(DISTINCT u)) FROM k WHERE k.address = h.address AND r = 3), CAST([] AS VARCHAR[])) AS star_over_a_holder, CAST(carriers AS VARCHAR[]) AS carriers
  FROM h LEFT JOIN dset USING (address) LEFT JOIN cset USING (address)),
y AS (SELECT *, list_sort(list_distinct(direct || through_a_carrier)) AS could_have_read, list_sort(list_distinct(named_the_column || named_a_carrier)) AS did_read FROM x),
z AS (SELECT *, list_sort(list_distinct(did_read || star_over_a_holder)) AS did_read_at_most FROM y)"""
_FLAT = ["direct", "through_a_carrier", "named_the_column", "named_a_carrier", "star_over_a_holder", "carriers"]


@query("exposures", f"{_SETS} SELECT address, {', '.join(f'array_to_string({c}, chr(44)) AS {c}' for c in _FLAT)} FROM z")
def _(spark, d):
    return _exposures(spark).select("address", *[F.array_join(c, ",").alias(c) for c in _FLAT])


_MORE = ["could_have_read", "did_read", "did_read_at_most", "only_by_star", "read_without_a_direct_grant", "granted_and_never_used"]


@query("exposure_sets", f"{_SETS} SELECT address, array_to_string(could_have_read, ',') AS could_have_read, array_to_string(did_read, ',') AS did_read, array_to_string(did_read_at_most, ',') AS did_read_at_most, array_to_string(list_filter(star_over_a_holder, lambda u: NOT list_contains(did_read, u)), ',') AS only_by_star, array_to_string(list_filter(did_read, lambda u: NOT list_contains(direct, u)), ',') AS read_without_a_direct_grant, array_to_string(list_filter(could_have_read, lambda u: NOT list_contains(did_read_at_most, u)), ',') AS granted_and_never_used FROM z")
def _(spark, d):
    return access.derived(_exposures(spark)).select("address", *[F.array_join(c, ",").alias(c) for c in _MORE])


@query("unanswerable", f"{_SETS} SELECT address FROM z WHERE len(did_read) = 0 AND len(did_read_at_most) > 0")
def _(spark, d):
    return access.unanswerable(access.derived(_exposures(spark)))


@query("unused_grants", f"{_SETS} SELECT DISTINCT u AS \"user\" FROM (SELECT unnest(could_have_read) AS u FROM z) WHERE u NOT IN (SELECT unnest(did_read_at_most) FROM z)")
def _(spark, d):
    return access.unused_grants(access.derived(_exposures(spark)))


@query("widening", f"{_SETS} SELECT address, CAST(len(direct) AS INT) AS direct, CAST(len(through_a_carrier) AS INT) AS more, array_to_string(carriers, ', ') AS carriers FROM z WHERE len(through_a_carrier) > 0")
def _(spark, d):
    return access.widening(_exposures(spark))


@query("access_summary", f"SELECT {len(access_log.GRANTS)} AS grants, 5 AS roles, 7 AS users, count(*) AS queries, count(*) FILTER (select_star) AS stars, min(\"at\") AS first, max(\"at\") AS last FROM {_events_sql()}")
def _(spark, d):
    return access.summary(*_log(spark)).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query("star_share", f"SELECT count(*) FILTER (select_star) AS stars, count(*) AS queries FROM {_events_sql()} WHERE CAST(\"at\" AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'")
def _(spark, d):
    return access.star_share(_log(spark)[2], START, END)


WINDOWS = [3, 7, 30, 90, 113]


@query("retention", f"SELECT days, count(*) AS queries, count(*) FILTER (select_star) AS stars FROM {_events_sql()}, (SELECT unnest({WINDOWS})::INT AS days) WHERE CAST(\"at\" AS DATE) <= DATE '{access_log.LAST}' AND CAST(\"at\" AS DATE) > DATE '{access_log.LAST}' - days GROUP BY ALL")
def _(spark, d):
    return access.retention(_log(spark)[2], access_log.LAST, WINDOWS)


@query("users_by_role", f"SELECT role, array_to_string(list_sort(list(DISTINCT \"user\")), ',') AS users FROM {oracle.values(access_log.MEMBERS, '\"user\", role')} GROUP BY ALL")
def _(spark, d):
    return access.users_by_role(_log(spark)[1]).withColumn("users", F.array_join("users", ","))


@query("readable_tables", f"SELECT role, array_to_string(list_sort(list(DISTINCT \"table\")), ',') AS tables FROM {oracle.values(access_log.GRANTS, 'role, \"table\", privilege')} WHERE privilege IN ('select', 'all') GROUP BY ALL")
def _(spark, d):
    return access.readable_tables(_log(spark)[0]).withColumn("tables", F.array_join("tables", ","))


# -- review and report ------------------------------------------------------------------------------


def _queue(spark: SparkSession, d: str) -> DataFrame:
    verdicts = _verdicts(spark, d)[2]
    policies = _kept(masking.policies(verdicts))
    g = _graph(spark)
    start = policies.where("action = 'review'").select(F.concat_ws(".", "table", "column").alias("node"))
    return review.queue(verdicts, policies, lineage.carriers(g, start), lineage.column_sources(g, start))


@query("review_queue", f"""{POLICIES}, e AS (SELECT source_table || '.' || source_column AS s, target_table AS tt, kind FROM {oracle.values(EDGE_ROWS, EDGE_NAMES)} WHERE kind IN ('copy', 'cast', 'grouped', 'transform')),
items AS (SELECT p."table" || '.' || p."column" AS address, p."table" AS tbl, s.category, s.confidence, s.identifiability FROM policies p JOIN settled s USING ("table", "column") WHERE p.action = 'review'),
held AS (SELECT DISTINCT address, tbl FROM items UNION SELECT address, tt FROM items JOIN e ON s = address WHERE tt IN (SELECT "table" FROM settled)),
counts AS (SELECT tbl, count(*) AS n FROM held GROUP BY ALL),
blocked AS (SELECT address, list_sort(list(tbl)) AS tables_blocked, coalesce(list_sort(list(tbl) FILTER (n = 1)), CAST([] AS VARCHAR[])) AS sole FROM held JOIN counts USING (tbl) GROUP BY ALL)
SELECT address, category, confidence, round({rules.ACCEPT_AT} - confidence, 4) AS distance, array_to_string(tables_blocked, ',') AS tables_blocked, array_to_string(sole, ',') AS sole_blocker_of,
  CAST(row_number() OVER (ORDER BY len(sole) DESC, len(tables_blocked) DESC, CASE identifiability WHEN 'direct' THEN 0 WHEN 'quasi' THEN 1 WHEN 'sensitive' THEN 2 ELSE 3 END, round({rules.ACCEPT_AT} - confidence, 4), address) AS INT) AS place FROM items JOIN blocked USING (address)""")
def _(spark, d):
    return _queue(spark, d).select("address", "category", "confidence", "distance", F.array_join("tables_blocked", ",").alias("tables_blocked"), F.array_join("sole_blocker_of", ",").alias("sole_blocker_of"), "place")


@query("review_unblocked", f"{POLICIES}, waiting AS (SELECT \"table\", count(*) AS n FROM policies WHERE action = 'review' GROUP BY ALL) SELECT \"table\" FROM waiting WHERE n = 1")
def _(spark, d):
    queue = _queue(spark, d).cache()
    # decide every column that alone holds up a table
    return review.unblocked(queue, review.frees_a_table(queue).select("address"))


_BRIEFS_SQL = f"""{POLICIES.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT source_table || '.' || source_column AS s, target_table || '.' || target_column AS t, target_table AS tt, kind FROM {oracle.values(EDGE_ROWS, EDGE_NAMES)}),
items AS (SELECT p."table" || '.' || p."column" AS address, p."table" AS tbl, s.category, s.confidence, s.runner_up, s.runner_up_score FROM policies p JOIN settled s USING ("table", "column") WHERE p.action = 'review'),
fw(origin, node) AS (SELECT address, address FROM items UNION SELECT origin, t FROM fw JOIN e ON s = node WHERE kind IN ('copy', 'cast', 'grouped', 'transform')),
bw(origin, node) AS (SELECT address, address FROM items UNION SELECT origin, s FROM bw JOIN e ON t = node),
into_ AS (SELECT origin AS address, string_agg(node, ', ' ORDER BY node) AS nodes FROM fw WHERE node <> origin GROUP BY ALL),
from_ AS (SELECT origin AS address, string_agg(node, ', ' ORDER BY node) AS nodes FROM bw WHERE node <> origin GROUP BY ALL),
held AS (SELECT DISTINCT address, tbl FROM items UNION SELECT origin, regexp_replace(node, '\\.[^.]*$', '') FROM fw WHERE node <> origin AND regexp_replace(node, '\\.[^.]*$', '') IN (SELECT "table" FROM settled)),
counts AS (SELECT tbl, count(*) AS n FROM held GROUP BY ALL),
sole AS (SELECT address, string_agg(tbl, ', ' ORDER BY tbl) FILTER (n = 1) AS frees FROM held JOIN counts USING (tbl) GROUP BY ALL)
SELECT address, concat_ws(chr(10), printf('%s  candidate %s at %.4f', address, category, confidence), printf('  short of the accept threshold by %.4f', round({rules.ACCEPT_AT} - confidence, 4)),
  CASE WHEN runner_up IS NOT NULL THEN printf('  runner up %s at %.4f', runner_up, runner_up_score) END, '  came from ' || from_.nodes, '  carried into ' || into_.nodes, '  frees ' || frees) AS text
FROM items LEFT JOIN sole USING (address) LEFT JOIN into_ USING (address) LEFT JOIN from_ USING (address)"""


@query("review_briefs", _BRIEFS_SQL)
def _(spark, d):
    return review.briefs(_queue(spark, d))


def _report(spark: SparkSession, d: str) -> DataFrame:
    verdicts = _verdicts(spark, d)[2]
    policies = _kept(masking.policies(verdicts))
    customer = masking.residual(tables.load(spark, d, "customer"), "customer", spark.createDataFrame(MASKED, POLICY)).withColumn("table", F.lit("customer"))
    quasi = [k for k, level in rules.IDENTIFIABILITY.items() if level == "quasi"]
    waiting = sorted({r["table"] for r in policies.where((F.col("action") == "review") & F.col("category").isin(quasi)).collect()})
    _, refused = report.measured_or_refused(spark, waiting, lambda name: masking.residual(tables.load(spark, d, name), name, policies))
    unreachable = classify.rule_coverage(spark).where("not reachable and category <> 'not_personal'")
    return report.assembled([
        report.scope(verdicts), report.classification(classify.band_counts(verdicts), verdicts), report.policy(masking.action_counts(policies), masking.retained_on_absence(policies)),
        report.residual(customer, refused), report.access(access.derived(_exposures(spark))), report.coverage(coverage.gaps(spark), unreachable),
    ])


def _report_sql() -> str:
    """The lines of the report as the CTE ``lines``."""
    place = oracle.values([(t, c, i) for t in tables.KEYS for i, (c, _) in enumerate(oracle.columns_of(t))], "t, c, position")
    quasi = ", ".join(repr(k) for k, level in rules.IDENTIFIABILITY.items() if level == "quasi")
    unreachable = [k for k in rules.IDENTIFIABILITY if k not in _BY_NAME | _BY_VALUE | _BY_SAMPLE and k != "not_personal"]
    row = lambda section, title, at, question, answer, source, refusal="NULL", closable="true": f"SELECT {section} AS section, '{title}' AS title, {at} AS place, {question} AS question, CAST({answer} AS VARCHAR) AS answer, {refusal} AS refusal, {closable} AS closable FROM {source}"
    parts = [
        row(1, "Scope", 0, "'tables'", 'count(DISTINCT "table")', "settled"), row(1, "Scope", 1, "'columns'", "count(*)", "settled"),
        row(2, "Classification", 0, "'columns in band ' || band", "n", "(SELECT band, count(\"table\") AS n FROM (VALUES ('accept'), ('review'), ('ignore')) b(band) LEFT JOIN settled USING (band) GROUP BY ALL)"),
        row(2, "Classification", 1, "'is ' || \"table\" || '.' || \"column\" || ' personal data'", "NULL", "settled WHERE band = 'review'", "printf('scored %.4f, so a person decides', confidence)"),
        row(3, "Policy", 0, "'columns to ' || action", "n", "(SELECT action, count(\"table\") AS n FROM (VALUES ('redact'), ('generalise'), ('retain'), ('review')) a(action) LEFT JOIN policies USING (action) GROUP BY ALL)"),
        row(3, "Policy", 1, "'columns retained on absence of evidence'", "count(*)", "policies WHERE evidence_only"),
        row(4, "Residual risk", 0, "'residual k of customer'", "printf('k %d, %d of %d people alone', k, singletons, population)", f"({oracle.residual('customer', _AFTER)})"),
        row(4, "Residual risk", 0, "'residual k of ' || t", "NULL", f"(SELECT t, arg_min(c, position) AS c FROM {place} JOIN policies ON t = \"table\" AND c = \"column\" WHERE action = 'review' AND category IN ({quasi}) GROUP BY ALL)", "t || '.' || c || ' is in review, so there is no policy to measure'"),
        row(5, "Access", 0, "'users who could have read ' || address", "len(could_have_read)", "z"),
        row(5, "Access", 1, "'users who read ' || address", "len(did_read)", "z WHERE NOT (len(did_read) = 0 AND len(did_read_at_most) > 0)"),
        row(5, "Access", 1, "'users who read ' || address", "NULL", "z WHERE len(did_read) = 0 AND len(did_read_at_most) > 0", "printf('%d users only by star, which names no column', len(list_filter(star_over_a_holder, lambda u: NOT list_contains(did_read, u))))", "false"),
        row(6, "Coverage", 0, "'clause ' || letter", "NULL", "(VALUES ('E'), ('R')) c(letter)", "'no category stands for it'", "false"),
        row(6, "Coverage", 1, "'category ' || category", "NULL", oracle.values([(k,) for k in unreachable], "category") + " c", "'no rule can find it'"),
    ]
    return f"{_SETS}, {POLICIES.removeprefix('WITH ')}, lines AS ({' UNION ALL '.join(parts)})"


_REPORT = _report_sql()


@query("compliance_report", f"{_REPORT} SELECT * FROM lines")
def _(spark, d):
    return _report(spark, d)


@query("compliance_counts", f"{_REPORT} SELECT count(*) AS asked, count(answer) AS answered, count(refusal) AS refused, count(*) FILTER (refusal IS NOT NULL AND NOT closable) AS unclosable FROM lines")
def _(spark, d):
    return report.counts(_report(spark, d))


@query("compliance_refusals_by_section", f"{_REPORT} SELECT title, count(*) AS refusals FROM lines WHERE refusal IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return report.by_question(_report(spark, d))
