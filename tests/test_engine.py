"""The operators on the planted warehouse and on small frames."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.operators import access, classify, coverage, kanon, lineage, masking, measure, profile, report, review, sampling
from quillon.plans import access_log, rules
from quillon.sources import tables, warehouse
from quillon.sources.catalog import Catalog, Table, compared, quoted, read_ddl, recovered


@pytest.fixture(scope="module")
def planted(spark):
    return warehouse.planted(spark, 300)


@pytest.fixture(scope="module")
def found(spark, planted):
    return queries._kept(profile.warehouse_profile(planted))


@pytest.fixture(scope="module")
def verdicts(spark, found):
    return queries._kept(classify.warehouse(found, queries._kept(classify.signals(found))))


def test_profile_counts(spark):
    df = spark.createDataFrame([("a@b.co",), ("c@d.org",), ("e@f.net",), (None,), (None,), (None,)], "v string")
    row = profile.measured(df).first()
    assert (row["rows"], row["non_null"], row["distinct"], row["pattern_hits"]["email"]) == (6, 3, 3, 3)
    assert profile.leaks(profile.profiled(Table("t", df))) == [] and profile.leaks(df) == ["v"]


def test_profile_shapes_agree(spark):
    wide = warehouse.wide(spark, 12, 200).withColumn("long", F.repeat(F.col("row_id").cast("string"), 60))
    assert profile.disagreements(profile.measured(wide), profile.measured_wide(wide)).count() == 0
    assert profile.measured(wide.where("row_id < 0")).where("rows = 0 and mean_length = 0").count() == 14


def test_planted_classification(found, verdicts, spark, planted):
    mart = "analytics.encounter_daily"
    g = lineage.Graph.of(spark, [lineage.read(spark, warehouse.MART)])
    grain = kanon.grain(planted.tables[mart].data, lineage.weight_column(g, mart)).select(F.lit(mart).alias("table"), "factor")
    settled = queries._kept(classify.warehouse(found, queries._kept(classify.signals(found)), lineage.upstream_tables(g), grain))
    moved = settled.exceptAll(verdicts).collect()
    assert [(r["table"], r["column"], r["category"], r["band"]) for r in moved] == [(mart, "day", "event_date", "review")]
    grades = coverage.graded(settled, warehouse.labels(spark))
    summary = {r["identifiability"]: (r["in_scope"], r["found"]) for r in coverage.recall(grades).collect()}
    assert all(f == n for n, f in summary.values()) and sum(n for n, _ in summary.values()) == 20
    assert coverage.headline(grades, settled).first() == (20, 20, 12, 2)
    bands = {(r["table"], r["column"]): r["band"] for r in verdicts.collect()}
    assert bands["raw.patient", "email"] == bands["raw.patient", "ssn"] == "accept"
    assert {r["band"]: r["columns"] for r in classify.band_counts(verdicts).collect()}.keys() == set(rules.BANDS)


def test_names_removed(spark, planted):
    hidden = [warehouse.renamed(t) for t in planted.tables.values()]
    blind = classify.warehouse(*(lambda p: (p, classify.signals(p)))(queries._kept(profile.warehouse_profile(Catalog(spark).add(*hidden)))))
    assert 0 < blind.where("band <> 'ignore'").count() < 25


def test_dates_count_only_beside_people(spark):
    columns = spark.createDataFrame([("a", "email", "VARCHAR", False), ("a", "seen_at", "TIMESTAMP", False), ("b", "seen_at", "TIMESTAMP", False)], "table string, column string, sql_type string, is_key boolean")
    evidence = classify.name_signals(columns).unionByName(classify.structure_signals(columns))
    out = {(r["table"], r["column"]): (r["category"], r["confidence"]) for r in classify.warehouse(columns, evidence).collect()}
    assert out["a", "seen_at"] == ("event_date", 0.725) and out["b", "seen_at"] == ("not_personal", 0.0)
    grain = spark.createDataFrame([("b", 0.5)], "table string, factor double")
    second = classify.warehouse(columns, evidence, spark.createDataFrame([("b", "a")], "table string, source string"), grain)
    assert {r["table"]: r["confidence"] for r in second.where("column = 'seen_at'").collect()}["b"] == pytest.approx(1 - 0.75 * 0.775, abs=1e-4)


def test_conflict_costs_confidence(spark):
    columns = spark.createDataFrame([("t", "home_phone_email", "VARCHAR", False)], "table string, column string, sql_type string, is_key boolean")
    row = classify.decided(columns, classify.name_signals(columns)).first()
    assert (row["category"], row["runner_up"]) == ("email", "phone") and row["confidence"] == pytest.approx(0.9 * (1 - 0.5 * 0.85))


def test_sampling_finds_codes(spark):
    df = spark.range(300).select(F.format_string("ABC%06d", "id").alias("code"), F.format_string("2026-01-%02d", F.col("id") % 28 + 1).alias("day"), F.lit("4111111111111111").alias("card"))
    out = {(r["column"], r["category"]) for r in sampling.signals("t", sampling.window(df, ["code"])).collect()}
    assert out == {("code", "unknown_identifier"), ("card", "payment_card")}
    assert sampling.unsafe_shapes(sampling.window(df, None)).count() == 0


def test_residual_and_generalising(spark, planted):
    patient = planted.tables["raw.patient"].data
    fine = kanon.residual(patient, [F.col("birth_date"), F.col("postal_code"), F.col("sex")]).first()
    coarse = kanon.residual(patient, [F.year("birth_date"), F.substring("postal_code", 1, 3), F.col("sex")]).first()
    assert coarse["k"] >= fine["k"] and coarse["alone_share"] <= fine["alone_share"] and fine["population"] == 300
    with pytest.raises(ValueError):
        kanon.residual(patient, [])


def test_sweep_is_monotone(spark, planted):
    rows = kanon.sweep(planted.tables["raw.patient"].data, ["sex", "city", "birth_date"]).orderBy("columns").collect()
    assert [r["columns"] for r in rows] == [1, 2, 3] and rows[0]["measured"] <= rows[1]["measured"] <= rows[2]["measured"]


def test_masking(spark, planted, verdicts):
    policy = masking.policies(verdicts).cache()
    assert sum(r["columns"] for r in masking.action_counts(policy).collect()) == 42
    with pytest.raises(ValueError, match="review"):
        masking.expression("x", "review", None)
    waiting = policy.where("action = 'review'").select("table", "column", F.lit(True).alias("personal"))
    done = masking.resolved(policy, waiting).cache()
    assert done.where("action = 'review'").count() == 0
    patient = planted.tables["raw.patient"].data
    masked = masking.masked(patient, "raw.patient", done)
    assert masked.columns == patient.columns and masked.where("ssn is not null or email is not null").count() == 0
    assert masking.residual(patient, "raw.patient", done).first()["k"] >= 1
    with pytest.raises(Exception, match="patient_id"):
        masking.resolved(policy, spark.createDataFrame([("raw.patient", "patient_id", False)], "table string, column string, personal boolean")).collect()


def test_lineage_of_the_mart(spark, planted):
    g = lineage.Graph.of(spark, [lineage.read(spark, warehouse.MART)], planted.references())
    kinds = {(r["source"], r["target"]): r["kind"] for r in g.addressed().collect()}
    assert kinds["raw.encounter.admitted_at", "analytics.encounter_daily.day"] == "cast"
    assert kinds["raw.patient.postal_code", "analytics.encounter_daily.postal_code"] == "grouped"
    assert kinds["raw.encounter.*", "analytics.encounter_daily.encounters"] == "aggregate"
    assert kinds["raw.patient.patient_id", "raw.encounter.patient_id"] == "join_key"
    assert lineage.weight_column(g, "analytics.encounter_daily") == "encounters" and lineage.weight_column(g, "raw.claim") is None
    assert {(r["table"], r["source"]) for r in lineage.upstream_tables(g).collect()} == {("analytics.encounter_daily", "raw.encounter"), ("analytics.encounter_daily", "raw.patient")}


@pytest.mark.parametrize(
    ("sql", "what"),
    [
        ("INSERT INTO t WITH x AS (SELECT 1 AS a) SELECT a FROM x", "unsupported: with"), ("INSERT INTO t SELECT a FROM s UNION SELECT a FROM u", "unsupported: union"),
        ("INSERT INTO t SELECT a FROM s EXCEPT SELECT a FROM u", "unsupported: except"), ("INSERT INTO t SELECT a FROM s INTERSECT SELECT a FROM u", "unsupported: intersect"),
        ("INSERT INTO t SELECT sum(a) OVER (PARTITION BY b) FROM s", "unsupported: over"), ("INSERT INTO t SELECT * FROM s", "star expansion"),
        ("INSERT INTO t SELECT a::int AS a FROM s", "shorthand cast"), ("INSERT INTO t SELECT (SELECT max(b) FROM u) AS m FROM s", "scalar subquery"),
        ("INSERT INTO t SELECT z.a FROM s", "unknown qualifier"), ("INSERT INTO t SELECT a FROM s JOIN u ON s.i = u.i", "unqualified column"),
        ("INSERT INTO t (a, b) SELECT a FROM s", "arity mismatch"), ("INSERT INTO t SELECT q.a FROM (SELECT a FROM s) q", "subquery in from"),
        ("INSERT INTO t SELECT 1 AS one", "no from clause"), ("MERGE INTO t USING s ON t.i = s.i", "not an insert select"), ("DELETE FROM t", "not an insert select"), ("SELECT a FROM s", "not an insert select"),
    ],
)
def test_refusals(spark, sql, what):
    out = lineage.read(spark, sql)
    assert what in [r[0] for r in out.refusals]


def test_strings_do_not_confuse_the_reader(spark):
    out = lineage.read(spark, "INSERT INTO t SELECT concat(s.a, ' :: over union ') AS x, CAST(CAST(s.b AS DATE) AS STRING) AS y /* union */ FROM s -- over\n")
    assert not out.refusals and [(e[1], e[3], e[4]) for e in out.edges] == [("a", "x", "transform"), ("b", "y", "cast")]


def test_walks_survive_cycles(spark):
    ring = [("a", "x", "b", "x", "copy", ""), ("b", "x", "c", "x", "copy", ""), ("c", "x", "a", "x", "copy", "")]
    g = lineage.Graph(spark, spark.createDataFrame(ring, lineage.EDGES), spark.createDataFrame([], lineage.REFUSALS))
    out = lineage.carriers(g, spark.createDataFrame([("a.x",)], "node string")).collect()
    assert {r["node"] for r in out} == {"b.x", "c.x"}


def test_access(spark):
    rows = queries._exposures(spark)
    sets = {r["address"]: r for r in access.derived(rows).collect()}
    assert set(sets) == set(access_log.ADDRESSES)
    assert "dee" not in sets["orders.o_orderdate"]["could_have_read"]  # may only insert
    for r in sets.values():
        assert set(r["did_read"]) <= set(r["did_read_at_most"]) and not set(r["only_by_star"]) & set(r["did_read"])
    with pytest.raises(ValueError):
        access.in_window(queries._log(spark)[2], dt.date(2026, 9, 2), dt.date(2026, 9, 1))
    assert access_log.query_log() == access_log.query_log()


def test_review(spark, verdicts):
    policy = queries._kept(masking.policies(verdicts))
    none = spark.createDataFrame([], "origin string, node string")
    queue = review.queue(verdicts, policy, none, none).cache()
    assert queue.count() == policy.where("action = 'review'").count() and {r["place"] for r in queue.collect()} == set(range(1, queue.count() + 1))
    decisions = queue.select("address", F.lit(True).alias("personal"), F.lit("kim").alias("reviewer"), F.lit("2026-09-01").cast("date").alias("decided_at"), F.lit("seen").alias("note"))
    assert review.still_open(queue, decisions).count() == 0
    assert review.unblocked(queue, decisions).count() == queue.select(F.explode("tables_blocked")).distinct().count()
    assert review.trail(decisions).count() == queue.count() and review.briefs(queue).count() == queue.count()
    with pytest.raises(Exception, match="without a name"):
        review.trail(decisions.withColumn("note", F.lit(" "))).collect()


def test_report_delivers_every_refusal(spark, verdicts):
    policy = masking.policies(verdicts)
    rows = report.assembled([report.scope(verdicts), report.classification(classify.band_counts(verdicts), verdicts), report.policy(masking.action_counts(policy), masking.retained_on_absence(policy)), report.coverage(coverage.gaps(spark), classify.rule_coverage(spark).where("not reachable"))]).cache()
    text = report.rendered(rows)
    assert report.undelivered(rows, text).count() == 0
    assert report.undelivered(rows, report.rendered(rows, drop_refusals=True)).count() == rows.where("refusal is not null").count()
    count = report.counts(rows).first()
    assert count["asked"] == count["answered"] + count["refused"] and '"rows"' in report.manifest(report.counts(rows))


def test_catalog(spark, planted, tmp_path):
    assert planted.columns().count() == 42
    again = warehouse.saved(planted, str(tmp_path))
    assert again.fingerprint() == planted.fingerprint() and compared(planted.columns(), again.columns()).count() == 0
    assert {r["orphans"] for r in planted.orphans().collect()} == {0}
    states = {(r["table"], r["column"]): r["verdict"] for r in planted.nullability().collect()}
    assert states["raw.patient", "mrn"] == "kept" and states["raw.patient", "email"] == "exercised" and "contradicted" not in states.values()
    assert quoted("a`b", "c") == "`a``b`.`c`" and "NOT NULL" in warehouse.ddl(planted.tables["raw.claim"])
    for bad in ("", "x\0"):
        with pytest.raises(ValueError):
            quoted(bad)
    with pytest.raises(ValueError):
        Table("t", planted.tables["raw.claim"].data, ("nope",))


def test_planted_values_do_not_depend_on_partitions(spark):
    one = warehouse.patients(spark, 50)
    assert one.exceptAll(warehouse.patients(spark, 60).repartition(7).where("patient_id <= 50")).count() == 0
    row = warehouse.statistics(one).first()
    ages = sorted(r[0] for r in one.selectExpr("floor(months_between(date'2026-09-17', birth_date) / 12)").collect() if r[0] is not None)
    assert row["median_age"] == ages[len(ages) // 2] and row["rows"] == 50


def test_measure(spark):
    slow, fast = measure.Timing("a", (4.0, 5.0, 6.0)), measure.Timing("b", (1.0, 2.0, 2.5))
    assert measure.speedup(slow, fast) == 2.5 and measure.speedup(slow, measure.Timing("c", (1.0, 4.5))) is None
    assert measure.growth([10, 100, 1000], [1, 10, 100]) == pytest.approx(1.0)
    assert set(measure.phases(spark.range(10).groupBy().count())) >= {"planning", "execution"}
    with measure.jobs(spark, "counted") as found:
        spark.range(10).count()
    assert len(found) >= 1
    assert measure.timed("x", lambda: spark.range(3), passes=1).median > 0


def test_only_rescued_tables_are_measured(spark, found, planted):
    asked = []

    def grain(names):
        asked.append(names)
        return kanon.confidences({n: t.data for n, t in planted.tables.items()}, {"analytics.encounter_daily": "encounters"}, names)

    upstream = spark.createDataFrame([("analytics.encounter_daily", "raw.patient")], "table string, source string")
    evidence = queries._kept(classify.signals(found))
    lazy = classify.warehouse(found, evidence, upstream, grain)
    assert asked == [["analytics.encounter_daily"]]
    assert lazy.exceptAll(classify.warehouse(found, evidence, upstream, grain(["analytics.encounter_daily"]))).count() == 0
    with pytest.raises(ValueError, match="no grain"):
        classify.warehouse(found, evidence, upstream, lambda names: grain(names).where("false"))
    with pytest.raises(ValueError):
        kanon.confidences({}, {}, [])


def test_round_two_costs(spark):
    with pytest.raises(ValueError):
        warehouse.round_two(spark, 3)
    catalog, edges = warehouse.round_two(spark, 6, 3, 40)
    assert len(catalog.tables) == 6 and len(edges) == 6 and catalog.tables["bench.mart_0"].data.count() == 40
    assert measure.grain_cost(catalog.tables, {f"bench.mart_{i}": "encounters" for i in range(3)}, [f"bench.mart_{i}" for i in range(3)]) == {"eager_tables": 6, "lazy_tables": 3, "eager": 9, "lazy": 6, "saved": 3}
    slow, fast = measure.sample_counts(catalog.tables["bench.ref_0"].data, 1)
    assert slow.median > 0 and fast.median > 0 and measure.share({"a": 1.0, "b": 3.0}, "b") == 0.75 and measure.share({"a": 0.0}, "a") == 0.0


def test_complex_columns_are_profiled(spark, planted):
    df = spark.sql("SELECT array(1.5D, 2D, null) a, map('k', 1) m, named_struct('x', 'a@b.co') s, X'00ff' b, array(array(1)) d, CAST(NULL AS ARRAY<INT>) n, 'v' AS `odd ``name`")
    rows = {r["column"]: (r["non_null"], r["distinct"], r["mean_length"]) for r in profile.measured(df).collect()}
    assert rows == {"a": (1, 1, 17.0), "m": (1, 1, 7.0), "s": (1, 1, 14.0), "b": (1, 1, 4.0), "d": (1, 1, 5.0), "n": (0, 0, 0.0), "odd `name": (1, 1, 1.0)}
    assert profile.disagreements(profile.measured(df), profile.measured_wide(df)).count() == 0


def test_the_store_measures_what_has_changed(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    store, made = profile.Store(), []
    whole = profile.warehouse_profile
    catalog = lambda: Catalog(spark).add(Table("t", spark.read.parquet(path)), Table("made", spark.range(3).selectExpr("id + 1 AS x")))
    try:
        profile.warehouse_profile = lambda c: made.append(sorted(c.tables)) or whole(c)
        first = {(r["table"], r["column"]): r["rows"] for r in store.profile(catalog()).collect()}
        again = {(r["table"], r["column"]): r["rows"] for r in store.profile(catalog()).collect()}
        spark.range(7).write.mode("overwrite").parquet(path)
        changed = {(r["table"], r["column"]): r["rows"] for r in store.profile(catalog()).collect()}
    finally:
        profile.warehouse_profile = whole
    assert first == again == {("t", "id"): 5, ("made", "x"): 3} and changed["t", "id"] == 7
    assert made == [["made", "t"], ["made"], ["made", "t"]]


def test_keys_come_from_constraints(spark, planted):
    for table in planted.tables.values():
        said = read_ddl(spark, warehouse.ddl(table))
        assert (said.name, said.columns, said.key, said.references) == (table.name, tuple(table.data.columns), table.key, table.references)
        again = said.table(table.data)
        assert again.key == table.key and {c for c in table.data.columns if not again.nullable(c)} == {c for c in table.data.columns if not table.nullable(c)}
    assert recovered(planted, Catalog(spark).add(*[read_ddl(spark, warehouse.ddl(t)).table(t.data) for t in planted.tables.values()]))
    assert read_ddl(spark, "CREATE TABLE s.t (id BIGINT)").key == ()  # a name makes no key
    with pytest.raises(ValueError):
        read_ddl(spark, "SELECT 1")


def test_planted_draws(spark):
    rows = warehouse.patients(spark, 4000, null_rate=0.0).selectExpr("postal_code", "year(date'2026-09-17') - year(birth_date) AS age").collect()
    codes = sorted(Counter(r["postal_code"] for r in rows).values(), reverse=True)
    assert len(codes) == 60 and codes[0] > 1.6 * codes[1] > 1.6 * codes[3]  # one, a half, a third, a quarter
    ages = sorted(r["age"] for r in rows)
    assert 0 <= ages[0] and ages[-1] <= 95 and 40 <= ages[len(ages) // 2] <= 53 and sum(30 < a < 62 for a in ages) > 0.5 * len(ages)
    assert warehouse.null_counts(warehouse.planted(spark, 50)).where("column = 'mrn'").count() == 0


def test_residual_refusals_come_from_the_error(spark):
    def residual(name):
        if name == "bad":
            raise ValueError("bad.x is in review. More is not said")
        return spark.createDataFrame([(2, 0, 9)], "k long, singletons long, population long")

    measured, refused = report.measured_or_refused(spark, ["fine", "bad"], residual)
    assert measured.collect() == [("fine", 2, 0, 9)] and refused.collect() == [("bad", "bad.x is in review")]
    lines = report.residual(measured, refused)
    assert report.answer_rate(lines).first() == (1, 2)


def test_sweeps_and_signs(spark):
    sweep = spark.createDataFrame([(0.5, False), (0.7, True), (0.8, True), (0.9, True), (0.95, False)], "concentration double, found boolean")
    assert sampling.cliff(sweep, 0.9).first()["cliff"] == 0.5
    assert sampling.cliff(sweep.where("concentration > 0.6"), 0.9).first()["cliff"] == 0.0 == sampling.cliff(sweep, 0.3).first()["cliff"]
    effects = spark.createDataFrame([(0.1,), (0.0,), (-0.2,)], "flattery double")
    assert kanon.changes_sign(effects).first()["changes"] is True and kanon.changes_sign(effects.where("flattery >= 0")).first()["changes"] is False
    residuals = spark.createDataFrame([("a", 1), ("b", 2)], "table string, k long")
    assert [r["table"] for r in kanon.compliant_but_identifiable(residuals).collect()] == ["a"]


def test_labels_are_total(spark, planted):
    labels = warehouse.labels(spark)
    assert coverage.unlabelled(planted.columns(), labels).count() == 0
    odd = labels.where("column <> 'ssn'").unionByName(spark.createDataFrame([("raw.claim", "nope", "email", None), ("raw.claim", "claim_id", "email", None)], labels.schema))
    assert {(r["column"], r["problem"]) for r in coverage.unlabelled(planted.columns(), odd).collect()} == {("ssn", "no label"), ("nope", "no column"), ("claim_id", "two labels")}
    assert coverage.identifying_quasi(labels).count() == 9  # a city is too coarse


def test_refusals_are_attributed(spark):
    a, b = (lineage.Graph.of(spark, [lineage.read(spark, q)]) for q in ("INSERT INTO t SELECT s.*, s.a AS a FROM s", "DELETE FROM t"))
    g = a.merged(b)
    assert g.refusals_for("t").count() == 1 and g.unattributed().count() == 1 and g.into("t.a").count() == g.out_of("s.a").count() == 1
    with pytest.raises(ValueError):
        lineage.Statement().refuse("a whim", "")


def test_a_log_needs_days_and_queries():
    assert access_log.query_log(queries=7, start=dt.date(2026, 1, 1), end=dt.date(2026, 1, 1))[6][2] == dt.date(2026, 1, 1)
    for bad in ({"queries": 0}, {"start": dt.date(2027, 1, 1)}):
        with pytest.raises(ValueError):
            access_log.query_log(**bad)


def test_grain_floor():
    assert kanon.rescue_floor() == pytest.approx(0.7778, abs=1e-4)


def test_separates(spark):
    rows = spark.createDataFrame([(1, "accept"), (1, "review"), (2, "accept")], "k int, band string")
    assert kanon.separates(rows, "k").first()["separates"] is False


def test_mart_tables(spark):
    assert tables.mart_insert("daily").startswith("INSERT INTO mart.daily SELECT CAST(o.o_orderdate AS DATE) AS day")
