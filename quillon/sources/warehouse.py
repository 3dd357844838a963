"""A planted warehouse: people, encounters, claims and readings drawn from seeded hashes, with an answer key.

Every value is a function of (seed, table.column, row id), so the tables come out the same in any
partitioning, and another column or row changes none of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.sources.catalog import Catalog, Reference, Table, quoted, sql_type

SEED, TODAY, NULL_RATE = 20260917, "2026-09-17", 0.02

# Words to draw from, and what each column holds.
FIRST_NAMES = ["Ada", "Ben", "Cora", "Dev", "Elif", "Femi", "Gita", "Hugo", "Ines", "Jun", "Kofi", "Lena", "Mila", "Nils", "Omar", "Pia"]
LAST_NAMES = ["Abara", "Bauer", "Chen", "Diaz", "Eriksen", "Farouk", "Garcia", "Haddad", "Ito", "Jensen", "Kumar", "Lopez", "Moreau", "Novak"]
STREETS = ["Oak", "Elm", "Mill", "Lake", "Hill", "Park", "Church", "Station"]
CITIES = ["Northfield", "Easton", "Southport", "Westbury", "Midvale"]
DEPARTMENTS = ["cardiology", "oncology", "surgery", "pediatrics", "radiology"]
LABELS = {
    "raw.patient": {
        "patient_id": "not_personal", "mrn": "medical_record_number", "first_name": "person_name", "last_name": "person_name", "email": "email",
        "phone": "phone", "street_address": "street_address", "city": "postal_code", "postal_code": "postal_code", "birth_date": "birth_date",
        "sex": "sex", "ssn": "national_id", "created_at": "not_personal",
    },
    "raw.encounter": {
        "encounter_id": "not_personal", "patient_id": "not_personal", "admitted_at": "event_date", "discharged_at": "event_date", "department": "not_personal",
        "attending_npi": "licence_number", "primary_diagnosis": "health_condition", "clinical_note": "free_text_clinical", "disposition": "not_personal",
    },
    "raw.claim": {
        "claim_id": "not_personal", "encounter_id": "not_personal", "member_number": "health_plan_id", "payer_name": "not_personal", "billed_amount": "not_personal",
        "paid_amount": "not_personal", "claim_status": "not_personal", "submitted_on": "event_date",
    },
    "raw.device_reading": {
        "reading_id": "not_personal", "patient_id": "not_personal", "device_serial": "device_id", "taken_at": "event_date", "metric": "not_personal",
        "reading_value": "not_personal", "source_ip": "ip_address",
    },
    "analytics.encounter_daily": {"day": "event_date", "department": "not_personal", "postal_code": "postal_code", "encounters": "not_personal", "mean_length_of_stay_h": "not_personal"},
}
# How fine the planted dates and places are.
OBSERVED = {
    ("raw.patient", "city"): "postal_3", ("raw.patient", "postal_code"): "postal_5", ("raw.patient", "birth_date"): "day",
    ("raw.encounter", "admitted_at"): "second", ("raw.encounter", "discharged_at"): "second", ("raw.claim", "submitted_on"): "day",
    ("raw.device_reading", "taken_at"): "second", ("analytics.encounter_daily", "day"): "day", ("analytics.encounter_daily", "postal_code"): "postal_5",
}
# Postal codes by rule, and the statement that builds the mart.
POSTAL_CODES = [f"1{101 + 7 * i:04d}" for i in range(60)]
MART = (
    "INSERT INTO analytics.encounter_daily SELECT CAST(e.admitted_at AS DATE) AS day, e.department AS department, p.postal_code AS postal_code, "
    "count(*) AS encounters, avg(date_diff('minute', e.admitted_at, e.discharged_at) / 60.0) AS mean_length_of_stay_h "
    "FROM raw.encounter e JOIN raw.patient p ON e.patient_id = p.patient_id GROUP BY 1, 2, 3"
)


class _Draw:
    """Named streams of one table: whole numbers, choices and nulls by row id."""

    def __init__(self, table: str, seed: int, null_rate: float):
        self.table, self.seed, self.null_rate = table, seed, null_rate

    def whole(self, name: str, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(f"{self.table}.{name}"), "id"), F.lit(below))

    def choice(self, name: str, members: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, members)), self.whole(name, len(members)).cast("int"))

    def digits(self, name: str, width: int) -> Column:
        return F.lpad(self.whole(name, 10**width).cast("string"), width, "0")

    def share(self, name: str) -> Column:
        """A number from 0 on, below 1."""
        return self.whole(name, 1_000_000_000) / F.lit(1e9)

    def weighted(self, name: str, members: list[str], weights: list[float]) -> Column:
        """A choice by weights: how many of the running sums the share has passed."""
        total, sums = sum(weights), []
        for w in weights[:-1]:
            sums.append((sums[-1] if sums else 0.0) + w / total)
        passed = F.size(F.filter(F.array(*map(F.lit, sums)), lambda x: x <= self.share(name)))
        return F.get(F.array(*map(F.lit, members)), passed)

    def triangular(self, name: str, low: float, high: float, mode: float) -> Column:
        """The inverse of a triangular distribution at the share."""
        u, cut = self.share(name), (mode - low) / (high - low)
        return F.when(u < cut, low + F.sqrt(u * ((high - low) * (mode - low)))).otherwise(high - F.sqrt((1 - u) * ((high - low) * (high - mode))))

    def maybe(self, name: str, value: Column) -> Column:
        return F.when(self.whole(f"{name} is null", 10_000) >= int(self.null_rate * 10_000), value)


def patients(spark: SparkSession, n: int, seed: int = SEED, null_rate: float = NULL_RATE) -> DataFrame:
    d = _Draw("raw.patient", seed, null_rate)
    first, last = d.choice("first_name", FIRST_NAMES), d.choice("last_name", LAST_NAMES)
    age = F.floor(d.triangular("birth_date", 0, 95, 46)).cast("int")
    born = F.date_add(F.make_date(F.lit(int(TODAY[:4])) - age, F.lit(1), F.lit(1)), d.whole("birth day", 365).cast("int"))
    columns = {
        "mrn": F.concat(F.lit("MR"), d.digits("mrn", 7)), "first_name": first, "last_name": last,
        "email": F.concat_ws("", F.lower(first), F.lit("."), F.lower(last), F.col("id"), F.lit("@example.org")), "phone": F.concat(F.lit("+1555"), d.digits("phone", 7)),
        "street_address": F.concat_ws(" ", d.whole("house", 900) + 1, d.choice("street", STREETS), F.lit("Street")), "city": d.choice("city", CITIES),
        "postal_code": d.weighted("postal_code", POSTAL_CODES, [1 / (i + 1) for i in range(len(POSTAL_CODES))]), "birth_date": born, "sex": d.choice("sex", ["F", "M", "X"]),
        "ssn": F.concat_ws("-", d.digits("ssn a", 3), d.digits("ssn b", 2), d.digits("ssn c", 4)),
    }
    made = [(c if k == "mrn" else d.maybe(k, c)).alias(k) for k, c in columns.items()]
    created = (F.lit(f"{TODAY} 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(d.whole("created_at", 900).cast("int"))).alias("created_at")
    return spark.range(1, n + 1).select(F.col("id").alias("patient_id"), *made, created)


def encounters(spark: SparkSession, n: int, patients_: int, seed: int = SEED, null_rate: float = NULL_RATE) -> DataFrame:
    d = _Draw("raw.encounter", seed, null_rate)
    admitted = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(d.whole("day", 620).cast("int"), F.lit(0), d.whole("minute", 1440).cast("int"))
    stay = F.make_dt_interval(F.lit(0), F.lit(0), (d.whole("stay", 10_000) + 30).cast("int"))
    diagnosis = F.concat(d.choice("chapter", list("ABCEIJ")), d.digits("diagnosis", 2))
    note = F.concat_ws(" ", F.lit("Seen for"), diagnosis, F.lit("and sent on to"), d.choice("sent", DEPARTMENTS), F.lit("after"), d.whole("hours", 90), F.lit("hours of observation."))
    columns = {"discharged_at": admitted + stay, "department": d.choice("department", DEPARTMENTS), "attending_npi": F.concat(F.lit("1"), d.digits("npi", 9)), "primary_diagnosis": diagnosis, "clinical_note": note, "disposition": d.choice("disposition", ["home", "transfer", "follow up"])}
    return spark.range(1, n + 1).select(F.col("id").alias("encounter_id"), (d.whole("patient_id", patients_) + 1).alias("patient_id"), admitted.alias("admitted_at"), *[d.maybe(k, c).alias(k) for k, c in columns.items()])


def claims(spark: SparkSession, n: int, encounters_: int, seed: int = SEED, null_rate: float = NULL_RATE) -> DataFrame:
    d = _Draw("raw.claim", seed, null_rate)
    billed = (d.whole("billed", 5_000_000) / 100).cast("decimal(12,2)")
    columns = {"member_number": F.concat(F.lit("H"), d.digits("member", 9)), "payer_name": d.choice("payer", ["Harbor Mutual", "Union Care", "State Plan"]), "billed_amount": billed, "paid_amount": (billed * 4 / 5).cast("decimal(12,2)"), "claim_status": d.choice("status", ["paid", "denied", "open"]), "submitted_on": F.date_sub(F.lit(TODAY).cast("date"), d.whole("submitted", 600).cast("int"))}
    return spark.range(1, n + 1).select(F.col("id").alias("claim_id"), (d.whole("encounter_id", encounters_) + 1).alias("encounter_id"), *[d.maybe(k, c).alias(k) for k, c in columns.items()])


def readings(spark: SparkSession, n: int, patients_: int, seed: int = SEED, null_rate: float = NULL_RATE) -> DataFrame:
    d = _Draw("raw.device_reading", seed, null_rate)
    taken = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(d.whole("day", 250).cast("int"), F.lit(0), d.whole("minute", 1440).cast("int"))
    ip = F.concat_ws(".", F.lit("10"), d.whole("ip a", 256), d.whole("ip b", 256), d.whole("ip c", 254) + 1)
    columns = {"metric": d.choice("metric", ["pulse", "glucose", "pressure"]), "reading_value": (d.whole("value", 2000) / 10).cast("double"), "source_ip": ip}
    serial = d.maybe("device_serial", F.concat(F.lit("DV-"), d.digits("serial", 6)))
    return spark.range(1, n + 1).select(F.col("id").alias("reading_id"), (d.whole("patient_id", patients_) + 1).alias("patient_id"), serial.alias("device_serial"), taken.alias("taken_at"), *[d.maybe(k, c).alias(k) for k, c in columns.items()])


def daily(encounter: DataFrame, patient: DataFrame, by: tuple[str, ...] = ("day", "department", "postal_code"), unit: str = "day") -> DataFrame:
    """The mart, or a coarser one by fewer keys or months."""
    hours = values.minutes_between(F.col("admitted_at"), F.col("discharged_at")) / F.lit(60.0)
    joined = encounter.join(patient.select("patient_id", "postal_code"), "patient_id").withColumn("day", F.to_date(F.date_trunc(unit, "admitted_at")))
    return joined.groupBy(*by).agg(F.count("*").alias("encounters"), F.avg(hours).alias("mean_length_of_stay_h"))


def planted(spark: SparkSession, patients_: int = 1000, seed: int = SEED, null_rate: float = NULL_RATE) -> Catalog:
    """The five tables with keys and references. Encounters are three for two patients, claims and readings two each."""
    visits = patients_ * 3 // 2
    p, e = patients(spark, patients_, seed, null_rate), encounters(spark, visits, patients_, seed, null_rate)
    to_patient = Reference(("patient_id",), "raw.patient", ("patient_id",))
    return Catalog(spark).add(
        Table("raw.patient", p, ("patient_id",), ("mrn", "created_at")),
        Table("raw.encounter", e, ("encounter_id",), ("patient_id", "admitted_at"), (to_patient,)),
        Table("raw.claim", claims(spark, 2 * visits, visits, seed, null_rate), ("claim_id",), ("encounter_id",), (Reference(("encounter_id",), "raw.encounter", ("encounter_id",)),)),
        Table("raw.device_reading", readings(spark, 2 * patients_, patients_, seed, null_rate), ("reading_id",), ("patient_id", "taken_at"), (to_patient,)),
        Table("analytics.encounter_daily", daily(e, p), (), ("day", "encounters")),
    )


def labels(spark: SparkSession) -> DataFrame:
    """(table, column, label, observed): the answer key."""
    return spark.createDataFrame([(t, c, k, OBSERVED.get((t, c))) for t, columns in LABELS.items() for c, k in columns.items()], "table string, column string, label string, observed string")


def ddl(table: Table) -> str:
    """CREATE TABLE with what the catalog knows; for engines that keep constraints."""
    lines = [f"  {quoted(f.name)} {sql_type(f.dataType)}{'' if table.nullable(f.name) else ' NOT NULL'}" for f in table.data.schema]
    lines += [f"  PRIMARY KEY ({', '.join(quoted(c) for c in table.key)})"] if table.key else []
    lines += [f"  FOREIGN KEY ({', '.join(map(quoted, r.columns))}) REFERENCES {quoted(*r.table.split('.'))} ({', '.join(map(quoted, r.parent))})" for r in table.references]
    return f"CREATE TABLE {quoted(*table.name.split('.'))} (\n" + ",\n".join(lines) + "\n)"


def saved(catalog: Catalog, folder: str) -> Catalog:
    """The catalog with its tables written as Parquet and read back from there, with as many rows as before."""
    out = Catalog(catalog.spark)
    for t in catalog.tables.values():
        path = f"{folder}/{t.name}.parquet"
        t.data.write.mode("overwrite").parquet(path)
        out.add(Table(t.name, catalog.spark.read.parquet(path), t.key, t.not_null, t.references))
    return out


def renamed(table: Table) -> Table:
    """The table with meaningless column names, to see what values alone tell."""
    new = {c: f"c{i + 1:02d}" for i, c in enumerate(table.data.columns)}
    return Table(table.name, table.data.toDF(*new.values()), tuple(new[c] for c in table.key), tuple(new[c] for c in table.not_null))


def wide(spark: SparkSession, width: int, rows: int) -> DataFrame:
    """A table of an id and ``width`` columns that cycle through emails, cards, codes, sexes and nulls."""
    kinds = [
        "concat('user', id, '@example.org')", "concat('4', lpad(cast(id as string), 15, '0'))", "concat('AB', lpad(cast(id % 1000 as string), 6, '0'))",
        "CASE WHEN id % 2 = 0 THEN 'M' ELSE 'F' END", "CAST(NULL AS STRING)",
    ]
    return spark.range(1, rows + 1).selectExpr("id AS row_id", *[f"{kinds[i % 5]} AS c{i:03d}" for i in range(width)])


def null_counts(catalog: Catalog) -> DataFrame:
    """(table, column, nulls) of every column that may be null."""
    return catalog.nullability().where("nullable").select("table", "column", "nulls")


def statistics(patient: DataFrame) -> DataFrame:
    """(rows, median_age, distinct_postal, nulls): the middle of the sorted ages, not an interpolation."""
    age = F.floor(F.months_between(F.lit(TODAY).cast("date"), "birth_date") / 12)
    nulls = sum((F.col(quoted(c)).isNull().cast("long") for c in patient.columns), F.lit(0).cast("long"))
    ages = patient.withColumn("age", age).withColumn("nulls", nulls).groupBy("age").agg(F.count("*").alias("n"), F.sum("nulls").alias("nulls"), F.collect_set("postal_code").alias("codes"))
    # a row for each age: the median is found by running counts over these
    gathered = ages.agg(F.sort_array(F.collect_list(F.when(F.col("age").isNotNull(), F.struct("age", "n")))).alias("ages"), F.sum("n").alias("rows"), F.sum("nulls").alias("nulls"), F.size(F.array_distinct(F.flatten(F.collect_list("codes")))).cast("long").alias("distinct_postal"))
    counted = gathered.withColumn("known", F.aggregate("ages", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    median = F.expr("aggregate(ages, named_struct('seen', 0L, 'age', cast(null as bigint)), (a, x) -> IF(a.age IS NULL AND a.seen + x.n > known div 2, named_struct('seen', a.seen + x.n, 'age', x.age), named_struct('seen', a.seen + x.n, 'age', a.age)), a -> a.age)")
    return counted.select("rows", "distinct_postal", "nulls", median.alias("median_age"))


OUTSIDE = {"row_id": "not_personal", "travel_doc_ref": "unknown_identifier", "payer_ref": "payment_card", "site_patient_ref": "unknown_identifier", "request_ref": "not_personal"}


def outside(spark: SparkSession, rows: int = 400, seed: int = 20261010) -> Table:
    """References that no name or value rule knows: a travel document, a card written with slashes, patient codes in four
    formats, and request codes that belong to nobody."""
    d = _Draw("outside", seed, 0.0)
    letters = lambda name, n: F.concat(*[F.chr((d.whole(f"{name} {i}", 26) + 65).cast("long")) for i in range(n)])
    body = F.concat(F.lit("5"), d.digits("payer", 14))
    card = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(body, i.cast("string"))), values.luhn), F.lit(0))
    number = F.col("id").cast("int")
    formats = F.array(F.concat(letters("site", 2), d.digits("s1", 6)), F.concat(d.digits("s2", 4), F.lit("-"), d.digits("s3", 4)), F.concat(d.digits("s4", 3), F.lit("/"), letters("tail", 3), d.digits("s5", 3)), F.concat(F.lit("P"), d.digits("s6", 9)))
    made = spark.range(1, rows + 1).select(
        F.col("id").alias("row_id"), F.concat(letters("travel", 2), d.digits("travel number", 7)).alias("travel_doc_ref"),
        F.concat_ws("/", *[F.substring(card, k, 4) for k in (1, 5, 9, 13)]).alias("payer_ref"), F.get(formats, number % 4).alias("site_patient_ref"),
        F.concat(letters("request", 4), d.digits("request number", 4), letters("request end", 4)).alias("request_ref"),
    )
    return Table("bench.outside", made, ("row_id",))


def round_two(spark: SparkSession, total: int, marts: int = 3, rows: int = 200) -> tuple[Catalog, list[tuple]]:
    """A person table, marts grouped from it and tables that name nobody, ``total`` in all; and the edges of the marts."""
    if total < 1 + marts:
        raise ValueError(f"{total} tables can't hold a person table and {marts} marts")
    ids = spark.range(rows)
    person = ids.select(F.col("id").alias("person_id"), F.concat(F.lit("user"), "id", F.lit("@example.org")).alias("email"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("admitted_at"))
    mart = person.groupBy(F.col("admitted_at").alias("day")).agg(F.count("*").alias("encounters"))
    ref = ids.select(F.concat(F.lit("K"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("code"), F.col("id").alias("amount"))
    found = Catalog(spark).add(Table("bench.person", person, ("person_id",)))
    found.add(*[Table(f"bench.mart_{i}", mart) for i in range(marts)], *[Table(f"bench.ref_{i}", ref) for i in range(total - 1 - marts)])
    edges = [("bench.person", source, f"bench.mart_{i}", target, kind, "") for i in range(marts) for source, target, kind in (("admitted_at", "day", "grouped"), ("*", "encounters", "aggregate"))]
    return found, edges
