"""SQL for DuckDB that says the same as the operators, put together from the same rules."""

from __future__ import annotations

from quillon.plans import rules

PREDICATES = {
    "email": r"regexp_matches(v, '^[^@[:space:]]+@[^@[:space:]]+\.[A-Za-z]{2,}$')",
    "national_id": "regexp_matches(v, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')",
    "ip_address": r"regexp_matches(v, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$')",
    "phone": r"regexp_matches(regexp_replace(v, '[-. ()]', '', 'g'), '^\+?[0-9]{10,15}$')",
    "payment_card": "regexp_matches(regexp_replace(v, '[- ]', '', 'g'), '^[0-9]{13,19}$')",
    "sex": f"lower(v) IN ({', '.join(repr(w) for w in rules.SEX_WORDS)})",
}
STRENGTHS = {"email": 0.90, "national_id": 0.90, "ip_address": 0.85, "phone": 0.70, "payment_card": 0.75, "sex": 0.70}

# name, type of every column of the tables
COLUMNS = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in COLUMNS[table].split(", ")]


def as_text(column: str, kind: str) -> str:
    if kind.endswith("[]"):
        return f"array_to_string(list_transform({column}, lambda e: {as_text('e', kind[:-2])}), ',')"
    return f"CAST(TRY_CAST(CAST({column} AS DOUBLE) AS DECIMAL(38,6)) AS VARCHAR)" if kind in ("DOUBLE", "FLOAT") else f"CAST({column} AS VARCHAR)"


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]" if x else "CAST([] AS VARCHAR[])"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], names: str) -> str:
    """A table of rows; none of them still has its names."""
    if not rows:
        return f"(SELECT * FROM (VALUES ({', '.join('NULL' for _ in names.split(','))})) t({names}) WHERE false)"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names}))"


def profile(table: str, keys: tuple[str, ...] = (), source: str | None = None) -> str:
    """One row for each column of a table, one statement a column."""
    parts = []
    for column, kind in columns_of(table):
        hits = ", ".join(f"count(*) FILTER ({p}) AS {k}_hits" for k, p in PREDICATES.items())
        parts.append(f"""SELECT '{table}' AS "table", '{column}' AS "column", '{kind}' AS sql_type, {literal(column not in keys)} AS nullable, {literal(column in keys)} AS is_key,
  count(*) AS rows, count(v) AS non_null, count(DISTINCT v) AS "distinct", round(coalesce(avg(length(v)), 0), 6) AS mean_length, {hits}
  FROM (SELECT {as_text(column, kind)} AS v FROM {source or table})""")
    return "\nUNION ALL\n".join(parts)


def warehouse(keys: dict[str, tuple[str, ...]]) -> str:
    return "\nUNION ALL\n".join(profile(t, keys[t]) for t in keys)


def evidence(profile_sql: str, arms: tuple[str, ...] = ("name", "value", "structure")) -> str:
    """CTEs ``profile`` and ``evidence`` ("table", "column", arm, category, strength, support)."""
    ratio = 'CASE WHEN rows = 0 THEN 0 ELSE non_null / rows END'
    values_ = "\nUNION ALL\n".join(f'''SELECT "table", "column", 'value' AS arm, '{k}' AS category, CAST({s} AS DOUBLE) * ({k}_hits / non_null) AS strength, {ratio} AS support FROM profile WHERE non_null > 0 AND {k}_hits / non_null >= {rules.VALUE_FLOOR}''' for k, s in STRENGTHS.items())
    return f"""profile AS ({profile_sql}),
name_rules AS (SELECT * FROM {values([(n, c, s) for n, c, s in rules.NAME_RULES], "needles, category, strength")}),
words AS (SELECT "table", "column", list_filter(regexp_split_to_array(lower(regexp_replace("column", '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+'), lambda x: x <> '') AS words FROM profile),
evidence AS (SELECT * FROM (
SELECT "table", "column", 'name' AS arm, category, strength, CAST(1 AS DOUBLE) AS support FROM words, name_rules
  WHERE len(list_filter(needles, lambda n: list_contains(words, n) OR n = array_to_string(words, ''))) > 0
UNION ALL SELECT "table", "column", 'name', 'event_date', CAST({rules.TEMPORAL_NAME_STRENGTH} AS DOUBLE), 1 FROM words WHERE words[len(words)] IN ({', '.join(map(literal, rules.TEMPORAL_SUFFIXES))})
UNION ALL {values_}
UNION ALL SELECT "table", "column", 'value', 'free_text_clinical', CAST({rules.FREE_TEXT_STRENGTH} AS DOUBLE), {ratio} FROM profile WHERE non_null > 0 AND mean_length >= {rules.FREE_TEXT_LENGTH} AND "distinct" / non_null >= {rules.FREE_TEXT_DISTINCT}
UNION ALL SELECT "table", "column", 'structure', 'event_date', CAST({rules.TEMPORAL_TYPE_STRENGTH} AS DOUBLE), 1 FROM profile WHERE NOT is_key AND sql_type IN ({', '.join(map(literal, rules.TEMPORAL_TYPES))})
) WHERE arm IN ({', '.join(map(literal, arms))}))"""


def verdicts(source: str, name: str, columns: str = "profile") -> str:
    """A CTE of verdicts over the evidence in ``source``."""
    same = [(a, b) for a in rules.IDENTIFIABILITY for b in rules.IDENTIFIABILITY if a != b and rules.same_fact(a, b)]
    return f"""{name}_scores AS (SELECT "table", "column", category, 1 - list_reduce(list_transform(list_sort(list(strength * support)), lambda w: 1 - w), lambda a, x: a * x) AS score, count(*) AS n FROM {source} GROUP BY ALL),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY score DESC, category) AS rnk FROM {name}_scores),
{name}_best AS (SELECT "table", "column", max(category) FILTER (rnk = 1) AS category, max(score) FILTER (rnk = 1) AS best, max(category) FILTER (rnk = 2) AS runner_up, coalesce(max(score) FILTER (rnk = 2), 0) AS second, sum(n)::BIGINT AS fired FROM {name}_ranked GROUP BY ALL),
{name}_rows AS (SELECT p."table", p."column", coalesce(b.category, 'not_personal') AS category,
  round(coalesce(CASE WHEN b.runner_up IS NULL OR (b.category, b.runner_up) IN ({', '.join('(' + literal(a) + ', ' + literal(b) + ')' for a, b in same)}) THEN best ELSE best * (1 - {rules.CONFLICT_PENALTY} * second) END, 0), 4) AS confidence,
  b.runner_up, round(coalesce(b.second, 0), 4) AS runner_up_score, coalesce(b.fired, 0) AS fired
  FROM (SELECT DISTINCT "table", "column" FROM {columns}) p LEFT JOIN {name}_best b USING ("table", "column")),
{name} AS (SELECT *, {band('category', 'confidence')} AS band, {level('category')} AS identifiability FROM {name}_rows)"""


def band(category: str, confidence: str) -> str:
    return f"CASE WHEN {category} = 'not_personal' THEN 'ignore' WHEN {confidence} >= {rules.ACCEPT_AT} THEN 'accept' WHEN {confidence} >= {rules.REVIEW_AT} THEN 'review' ELSE 'ignore' END"


def level(category: str) -> str:
    return f"CASE {category} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.IDENTIFIABILITY.items()) + " END"


def settled(source: str = "evidence", name: str = "settled", columns: str = "profile") -> str:
    """CTEs ``alone``, ``linked`` and the verdicts of round one."""
    return f"""{verdicts(source, "alone", columns)},
linked AS (SELECT "table", coalesce(bool_or(identifiability = 'direct' AND confidence >= {rules.REVIEW_AT}), false) AS linked FROM alone GROUP BY ALL),
{name}_evidence AS (SELECT e.* FROM {source} e JOIN linked USING ("table") WHERE linked OR category <> 'event_date'),
{verdicts(f"{name}_evidence", name, columns)}"""


def target(category: str) -> str:
    found = {key: rules.PERMITTED[rules.FAMILY[t]] for key, lv, _, t in rules.TAXONOMY if lv == "quasi" and t}
    return f"CASE {category} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in found.items()) + " END"


def policies(source: str = "settled") -> str:
    action = f"CASE WHEN band = 'review' THEN 'review' WHEN identifiability = 'direct' THEN 'redact' WHEN identifiability = 'quasi' AND {target('category')} IS NOT NULL THEN 'generalise' ELSE 'retain' END"
    return f"""policies AS (SELECT "table", "column", category, confidence, action, CASE WHEN action = 'generalise' THEN {target('category')} END AS target, action = 'retain' AND identifiability = 'none' AND fired = 0 AS evidence_only FROM (SELECT *, {action} AS action FROM {source}))"""


def residual(source: str, keys: list[str], weight: str | None = None) -> str:
    size = "count(*)" if weight is None else f"sum({weight})"
    return f"""SELECT min(s) AS k, count(*) AS groups, coalesce(sum(CASE WHEN s = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS singletons, coalesce(sum(s), 0)::BIGINT AS population,
  sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) / sum(s) AS alone_share FROM (SELECT CAST({size} AS BIGINT) AS s FROM {source} GROUP BY {', '.join(keys)})"""


def uniqueness(source: str, columns: list[str]) -> str:
    cells = " * ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM {source}))" for c in columns)
    return f"""SELECT * REPLACE (round(measured, 12) AS measured, round(uniform, 12) AS uniform), round(measured - uniform, 12) + 0.0::DOUBLE AS shape_effect FROM (SELECT *, unique_rows / rows AS measured, CASE WHEN rows = 0 THEN 0 ELSE pow(1 - 1 / cells, rows - 1) END AS uniform FROM (
  SELECT {len(columns)} AS columns, sum(s)::BIGINT AS rows, count(*) AS combinations, count(*) FILTER (s = 1) AS unique_rows, min(s) AS k, CAST({cells} AS DOUBLE) AS cells
  FROM (SELECT count(*) AS s FROM {source} GROUP BY {', '.join(columns)})))"""
