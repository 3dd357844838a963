"""Policies: what happens to each column, the expressions that do it, and the risk that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.operators import kanon
from quillon.operators.classify import counted
from quillon.plans import rules
from quillon.sources.catalog import quoted

GENERALISED = {"year": values.year, "postal_3": values.postal_3}


def _target(category: Column) -> Column:
    found = {key: rules.PERMITTED[rules.FAMILY[t]] for key, level, _, t in rules.TAXONOMY if level == "quasi" and t}
    return F.create_map(*[x for k, v in found.items() for x in (F.lit(k), F.lit(v))])[category]


def _settled(category: Column, level: Column) -> Column:
    return F.when(level == "direct", "redact").when((level == "quasi") & _target(category).isNotNull(), "generalise").otherwise("retain")


def policies(verdicts: DataFrame) -> DataFrame:
    """(table, column, category, confidence, action, target, evidence_only). The review band waits for a person; a column
    without evidence is retained on that alone."""
    action = F.when(F.col("band") == "review", "review").otherwise(_settled(F.col("category"), F.col("identifiability")))
    rows = verdicts.withColumn("action", action).withColumn("target", F.when(F.col("action") == "generalise", _target(F.col("category"))))
    alone = (F.col("action") == "retain") & (F.col("identifiability") == "none") & (F.col("fired") == 0)
    return rows.select("table", "column", "category", "confidence", "action", "target", alone.alias("evidence_only"))


def resolved(policy: DataFrame, decisions: DataFrame) -> DataFrame:
    """Policies after the decisions (table, column, personal) of reviewers; a decision on anything not in review is an error."""
    level = F.create_map(*[x for k, v in rules.IDENTIFIABILITY.items() for x in (F.lit(k), F.lit(v))])[F.col("category")]
    met = policy.join(decisions.select("table", "column", "personal"), ["table", "column"], "left")
    wrong = F.col("personal").isNotNull() & (F.col("action") != "review")
    action = F.when(wrong, F.raise_error(F.concat_ws(".", "table", "column")).cast("string")).when(F.col("personal"), _settled(F.col("category"), level)).when(~F.col("personal"), "retain").otherwise(F.col("action"))
    met = met.withColumn("action", action).withColumn("category", F.when(~F.coalesce("personal", F.lit(True)), "not_personal").otherwise(F.col("category")))
    target = F.when(F.col("action") == "generalise", _target(F.col("category")))
    return met.withColumn("target", target).select("table", "column", "category", "confidence", "action", "target", "evidence_only")


def action_counts(policy: DataFrame) -> DataFrame:
    return counted(policy, "action", rules.ACTIONS)


def retained_on_absence(policy: DataFrame) -> DataFrame:
    return policy.where("evidence_only").select("table", "column")


def expression(column: str, action: str, target: str | None, dtype=None) -> Column:
    """The masked column. A column in review has none: it has to be decided before."""
    if action == "redact":
        return F.lit(None).cast(dtype or "string")
    if action == "generalise":
        return GENERALISED[target](F.col(quoted(column)))
    if action == "retain":
        return F.col(quoted(column))
    raise ValueError(f"{column} is in review and can't be masked yet")


def masked(df: DataFrame, table: str, policy: DataFrame) -> DataFrame:
    """The table with every policy applied in one projection; as many policies as it has columns are read by the driver."""
    rows = {r["column"]: r for r in policy.where(F.col("table") == table).collect()}
    return df.select(*[expression(f.name, rows[f.name]["action"], rows[f.name]["target"], f.dataType).alias(f.name) if f.name in rows else F.col(quoted(f.name)) for f in df.schema])


def residual(df: DataFrame, table: str, policy: DataFrame, weight: str | None = None) -> DataFrame:
    """The groups that are left when the quasi columns of a table are masked. Refused without such a column or with one in review."""
    quasi = [k for k, level in rules.IDENTIFIABILITY.items() if level == "quasi"]
    rows = sorted(policy.where((F.col("table") == table) & F.col("category").isin(quasi)).collect(), key=lambda r: df.columns.index(r["column"]))
    if waiting := [r["column"] for r in rows if r["action"] == "review"]:
        raise ValueError(f"{table}.{waiting[0]} is in review, so there is no policy to measure")
    return kanon.residual(df, [expression(r["column"], r["action"], r["target"]) for r in rows], weight)
