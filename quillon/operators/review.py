"""The review queue: which undecided columns hold up which tables, and what decisions free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans import rules

RANK = {"direct": 0, "quasi": 1, "sensitive": 2, "none": 3}


def _table(address: Column) -> Column:
    return F.regexp_replace(address, r"\.[^.]*$", "")


def queue(verdicts: DataFrame, policies: DataFrame, carried: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns in review with the tables that wait for them, in the order in which they should be decided.

    A column blocks its own table and those that its values are carried into, if they are in the warehouse.
    First come columns that alone block most tables, then those that block most, then the most
    identifying, then the nearest to acceptance, then by name. ``carried`` and ``sources`` have (origin, node).
    """
    tables = verdicts.select("table").distinct()
    address = F.concat_ws(".", "table", "column")
    waiting = policies.where("action = 'review'").select(address.alias("address"), "table", "column")
    items = waiting.join(verdicts.select("table", "column", "category", "confidence", "identifiability", "runner_up", "runner_up_score"), ["table", "column"])
    held = items.select("address", "table").unionByName(carried.join(items.select(F.col("address").alias("origin")), "origin", "left_semi").select(F.col("origin").alias("address"), _table(F.col("node")).alias("table")))
    held = held.distinct().join(tables, "table", "left_semi").withColumn("alone", F.count("*").over(Window.partitionBy("table")) == 1)
    blocked = held.groupBy("address").agg(F.sort_array(F.collect_set("table")).alias("tables_blocked"), F.sort_array(F.collect_set(F.when(F.col("alone"), F.col("table")))).alias("sole_blocker_of"))
    ends = lambda df, name: df.groupBy(F.col("origin").alias("address")).agg(F.sort_array(F.collect_set("node")).alias(name))
    none = F.array().cast("array<string>")
    out = items.join(blocked, "address", "left").join(ends(carried, "carried_into"), "address", "left").join(ends(sources, "came_from"), "address", "left")
    out = out.select("address", "table", "column", "category", "confidence", "identifiability", "runner_up", "runner_up_score", F.round(rules.ACCEPT_AT - F.col("confidence"), 4).alias("distance"), *[F.coalesce(c, none).alias(c) for c in ("tables_blocked", "sole_blocker_of", "carried_into", "came_from")])
    level = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("identifiability")]
    order = Window.orderBy(F.desc(F.size("sole_blocker_of")), F.desc(F.size("tables_blocked")), level, "distance", "address")
    return out.withColumn("place", F.row_number().over(order))


def unblocked(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tables all of whose waiting columns have a decision (address)."""
    met = queue.select("address", F.explode("tables_blocked").alias("table")).join(decisions.select("address", F.lit(True).alias("done")), "address", "left")
    return met.groupBy("table").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("free")).where("free").select("table")


def still_open(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    return queue.join(decisions, "address", "left_anti")


def worked_share(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    met = queue.select("address").join(decisions.select("address", F.lit(True).alias("done")).distinct(), "address", "left")
    return met.agg(F.count("done").alias("decided"), F.count("*").alias("queued"))


def frees_a_table(queue: DataFrame) -> DataFrame:
    return queue.where(F.size("sole_blocker_of") > 0)


def trail(decisions: DataFrame) -> DataFrame:
    """(line): decisions (address, personal, reviewer, decided_at, note) as they were made; one without a reviewer or a note is refused."""
    unsaid = (F.length(F.trim(F.coalesce("reviewer", F.lit("")))) == 0) | (F.length(F.trim(F.coalesce("note", F.lit("")))) == 0)
    word = F.when(F.col("personal"), "personal").otherwise("not personal")
    line = F.when(unsaid, F.raise_error(F.concat("address", F.lit(" was decided without a name or a reason"))).cast("string")).otherwise(F.concat_ws("  ", F.col("decided_at").cast("string"), "address", word, "reviewer", "note"))
    return decisions.orderBy("decided_at", "address").select(line.alias("line"))


def briefs(queue: DataFrame) -> DataFrame:
    """(address, text): what a reviewer is told."""
    parts = [
        F.format_string("%s  candidate %s at %.4f", "address", "category", "confidence"),
        F.format_string("  short of the accept threshold by %.4f", "distance"),
        F.when(F.col("runner_up").isNotNull(), F.format_string("  runner up %s at %.4f", "runner_up", "runner_up_score")),
        F.when(F.size("came_from") > 0, F.concat(F.lit("  came from "), F.array_join("came_from", ", "))),
        F.when(F.size("carried_into") > 0, F.concat(F.lit("  carried into "), F.array_join("carried_into", ", "))),
        F.when(F.size("sole_blocker_of") > 0, F.concat(F.lit("  frees "), F.array_join("sole_blocker_of", ", "))),
        F.when(F.size("tables_blocked") == 0, F.lit("  blocks nothing measurable")),
    ]
    return queue.select("address", F.concat_ws("\n", *parts).alias("text"))
