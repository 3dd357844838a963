"""Who could have read a column and who did: grants, roles, a query log and lineage, joined."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READS = ["select", "all"]


def in_window(events: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Events of the days from start to end, both included; a window that ends before it starts is refused."""
    if start is not None and end is not None and start > end:
        raise ValueError(f"a window from {start} to {end} holds nothing")
    if start is not None:
        events = events.where(F.col("at") >= F.lit(start))
    return events.where(F.col("at") <= F.lit(end)) if end is not None else events


def users_by_role(members: DataFrame) -> DataFrame:
    return members.groupBy("role").agg(F.sort_array(F.collect_set("user")).alias("users"))


def readable_tables(grants: DataFrame) -> DataFrame:
    return grants.where(F.col("privilege").isin(READS)).groupBy("role").agg(F.sort_array(F.collect_set("table")).alias("tables"))


def _table(address):
    return F.regexp_replace(address, r"\.[^.]*$", "")


def exposures(addresses: DataFrame, grants: DataFrame, members: DataFrame, events: DataFrame, carried: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """One row for each address: sorted arrays of users, direct, through_a_carrier, named_the_column, named_a_carrier, star_over_a_holder, and carriers.

    ``carried`` has (origin, node). Of an event only the strongest reading counts: it names the column, or
    a carrier, or is a star over a table that holds one. The log is exploded once by column and once by
    table and joined on them; users are deduplicated before they are gathered.
    """
    carriers = carried.select(F.col("origin").alias("address"), F.col("node").alias("carrier"))
    holder = addresses.select("address", F.col("address").alias("held"), F.lit(1).alias("rank")).unionByName(carriers.select("address", F.col("carrier").alias("held"), F.lit(2).alias("rank")))
    tables = holder.select("address", _table(F.col("held")).alias("table"), "rank").groupBy("address", "table").agg(F.min("rank").alias("rank"))

    able = grants.where(F.col("privilege").isin(READS)).select("role", "table").distinct().join(members, "role").join(tables, "table")
    able = able.groupBy("address", "user").agg(F.min("rank").alias("rank"))

    seen = in_window(events, start, end)
    by_column = seen.select("query_id", "user", F.explode("columns").alias("held")).join(holder, "held").select("address", "query_id", "user", "rank")
    by_star = seen.where("select_star").select("query_id", "user", F.explode("tables").alias("table")).join(tables, "table").select("address", "query_id", "user", F.lit(3).alias("rank"))
    did = by_column.unionByName(by_star).groupBy("address", "query_id", "user").agg(F.min("rank").alias("rank")).select("address", "user", "rank").distinct()

    users = lambda rank: F.sort_array(F.collect_set(F.when(F.col("rank") == rank, F.col("user"))))
    could = able.groupBy("address").agg(users(1).alias("direct"), users(2).alias("through_a_carrier"))
    read = did.groupBy("address").agg(users(1).alias("named_the_column"), users(2).alias("named_a_carrier"), users(3).alias("star_over_a_holder"))
    into = carriers.groupBy("address").agg(F.sort_array(F.collect_set("carrier")).alias("carriers"))
    out = addresses.select("address").join(could, "address", "left").join(read, "address", "left").join(into, "address", "left")
    none = F.array().cast("array<string>")
    return out.select("address", *[F.coalesce(c, none).alias(c) for c in ("direct", "through_a_carrier", "named_the_column", "named_a_carrier", "star_over_a_holder", "carriers")])


def derived(exposure: DataFrame) -> DataFrame:
    """The sets that follow: could_have_read, did_read, did_read_at_most, only_by_star, read_without_a_direct_grant, granted_and_never_used."""
    union = lambda a, b: F.sort_array(F.array_union(a, b))
    less = lambda a, b: F.sort_array(F.array_except(a, b))
    out = exposure.withColumn("could_have_read", union("direct", "through_a_carrier")).withColumn("did_read", union("named_the_column", "named_a_carrier"))
    out = out.withColumn("did_read_at_most", union("did_read", "star_over_a_holder")).withColumn("only_by_star", less("star_over_a_holder", "did_read"))
    return out.withColumn("read_without_a_direct_grant", less("did_read", "direct")).withColumn("granted_and_never_used", less("could_have_read", "did_read_at_most"))


def star_share(events: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    return in_window(events, start, end).agg(F.count_if("select_star").alias("stars"), F.count("*").alias("queries"))


def unanswerable(sets: DataFrame) -> DataFrame:
    """Addresses that only stars may have read."""
    return sets.where((F.size("did_read") == 0) & (F.size("did_read_at_most") > 0)).select("address")


def unused_grants(sets: DataFrame) -> DataFrame:
    """Users who could read one of the addresses and read none."""
    used = sets.select(F.explode("did_read_at_most").alias("user")).distinct()
    return sets.select(F.explode("could_have_read").alias("user")).distinct().join(used, "user", "left_anti")


def widening(exposure: DataFrame) -> DataFrame:
    """(address, direct, more, carriers): how many more users derivations let in."""
    return exposure.where(F.size("through_a_carrier") > 0).select("address", F.size("direct").alias("direct"), F.size("through_a_carrier").alias("more"), F.array_join("carriers", ", ").alias("carriers"))


def retention(events: DataFrame, last: dt.date, days: list[int]) -> DataFrame:
    """(days, queries, stars): what is left of the log when only the last days are kept. One pass for all windows."""
    each = events.withColumn("days", F.explode(F.array(*map(F.lit, days)))).where((F.col("at") <= F.lit(last)) & (F.col("at") > F.date_sub(F.lit(last), F.col("days"))))
    return each.groupBy("days").agg(F.count("*").alias("queries"), F.count_if("select_star").alias("stars"))


def summary(grants: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """(grants, roles, users, queries, stars, first, last): the size of an access log."""
    who = members.agg(F.countDistinct("role").alias("roles"), F.countDistinct("user").alias("users"))
    said = events.agg(F.count("*").alias("queries"), F.count_if("select_star").alias("stars"), F.min("at").alias("first"), F.max("at").alias("last"))
    return grants.agg(F.count("*").alias("grants")).join(F.broadcast(who)).join(F.broadcast(said))  # one row each
