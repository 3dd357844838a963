"""Classification: evidence of four arms, combined for each column, settled for each table.

Everything is a DataFrame of one row for each column or piece of evidence. Rules are literals in the
expressions, so that no join spreads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.operators.profile import distinct_ratio, support
from quillon.plans import rules

SIGNAL = "table string, column string, arm string, category string, strength double, support double, detail string"
ARMS = ("name", "value", "structure")
ADDRESS = ["table", "column"]


def name_signals(columns: DataFrame) -> DataFrame:
    """Every name rule with a word among the column's words, or equal to all of them joined; and the temporal suffix."""
    words = columns.select(*ADDRESS, values.tokens(F.col("column")).alias("words"))
    table_of_rules = F.array(*[F.struct(F.array(*map(F.lit, needles)).alias("needles"), F.lit(key).alias("category"), F.lit(strength).alias("strength")) for needles, key, strength in rules.NAME_RULES])
    each = words.select(*ADDRESS, "words", F.explode(table_of_rules).alias("rule"))
    hit = F.get(F.expr("filter(rule.needles, n -> array_contains(words, n) or n = array_join(words, ''))"), F.lit(0))
    named = each.withColumn("hit", hit).where("hit is not null").select(*ADDRESS, "rule.category", "rule.strength", F.concat(F.lit("word "), "hit").alias("detail"))
    last = F.get("words", F.size("words") - 1)
    timed = words.where(last.isin(rules.TEMPORAL_SUFFIXES)).select(*ADDRESS, F.lit("event_date").alias("category"), F.lit(rules.TEMPORAL_NAME_STRENGTH).alias("strength"), F.concat(F.lit("ends in "), last).alias("detail"))
    return named.unionByName(timed).select(*ADDRESS, F.lit("name").alias("arm"), "category", "strength", F.lit(1.0).alias("support"), "detail")


def value_signals(profile: DataFrame) -> DataFrame:
    """A pattern that at least 60 % of the values match, by the share that does; and prose by length and variety."""
    strengths = F.create_map(*[x for key, _, s in values.PREDICATES for x in (F.lit(key), F.lit(s))])
    rate = F.col("hits") / F.col("non_null")
    matched = profile.where("non_null > 0").select("*", F.explode("pattern_hits").alias("category", "hits")).where(rate >= rules.VALUE_FLOOR)
    matched = matched.select(*ADDRESS, "category", (strengths[F.col("category")] * rate).alias("strength"), support().alias("support"), F.format_string("%d of %d values match", "hits", "non_null").alias("detail"))
    prose = profile.where((F.col("non_null") > 0) & (F.col("mean_length") >= rules.FREE_TEXT_LENGTH) & (distinct_ratio() >= rules.FREE_TEXT_DISTINCT))
    prose = prose.select(*ADDRESS, F.lit("free_text_clinical").alias("category"), F.lit(rules.FREE_TEXT_STRENGTH).alias("strength"), support().alias("support"), F.format_string("mean length %.0f", "mean_length").alias("detail"))
    return matched.unionByName(prose).select(*ADDRESS, F.lit("value").alias("arm"), "category", "strength", "support", "detail")


def structure_signals(columns: DataFrame) -> DataFrame:
    """Temporal types of columns that are no keys."""
    base = F.trim(F.split_part(F.upper("sql_type"), F.lit("("), F.lit(1)))
    found = columns.where(~F.col("is_key") & base.isin(rules.TEMPORAL_TYPES))
    return found.select(*ADDRESS, F.lit("structure").alias("arm"), F.lit("event_date").alias("category"), F.lit(rules.TEMPORAL_TYPE_STRENGTH).alias("strength"), F.lit(1.0).alias("support"), F.concat(F.lit("type "), "sql_type").alias("detail"))


def signals(profile: DataFrame, arms: Iterable[str] = ARMS, sampled: DataFrame | None = None) -> DataFrame:
    """The evidence of the chosen arms; an arm that isn't chosen costs nothing."""
    made = {"name": lambda: name_signals(profile), "value": lambda: value_signals(profile), "structure": lambda: structure_signals(profile), "sample": lambda: sampled}
    found = [made[a]() for a in arms if a != "sample" or sampled is not None]
    return reduce(DataFrame.unionByName, found) if found else profile.sparkSession.createDataFrame([], SIGNAL)


def identifiability(category: Column) -> Column:
    return F.create_map(*[x for k, level in rules.IDENTIFIABILITY.items() for x in (F.lit(k), F.lit(level))])[category]


def band(category: Column, confidence: Column) -> Column:
    return F.when(category == "not_personal", "ignore").when(confidence >= rules.ACCEPT_AT, "accept").when(confidence >= rules.REVIEW_AT, "review").otherwise("ignore")


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - weight) over a list, sorted first so that the order of rows doesn't matter."""
    return 1 - F.aggregate(F.sort_array(weights), F.lit(1.0), lambda a, x: a * (1 - x))


def decided(columns: DataFrame, evidence: DataFrame) -> DataFrame:
    """One verdict for each column: category, confidence (4 decimals), runner_up, runner_up_score, fired, band, identifiability.

    Weights of a category are combined; the best category wins, by name among equals. The runner-up costs
    confidence unless both say the same. A column without evidence is not personal.
    """
    scored = evidence.groupBy(*ADDRESS, "category").agg(noisy_or(F.collect_list(F.col("strength") * F.col("support"))).alias("score"), F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy(*ADDRESS).orderBy(F.desc("score"), "category"))
    top = scored.withColumn("rank", order)
    pick = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    best = top.groupBy(*ADDRESS).agg(pick(1, "category").alias("category"), pick(1, "score").alias("best"), pick(2, "category").alias("runner_up"), F.coalesce(pick(2, "score"), F.lit(0.0)).alias("second"), F.sum("n").alias("fired"))
    same = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in rules.IDENTIFIABILITY for b in rules.IDENTIFIABILITY if a != b and rules.same_fact(a, b)]
    agrees = F.array_contains(F.array(*same), F.struct(F.col("category").alias("a"), F.col("runner_up").alias("b")))
    confidence = F.when(F.col("runner_up").isNull() | agrees, F.col("best")).otherwise(F.col("best") * (1 - rules.CONFLICT_PENALTY * F.col("second")))
    rows = columns.select(*ADDRESS).join(best, ADDRESS, "left")
    rows = rows.select(*ADDRESS, F.coalesce("category", F.lit("not_personal")).alias("category"), F.round(F.coalesce(confidence, F.lit(0.0)), 4).alias("confidence"), "runner_up", F.round(F.coalesce("second", F.lit(0.0)), 4).alias("runner_up_score"), F.coalesce("fired", F.lit(0)).cast("long").alias("fired"))
    return rows.withColumn("band", band(F.col("category"), F.col("confidence"))).withColumn("identifiability", identifiability(F.col("category")))


def person_linked(verdicts: DataFrame, bar: float = rules.REVIEW_AT) -> DataFrame:
    """(table, linked): whether a table has a direct identifier of at least that confidence."""
    return verdicts.groupBy("table").agg(F.coalesce(F.bool_or((F.col("identifiability") == "direct") & (F.col("confidence") >= bar)), F.lit(False)).alias("linked"))


def settled(columns: DataFrame, evidence: DataFrame, linked: DataFrame) -> DataFrame:
    """Verdicts by (table, linked, factor): dates count only in linked tables, and there by the factor where one is given."""
    kept = evidence.join(linked, "table").where(F.col("linked") | (F.col("category") != "event_date"))
    strength = F.when(F.col("category") == "event_date", F.col("strength") * F.coalesce("factor", F.lit(1.0))).otherwise(F.col("strength"))
    return decided(columns, kept.withColumn("strength", strength).drop("linked", "factor"))


def rescued(verdicts: DataFrame, upstream: DataFrame, bar: float = rules.REVIEW_AT) -> DataFrame:
    """(table): unlinked tables with a linked one upstream; ``upstream`` has (table, source)."""
    linked = person_linked(verdicts, bar)
    sources = linked.where("linked").select(F.col("table").alias("source"))
    return upstream.join(sources, "source", "left_semi").join(linked.where("not linked"), "table", "left_semi").select("table").distinct()


Grain = DataFrame | Callable[[list[str]], DataFrame]


def _factors(saved: DataFrame, grain: Grain | None) -> DataFrame:
    """(table, factor) of the rescued tables. A function is asked once, for these tables alone, and must answer for all."""
    if grain is None:
        return saved.withColumn("factor", F.lit(None).cast("double"))
    if isinstance(grain, DataFrame):
        return saved.join(grain, "table", "left")
    names = sorted(r["table"] for r in saved.collect())  # as many as the schema has tables
    if not names:
        return saved.withColumn("factor", F.lit(None).cast("double"))
    rows = grain(names).select("table", F.col("factor").cast("double").alias("factor")).collect()
    if silent := sorted(set(names) - {r["table"] for r in rows}):
        raise ValueError(f"no grain for {', '.join(silent)}")
    return saved.sparkSession.createDataFrame([(r["table"], r["factor"]) for r in rows if r["table"] in names], "table string, factor double")


def warehouse(profile: DataFrame, evidence: DataFrame, upstream: DataFrame | None = None, grain: Grain | None = None, bar: float = rules.REVIEW_AT) -> DataFrame:
    """The verdicts of a warehouse in two rounds.

    Round one drops dates from tables without a person. Round two, with ``upstream``, gives them back to
    tables derived from linked ones, weakened by ``grain``: (table, factor), or a function that measures it
    for the tables that are rescued and for no others.
    """
    columns = profile.select(*ADDRESS)
    alone = decided(columns, evidence)
    first = settled(columns, evidence, person_linked(alone, bar).withColumn("factor", F.lit(None).cast("double")))
    if upstream is None:
        return first
    saved = rescued(first, upstream, bar)
    factors = _factors(saved, grain)
    second = settled(columns.join(saved, "table", "left_semi"), evidence, factors.select("table", F.lit(True).alias("linked"), "factor"))
    return first.join(saved, "table", "left_anti").unionByName(second)


def reprofiled(profile: DataFrame, upstream: DataFrame, grain: Grain | None = None, bar: float = rules.REVIEW_AT) -> DataFrame:
    """The same verdicts with every arm run again over the rescued tables: what ``warehouse`` is held against."""
    first = warehouse(profile, signals(profile), bar=bar)
    saved = rescued(first, upstream, bar)
    again = profile.join(saved, "table", "left_semi")
    linked = _factors(saved, grain).select("table", F.lit(True).alias("linked"), "factor")
    return first.join(saved, "table", "left_anti").unionByName(settled(again.select(*ADDRESS), signals(again), linked))


def derived_linked(verdicts: DataFrame, upstream: DataFrame, bar: float = rules.REVIEW_AT) -> DataFrame:
    """(table, source): each rescued table with the linked tables that are the reason."""
    linked = person_linked(verdicts, bar)
    return upstream.join(rescued(verdicts, upstream, bar), "table", "left_semi").join(linked.where("linked").select(F.col("table").alias("source")), "source", "left_semi").select("table", "source").distinct()


def flags(verdicts: DataFrame) -> DataFrame:
    """(table, column, flagged, auto_masked): somebody or a policy acts on it; a policy alone does."""
    return verdicts.select(*ADDRESS, (F.col("band") != "ignore").alias("flagged"), (F.col("band") == "accept").alias("auto_masked"))

def band_counts(verdicts: DataFrame) -> DataFrame:
    """(band, columns), zeros included."""
    return counted(verdicts, "band", rules.BANDS)


def counted(df: DataFrame, column: str, members: Iterable[str]) -> DataFrame:
    every = df.sparkSession.createDataFrame([(m,) for m in members], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("columns"))


def rule_coverage(spark: SparkSession) -> DataFrame:
    """(category, by_name, by_value, by_sample, reachable) from the rules themselves."""
    by_name = {key for _, key, _ in rules.NAME_RULES} | {"event_date"}
    by_value = {key for key, _, _ in values.PREDICATES} | {"free_text_clinical"}
    by_sample = {"unknown_identifier", "payment_card"}
    rows = [(k, k in by_name, k in by_value, k in by_sample, k in by_name | by_value | by_sample) for k in rules.IDENTIFIABILITY]
    return spark.createDataFrame(rows, "category string, by_name boolean, by_value boolean, by_sample boolean, reachable boolean")


# The sets of arms that are compared.
ARM_SETS = [
    ("all arms", ("name", "value", "structure")), ("without name", ("value", "structure")), ("without value", ("name", "structure")),
    ("without structure", ("name", "value")), ("name alone", ("name",)), ("value alone", ("value",)), ("structure alone", ("structure",)),
]


def moves(profile: DataFrame, evidence: DataFrame) -> DataFrame:
    """(arms, table, column, band_before, confidence_before, category_before, band_after, confidence_after, category_after):
    columns whose band moves when arms are taken away.

    All sets are decided in one plan: the evidence is exploded by set, and the set is part of the address.
    """
    sets = F.array(*[F.struct(F.lit(label).alias("arms"), F.array(*map(F.lit, arms)).alias("members")) for label, arms in ARM_SETS])
    joined = lambda df: df.withColumn("s", F.explode(sets)).withColumn("table", F.concat_ws("\x1f", "s.arms", "table"))
    columns = joined(profile.select(*ADDRESS)).drop("s")
    chosen = joined(evidence).where(F.array_contains("s.members", F.col("arm"))).drop("s")
    alone = decided(columns, chosen)
    verdicts = settled(columns, chosen, person_linked(alone).withColumn("factor", F.lit(None).cast("double")))
    said = ["band", "confidence", "category"]
    split = verdicts.select(F.split_part("table", F.lit("\x1f"), F.lit(1)).alias("arms"), F.split_part("table", F.lit("\x1f"), F.lit(2)).alias("table"), "column", *said)
    whole = split.where(F.col("arms") == ARM_SETS[0][0]).select(*ADDRESS, *[F.col(c).alias(f"{c}_before") for c in said])
    return split.select("arms", *ADDRESS, *[F.col(c).alias(f"{c}_after") for c in said]).join(whole, ADDRESS).where("band_before <> band_after").select("arms", *ADDRESS, *[f"{c}_{when}" for when in ("before", "after") for c in said])


def ablation(profile: DataFrame, evidence: DataFrame) -> DataFrame:
    """(arms, table, column, band_before, band_after)."""
    return moves(profile, evidence).select("arms", *ADDRESS, "band_before", "band_after")


def move_texts(moved: DataFrame) -> DataFrame:
    """(arms, text): each move in a line."""
    return moved.select("arms", F.format_string("%s.%s: %s %s at %.4f, then %s %s at %.4f", "table", "column", "band_before", "category_before", "confidence_before", "band_after", "category_after", "confidence_after").alias("text"))


def decides_nothing(moved: DataFrame) -> DataFrame:
    """(arm): arms whose removal alone moves no band, which is all that allows to leave one out."""
    removals = [(arm, f"without {arm}") for arm in ARMS if f"without {arm}" in dict(ARM_SETS)]
    return moved.sparkSession.createDataFrame(removals, "arm string, arms string").join(moved.select("arms"), "arms", "left_anti").select("arm")


def threshold_sweep(verdicts: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """(threshold, masked): columns that would be masked without a person at each accept threshold."""
    each = verdicts.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return each.groupBy("threshold").agg(F.count_if((F.col("category") != "not_personal") & (F.col("confidence") >= F.col("threshold"))).alias("masked"))


def bar_sweep(verdicts: DataFrame, bars: Iterable[float]) -> DataFrame:
    """(bar, linked): tables that count as linked to a person at each evidence bar."""
    by = verdicts.withColumn("bar", F.explode(F.array(*map(F.lit, bars)))).groupBy("bar", "table")
    linked = by.agg(F.bool_or((F.col("identifiability") == "direct") & (F.col("confidence") >= F.col("bar"))).alias("linked"))
    return linked.groupBy("bar").agg(F.count_if("linked").alias("linked"))


def explained(verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(table, column, text): the verdict and its evidence, strongest first."""
    weight = F.round(F.col("strength") * F.col("support"), 4)
    line = F.format_string("    %-9s %-22s %.4f  %s", "arm", "category", weight, "detail")
    lines = evidence.groupBy(*ADDRESS).agg(F.transform(F.sort_array(F.collect_list(F.struct((-weight).alias("w"), line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.format_string("%s.%s -> %s at %.4f (%s)", "table", "column", "category", "confidence", "band")
    tail = F.when(F.col("runner_up").isNotNull(), F.format_string("    runner up %s at %.4f", "runner_up", "runner_up_score"))
    return verdicts.join(lines, ADDRESS, "left").select(*ADDRESS, F.concat_ws("\n", head, F.concat_ws("\n", "lines"), tail).alias("text"))
