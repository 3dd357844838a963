"""The compliance report: answered questions and refusals as rows, rendered as a document."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import rules

LINE = "section int, title string, place int, question string, answer string, refusal string, closable boolean"
TITLES = ["Scope", "Classification", "Policy", "Residual risk", "Access", "Coverage"]


def _lines(df: DataFrame, section: int, question, answer, refusal=None, closable=True, place=0) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(section).alias("section"), F.lit(TITLES[section - 1]).alias("title"), F.lit(place).alias("place"), question.alias("question"), (none if answer is None else answer.cast("string")).alias("answer"), (none if refusal is None else refusal).alias("refusal"), F.lit(closable).alias("closable"))


def scope(verdicts: DataFrame) -> DataFrame:
    out = verdicts.agg(F.countDistinct("table").alias("tables"), F.count("*").alias("columns"))
    return _lines(out, 1, F.lit("tables"), F.col("tables")).unionByName(_lines(out, 1, F.lit("columns"), F.col("columns"), place=1))


def classification(band_counts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The bands, and a refusal for each column that waits for a person."""
    bands = _lines(band_counts, 2, F.concat(F.lit("columns in band "), "band"), F.col("columns"))
    open_ = verdicts.where("band = 'review'")
    return bands.unionByName(_lines(open_, 2, F.concat(F.lit("is "), F.concat_ws(".", "table", "column"), F.lit(" personal data")), None, F.format_string("scored %.4f, so a person decides", "confidence"), place=1))


def policy(action_counts: DataFrame, on_absence: DataFrame) -> DataFrame:
    actions = _lines(action_counts, 3, F.concat(F.lit("columns to "), "action"), F.col("columns"))
    return actions.unionByName(_lines(on_absence.agg(F.count("*").alias("n")), 3, F.lit("columns retained on absence of evidence"), F.col("n"), place=1))


def residual(measured: DataFrame, refused: DataFrame) -> DataFrame:
    """``measured`` (table, k, singletons, population) and ``refused`` (table, reason)."""
    said = F.format_string("k %d, %d of %d people alone", "k", "singletons", "population")
    return _lines(measured, 4, F.concat(F.lit("residual k of "), "table"), said).unionByName(_lines(refused, 4, F.concat(F.lit("residual k of "), "table"), None, F.col("reason")))


def measured_or_refused(spark: SparkSession, names: Iterable[str], measure: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What ``residual`` takes: measures each table, and makes a refusal of what the measurement itself says against it."""
    rows, refused = [], []
    for name in names:
        try:
            r = measure(name).first()
            rows.append((name, r["k"], r["singletons"], r["population"]))
        except ValueError as error:
            refused.append((name, str(error).split(". ")[0]))
    return spark.createDataFrame(rows, "table string, k long, singletons long, population long"), spark.createDataFrame(refused, "table string, reason string")


def access(sets: DataFrame) -> DataFrame:
    """Addresses that only stars may have read can't be answered, whatever anybody does now."""
    unsure = (F.size("did_read") == 0) & (F.size("did_read_at_most") > 0)
    could = _lines(sets, 5, F.concat(F.lit("users who could have read "), "address"), F.size("could_have_read"))
    did = _lines(sets.where(~unsure), 5, F.concat(F.lit("users who read "), "address"), F.size("did_read"), place=1)
    return could.unionByName(did).unionByName(_lines(sets.where(unsure), 5, F.concat(F.lit("users who read "), "address"), None, F.format_string("%d users only by star, which names no column", F.size("only_by_star")), closable=False, place=1))


def coverage(gaps: DataFrame, unreachable: DataFrame) -> DataFrame:
    """Clauses without a category can't be closed by a rule; categories without a rule can."""
    clauses = _lines(gaps.where("side = 'clause'"), 6, F.concat(F.lit("clause "), "name"), None, F.lit("no category stands for it"), closable=False)
    return clauses.unionByName(_lines(unreachable, 6, F.concat(F.lit("category "), "category"), None, F.lit("no rule can find it"), place=1))


def assembled(sections: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sections)


def counts(report: DataFrame) -> DataFrame:
    """(asked, answered, refused, unclosable)."""
    return report.agg(F.count("*").alias("asked"), F.count("answer").alias("answered"), F.count("refusal").alias("refused"), F.count_if(F.col("refusal").isNotNull() & ~F.col("closable")).alias("unclosable"))


def answer_rate(report: DataFrame) -> DataFrame:
    """(answered, asked): two numbers, as a share would hide how few questions there are."""
    return counts(report).select("answered", "asked")


def by_question(report: DataFrame) -> DataFrame:
    return report.where("refusal is not null").groupBy("title").agg(F.count("*").alias("refusals"))


def rendered(report: DataFrame, drop_refusals: bool = False) -> str:
    """The report as Markdown; its lines, one for each question, are read by the driver."""
    rows = report.orderBy("section", "place", "question").collect()
    out = ["# Compliance report", ""]
    for number, title in enumerate(TITLES, 1):
        out += [f"## {title}", ""]
        for r in (r for r in rows if r["section"] == number):
            if r["answer"] is not None:
                out.append(f"- {r['question']}: {r['answer']}")
            elif not drop_refusals:
                out.append(f"- {r['question']}: REFUSED, {r['refusal']}{'' if r['closable'] else ' (cannot be closed)'}")
        out.append("")
    return "\n".join(out)


def undelivered(report: DataFrame, text: str) -> DataFrame:
    """Refusals that a rendered document leaves out."""
    return report.where(F.col("refusal").isNotNull() & ~F.contains(F.lit(text), F.concat("question", F.lit(": REFUSED, "), "refusal")))


def manifest(df: DataFrame, **more: object) -> str:
    """The rows of a small result as sorted JSON."""
    rows = sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return json.dumps({"rows": rows, "review_at": rules.REVIEW_AT, **more}, sort_keys=True, default=str, indent=1)
