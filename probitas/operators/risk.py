"""Evidence chains and weighted risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = [(15, "none"), (35, "low"), (55, "medium"), (75, "high"), (100, "critical")]


def chain_filter(nodes: DataFrame, status: str | None = None, category: str | None = None, escalated: bool | None = None) -> DataFrame:
    for name, want in (("status", status), ("category", category), ("escalated", escalated)):
        if want is not None:
            nodes = nodes.where(F.col(name) == want)
    return nodes


def chain_stats(nodes: DataFrame) -> DataFrame:
    """Counts by status, by category and in all, by grouping sets: (status, category, nodes, escalated)."""
    rows = nodes.groupingSets([["status"], ["category"], []], "status", "category")
    return rows.agg(F.count("*").alias("nodes"), F.count_if("escalated").alias("escalated"))


def risk(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(case_id, category, score 0-100) by (category, weight): weighted score over the categories present, and its band."""
    rows = scores.join(F.broadcast(weights), "category") if weights.count() <= 10_000 else scores.join(weights, "category")
    out = rows.groupBy("case_id").agg(F.round(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), 6).alias("risk_score"))
    return out.withColumn("risk_level", band(F.col("risk_score")))


def band(score: Column) -> Column:
    level = F.lit("critical")
    for most, name in reversed(BANDS[:-1]):
        level = F.when(score <= most, name).otherwise(level)
    return level


def short_citation(authors: Column, year: Column) -> Column:
    """By the last names of one or two authors, or the first of more."""
    last = lambda k: F.element_at(F.split(F.element_at(authors, k), r"\s+"), -1)
    who = F.when(F.size(authors) == 0, "Unknown").when(F.size(authors) == 1, last(1)).when(F.size(authors) == 2, F.concat(last(1), F.lit(" & "), last(2))).otherwise(F.concat(last(1), F.lit(" et al.")))
    return F.concat(who, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def report_summary(reports: DataFrame) -> DataFrame:
    """(title, risk_level, risk_score): each report in one line."""
    score = F.coalesce(F.col("risk_score").cast("string"), F.lit("N/A"))
    line = F.concat(F.lit("["), F.upper(F.coalesce("risk_level", F.lit("unknown"))), F.lit("] score="), score, F.lit("/100 — "), F.coalesce("title", F.lit("Unknown paper")))
    return reports.withColumn("summary", line)
