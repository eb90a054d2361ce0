"""From detector rows to numbered evidence: multiple testing, calibration, order, summary, downgrades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch

#: Largest q value, severity and confidence that it gives at least.
CALIBRATION = [(1e-6, 4, 0.97), (1e-4, 3, 0.92), (1e-3, 3, 0.88), (1e-2, 2, 0.76), (0.05, 1, 0.62)]
LEVELS = ("informational", "low", "medium", "high", "critical")


def designed_downgrade(evidence: DataFrame, designed: DataFrame) -> DataFrame:
    """One severity step and confidence x 0.65 where a series is a designed sequence; another and x 0.80 where both of two are."""
    marks = F.broadcast(designed.select("ds").distinct()) if designed.count() <= 1_000_000 else designed.select("ds").distinct()
    out = evidence.join(marks.withColumnsRenamed({"ds": "ds_a"}).withColumn("_a", F.lit(1)), "ds_a", "left").join(marks.withColumnsRenamed({"ds": "ds_b"}).withColumn("_b", F.lit(1)), "ds_b", "left")
    any_one, both = F.coalesce("_a", "_b").isNotNull(), F.col("_a").isNotNull() & F.col("_b").isNotNull()
    steps = any_one.cast("int") + both.cast("int")
    return out.withColumns({"severity": F.greatest(F.lit(0), F.col("severity") - steps), "confidence": F.col("confidence") * F.when(both, 0.52).when(any_one, 0.65).otherwise(1.0)}).drop("_a", "_b")


def fdr(evidence: DataFrame) -> DataFrame:
    """Benjamini-Hochberg q values over the rows with a p value; the family is the declared hypotheses if they are more.

    Ranks are running counts of the distinct p values, which are dealt in ranges: what comes before a range (counts) and
    after it (least q) is added from a row a range.
    """
    tested = evidence.where("p_value is not null")
    by_p = scratch.in_order(tested.groupBy("p_value").agg(F.count("*").alias("k"), F.sum("fdr_hypothesis_count").alias("h")), "p_value")
    size = by_p.agg(F.greatest(F.sum("k"), F.sum("h")).alias("m"))
    ranges = by_p.groupBy("part").agg(F.sum("k").alias("ks"))
    ranges = ranges.select("part", (F.sum("ks").over(Window.orderBy("part")) - F.col("ks")).alias("before"))
    own = Window.partitionBy("part").orderBy("p_value")
    ranked = by_p.join(F.broadcast(ranges), "part").crossJoin(F.broadcast(size)).withColumn("rank", F.col("before") + F.sum("k").over(own))  # one row
    ranked = ranked.withColumn("q", F.least(F.lit(1.0), F.col("p_value") * F.col("m") / F.col("rank")))
    least = ranked.groupBy("part").agg(F.min("q").alias("lq"))
    least = least.select("part", F.min("lq").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    q = ranked.join(F.broadcast(least), "part").withColumn("q_value", F.least(F.min("q").over(own.rowsBetween(0, Window.unboundedFollowing)), F.coalesce("after", F.lit(1.0))))
    return evidence.join(q.select("p_value", "q_value", F.col("m").alias("fdr_total_hypothesis_count")), "p_value", "left")


def calibrate(evidence: DataFrame) -> DataFrame:
    """Severity and confidence raised by q; digit and suffix evidence above 0.05 becomes low."""
    level, trust = F.lit(0), F.lit(0.0)
    for most, severity, confidence in reversed(CALIBRATION):
        level, trust = F.when(F.col("q_value") <= most, severity).otherwise(level), F.when(F.col("q_value") <= most, confidence).otherwise(trust)
    weak = (F.col("q_value") > 0.05) & F.col("evidence_type").rlike("^(last_digit|decimal_suffix)")
    return evidence.withColumns({
        "severity": F.when(weak, 1).otherwise(F.greatest("severity", F.coalesce(level, F.lit(0)))),
        "confidence": F.when(weak, F.least("confidence", F.lit(0.55))).otherwise(F.greatest("confidence", F.coalesce(trust, F.lit(0.0)))),
        "fdr_significant": F.col("q_value") <= 0.05,
    })


def number(evidence: DataFrame, *ties: str) -> DataFrame:
    """evidence_id by severity, confidence, type and the tie columns."""
    rows = scratch.numbered(evidence, "_k", F.desc("severity"), F.desc("confidence"), "evidence_type", *[F.asc_nulls_first(t) for t in ties])
    return rows.withColumns({"evidence_id": F.format_string("E-%04d", "_k"), "severity_label": F.element_at(F.array(*map(F.lit, LEVELS)), F.col("severity") + 1), "confidence_label": F.when(F.col("confidence") >= 0.95, "very_high").when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")}).drop("_k")


#: Rows that go into the context of a report.
CONTEXT_ROWS = 300


def for_context(evidence: DataFrame, most: int = CONTEXT_ROWS) -> DataFrame:
    """The first rows by evidence_id, and what each allows to be claimed: (evidence_id, severity_label, confidence, claim)."""
    first = evidence.orderBy(F.length("evidence_id"), "evidence_id").limit(most)
    return first.withColumn("claim", F.concat_ws(" ", F.concat(F.col("evidence_type"), F.lit(":")), "match_type", F.concat(F.lit("n = "), "n"), F.concat(F.lit("q = "), F.format_string("%.3g", "q_value"))))


def pair_context(evidence: DataFrame, series: DataFrame) -> DataFrame:
    """Rows of two series with whether these share file, sheet, range and label; reuse across sources unless all of the first three."""
    about = series.select("ds", "file", "sheet", "range", F.trim("label").alias("label"))
    out = evidence.where("ds_b is not null").join(about.toDF("ds_a", "file_a", "sheet_a", "range_a", "label_a"), "ds_a").join(about.toDF("ds_b", "file_b", "sheet_b", "range_b", "label_b"), "ds_b")
    same = {f"same_{c}": F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in ("file", "sheet", "range", "label")}
    out = out.withColumns(same).drop(*[f"{c}_{side}" for c in ("file", "sheet", "range", "label") for side in "ab"])
    return out.withColumn("cross_source_reuse_candidate", ~(F.col("same_file") & F.col("same_sheet") & F.col("same_range")))


def scan_stats(cells: DataFrame, least: int, most_pairs: int | None = None) -> DataFrame:
    """One row: pairs among the series of at least `least` values, and how many a limit would scan and skip (without one, none)."""
    n = cells.groupBy("ds").agg(F.count("*").alias("n")).where(F.col("n") >= least).agg(F.count("*").alias("k"))
    total = (F.col("k") * (F.col("k") - 1) / 2).cast("long")
    scanned = total if most_pairs is None else F.least(total, F.lit(most_pairs).cast("long"))
    return n.select(total.alias("pairwise_comparisons_total"), scanned.alias("pairwise_comparisons_scanned"), (total - scanned).alias("pairwise_comparisons_skipped"), (total > scanned).alias("pairwise_comparison_limit_reached"))


def summary(evidence: DataFrame) -> DataFrame:
    """One row: counts by level, overall level, greatest confidence. Low counts informational rows too."""
    at = [F.count_if(F.col("severity") == k) for k in range(5)]
    out = evidence.agg(F.count("*").alias("total"), at[4].alias("critical"), at[3].alias("high"), at[2].alias("medium"), (at[1] + at[0]).alias("low"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"))
    overall = F.when(F.col("critical") > 0, "serious").when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").when(F.col("total") > 0, "low").otherwise("none_detected")
    return out.withColumn("overall", overall)
