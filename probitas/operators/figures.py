"""Numbers in paper text and in text read from charts, figures of pages, panels, and the checks that a paper's numbers go through."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import statistics

_N = r"(\d+\.?\d*)"
#: Patterns of numbers in text (fixed patterns).
ANY_NUMBER = r"(?<![a-zA-Z0-9])(\d+\.?\d*)(?![a-zA-Z])"
MEAN_SD = rf"{_N}\s*[±+/-]+\s*{_N}"
P_VALUE, PERCENT, SAMPLE = r"[pP]\s*[<>=]+\s*(\d+\.\d+)", rf"{_N}\s*%", r"[nN]\s*[=:]\s*(\d+)"


def _all(text: Column, pattern: str, kind: str = "double") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.try_cast(kind))


def text_numbers(papers: DataFrame) -> DataFrame:
    """(doc_id, text): all numbers in (0, 1e6); means with deviations that aren't identifiers, years, fractions or wider than
    three times the mean; p values in (0, 1]; percentages in (0, 100]; sample sizes of 2 to 1000. Arrays in order."""
    text = F.coalesce("text", F.lit(""))
    pairs = F.arrays_zip(_all(text, MEAN_SD).alias("mean"), F.transform(F.regexp_extract_all(text, F.lit(MEAN_SD), 2), lambda x: x.try_cast("double")).alias("sd"), F.regexp_extract_all(text, F.lit(MEAN_SD), 0).alias("raw"))

    def real(p: Column) -> Column:
        slash = p["raw"].contains("/")
        dashes = F.length(p["raw"]) - F.length(F.replace(p["raw"], F.lit("-"), F.lit("")))
        small = (p["mean"] > 0) & (p["sd"] > 0) & (p["mean"] <= 10_000) & (p["sd"] <= 10_000) & (p["sd"] <= 3 * p["mean"])
        return small & (dashes < 3) & ~(slash & p["mean"].between(1900, 2099)) & ~(slash & (p["mean"] > 100) & (p["sd"] > 100))

    within = lambda c, low, high: F.filter(c, lambda v: (v > low) & (v <= high))
    return papers.select(
        "doc_id", F.filter(_all(text, ANY_NUMBER), lambda v: (v > 0) & (v < 1_000_000)).alias("all_numbers"), F.filter(pairs, real).alias("mean_sd_pairs"),
        within(_all(text, P_VALUE), 0, 1).alias("p_values"), within(_all(text, PERCENT), 0, 100).alias("percentages"), F.filter(_all(text, SAMPLE, "long"), lambda n: n.between(2, 1000)).alias("sample_sizes"),
    )


_LINE, _ONE = re.compile(r"(?<!\w)(\d+\.?\d*)(?!\w)"), re.compile(r"\d+\.?\d*")
_LIST = re.compile(rf"{_N}\s*[,，]\s*{_N}\s*[,，]\s*(\d+\.?\d*(?:\s*[,，]\s*\d+\.?\d*)*)")
_OPENED = re.compile(rf"\(\s*{_N}\s*[±+-]")
_STEPS = [re.compile(rf"{_N}\s*(?:to|→|->)\s*{_N}\s*(?:to|→|->)\s*{_N}", re.I), re.compile(rf"{_N},\s*{_N},\s*(?:and|&)\s*{_N}\s+respectively", re.I)]
SEQUENCES = "doc_id string, place int, source string, vals array<double>"


def _found(text: str) -> Iterator[tuple[str, list[str]]]:
    for line in text.split("\n"):
        yield "table_row", _LINE.findall(line)
    for m in _LIST.finditer(text):
        yield "comma_list", _ONE.findall(m[0])
    for m in _OPENED.finditer(text):
        yield "parenthetical_groups", _OPENED.findall(text[m.start() : m.start() + 500])
    for pattern in _STEPS:
        for m in pattern.finditer(text):
            yield "textual_sequence", list(m.groups())


def _numbering(vals: list[float]) -> bool:
    """Whether whole numbers only count pages or figures, or say yes and no."""
    if any(v != int(v) for v in vals):
        return False
    counts = all(b - a == 1 for a, b in zip(vals, vals[1:])) and vals[0] < 20
    return counts or all(1 <= v <= 30 for v in vals) or all(v in (0, 1) for v in vals)


def sequences(text: str) -> list[tuple[str, list[float]]]:
    """Ordered sequences of three numbers or more that aren't numbering: rows, lists, groups in parentheses, steps; the
    longest first, each once (to four decimals)."""
    kept = []
    for source, raw in _found(text):
        vals = [float(x) for x in raw]
        if len(vals) >= 3 and len(set(vals)) > 1 and not _numbering(vals):
            kept.append((source, vals))
    out = {}
    for source, vals in sorted(kept, key=lambda s: -len(s[1])):
        out.setdefault(tuple(round(v, 4) for v in vals), (source, vals))
    return list(out.values())


def ordered_sequences(papers: DataFrame) -> DataFrame:
    """(doc_id, place, source, vals) of the sequences in each text."""

    def run(batches):
        for pdf in batches:
            rows = [(d, k, s, v) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, (s, v) in enumerate(sequences(t or ""))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEQUENCES.split(", ")])

    return papers.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SEQUENCES)


CHART_NUMBER = r"(?<![a-zA-Z])(\d+\.?\d*(?:[eE][+-]?\d+)?)(?![a-zA-Z])"
CHART_PAIRS = (rf"{_N}\s*[±\+]\s*{_N}", rf"(?i)mean[=:\s]+{_N}.*?SD[=:\s]+{_N}", rf"(?i)[Mm][=:\s]+{_N}.*?[Ss][Dd][=:\s]+{_N}")


def chart_texts(charts: DataFrame) -> DataFrame:
    """(chart_id, text), as read from a chart: distinct whole numbers and others, sorted; p values by size, each wording once;
    labels (two letters or more, each once, case aside, 50 at most); means with deviations and variation in percent."""
    text = F.coalesce("text", F.lit(""))
    raw = F.regexp_extract_all(text, F.lit(CHART_NUMBER), 1)
    whole = lambda x: (x.try_cast("double") == F.floor(x.try_cast("double"))) & ~x.contains(".")
    p = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(P_VALUE), 0), F.trim))
    p = F.array_sort(F.transform(p, lambda r: F.struct(F.regexp_extract(r, r"(\d+\.\d+)$", 1).cast("double").alias("value"), r.alias("raw_text"))))
    words = F.filter(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), 0), lambda w: F.length(w) >= 2)
    lowered = F.transform(words, F.lower)
    labels = F.slice(F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1), 1, 50)

    def pairs(pattern: str) -> Column:
        both = F.arrays_zip(_all(text, pattern).alias("mean"), F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), lambda x: x.cast("double")).alias("sd"))
        return F.transform(both, lambda x: F.struct(x["mean"].alias("mean"), x["sd"].alias("sd"), F.round(F.try_divide(x["sd"], x["mean"]) * 100, 2).alias("cv_percent")))

    return charts.select(
        "chart_id", F.array_sort(F.array_distinct(F.transform(F.filter(raw, lambda x: ~whole(x)), lambda x: x.cast("double")))).alias("numbers"), F.array_sort(F.array_distinct(F.transform(F.filter(raw, whole), lambda x: x.cast("double").cast("long")))).alias("integers"),
        F.transform(p, lambda x: F.struct(x["raw_text"], x["value"], (x["value"] < 0.05).alias("is_significant"))).alias("p_values"), labels.alias("labels"), F.concat(*map(pairs, CHART_PAIRS)).alias("mean_sd_pairs"),
    )


def page_figures(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text): the first figure that each page's first 3000 characters name."""
    number = F.regexp_extract(F.substring(F.coalesce("text", F.lit("")), 1, 3000), r"(?i)(?:Fig(?:ure)?[.\s]+)(\d+)[.\s]", 1)
    return pages.select("doc_id", "page", F.concat(F.lit("Fig "), F.nullif(number, F.lit(""))).alias("figure_label")).where("figure_label is not null")


#: Pairs of figures that are compared by name, and their groups (fixed values).
RISK_PAIRS = [("Fig 1E", "Fig 4B", ["Control", "COH", "COH+RTA408"]), ("Fig 1F", "Fig 4C", ["Control", "COH", "COH+RTA408"])]


def risk_pairs(bars: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, figure_label, full_label) of bar-chart panels: which of the named pairs have panels of both figures; five labels of each at most."""
    known = spark.createDataFrame([(k, a, b, g) for k, (a, b, g) in enumerate(RISK_PAIRS)], "pair int, figure_a string, figure_b string, shared_groups array<string>")
    base = lambda c: F.regexp_extract(c, r"^(Fig\s+\d+)", 1)
    labels = bars.groupBy("doc_id", "figure_label").agg(F.slice(F.array_sort(F.collect_list("full_label")), 1, 5).alias("panels"))
    rows = bars.select("doc_id").distinct().join(F.broadcast(known))  # two rows
    for side in "ab":
        rows = rows.withColumn("figure_label", base(F.col(f"figure_{side}"))).join(labels.withColumnRenamed("panels", f"panels_{side}"), ["doc_id", "figure_label"], "left").withColumnRenamed("figure_label", f"base_{side}")
    return rows.select("doc_id", F.concat_ws(" vs ", "figure_a", "figure_b").alias("pair"), "base_a", "base_b", "shared_groups", "panels_a", "panels_b", (F.col("panels_a").isNotNull() & F.col("panels_b").isNotNull()).alias("both_have_bar_charts"))


def best_panels(panels: DataFrame) -> DataFrame:
    """(page, image, grp, panel): of the groups that one image was split into, the one of most panels (the first by name of equals)."""
    sizes = panels.groupBy("page", "image", "grp").agg(F.count("*").alias("n"))
    best = sizes.groupBy("page", "image").agg(F.min_by("grp", F.struct((-F.col("n")).alias("n"), "grp")).alias("grp"))
    return panels.join(best, ["page", "image", "grp"], "left_semi")


COMMON_SIZES = (3, 4, 5, 6, 8, 10)


def sample_size(means: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, mean) with n: the document's most frequent sample size (of equals the first named: `place`), if the mean is
    possible with it; without any size, the first common one that is. Hence a size that is found never contradicts the mean."""
    fits = lambda n: F.abs(F.col("mean") * n - F.rint(F.col("mean") * n)) < 0.01
    counts = sizes.groupBy("doc_id", "n").agg(F.count("*").alias("k"), F.min("place").alias("first"))
    usual = counts.groupBy("doc_id").agg(F.max_by("n", F.struct("k", (-F.col("first")).alias("f"))).alias("usual"))
    out = means.join(usual, "doc_id", "left")
    guess = F.coalesce(*[F.when(fits(F.lit(n)), F.lit(n)) for n in COMMON_SIZES])
    return out.withColumn("n", F.when(F.col("usual").isNull(), guess).otherwise(F.when(fits(F.col("usual")), F.col("usual"))).cast("int")).drop("usual")


def pipeline_checks(numbers: DataFrame, p_values: DataFrame, means: DataFrame, sizes: DataFrame, series: DataFrame) -> DataFrame:
    """Per document, the checks that ran on its numbers and which flagged it.

    Takes (doc_id, value) of numbers over zero, (doc_id, value) of p values, (doc_id, mean, sd), (doc_id, place, n) of
    sample sizes, and (doc_id, ds, pos, value) of ordered series. Benford needs 30 numbers, p values 10.
    """
    def flags(rows: DataFrame, name: str, flag: Column | None = None) -> DataFrame:
        return rows.groupBy(F.col("group_id").alias("doc_id")).agg(F.bool_or(F.lit(True) if flag is None else flag).alias(name))

    grouped = lambda df: df.withColumnRenamed("doc_id", "group_id")
    found = [
        flags(statistics.benford(grouped(numbers.where("value > 0"))), "benford", F.col("flagged")),
        flags(statistics.p_value_distribution(grouped(p_values)), "p_values", (F.col("caliper_ratio") > 2) | (F.col("uniformity_p") < 0.05)),
        flags(statistics.grim(grouped(sample_size(means, sizes).where("n is not null").withColumn("pair_index", F.lit(0)))), "grim", ~F.col("consistent")),
        flags(statistics.variation(grouped(means.where("sd >= 0").withColumn("idx", F.lit(0)))), "variation"),
        flags(statistics.digit_preference(grouped(numbers.where("value > 0")), variant="strict"), "last_digits"),
        flags(statistics.near_arithmetic(series.select(F.struct("doc_id", "ds").alias("ds"), "pos", "value"), "strict").withColumn("group_id", F.col("ds.doc_id")), "progressions"),
        flags(statistics.frequent_repeats(grouped(numbers.where("value > 0"))), "repeats"),
    ]
    docs = numbers.select("doc_id").union(p_values.select("doc_id")).union(means.select("doc_id")).union(series.select("doc_id")).distinct()
    for part in found:
        docs = docs.join(part, "doc_id", "left")
    names = ["benford", "p_values", "grim", "variation", "last_digits", "progressions", "repeats"]
    ran = F.concat_ws(",", *[F.when(F.col(n).isNotNull(), n) for n in names[:3]], F.lit("anomalous_precision"))
    docs = docs.withColumn("checks_run", ran).na.fill(False, names)
    return docs.withColumn("total_flagged_checks", sum((F.col(n).cast("int") for n in names), F.lit(0)))
