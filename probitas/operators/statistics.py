"""Statistical screens. Each takes a long table with a group column and gives one row a group (or a finding)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import scratch
from ..functions.stats import chi2_sf_8, chi2_sf_9, test_p_value

#: First-digit screen: least n, largest mean absolute deviation that passes.
BENFORD_N, BENFORD_MAD = 30, 0.015


def leading_digit(v: Column) -> Column:
    """First digit of the integer part, or the first non-zero of ten decimals below one."""
    size = F.abs(v)
    whole = F.substring(F.floor(size).cast("decimal(38,0)").cast("string"), 1, 1).cast("int")
    small = F.regexp_extract(F.format_string("%.10f", size), "[1-9]", 0)
    return F.when(size >= 1, whole).otherwise(F.nullif(small, F.lit("")).cast("int"))


def benford(values: DataFrame, group: str = "group_id", value: str = "value") -> DataFrame:
    """First digits against Benford's law: chi-square (8 degrees) and mean absolute deviation."""
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v != 0)).select(F.col(group).alias("group_id"), leading_digit(v).alias("d")).where("d is not null")
    counts = rows.groupBy("group_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(1, 10)]).where(F.col("n") >= BENFORD_N)
    digits = [(F.col(f"d{k}"), F.log10(F.lit(1 + 1 / k))) for k in range(1, 10)]
    n = F.col("n")
    x = sum((F.pow(c - n * p, 2) / (n * p) for c, p in digits), F.lit(0.0))
    mad = sum((F.abs(c / n - p) for c, p in digits), F.lit(0.0)) / 9
    band = F.when(F.col("mad") < 0.006, "close").when(F.col("mad") < 0.012, "acceptable").when(F.col("mad") < 0.015, "marginal").otherwise("nonconforming")
    out = counts.withColumns({"chi_square": x, "mad": mad})
    return out.withColumns({"p_value": chi2_sf_8(F.col("chi_square")), "conformity": band}).withColumn("flagged", (F.col("p_value") < 0.05) | (F.col("mad") > BENFORD_MAD)).select("group_id", "n", "chi_square", "mad", "p_value", "conformity", "flagged")


def p_value_distribution(values: DataFrame, group: str = "group_id", value: str = "value") -> DataFrame:
    """Counts either side of .05 and .01, uniformity over ten bins. A ratio with nothing above is 999."""
    p = F.col(value)
    rows = values.where((p > 0) & (p <= 1)).withColumn("bin", F.least(F.lit(9), F.floor(p * 10)).cast("int"))
    between = lambda lo, hi: F.count_if((p > lo) & (p <= hi))
    out = rows.groupBy(F.col(group).alias("group_id")).agg(
        F.count("*").alias("n"), between(0.045, 0.05).alias("below_05"), between(0.05, 0.055).alias("above_05"), between(0.009, 0.01).alias("below_01"), between(0.01, 0.011).alias("above_01"),
        F.median(p).alias("median_p"), F.avg((p <= 0.05).cast("int")).alias("share_significant"), *[F.count_if(F.col("bin") == k).alias(f"b{k}") for k in range(10)],
    ).where("n >= 10")
    x = sum((F.pow(F.col(f"b{k}") - F.col("n") / 10, 2) / (F.col("n") / 10) for k in range(10)), F.lit(0.0))
    out = out.withColumns({"chi_square": x, "caliper_ratio": F.when(F.col("above_05") == 0, 999.0).otherwise(F.try_divide("below_05", "above_05"))})
    out = out.withColumns({"caliper_flag": F.col("caliper_ratio") > 2, "caliper_01_flag": F.col("below_01") > 2 * F.greatest("above_01", F.lit(1)), "uniformity_p": chi2_sf_9("chi_square")})
    return out.select("group_id", "n", "below_05", "above_05", "caliper_ratio", "caliper_flag", "caliper_01_flag", "median_p", "share_significant", "chi_square", "uniformity_p", (F.col("caliper_flag") | F.col("caliper_01_flag") | (F.col("chi_square") > 16.918978)).alias("flagged"))


def grim(pairs: DataFrame, decimals: float = 0.01) -> DataFrame:
    """(group_id, pair_index, mean, n): whether n integers can have the mean; rows without both are errors that count."""
    good = F.col("mean").isNotNull() & (F.col("n") > 0)
    total = F.col("mean") * F.col("n")
    gap = F.abs(total - F.rint(total))
    return pairs.select("group_id", "pair_index", "mean", "n", F.when(good, F.round(gap, 6)).alias("gap"), F.when(good, gap < decimals).alias("consistent"), F.when(~F.coalesce(good, F.lit(False)), "invalid").alias("error"))


def variation(rows: DataFrame) -> DataFrame:
    """(group_id, idx, mean, sd): coefficients of variation under .01 (critical) or .03 (warning)."""
    out = rows.where("mean != 0").withColumn("cv", F.abs(F.col("sd") / F.col("mean")))
    return out.withColumn("level", F.when(F.col("cv") < 0.01, "critical").when(F.col("cv") < 0.03, "warning")).where("level is not null")


#: By variant: shares over which digit 5, digit 0, and 0 and 5 together are (strongly, slightly) too frequent, and any other digit.
DIGIT_LIMITS = {"default": {"5": (0.20, 0.15), "0": (0.20, 0.20), "0+5": (0.35, 0.35), "other": 0.20}, "strict": {"5": (0.18, 0.12), "0": (0.18, 0.12), "0+5": (0.35, 0.25), "other": 0.15}}


@F.pandas_udf(T.IntegerType())
def last_shown_digit(value: pd.Series) -> pd.Series:
    """The last digit of the number as ten significant digits show it, that of the exponent of very large or small ones."""
    return pd.Series([int(f"{abs(v):.10g}"[-1]) for v in value], dtype="Int32")


def digit_preference(values: DataFrame, group: str = "group_id", value: str = "value", variant: str = "default") -> DataFrame:
    """Groups of ten values or more whose last digits are too frequent; shares have three decimals. `strict` is the pipeline's
    variant; it doesn't count 0 and 5 among the overrepresented digits."""
    limits, v = DIGIT_LIMITS[variant], F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col(group).alias("group_id"), last_shown_digit(v).alias("digit"))
    counts = rows.groupBy("group_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(10)]).where("n >= 10")
    share = {d: F.round(F.col(f"d{d}") / F.col("n"), 3) for d in range(10)}
    out = counts.select("group_id", "n", share[0].alias("share_0"), share[5].alias("share_5"), F.round(share[0] + share[5], 3).alias("share_0_5"), F.concat_ws(",", *[F.when(share[d] > limits["other"], str(d)) for d in range(10) if variant == "default" or d not in (0, 5)]).alias("overrepresented"))
    for name, column in (("5", "share_5"), ("0", "share_0"), ("0+5", "share_0_5")):
        strong, slight = limits[name]
        out = out.withColumn("level" + column[5:], F.when(F.col(column) > strong, "strong").when(F.col(column) > slight, "slight"))
    return out.where("level_5 is not null or level_0 is not null or level_0_5 is not null or overrepresented <> ''")


#: Largest variation of differences, by level.
STEP_LIMITS = {"default": (0.05, 0.10, 0.20), "strict": (0.08, 0.15, 0.25)}


def near_arithmetic(cells: DataFrame, variant: str = "default", min_n: int = 3) -> DataFrame:
    """(ds, pos, value): series whose differences vary by under .20 of their mean size, with R squared to the line through the ends."""
    w = Window.partitionBy("ds").orderBy("pos")
    rows = cells.withColumns({"step": F.col("value") - F.lag("value").over(w), "i": F.row_number().over(w) - 1})
    a = rows.groupBy("ds").agg(F.count("*").alias("n"), F.stddev_pop("step").alias("sd"), F.avg(F.abs("step")).alias("size"), F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last"), F.avg("value").alias("mean"))
    critical, high, medium = STEP_LIMITS[variant]
    a = a.where((F.col("n") >= min_n) & (F.col("size") > 1e-12)).withColumn("cv", F.col("sd") / F.col("size")).where(F.col("cv") < medium)
    fit = rows.join(a.select("ds", "n", "first", "last", "mean"), "ds").withColumn("line", F.col("first") + (F.col("last") - F.col("first")) * F.col("i") / (F.col("n") - 1))
    fit = fit.groupBy("ds").agg(F.sum(F.pow(F.col("value") - F.col("line"), 2)).alias("ss"), F.sum(F.pow(F.col("value") - F.col("mean"), 2)).alias("st"), F.max(F.abs(F.col("value") - F.col("line"))).alias("max_residual"))
    out = a.join(fit, "ds")
    return out.select("ds", "n", F.round("cv", 6).alias("cv"), F.round(F.when(F.col("st") > 1e-12, 1 - F.col("ss") / F.col("st")).otherwise(1.0), 6).alias("r_squared"), F.round("max_residual", 6).alias("max_residual"), F.when(F.col("cv") < critical, "critical").when(F.col("cv") < high, "high").otherwise("medium").alias("level"))


def frequent_repeats(values: DataFrame, group: str = "group_id", value: str = "value") -> DataFrame:
    """Values that make up over 15 % of at least six, three times or more; critical from four times and 25 %."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("group_id"), F.col(value).alias("value")).agg(F.count("*").alias("times"))
    counts = counts.withColumn("n", F.sum("times").over(Window.partitionBy("group_id"))).withColumn("share", F.col("times") / F.col("n"))
    out = counts.where("n >= 6 and times >= 3 and share > 0.15")
    return out.withColumn("level", F.when((F.col("times") >= 4) & (F.col("share") > 0.25), "critical").otherwise("high"))


def significance_concentration(values: DataFrame, group: str = "group_id", value: str = "value") -> DataFrame:
    """Groups of at least five p values: over 80 % below .05; three or more and over 40 % in [.01, .05)."""
    p = F.col(value)
    out = values.where(p.isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.count("*").alias("n"), F.count_if(p < 0.05).alias("significant"), F.count_if((p >= 0.01) & (p < 0.05)).alias("clustered")).where("n >= 5")
    return out.withColumns({"concentrated": F.col("significant") / F.col("n") > 0.8, "p_hacking_cluster": (F.col("clustered") >= 3) & (F.col("clustered") / F.col("n") > 0.4)})


def test_consistency(rows: DataFrame) -> DataFrame:
    """(group_id, idx, test_type, value, df, df1, df2, reported_p, reported_n): recomputed p values, impossible values, degrees that don't fit n."""
    kind = F.lower("test_type")
    out = rows.withColumn("computed_p", test_p_value("test_type", "value", F.col("df").cast("double"), F.col("df1").cast("double"), F.col("df2").cast("double")))
    small = F.lit(1e-300)
    ratio = F.greatest("computed_p", "reported_p") / F.greatest(F.least("computed_p", "reported_p"), small)
    return out.withColumns({
        "p_mismatch": F.coalesce(ratio > 10, F.lit(False)),
        "impossible": F.coalesce(((kind == "r") & (F.abs("value") > 1)) | (kind.isin("chi2", "chi-square", "chi_square") & (F.col("value") < 0)), F.lit(False)),
        "df_mismatch": F.coalesce((kind == "t") & ~((F.col("df") == F.col("reported_n") - 1) | (F.col("df") == F.col("reported_n") - 2)), F.lit(False)),
    }).withColumn("flagged", F.col("p_mismatch") | F.col("impossible") | F.col("df_mismatch"))


def figure_series(series: DataFrame) -> DataFrame:
    """(label, n, vs, gs): values and group labels of each series in order, from (label, pos, group_label, value)."""
    rows = series.where("value is not null").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("v"), F.col("group_label").alias("g")))).alias("x"))
    return rows.select("label", F.size("x").alias("n"), F.expr("transform(x, y -> y.v + 0D)").alias("vs"), F.expr("transform(x, y -> y.g)").alias("gs"))


def _grid(v: Column, step: float | Column) -> Column:
    """Cell of a value: its sign and the logarithm of its size, a cell every `step`; zero by itself."""
    return F.when(F.abs(v) < 1e-300, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * (F.floor(F.log(F.abs(v)) / step) + 10**12))


def _around(cell: Column) -> Column:
    return F.explode(F.when(cell == 0, F.array(cell)).otherwise(F.array(cell - 1, cell, cell + 1)))


def _two(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(c + side) for c in ("label", "n", "vs", "gs")])


def _whole_matches(rows: DataFrame, tolerance: float, floor: float) -> DataFrame:
    """Pairs a < b of one length that are equal, or at every place within the tolerance of the larger value (of 1 where both are under `floor`)."""
    step = 2 * tolerance + 1e-6
    keyed = rows.where("n > 0").select("label", "n", _grid(F.expr("vs[0]"), step).alias("f"), _grid(F.expr("vs[n - 1]"), step).alias("l"), _grid(F.expr("vs[div(n, 2)]"), step).alias("m"))
    if floor:  # values under the floor are all alike
        keyed = rows.where("n > 0").select("label", "n", *[_grid(F.when(F.abs(F.expr(at)) < floor, 0.0).otherwise(F.expr(at)), step).alias(k) for k, at in (("f", "vs[0]"), ("l", "vs[n - 1]"), ("m", "vs[div(n, 2)]"))])
    left = keyed.select(F.col("label").alias("la"), "n", "f", "l", "m")
    right = keyed.select(F.col("label").alias("lb"), "n", _around(F.col("f")).alias("f"), "l", "m").withColumn("l", _around(F.col("l"))).withColumn("m", _around(F.col("m")))
    pairs = left.join(right, ["n", "f", "l", "m"]).where("la < lb").select("la", "lb").distinct()
    both = pairs.join(_two(rows, "_a").withColumnRenamed("label_a", "la"), "la").join(_two(rows, "_b").withColumnRenamed("label_b", "lb"), "lb")
    scale = "greatest(abs(x), abs(y))" if not floor else f"if(greatest(abs(x), abs(y)) < {floor}, 1D, greatest(abs(x), abs(y)))"
    both = both.withColumn("rel", F.expr(f"array_max(zip_with(vs_a, vs_b, (x, y) -> coalesce(try_divide(abs(x - y), {scale}), 0D)))"))
    equal = F.col("vs_a") == F.col("vs_b")
    return both.where(equal | ((F.col("rel") <= tolerance) & F.lit(tolerance > 0))).select("la", "lb", F.col("n_a").alias("n"), F.when(equal, "exact_match").otherwise("near_match").alias("match_type"), F.when(~equal, F.round("rel", 6)).alias("detail"))


def _subset_matches(rows: DataFrame, tolerance: float) -> DataFrame:
    """Pairs where the shorter series (the second of two of one length) stands in the longer, within the tolerance of its own
    values: the first place. They meet on the shorter's first two values."""
    step = 2 * tolerance + 1e-6
    short = rows.where("n >= 2").select(F.col("label").alias("s"), F.col("n").alias("ns"), _grid(F.expr("vs[0]"), step).alias("f"), _grid(F.expr("vs[1]"), step).alias("g"))
    short = short.select("s", "ns", _around(F.col("f")).alias("f"), "g").withColumn("g", _around(F.col("g")))
    pieces = F.expr("transform(sequence(0, n - 2), i -> struct(i as at, vs[i] as x, vs[i + 1] as y))")
    long = rows.where("n >= 2").select(F.col("label").alias("l"), F.col("n").alias("nl"), F.inline(pieces)).select("l", "nl", "at", _grid(F.col("x"), step).alias("f"), _grid(F.col("y"), step).alias("g"))
    pairs = short.join(long, ["f", "g"]).where("s <> l and at + ns <= nl and (ns < nl or l < s)").select("s", "l", "at").distinct()
    both = pairs.join(_two(rows, "_s").withColumnRenamed("label_s", "s"), "s").join(_two(rows, "_l").withColumnRenamed("label_l", "l"), "l")
    both = both.where(F.expr(f"forall(zip_with(slice(vs_l, at + 1, n_s), vs_s, (x, y) -> abs(x - y) <= {tolerance}D * abs(y)), z -> z)"))
    found = both.groupBy("s", "l").agg(F.min("at").alias("at"), F.first("n_s").alias("n"))
    return found.select(F.least("s", "l").alias("la"), F.greatest("s", "l").alias("lb"), "n", F.lit("subset_match").alias("match_type"), F.col("at").cast("double").alias("detail"))


def _ratio_matches(rows: DataFrame) -> DataFrame:
    """Pairs a < b of one length whose ratios a / b (where b isn't zero) vary by under 1 % of their mean, which isn't 1.

    No ratio of n is further from the mean than sqrt(n) times their deviation, so the quotients of two places of a and of b
    differ by a bounded factor: pairs meet on its logarithm at b's first two places that aren't zero. From 2,500 values
    on that bounds nothing, and series of one length meet.
    """
    rows = rows.where("n >= 2").withColumn("p", F.expr("filter(sequence(0, n - 1), i -> abs(vs[i]) > 1e-10)")).withColumns({"p1": F.expr("get(p, 0)"), "p2": F.expr("get(p, 1)")})
    step = F.when(F.col("n") < 2500, -2 * F.log(1 - 0.01 * F.sqrt(F.col("n"))) + 2 * F.log(1 + 0.01 * F.sqrt(F.col("n"))) + 1e-6).otherwise(1.0)
    key = F.when(F.col("n") < 2500, _grid(F.expr("try_divide(vs[p1], vs[p2])"), step)).otherwise(F.lit(0).cast("long"))
    b = rows.where("p2 is not null").select(F.col("label").alias("lb"), "n", "p1", "p2", key.alias("k"))
    places = b.select("n", "p1", "p2").distinct()
    a = rows.drop("p", "p1", "p2").join(places, "n").where("abs(vs[p1]) > 0 and abs(vs[p2]) > 0").select(F.col("label").alias("la"), "n", "p1", "p2", key.alias("k")).withColumn("k", _around(F.col("k")))
    pairs = a.join(b, ["n", "p1", "p2", "k"]).where("la < lb").select("la", "lb").distinct()
    both = pairs.join(_two(rows, "_a").withColumnRenamed("label_a", "la"), "la").join(_two(rows, "_b").withColumnRenamed("label_b", "lb"), "lb")
    both = both.withColumn("r", F.expr("filter(zip_with(vs_a, vs_b, (x, y) -> if(abs(y) > 1e-10, x / y, null)), z -> z is not null)")).where("size(r) >= 2")
    both = both.withColumn("m", F.expr("aggregate(r, 0D, (t, z) -> t + z) / size(r)")).withColumn("sd", F.expr("sqrt(aggregate(r, 0D, (t, z) -> t + (z - m) * (z - m)) / size(r))"))
    found = both.where("sd < 0.01 * abs(m) and abs(m - 1) > 0.01")
    return found.select("la", "lb", F.col("n_a").alias("n"), F.lit("ratio_match").alias("match_type"), F.round("m", 4).alias("detail"))


def _first_of_groups(rows: DataFrame) -> DataFrame:
    """(label, n, g, v): the first value of each group label of a series."""
    first = F.expr("filter(transform(gs, (g, i) -> struct(g as g, vs[i] as v, array_position(gs, g) = i + 1 as f)), x -> x.g is not null and x.f)")
    return rows.select("label", "n", F.inline(first)).drop("f")


def cross_figure(series: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Pairs la < lb of (label, pos, group_label, value) series: equal; near; one within the other; in constant ratio; of the
    same groups with equal values by group. Equal pairs have no other match. detail is the largest relative difference, the
    first place, or the ratio.

    Pairs meet on grids of the rule's own tolerance with neighbours and are then verified, so all are found.
    """
    rows = scratch.save(figure_series(series))  # written down, as each step would make the series again
    whole = _whole_matches(rows, tolerance, 0.0)
    exact = whole.where("match_type = 'exact_match'").select("la", "lb")
    groups = _first_of_groups(rows).groupBy("label", "n").agg(F.array_sort(F.collect_list(F.struct("g", "v"))).alias("x")).where("size(x) = n and n >= 2").withColumn("h", F.xxhash64("x"))
    by = groups.select(F.col("label").alias("la"), "n", "x", "h").join(groups.select(F.col("label").alias("lb"), F.col("x").alias("y"), "h"), "h").where("la < lb and x = y")
    by = by.select("la", "lb", "n", F.lit("shared_group_exact_match").alias("match_type"), F.lit(None).cast("double").alias("detail"))
    others = _subset_matches(rows, tolerance).unionByName(_ratio_matches(rows)).unionByName(by).join(exact, ["la", "lb"], "left_anti")
    return whole.unionByName(others)


def cross_figure_pipeline(series: DataFrame) -> DataFrame:
    """The pipeline's variant, for series of two values or more: near is within 1 % (values under 1e-10 count as 1 for scale),
    nothing is looked for inside others, and two or more common groups with equal values suffice.

    Pairs that share two (group, value) meet on one that isn't the commonest of either, in one order for all series.
    """
    rows = scratch.save(figure_series(series).where("n >= 2"))
    whole = _whole_matches(rows, 0.01, 1e-10)
    exact = whole.where("match_type = 'exact_match'").select("la", "lb")
    tokens = _first_of_groups(rows).select("label", "g", F.xxhash64("g", "v").alias("t"))
    common = tokens.groupBy("t").agg(F.count("*").alias("df"))
    sets = tokens.join(common, "t").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"), F.collect_set("g").alias("g")).select("label", "g", F.col("o.t").alias("ts")).where("size(ts) >= 2")
    seeds = sets.select("label", F.explode(F.expr("slice(ts, 1, size(ts) - 1)")).alias("t"))
    pairs = seeds.withColumnRenamed("label", "la").join(seeds.withColumnRenamed("label", "lb"), "t").where("la < lb").select("la", "lb").distinct()
    both = pairs.join(sets.toDF("la", "ga", "ta"), "la").join(sets.toDF("lb", "gb", "tb"), "lb").withColumn("n", F.size(F.array_intersect("ga", "gb")))
    by = both.where((F.col("n") >= 2) & (F.size(F.array_intersect("ta", "tb")) == F.col("n"))).select("la", "lb", "n", F.lit("shared_group_exact_match").alias("match_type"), F.lit(None).cast("double").alias("detail"))
    return whole.unionByName(_ratio_matches(rows).unionByName(by).join(exact, ["la", "lb"], "left_anti"))
