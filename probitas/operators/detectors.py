"""Evidence detectors over numeric series. Each takes cells (ds, pos, value, raw) and gives typed evidence rows.

Common columns: evidence_type, ds_a, ds_b (null for one series), match_type, n, severity (0 informational, 1 low,
2 medium, 3 high, 4 critical), confidence; probability detectors add p_value and fdr_hypothesis_count. Pairs are found
by equi-joins on signatures or, where no signature rules most of them out, counted in blocks; none has a cap on pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions.stats import binomial_tail, chi2_sf_9
from .series import arrays, clean, decimals, informative



def _graded(cases: list[tuple[Column, str | None, int, float]]) -> dict[str, Column]:
    """match_type, severity and confidence of the first case that holds; null severity if none does."""
    match, severity, confidence = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("double")
    for when, name, level, trust in reversed(cases):
        match = F.when(when, F.lit(name)).otherwise(match)
        severity = F.when(when, F.lit(level)).otherwise(severity)
        confidence = F.when(when, F.lit(trust)).otherwise(confidence)
    return {"match_type": match, "severity": severity, "confidence": confidence}


def constant_series(cells: DataFrame, min_n: int = 5) -> DataFrame:
    """Series of one numeric value (10 decimals) or one displayed text."""
    found = clean(cells).groupBy(F.col("ds").alias("ds_a")).agg(
        F.count("*").cast("int").alias("n"), F.min(F.round("value", 10)).alias("lo"), F.max(F.round("value", 10)).alias("hi"),
        F.min(F.nullif("raw", F.lit(""))).alias("raw_lo"), F.max(F.nullif("raw", F.lit(""))).alias("raw_hi"),
    )
    number, text = F.col("lo") == F.col("hi"), F.coalesce(F.col("raw_lo") == F.col("raw_hi"), F.lit(False))
    found = found.where((F.col("n") >= min_n) & (number | text)).withColumns({"numeric_constant": number, "raw_text_constant": text})
    graded = _graded([((F.col("n") >= 8) & number & text, None, 3, 0.88), (F.lit(True), None, 2, 0.72)])
    return found.withColumns(graded).withColumn("evidence_type", F.lit("constant_numeric_series")).select("evidence_type", "ds_a", "n", "numeric_constant", "raw_text_constant", F.col("lo").alias("constant_value"), "severity", "confidence")


#: By mode: (least n, largest variation of differences, least R squared, severity, confidence).
ARITHMETIC = {
    "original_order": [(10, 0.01, 0.9995, 4, 0.96), (8, 0.03, 0.998, 3, 0.88), (6, 0.05, 0.995, 2, 0.72)],
    "sorted_values": [(10, 0.015, 0.9995, 4, 0.96), (8, 0.03, 0.999, 3, 0.88), (8, 0.05, 0.998, 2, 0.72)],
}


def arithmetic_sequences(cells: DataFrame, min_n: int = 6) -> DataFrame:
    """Series whose differences hardly vary, as they stand and sorted. A series is one row, and its line is fitted there."""
    total = lambda what: f"aggregate({what}, 0D, (s, v) -> s + v)"
    series = arrays(clean(cells)).where(F.col("n") >= min_n)
    modes = F.array(F.struct(F.lit("original_order").alias("mode"), "vs"), F.struct(F.lit("sorted_values").alias("mode"), F.array_sort("vs").alias("vs")))
    rows = series.select(F.col("ds").alias("ds_a"), "n", F.inline(modes)).withColumn("steps", F.expr("zip_with(slice(vs, 2, n - 1), slice(vs, 1, n - 1), (b, a) -> b - a)"))
    rows = scratch.save(rows)  # written down, as later steps would evaluate these arrays again for each value they make
    rows = rows.withColumns({"size": F.expr(f"{total('transform(steps, v -> abs(v))')} / (n - 1)"), "_m": F.expr(f"{total('steps')} / (n - 1)"), "_y": F.expr(f"{total('vs')} / n"), "_xx": F.expr("n * (1D * n * n - 1) / 12")}).where("size > 1e-12")
    rows = scratch.save(rows)
    rows = rows.withColumn("cv", F.expr(f"sqrt({total('transform(steps, v -> (v - _m) * (v - _m))')} / (n - 1)) / size"))
    rows = rows.withColumns({"_xy": F.expr(total("transform(vs, (v, i) -> (v - _y) * (i - (n - 1) / 2D))")), "_yy": F.expr(total("transform(vs, v -> (v - _y) * (v - _y))"))})
    rows = scratch.save(rows.drop("steps"))
    rows = rows.withColumns({"slope": F.expr("_xy / _xx"), "r2": F.expr("if(_yy > 0, _xy * _xy / (_xx * _yy), 1D)")})
    rows = rows.withColumn("max_residual", F.expr("array_max(transform(vs, (v, i) -> abs(v - _y - slope * (i - (n - 1) / 2D))))"))
    out = None
    for mode, cases in ARITHMETIC.items():
        graded = _graded([((F.col("n") >= n) & (F.col("cv") <= cv) & (F.col("r2") >= r2), mode, level, trust) for n, cv, r2, level, trust in cases])
        found = rows.where(F.col("mode") == mode).withColumns(graded).where("severity is not null")
        out = found if out is None else out.unionByName(found)
    return out.select(F.lit("approximate_arithmetic_sequence").alias("evidence_type"), "ds_a", F.col("match_type").alias("order_mode"), "n", F.round("cv", 8).alias("cv_of_diffs"), F.round("r2", 8).alias("r_squared"), F.round("slope", 8).alias("slope"), F.round("max_residual", 8).alias("max_residual"), "severity", "confidence")


#: Ids of a class in one row when its pairs are made; classes that are told apart by a broadcast of their representatives.
CHUNK, BROADCAST = 512, 1_000_000


def classes(series: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Of series (ds, keys...): one of each class of equal keys (the least ds), and the classes' ids in chunks (rep, c, of); both written down, as they are read again and again.

    The series are evaluated once. Classes are made on a digest of the keys, so that arrays are not dealt out again.
    """
    mark = F.unhex(F.sha2(F.to_json(F.struct(*keys)).cast("binary"), 256))
    marked = scratch.save(series.select("ds", *keys, mark.alias("_mark")))
    reps = scratch.save(marked.groupBy("_mark").agg(F.min("ds").alias("rep"), F.count("*").alias("_k")))
    chunk = F.pmod(F.xxhash64("ds"), F.ceil(F.col("_k") / CHUNK)).cast("int").alias("c")
    members = scratch.save(marked.select("ds", "_mark").join(reps, "_mark").groupBy("rep", chunk).agg(F.collect_list("ds").alias("of")))
    few = reps.select(F.col("rep").alias("ds"))
    one = scratch.save(marked.drop("_mark").join(F.broadcast(few) if few.count() <= BROADCAST else few, "ds", "left_semi"))
    scratch.drop(marked)
    scratch.drop(reps)
    return one, members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives as pairs (ds_a, ds_b) of all that they stand for, with `turned` where a stands for ds_b.
    A pair (a, a) gives the pairs within its class.

    Chunks of ids are dealt out, pairs of chunks evenly, and pairs of ids not at all. The number of parts is given, as it
    would else go by the chunks' size, not that of the pairs.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(members.toDF("a", "_c", "_of"), "a").join(members.toDF("b", "_d", "_to"), "b").where("a <> b or _c <= _d").repartition(parts, "a", "b", "_c", "_d")
    out = both.withColumn("_x", F.explode("_of")).withColumn("_y", F.explode("_to")).where("a <> b or _c < _d or _x < _y")
    return out.withColumns({"ds_a": F.least("_x", "_y"), "ds_b": F.greatest("_x", "_y"), "turned": F.col("_x") > F.col("_y")}).drop("a", "b", "_x", "_y", "_c", "_d", "_of", "_to")


def _within(members: DataFrame) -> DataFrame:
    """(a, b): each representative of several series with itself."""
    return members.groupBy("rep").agg(F.sum(F.size("of")).alias("k")).where("k > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))


#: Series in a block at most; blocks at least, unless there are few series; series in a tile of pairs; elements in a block, about.
BLOCK, BLOCKS, TILE, ELEMENTS = 16_384, 6, 1024, 1 << 21


def _dealt(one: DataFrame, arrays: list[str], *by: str, block: int = BLOCK, elements: int = ELEMENTS) -> DataFrame:
    """Of series (ds, arrays..., by...): each with every block of those of the same `by`, for groups (by..., i, j) of a block's or two blocks' series; `own` is a series' block."""
    sizes = one.groupBy(*by).agg(F.count("*").alias("_k"), F.sum(F.size(arrays[0])).alias("_e"))
    blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("_k") / 256)), F.ceil(F.col("_k") / block), F.ceil(F.col("_e") / elements)).cast("int")
    sizes = F.broadcast(sizes.select(*by, blocks.alias("_b")))  # a row a length of series, or one
    rows = one.join(sizes, list(by)) if by else one.crossJoin(sizes)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("ds"), F.col("_b")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    parts = 4 * int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("ds", *arrays, *by, "own", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j")).repartition(parts, *by, "i", "j")


def _tiles(group: pa.Table, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a group that meet, tile by tile, taken in `order`; where a tile meets itself, only pairs x < y count."""
    own, i, j = group.column("own").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    order = np.arange(len(own)) if order is None else order
    at, to = order[own[order] == i], order[own[order] == j]
    for k in range(0, len(at), TILE):
        for m in range(k if i == j else 0, len(to), TILE):
            yield at[k : k + TILE], to[m : m + TILE]


def _agreeing(one: DataFrame, equal: float, suffix: float) -> DataFrame:
    """(a, b): pairs, each once, of series (ds, n, vs, ss) of one length that agree at `equal` of their places, or of eight values and more in the suffix at `suffix` of them.

    All pairs of a length are counted, block by block; no candidate is written down. Values within 1e-12 of their next one count as equal.
    """
    def run(group: pa.Table) -> pa.Table:
        ids, n = group.column("ds"), group.column("n")[0].as_py()
        values = group.column("vs").combine_chunks().flatten().to_numpy()
        known, code = np.unique(values, return_inverse=True)
        code = np.append(0, np.cumsum(np.diff(known) > 1e-12)).astype(np.int32)[code].reshape(-1, n).T.copy()
        marks = group.column("ss").combine_chunks().flatten().to_numpy().astype(np.int8).reshape(-1, n).T.copy()
        kind = np.uint8 if n < 256 else np.int32
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at, to in _tiles(group):
            same, alike = np.zeros((len(at), len(to)), kind), np.zeros((len(at), len(to)), kind)
            for x, y, u, v in zip(code[:, at], code[:, to], marks[:, at], marks[:, to]):
                same += x[:, None] == y
                if n >= 8:
                    alike += (u[:, None] == v) & (v >= 0)
            x, y = np.nonzero((same >= math.ceil(equal * n)) | (alike >= math.ceil(suffix * n)))
            x, y = at[x], to[y]
            once = x < y if at[0] == to[0] else slice(None)
            found.append((x[once], y[once]))
        x, y = (np.concatenate(p) for p in zip(*found))
        return pa.table([ids.take(pa.array(x)), ids.take(pa.array(y))], ["a", "b"])

    kind = one.schema["ds"].dataType.simpleString()
    return _dealt(one, ["vs", "ss"], "n").groupBy("n", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(cells: DataFrame) -> DataFrame:
    """Pairs of equal length that agree at most places: in value, nearly, or in the last two decimals.

    The rules ask for at least three fifths of the places equal, or 68 % with equal suffixes; pairs of a length that have
    so many are counted, and graded afterwards. Equal series go in as one, as no rule names them.
    Series shorter than six values are left out.
    """
    place = (F.col("pos").cast("long") * 128 + F.coalesce(F.col("suffix2").cast("int"), F.lit(127))).alias("p")  # one number, as all cells are dealt out
    rows = decimals(clean(cells)).groupBy("ds").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct(place, F.expr("value + 0D").alias("v")))).alias("x")).where("n >= 6")
    series = rows.select("ds", "n", F.expr("transform(x, y -> y.v)").alias("vs"), F.expr("transform(x, y -> cast(if(pmod(y.p, 128) = 127, -1, pmod(y.p, 128)) as int))").alias("ss"))
    one, members = classes(series, "n", "vs", "ss")
    pairs = _agreeing(one, 0.6, 0.68)
    both = pairs.join(one.toDF("a", "n", "va", "sa"), "a").join(one.select(F.col("ds").alias("b"), F.col("vs").alias("vb"), F.col("ss").alias("sb")), "b")
    count = lambda what: F.expr(f"cast(size(filter({what}, z -> z)) as int)")
    found = both.select("a", "b", "n", count("zip_with(va, vb, (x, y) -> abs(x - y) <= 1e-12)").alias("equal"),
        count("zip_with(va, vb, (x, y) -> abs(x - y) <= greatest(1e-9D, 1e-6D * greatest(abs(x), abs(y), 1D)))").alias("near"),
        count("zip_with(sa, sb, (x, y) -> x >= 0 and y >= 0)").alias("valid"), count("zip_with(sa, sb, (x, y) -> x = y and x >= 0)").alias("same_suffix"),
    ).where("equal < n").withColumn("diff", F.col("n") - F.col("equal"))
    n = F.col("n")
    graded = _graded([
        ((n >= 8) & (F.col("equal") >= 0.85 * n) & (F.col("diff") <= F.greatest(F.lit(2), F.floor(0.15 * n))), "positionwise_near_duplicate", 3, 0.89),
        ((n >= 8) & (F.col("near") >= 0.90 * n) & (F.col("diff") <= F.greatest(F.lit(3), F.floor(0.20 * n))), "positionwise_near_equal", 2, 0.78),
        ((n >= 8) & (F.col("valid") >= F.greatest(F.lit(8), F.ceil(0.8 * n))) & (F.col("same_suffix") >= 0.85 * F.col("valid")), "positionwise_decimal_suffix2_reuse", 2, 0.74),
        ((F.col("equal") >= 0.83 * n) & (F.col("diff") <= 1), "small_sample_near_duplicate", 2, 0.70),
    ])
    found = expanded(found.withColumns(graded).where("severity is not null"), members)
    return found.select(F.lit("near_duplicate_numeric_series").alias("evidence_type"), "ds_a", "ds_b", "match_type", "n", F.col("equal").alias("equal_position_count"), F.col("near").alias("near_equal_count"), F.col("valid").alias("suffix2_valid_count"), F.col("same_suffix").alias("suffix2_equal_count"), "severity", "confidence")


def _grams(cells: DataFrame) -> DataFrame:
    """(ds, n, w, start, gram): windows of 5, 4 and 3 rounded values that aren't constant."""
    series = arrays(clean(cells)).where("n >= 6").withColumn("vs", F.expr("transform(vs, v -> round(v, 8) + 0D)"))
    rows = series.select("ds", "n", "vs", F.explode(F.array(F.lit(5), F.lit(4), F.lit(3))).alias("w")).where("n >= w")
    rows = rows.select("ds", "n", "w", F.expr("posexplode(transform(sequence(0, n - w), i -> slice(vs, i + 1, w)))").alias("start", "gram"))
    return rows.where("array_min(gram) < array_max(gram)")


def fragments_within(cells: DataFrame) -> DataFrame:
    """The longest window size with a repeated fragment in a series; most repeats, then the earliest."""
    found = _grams(cells).where("n >= 2 * w").groupBy("ds", "n", "w", "gram").agg(F.count("*").cast("int").alias("times"), F.min("start").alias("first")).where("times >= 2")
    best = F.row_number().over(Window.partitionBy("ds").orderBy(F.desc("w"), F.desc("times"), "first"))
    found = found.withColumn("r", best).where("r = 1")
    strong = (F.col("w") >= 4) & (F.col("n") >= 8)
    return found.withColumns(_graded([(strong, None, 3, 0.84), (F.lit(True), None, 2, 0.72)])).select(
        F.lit("repeated_numeric_fragment").alias("evidence_type"), F.col("ds").alias("ds_a"), "n", F.col("w").alias("fragment_length"), F.col("times").alias("occurrence_count"), F.col("first").alias("first_start"),
        F.round(F.least(F.lit(1.0), F.col("times") * F.col("w") / F.col("n")), 6).alias("coverage_ratio"), "severity", "confidence")


def fragments_across(cells: DataFrame) -> DataFrame:
    """For each pair of series that share a fragment: the longest window size, and its least fragment.

    A shared window of four or five that isn't constant holds a shared one of three that isn't, so pairs meet on those
    alone; equal series go in as one.
    """
    series = arrays(clean(cells)).where("n >= 6").withColumn("vs", F.expr("transform(vs, v -> round(v, 8) + 0D)"))
    one, members = classes(series, "n", "vs")
    windows = lambda w: F.expr(f"array_distinct(filter(transform(sequence(0, n - {w}), i -> slice(vs, i + 1, {w})), g -> array_min(g) < array_max(g)))")
    one = scratch.save(one.select("ds", "n", *[windows(w).alias(f"w{w}") for w in (5, 4, 3)]).where("size(w3) > 0"))
    keys = one.select("ds", F.explode(F.expr("transform(w3, g -> xxhash64(g))")).alias("t"))
    pairs = keys.toDF("a", "t").join(keys.toDF("b", "t"), "t").where("a < b").select("a", "b").distinct()
    itself = _within(members).join(one.select(F.col("ds").alias("a")), "a", "left_semi")
    both = pairs.unionByName(itself).join(one.toDF("a", "na", "a5", "a4", "a3"), "a").join(one.toDF("b", "nb", "b5", "b4", "b3"), "b")
    shared = both.select("a", "b", F.least("na", "nb").alias("n"), *[F.array_intersect(f"a{w}", f"b{w}").alias(f"g{w}") for w in (5, 4, 3)]).where("size(g3) > 0")
    best = F.when(F.size("g5") > 0, F.struct(F.lit(5).alias("w"), F.array_min("g5").alias("g"))).when(F.size("g4") > 0, F.struct(F.lit(4).alias("w"), F.array_min("g4").alias("g"))).otherwise(F.struct(F.lit(3).alias("w"), F.array_min("g3").alias("g")))
    found = expanded(shared.select("a", "b", "n", best.alias("x")).select("a", "b", "n", "x.w", F.expr("x.g[0]").alias("v")), members).drop("turned")
    strong = (F.col("w") >= 4) & (F.col("n") >= 8)
    return found.withColumns(_graded([(strong, None, 3, 0.86), (F.lit(True), None, 2, 0.74)])).select(
        F.lit("repeated_numeric_fragment").alias("evidence_type"), "ds_a", "ds_b", "n", F.col("w").alias("fragment_length"), F.col("v").alias("fragment_first_value"), F.round(F.col("w") / F.col("n"), 6).alias("coverage_ratio"), "severity", "confidence")


def similarity(cells: DataFrame) -> DataFrame:
    """Pairs of informative series (n >= 5) that are equal, near, permuted, rescaled, or contained in one another.

    Equal series go in as one of their class; pairs within a class need no search. Near and permuted series meet on coarse
    means, first values and magnitudes of their values in order or sorted, linear images on standardised values, subsets
    on the shorter's rarest value. Each grid is tried with its neighbours, and every candidate is then verified by the
    stated rule. A constant right series counts as a linear image of any series of its length. The first rule that holds names a pair: equal, near in order, permuted (equal or near), linear.
    """
    series = informative(arrays(clean(cells)).where("n >= 5"))
    series = series.withColumn("vs", F.expr("transform(vs, v -> v + 0D)"))
    one, members = classes(series, "n", "vs")
    one = one.withColumn("sorted", F.array_sort("vs"))
    same = expanded(_within(members).join(one.select(F.col("ds").alias("a"), "n"), "a"), members).select("ds_a", "ds_b", "n", F.lit("same_order_exact").alias("match_type"))
    ordered = scratch.save(_close(one.where("n >= 8"), "vs", 1e-3).select("a", "b", "n", F.lit("same_order_near").alias("match_type")))
    permuted = _close(one, "sorted", 1e-6).join(ordered, ["a", "b"], "left_anti")
    equal = F.expr("forall(zip_with(va, vb, (x, y) -> round(x, 10) = round(y, 10)), z -> z)")
    permuted = permuted.select("a", "b", "n", F.when(equal, "permutation_exact").otherwise("permutation_near").alias("match_type"))
    near = scratch.save(ordered.unionByName(permuted))
    line = expanded(_linear(one).join(near, ["a", "b"], "left_anti"), members).where(F.when(F.col("turned"), F.col("fits_a")).otherwise(F.col("fits_b")))
    flat = one.where("n >= 8 and aggregate(vs, 0D, (s, v) -> s + pow(v - vs[0], 2)) <= 1e-12").select(F.col("ds").alias("b"), "n")
    flat = one.select(F.col("ds").alias("a"), "n").join(flat, "n").where("a <> b").withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    flat = expanded(flat.join(near.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti").select("a", "b", "n"), members).where("not turned")
    line = line.select("ds_a", "ds_b", "n").unionByName(flat.select("ds_a", "ds_b", "n")).distinct()
    inside = _subsets(one)
    found = same.unionByName(expanded(near, members).drop("turned")).unionByName(line.select("ds_a", "ds_b", "n", F.lit("linear_transform_near").alias("match_type"))).unionByName(expanded(inside, members).select("ds_a", "ds_b", "n", F.lit("permutation_subset_exact").alias("match_type")))
    kind = F.col("match_type")
    return found.withColumns({c: v for c, v in _graded([
        (kind == "same_order_exact", None, 4, 0.99), (kind == "permutation_exact", None, 4, 0.98), (kind == "same_order_near", None, 3, 0.91), (kind == "permutation_near", None, 3, 0.90),
        (kind == "linear_transform_near", None, 3, 0.88), (F.col("n") >= 10, None, 4, 0.96), (F.lit(True), None, 3, 0.87),
    ]).items() if c != "match_type"}).select("ds_a", "ds_b", "match_type", "n", "severity", "confidence", F.lit("raw_numeric_similarity").alias("evidence_type"))


def _close(series: DataFrame, values: str, tolerance: float) -> DataFrame:
    """(a, b, n, va, vb): pairs a < b of one length whose arrays differ by at most tolerance times their largest value, or 1, anywhere.

    Such pairs are neighbours on a grid of the logarithm of the largest value, and on one, in units of twice the
    tolerance at that size, of the mean and of the first value. Only keys are dealt out; arrays are joined afterwards.
    """
    step = 2 * tolerance
    rows = series.select("ds", "n", F.col(values).alias("v"))
    rows = rows.withColumns({"size": F.greatest(F.expr("array_max(transform(v, x -> abs(x)))"), F.lit(1.0)), "mean": F.expr("aggregate(v, 0D, (s, x) -> s + x) / n"), "first": F.expr("v[0]"), "mid": F.expr("v[div(n, 2)]")})
    rows = rows.withColumn("level", F.floor(F.log("size") / step)).drop("v")
    cell = lambda name, at: F.floor(F.col(name) / (step * F.exp(step * (F.col(at) + 2))))
    left = rows.select(F.col("ds").alias("a"), "n", "level", cell("mean", "level").alias("m"), cell("first", "level").alias("f"), F.col("mid").alias("mid_a"), F.col("size").alias("size_a"))
    around = lambda name: F.explode(F.array(*[F.col(name) + d for d in (-1, 0, 1)]))
    right = rows.withColumn("level", around("level"))
    right = right.select(F.col("ds").alias("b"), "n", "level", cell("mean", "level").alias("m"), cell("first", "level").alias("f"), F.col("mid").alias("mid_b"), F.col("size").alias("size_b"))
    for name in ("m", "f"):
        right = right.withColumn(name, around(name))
    scale = F.greatest("size_a", "size_b")
    pairs = left.join(right, ["n", "level", "m", "f"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("mid_a") - F.col("mid_b")) <= tolerance * scale))
    of = series.select("ds", F.col(values).alias("v"))
    found = pairs.select("a", "b", "n", scale.alias("scale")).join(of.toDF("a", "va"), "a").join(of.toDF("b", "vb"), "b")
    return found.where(F.expr("array_max(zip_with(va, vb, (x, y) -> abs(x - y))) / scale") <= tolerance).drop("scale")


def _linear(series: DataFrame) -> DataFrame:
    """(a, b, n, fits_a, fits_b): pairs a < b of equal length n >= 8 with R squared >= .999; whether the residual of b (of a)
    on the other is small.

    With standardised values x and y, or -y for a negative slope, the squares of x - y add up to 2 n (1 - r), at most .001 n.
    So no projection to a unit vector differs by more than its root. Pairs meet on a grid of that width, with its
    neighbours, of four projections to vectors of mixed signs, which are spread evenly however the values are.
    """
    rows = series.where("n >= 8").withColumn("mean", F.expr("aggregate(vs, 0D, (s, v) -> s + v) / n"))
    rows = rows.withColumn("sd", F.expr("sqrt(aggregate(vs, 0D, (s, v) -> s + (v - mean) * (v - mean)) / n)"))
    z = scratch.save(rows.where("sd > 0").select("ds", "n", "sd", F.expr("transform(vs, v -> try_divide(v - mean, sd))").alias("z")))
    width = F.sqrt(0.001 * F.col("n")) + 1e-6
    signed = [F.expr(f"aggregate(transform(z, (v, i) -> if(pmod(xxhash64(i, {k}), 2) = 0, v, -v)), 0D, (s, v) -> s + v) / sqrt(n)") for k in range(4)]
    cells = scratch.save(z.select("ds", "n", *[(p / width).alias(f"p{k}") for k, p in enumerate(signed)]))
    cell = lambda k, sign: F.floor(sign * F.col(f"p{k}")).cast("int")
    left = cells.select(F.col("ds").alias("a"), "n", *[cell(k, 1).alias(f"c{k}") for k in range(4)])
    right = cells.select(F.col("ds").alias("b"), "n", F.inline(F.array(*[F.struct(F.lit(sign).alias("sign"), *[cell(k, sign).alias(f"c{k}") for k in range(4)]) for sign in (1, -1)])))
    for k in range(4):
        right = right.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + d for d in (-1, 0, 1)])))
    pairs = left.join(right, ["n", "c0", "c1", "c2", "c3"]).where("a < b").select("a", "b").distinct()
    both = pairs.join(z.toDF("a", "n", "sa", "za"), "a").join(z.select(F.col("ds").alias("b"), F.col("sd").alias("sb"), F.col("z").alias("zb")), "b")
    both = both.withColumn("r", F.expr("aggregate(zip_with(za, zb, (x, y) -> x * y), 0D, (s, v) -> s + v) / n")).withColumn("r2", F.least(F.lit(1.0), F.col("r") * F.col("r"))).where("r2 >= 0.999")
    small = lambda s: F.col(s) * F.sqrt(1 - F.col("r2")) / F.greatest(F.col(s), F.lit(1.0)) <= 0.01
    return both.select("a", "b", "n", small("sa").alias("fits_a"), small("sb").alias("fits_b"))


def _subsets(series: DataFrame) -> DataFrame:
    """(a, b, n): pairs of unequal length where the shorter's values (10 decimals), with repeats, all occur in the longer.

    The longer has the shorter's rarest value too, so they meet on that alone.
    """
    values = F.expr("array_sort(transform(vs, v -> round(v, 10) + 0D))")
    tokens = F.expr("transform(w, (v, i) -> xxhash64(v, i - array_position(w, v) + 1))")
    rows = scratch.save(series.select("ds", "n", values.alias("w")).select("ds", "n", tokens.alias("ts")))
    each = rows.select("ds", "n", F.explode("ts").alias("t"))
    common = each.groupBy("t").agg(F.count("*").alias("df"))
    rarest = each.join(common, "t").groupBy("ds").agg(F.min_by("t", F.struct("df", "t")).alias("t"), F.first("n").alias("ns")).withColumnRenamed("ds", "s")
    pairs = rarest.join(each.select(F.col("ds").alias("l"), F.col("n").alias("nl"), "t"), "t").where("ns < nl").select("s", "l", "ns")
    both = pairs.join(rows.select(F.col("ds").alias("s"), F.col("ts").alias("x")), "s").join(rows.select(F.col("ds").alias("l"), F.col("ts").alias("y")), "l")
    found = both.where(F.size(F.array_except("x", "y")) == 0)
    return found.select(F.col("s").alias("a"), F.col("l").alias("b"), F.col("ns").cast("int").alias("n"))


def suffix_overrepresentation(cells: DataFrame) -> DataFrame:
    """The most frequent decimal suffix of two and three digits, where a binomial tail finds it too frequent."""
    out = None
    for size in (2, 3):
        rows = decimals(clean(cells)).where(F.col(f"suffix{size}").isNotNull()).groupBy("ds", F.col(f"suffix{size}").alias("suffix")).agg(F.count("*").cast("int").alias("c"), F.min("pos").alias("first"))
        w = Window.partitionBy("ds")
        rows = rows.withColumns({"n": F.sum("c").over(w).cast("int"), "r": F.row_number().over(w.orderBy(F.desc("c"), "first", "suffix"))})
        rows = rows.where(f"r = 1 and n >= 20 and c >= greatest(4, cast(0.18 * n as int))").withColumn("p_value", binomial_tail("c", "n", 10.0**-size)).where("p_value <= 1e-3")
        rows = rows.select("ds", "n", F.lit(size).alias("suffix_length"), "suffix", F.col("c").alias("observed_count"), "p_value", F.lit(10**size).alias("fdr_hypothesis_count"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns(_graded([(F.col("p_value") <= 1e-5, None, 3, 0.90), (F.lit(True), None, 2, 0.76)])).select(F.lit("decimal_suffix_overrepresentation").alias("evidence_type"), F.col("ds").alias("ds_a"), "n", "suffix_length", "suffix", "observed_count", "p_value", "fdr_hypothesis_count", "severity", "confidence")


#: Tokens in a product of matrices; series and elements in a block of suffixes.
WIDE, SUFFIX_BLOCK, SUFFIX_ELEMENTS = 4096, 32_768, 1 << 22
#: Groups of suffixes in a short and a long signature; share of a tile's pairs up to which the short one does; of those up to
#: which pairs are counted one by one, so many at once; bytes of rows of bits at most.
GROUPS, SHORT_DOES, FEW, AT_ONCE, BIT_BYTES = (48, 96), 0.04, 0.15, 1 << 14, 64 << 20
_MIXED = np.random.default_rng(3).permutation(1000)


def _signatures(row: np.ndarray, suffix: np.ndarray, n: int, groups: int) -> np.ndarray:
    """Of each of n series two signs a group of suffixes: the count modulo 4 in Gray code.

    Counts that differ by d differ in d signs at most, so two series differ in no more signs than there are suffixes,
    repeats counted, that only one of them has.
    """
    counts = np.bincount(row * groups + _MIXED[suffix] % groups, minlength=n * groups).reshape(n, groups)
    return np.concatenate([counts >> 1 & 1, counts + 1 >> 1 & 1], axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _tokens(series: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted lists of suffixes: each element's list, its token (suffix, how many of it came before), and the lists' lengths."""
    series = series.combine_chunks() if isinstance(series, pa.ChunkedArray) else series
    flat, sizes = series.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(series.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.ones(len(flat), bool)
    first[1:] = (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])
    at = np.arange(len(flat))
    return row, flat << 32 | at - np.maximum.accumulate(np.where(first, at, 0)), sizes


def _overlapping(one: DataFrame, share: float) -> DataFrame:
    """(a, b, n, shared_suffix_count): pairs, each once, of series whose sorted suffixes (ts) overlap by `share` of the smaller's n.

    All pairs go through their signatures, block by block; a task has two blocks, and no candidate is written down. Series
    of a and b suffixes that differ in h signs share (a + b - h) / 2 of them at most; the overlaps of pairs for which that is
    enough are counted. The k-th occurrence of a suffix is a token: the overlap is the number of common bits of two rows, or,
    where most pairs of a tile are left or the rows are too wide, a product of rows of zeros and ones, which is exact.
    """
    def run(group: pa.Table) -> pa.Table:
        ids, (row, token, sizes) = group.column("ds"), _tokens(group.column("ts"))
        signs = [_signatures(row, token >> 32, len(sizes), k) for k in GROUPS]
        known, token, times = np.unique(token, return_inverse=True, return_counts=True)
        row, token, known = row[times[token] > 1], token[times[token] > 1], np.cumsum(times > 1) - 1
        token, begin = known[token], np.searchsorted(row, np.arange(len(sizes) + 1))
        most = int(known[-1]) + 1 if len(known) else 0
        words = most // 64 + 1
        bits = np.zeros((len(sizes), words) if 8 * words * len(sizes) <= BIT_BYTES else (0, 0), np.uint64)
        if len(bits):
            np.add.at(bits.reshape(-1), row * words + (token >> 6), np.uint64(1) << (token & 63).astype(np.uint64))

        def tile(rows: np.ndarray, low: int, width: int) -> np.ndarray:
            out, counts = np.zeros((len(rows), width), np.float32), begin[rows + 1] - begin[rows]
            t = token[np.repeat(begin[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            inside = (t >= low) & (t < low + width)
            out[np.repeat(np.arange(len(rows)), counts)[inside], t[inside] - low] = 1
            return out

        products, enough = np.empty(TILE * TILE, np.float32), np.empty(TILE * TILE, bool)

        def close(sign: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
            """Places of the pairs whose signs let the overlap suffice. Rows come by size; one bound holds for those of one size."""
            a, b, shape = sizes[at], sizes[to], (len(at), len(to))
            near, out = products[: len(at) * len(to)].reshape(shape), enough[: len(at) * len(to)].reshape(shape)
            np.matmul(sign[at].astype(np.float32), sign[to].astype(np.float32).T, out=near)
            cuts = [0, *(np.flatnonzero(np.diff(a)) + 1), len(a)]
            for low, high in zip(cuts, cuts[1:]):
                bound = sign.shape[1] + 4 * share * np.minimum(a[low], b) - 2 * (a[low] + b) - 0.01
                np.greater_equal(near[low:high], bound.astype(np.float32), out=out[low:high])
            return np.flatnonzero(out)

        found = [(np.zeros(0, np.int64),) * 3]
        for at, to in _tiles(group, np.argsort(sizes, kind="stable")):
            few = len(close(signs[0], at[::32], to)) <= SHORT_DOES * len(at[::32]) * len(to)
            left = close(signs[0 if few else 1], at, to)
            x, y = at[left // len(to)], to[left % len(to)]
            if len(bits) and len(x) <= FEW * len(at) * len(to):
                c = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[x[k : k + AT_ONCE]] & bits[y[k : k + AT_ONCE]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), AT_ONCE))])
                kept = c >= share * np.minimum(sizes[x], sizes[y])
                x, y, c = x[kept], y[kept], c[kept]
            elif len(x):
                common = np.zeros((len(at), len(to)), np.float32)
                for low in range(0, most, WIDE):
                    width = min(WIDE, most - low)
                    common += tile(at, low, width) @ tile(to, low, width).T
                x, y = np.nonzero(common >= share * np.minimum(sizes[at][:, None], sizes[to]).astype(np.float64))
                c, x, y = common[x, y].astype(np.int64), at[x], to[y]
            once = x < y if at[0] == to[0] else slice(None)
            found.append((x[once], y[once], c[once]) if len(x) else found[0])
        x, y, c = (np.concatenate(p) for p in zip(*found))
        return pa.table([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(np.minimum(sizes[x], sizes[y]).astype(np.int32)), pa.array(c.astype(np.int32))], ["a", "b", "n", "shared_suffix_count"])

    kind = one.schema["ds"].dataType.simpleString()
    dealt = _dealt(one, ["ts"], block=SUFFIX_BLOCK, elements=SUFFIX_ELEMENTS)
    return dealt.groupBy("i", "j").applyInArrow(run, f"a {kind}, b {kind}, n int, shared_suffix_count int")


def suffix_reuse(cells: DataFrame, share: float = 0.85) -> DataFrame:
    """Pairs of series whose multisets of suffixes overlap by at least 85 % of the smaller.

    With a hundred suffixes of two digits any two series share about half of them, so neither rare tokens nor sizes rule
    pairs out. Series of equal suffixes go in as one, and all others meet in blocks, first by short signatures.
    """
    out, sizes = None, (2, 3)
    lists = scratch.save(decimals(clean(cells)).groupBy("ds").agg(*[F.array_sort(F.collect_list(F.col(f"suffix{k}").cast("tinyint" if k == 2 else "smallint"))).alias(f"s{k}") for k in sizes]))
    for size in sizes:
        one, members = classes(lists.select("ds", F.col(f"s{size}").alias("ts")).where("size(ts) >= 8"), "ts")
        same = _within(members).join(one.select(F.col("ds").alias("a"), F.size("ts").alias("n")), "a").withColumn("shared_suffix_count", F.col("n"))
        found = scratch.save(_overlapping(one, share).unionByName(same))
        found = expanded(found, members).drop("turned").withColumn("suffix_length", F.lit(size))
        out = found if out is None else out.unionByName(found)
    graded = out.withColumns(_graded([(F.col("n") >= 15, None, 3, 0.90), (F.lit(True), None, 2, 0.78)]))
    return graded.select(F.lit("decimal_suffix_reuse_across_datasets").alias("evidence_type"), "ds_a", "ds_b", "suffix_length", "n", "shared_suffix_count", F.round(F.col("shared_suffix_count") / F.col("n"), 6).alias("suffix_multiset_similarity"), "severity", "confidence")


def digit_counts(cells: DataFrame) -> DataFrame:
    """(ds, n, digit, c) for all ten digits of series with at least 20 last digits."""
    counts = decimals(clean(cells)).where("last_digit is not null").groupBy("ds").agg(F.count("*").cast("int").alias("n"), *[F.count_if(F.col("last_digit") == d).cast("int").alias(f"d{d}") for d in range(10)])
    digits = F.array(*[F.struct(F.lit(d).alias("digit"), F.col(f"d{d}").alias("c")) for d in range(10)])
    return counts.where("n >= 20").select("ds", "n", F.inline(digits))


def last_digits(cells: DataFrame, uniformity: bool = True) -> DataFrame:
    """Last digits that are too frequent, missing, or (with `uniformity`) unevenly spread by chi-square."""
    rows = digit_counts(cells)
    more = rows.where("c >= greatest(ceil(n / 5), ceil(n / 10 + 5))").withColumn("p_value", binomial_tail("c", "n", 0.1)).where("p_value <= 0.01")
    more = more.withColumns(_graded([(F.col("p_value") <= 1e-6, None, 4, 0.97), (F.lit(True), None, 3, 0.88)])).withColumn("evidence_type", F.lit("last_digit_overrepresentation"))
    none = rows.where("c = 0").withColumn("p_value", F.pow(F.lit(0.9), "n")).where("p_value <= 0.01")
    none = none.withColumns(_graded([(F.col("p_value") <= 1e-4, None, 3, 0.86), (F.lit(True), None, 2, 0.72)])).withColumn("evidence_type", F.lit("last_digit_absence"))
    out = more.unionByName(none)
    if uniformity:
        chi = rows.groupBy("ds", "n").agg(F.sum(F.pow(F.col("c") - F.col("n") / 10, 2) / (F.col("n") / 10)).alias("x")).where("x >= 21.665994").withColumn("p_value", chi2_sf_9("x")).where("p_value <= 0.01")
        chi = chi.withColumns(_graded([(F.col("p_value") <= 1e-4, None, 3, 0.88), (F.lit(True), None, 2, 0.74)])).withColumns({"evidence_type": F.lit("last_digit_distribution_chisquare"), "digit": F.lit(None).cast("int"), "c": F.lit(None).cast("int")}).drop("x")
        out = out.unionByName(chi)
    return out.select("evidence_type", F.col("ds").alias("ds_a"), "n", "digit", F.col("c").alias("observed_count"), "p_value", F.lit(21).alias("fdr_hypothesis_count"), "severity", "confidence")


def any_digit_missing(n: str = "n") -> Column:
    """Probability that some digit of ten is missing among n, by inclusion and exclusion."""
    ways = {1: 10, 2: 45, 3: 120, 4: 210, 5: 252, 6: 210, 7: 120, 8: 45, 9: 10, 10: 1}
    total = sum((F.lit(float(w if j % 2 else -w)) * F.pow(F.lit((10 - j) / 10), F.col(n)) for j, w in ways.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
