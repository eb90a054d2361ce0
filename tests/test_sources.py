"""Searches and alignments against brute force, and their work where many rows share a value."""

import difflib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from probitas.operators import claims, texts
from probitas.sources import literature


def search_by_force(works, queries, most):
    words = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    out = []
    for q, text in queries:
        hits = sorted(((-len(words(text) & words(t)), y is None, -(y or 0), w) for w, t, y in works if words(text) & words(t)))
        out += [(q, k + 1, h[3], -h[0]) for k, h in enumerate(hits[:most])]
    return sorted(out)


@pytest.mark.parametrize("subsets_to", [0, 2, 8])
def test_search_by_force(spark, subsets_to):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices("ab cd éf Gh i1 j k l m n".split(), k=rng.randint(0, 7)))
    works = [(k, text() if k % 9 else None, rng.choice([None, 2000, 2001, 2002])) for k in range(300)]
    queries = [(k, text() + " zz") for k in range(40)]
    found = literature.search(spark.createDataFrame(works, "work_id long, title string, year int"), spark.createDataFrame(queries, "query_id long, query string"), 4, subsets_to=subsets_to)
    assert sorted((r.query_id, r.place, r.work_id, r.hits) for r in found.collect()) == search_by_force(works, queries, 4)


def test_search_of_common_words(spark):
    """A word that all titles and queries have; every pair of them would be 400 million rows."""
    works = spark.range(20000).select(F.col("id").alias("work_id"), F.concat(F.lit("common w"), F.col("id") % 400).alias("title"), F.lit(2000).alias("year"))
    queries = spark.range(20000).select(F.col("id").alias("query_id"), F.concat(F.lit("common w"), F.col("id") % 300).alias("query"))
    start = time.monotonic()
    found = literature.search(works, queries, 3).collect()
    assert sorted((r.place, r.work_id, r.hits) for r in found if r.query_id == 301) == [(1, 1, 2), (2, 401, 2), (3, 801, 2)] and len(found) == 60000
    assert time.monotonic() - start < 60


def aligned_by_force(claimed, series, mean_tol=0.02, sd_tol=0.05):
    rel = lambda r, x: abs(r - x) / max(abs(r), abs(x), 1.0)
    out = {}
    for name, mean, sd in claimed:
        found = sorted((rel(mean, m), rel(sd, s), ds) for ds, m, s in series if rel(mean, m) <= mean_tol and rel(sd, s) <= sd_tol)
        out[name] = (len(found), sum(a <= mean_tol / 2 and b <= 0.6 * sd_tol for a, b, _ in found), [d for *_, d in found[:5]], found[0][0] if len(found) == 1 else None)
    return out


def test_align_by_force(spark):
    """Crowded, negative, small and repeated means, and limits that are met exactly."""
    rng = random.Random(5)
    cells, series = [], []
    for ds in range(300):
        middle, width = rng.choice([(25.5, 3.0), (0.3, 0.2), (-40.0, 5.0), (1.0, 1.0), (1e6, 2.0), (50.0, 2.0)])
        m, s = round(middle + rng.uniform(-0.02, 0.02) * max(1, abs(middle)), 2), round(width * rng.uniform(0.9, 1.1), 2)
        cells += [(ds, p, v) for p, v in enumerate((m - s, m, m + s))] if ds % 10 else [(ds, p, m) for p in range(3)]
    rows = spark.createDataFrame(cells, "ds long, pos int, value double")
    series = [tuple(r) for r in rows.groupBy("ds").agg(F.avg("value"), F.stddev_samp("value")).collect()]
    claimed = [(str(k), m, s) for k, (_, m, s) in enumerate(series)] + [("q1", 49.0, 2.0), ("q2", 0.98, 0.95), ("q3", -40.0, 5.0), ("q4", 7e7, 1.0), ("q5", -0.01, 0.0)]
    told = spark.createDataFrame([(n, "PCL-0001", "reported_mean_sd", m, s) for n, m, s in claimed], "doc_id string, claim_id string, claim_type string, mean double, sd double")
    got = {r.doc_id: (r.candidate_match_count, r.strong_matches, [c.ds for c in r.candidates or []], r.mean_relative_diff) for r in claims.align(told, rows).collect()}
    assert got == aligned_by_force(claimed, series)


def test_align_where_all_are_alike(spark):
    """30,000 claims that all match 30,000 series; every pair of them would be 900 million rows."""
    rows = spark.range(90000).selectExpr("id % 30000 as ds", "cast(floor(id / 30000) as int) as pos", "100 + floor(id / 30000) + 1e-5D * (id % 30000) as value")
    told = spark.range(30000).selectExpr("cast(id as string) as doc_id", "'PCL-0001' as claim_id", "'reported_mean_sd' as claim_type", "101 + 1e-5D * id as mean", "1D as sd")
    start = time.monotonic()
    assert claims.verdict_counts(claims.align(told, rows)).first().ambiguous == 30000
    assert time.monotonic() - start < 120


def test_common_length_bounds_the_match():
    rng = random.Random(6)
    for _ in range(300):
        x, y = ("".join(rng.choices("ab cé😀", k=rng.randint(0, 40))) for _ in range(2))
        row = [0] * (len(y) + 1)
        for c in x:
            row, old = [0], row
            for j, d in enumerate(y):
                row.append(old[j] + 1 if c == d else max(row[j], old[j + 1]))
        assert texts.common_length(x, y) == row[-1] >= sum(m.size for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks())


def test_review_templates_of_repeated_papers(spark):
    """Papers of the same texts have the same result, which is that of one alone."""
    own = ["The figures need more work before this is sound. The study shows a clear novelty in its field.", "The figures need some work before it is sound. The study shows clear novelty in this field!"]
    rows = spark.createDataFrame([(k, i, t) for k in range(5) for i, t in enumerate(own)], "paper_id long, review_index int, text string")
    got = {tuple(r)[1:] for r in texts.review_templates(rows).collect()}
    alone = {tuple(r)[1:] for r in texts.review_templates(rows.where("paper_id = 0")).collect()}
    assert got == alone and len(got) == 1
