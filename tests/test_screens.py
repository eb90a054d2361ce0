"""Known answers of the screens on small fixtures."""

import difflib
import io
import math
import random
import re
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from probitas import scratch
from probitas.functions import numbers, stats
from probitas.operators import claims, detectors, evidence, figures, graph, methodology, risk, statistics, texts
from probitas.plans import precheck as precheck_plan
from probitas.plans.precheck import precheck, precheck_classes
from probitas.sources import html, workbooks


def cells(spark, **series):
    rows = [(int(k[1:]), i, float(v), f"{v:.2f}" if isinstance(v, float) else str(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "ds long, pos int, value double, raw string")


def test_last_digits(spark):
    counts = {5: 26, 0: 7, 1: 7, 2: 7, 3: 0, 4: 6, 6: 6, 7: 5, 8: 3, 9: 3}
    c = cells(spark, s1=[1 + d / 10 for d, k in counts.items() for _ in range(k)]).withColumn("raw", F.format_string("%.1f", "value"))
    found = {(r.evidence_type, r.digit): r for r in detectors.last_digits(c).collect()}
    over, none, chi = found["last_digit_overrepresentation", 5], found["last_digit_absence", 3], found["last_digit_distribution_chisquare", None]
    assert over.observed_count == 26 and over.p_value == pytest.approx(1.31959218e-9, rel=1e-6)
    assert none.p_value == pytest.approx(0.9**70) and chi.p_value == pytest.approx(2.25697068e-10, rel=1e-6)
    q = evidence.calibrate(evidence.fdr(detectors.last_digits(c))).collect()
    assert all(r.q_value >= r.p_value for r in q) and max(r.severity for r in q) == 4
    missing = c.limit(1).select(F.lit(70).alias("n")).select(detectors.any_digit_missing()).first()[0]
    assert missing > 0.9**70


def test_arithmetic(spark):
    found = detectors.arithmetic_sequences(cells(spark, s1=[10.0, 11.01, 11.99, 13.0, 14.02, 15.01, 16.0, 17.0, 18.01, 19.0])).collect()
    assert found and found[0].cv_of_diffs < 0.05 and found[0].r_squared > 0.99


def test_permutation_and_zero_guard(spark):
    v = [1.11, 2.35, 3.47, 4.59, 5.61, 6.73, 7.85, 8.97]
    got = detectors.similarity(cells(spark, s1=v, s2=v[3:] + v[:3])).collect()
    assert [(r.match_type, r.severity) for r in got] == [("permutation_exact", 4)]
    assert detectors.similarity(cells(spark, s1=[0.0] * 8, s2=[0.0] * 8, s3=[0.0] * 8 + [1.0], s4=[0.0] * 8 + [1.0])).isEmpty()
    z = [0.0, 0.0, 0.0, 1.1, 2.2, 3.3, 4.4, 5.5]
    assert detectors.similarity(cells(spark, s1=z, s2=z)).first().match_type == "same_order_exact"


def test_near_and_permuted_rules_in_order(spark):
    v = [1001.4, 1000.2, 1000.9, 1000.1, 1000.6, 1000.3, 1000.8, 1000.5]  # near in order whatever the order
    w = [31.2, 5.7, 18.4, 77.1, 60.3, 2.9, 44.6]
    found = {(r.ds_a, r.ds_b): (r.match_type, r.severity, r.confidence) for r in detectors.similarity(cells(spark, s1=v, s2=v[::-1], s3=w, s4=[x + 2e-5 for x in w[::-1]], s5=[x + 2e-3 for x in w], s6=w)).collect()}
    assert found == {(1, 2): ("same_order_near", 3, 0.91), (3, 4): ("permutation_near", 3, 0.9), (4, 6): ("permutation_near", 3, 0.9), (3, 6): ("same_order_exact", 4, 0.99)}
    assert {r.match_type for r in detectors.similarity(cells(spark, s1=[-999.9995, *v], s2=[-1000.0, *(x - 0.9 for x in v)])).collect()} == {"same_order_near"}


def test_metamorphic_linear_and_subset(spark):
    v = [3.17, 9.31, 1.73, 6.41, 8.83, 2.29, 7.57, 4.91, 5.05, 0.77]
    got = {(r.ds_a, r.ds_b): r.match_type for r in detectors.similarity(cells(spark, s1=v, s2=[-2.5 * x + 7 for x in v], s3=v[2:8])).collect()}
    assert got[1, 2] == "linear_transform_near" and got[1, 3] == "permutation_subset_exact"


def test_near_duplicate(spark):
    v = [1.11, 2.22, 3.33, 4.44, 5.55, 6.66, 7.77, 8.88]
    r = detectors.near_duplicates(cells(spark, s1=v, s2=v[:-1] + [8.89])).first()
    assert (r.equal_position_count, r.n, r.match_type) == (7, 8, "positionwise_near_duplicate")
    r = detectors.near_duplicates(cells(spark, s1=[10 + k / 100 for k in range(11, 90, 10)], s2=[90 + k / 100 for k in range(11, 90, 10)])).first()
    assert r.match_type == "positionwise_decimal_suffix2_reuse" and r.severity < 4
    r = detectors.near_duplicates(cells(spark, s1=v[:4], s2=v[:3] + [9.0])).collect()
    assert all(x.severity < 3 for x in r)


def test_fragments(spark):
    r = detectors.fragments_within(cells(spark, s1=[1.1, 2.2, 3.3, 9.9, 1.1, 2.2, 3.3])).first()
    assert (r.fragment_length, r.occurrence_count) == (3, 2)
    r = detectors.fragments_across(cells(spark, s1=[1.0, 2.0, 3.0, 4.0, 10.0, 11.0, 12.0, 13.0], s2=[8.0, 9.0, 1.0, 2.0, 3.0, 4.0, 14.0, 15.0])).first()
    assert r.fragment_length == 4


def test_constant_designed_and_precheck(spark):
    c = cells(spark, s1=[1.23] * 8)
    found = detectors.constant_series(c)
    assert found.first().severity == 3
    low = evidence.designed_downgrade(found.withColumn("ds_b", F.lit(None).cast("long")), spark.createDataFrame([(1,)], "ds long")).first()
    assert low.severity == 2 and low.confidence < found.first().confidence
    done = precheck(c).collect()
    assert done[0].evidence_id == "E-0001"
    assert evidence.summary(precheck(cells(spark, s1=[0.31, 0.5]))).first().overall == "none_detected"


def test_tails():
    assert stats.chi2_sf([21.665994], 9)[0] == pytest.approx(0.01, rel=1e-5) and stats.chi2_sf([15.507313], 8)[0] == pytest.approx(0.05, rel=1e-5)
    assert stats.beta_inc(5, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, rel=1e-5)
    assert stats.gamma_q(0.5, 3.841459 / 2) == pytest.approx(0.05, rel=1e-5)


def test_tools(spark):
    pairs = spark.createDataFrame([("g", 0, 3.45, 20), ("g", 1, 2.5, 10), ("g", 2, 1.333, 3), ("g", 3, 3.47, 20), ("g", 4, 2.53, 10), ("g", 5, 1.0, 0), ("g", 6, None, 4)], "group_id string, pair_index int, mean double, n int")
    got = {r.pair_index: (r.consistent, r.error) for r in statistics.grim(pairs).collect()}
    assert [got[k][0] for k in range(5)] == [True, True, True, False, False] and got[5] == got[6] == (None, "invalid")
    p = spark.createDataFrame([("g", 0.0451 + 0.0001 * (k % 40)) for k in range(50)], "group_id string, value double")
    r = statistics.p_value_distribution(p).first()
    assert r.caliper_ratio == 999.0 and r.flagged
    t = spark.createDataFrame([("g", 0, "t", 2.228, 10.0, None, None, 0.05, 11), ("g", 1, "t", 2.228, 10.0, None, None, 0.001, 30), ("g", 2, "r", 1.2, None, None, None, None, None)], "group_id string, idx int, test_type string, value double, df double, df1 double, df2 double, reported_p double, reported_n int")
    got = {r.idx: (r.p_mismatch, r.impossible, r.df_mismatch) for r in statistics.test_consistency(t).collect()}
    assert got == {0: (False, False, False), 1: (True, False, True), 2: (False, True, False)}
    f = spark.createDataFrame([(l, i, None, v) for l, vs in {"a": [1.0, 2.5, 4.1], "b": [1.0, 2.5, 4.1], "c": [2.0, 5.0, 8.2], "d": [9.0, 1.0, 2.5, 4.1]}.items() for i, v in enumerate(vs)], "label string, pos int, group_label string, value double")
    got = {(r.la, r.lb, r.match_type) for r in statistics.cross_figure(f).collect()}
    assert {("a", "b", "exact_match"), ("a", "c", "ratio_match"), ("a", "d", "subset_match")} <= got
    spread = {"p": [0.0, 12.0, 340.0, 5.5], "q": [0.0, 1.0, 28.1, 0.46], "r": [12.006, 340.2, 5.503], "s": [0.0, 12.0001, 340.001, 5.50001]}  # a zero first; ratios of 12 that vary by 1 %; rounded copies
    f = spark.createDataFrame([(l, i, None, v) for l, vs in spread.items() for i, v in enumerate(vs)], "label string, pos int, group_label string, value double")
    got = {(r.la, r.lb, r.match_type) for r in statistics.cross_figure(f).collect()}
    assert {("p", "q", "ratio_match"), ("p", "r", "subset_match"), ("p", "s", "near_match"), ("p", "s", "subset_match")} <= got


def test_claims(spark):
    text = "[Page 1]\nMethods\nmice n = 6\n[Page 2]\nResults\nsize 12.3 ± 1.1 and p=0.031, p = 2, p < .05\nMean age was 23.5 (SD = 2.1)."
    found = claims.claims(spark.createDataFrame([("x", text), ("y", None), ("z", "")], "doc_id string, text string")).orderBy("claim_id").collect()
    assert [(r.claim_type, r.page, r.section) for r in found][:3] == [("reported_n", 1, "Methods"), ("reported_mean_sd", 2, "Results"), ("reported_p_value", 2, "Results")]
    assert found[1].char_start == text.index("12.3") and found[-1].mean == 23.5 and len(found) == 5
    first = claims.claims(spark.createDataFrame([("x", "p = .05 " + "1.0 ± 0.1 " * 5)], "doc_id string, text string"), most=3).collect()
    assert len(first) == 3
    c = cells(spark, s1=[10.0, 12.0, 14.0, 16.0])
    rows = spark.createDataFrame([("x", "PCL-0001", "reported_mean_sd", 13.0, 2.581988897), ("x", "PCL-0002", "reported_mean_sd", 99.0, 1.0)], "doc_id string, claim_id string, claim_type string, mean double, sd double")
    assert {r.claim_id: r.verdict for r in claims.align(rows, c).collect()} == {"PCL-0001": "matched", "PCL-0002": "no_candidate"}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (9, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "paper_id long")
    kept = graph.restrict(edges, nodes)
    assert {(r.paper_id, r.ring) for r in graph.rings(kept).collect()} == {(1, 1), (2, 1), (3, 1)}
    more = spark.createDataFrame([(k, k + 1) for k in range(1, 9)] + [(4, 2), (9, 6), (5, 5), (1, 4)], "src long, dst long")
    rows = {(r.paper_id, r.ring, r["size"]) for r in graph.rings(more).collect()}
    assert rows == {(r.paper_id, r.ring, r["size"]) for r in graph.rings(more, one_task=0).collect()} == {(k, 2, 3) for k in (2, 3, 4)} | {(k, 6, 4) for k in (6, 7, 8, 9)}
    assert graph.reciprocal(kept).collect() == [(4, 5)]
    ranks = {r.paper_id: r["rank"] for r in graph.pagerank(kept, nodes).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6) and ranks[4] > ranks[7]
    assert graph.graph_summary(edges.limit(0), nodes.limit(0)).first().density == 0


def test_texts_and_methods(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from here " * 2
    pairs = spark.createDataFrame([("same", long, long.upper()), ("none", "abc def", "xyz uvw"), ("null", None, "a")], "pair_id string, text_a string, text_b string")
    got = {r.pair_id: r for r in texts.lexical_reuse(pairs).collect()}
    assert got["same"].ratio == 1 and got["none"].ratio < 0.3 and not got["null"].flagged
    items = spark.createDataFrame([(1, "Anti-X antibody", "ab12345", "Abcam plc"), (2, "Anti-X antibody", "", "Abcam"), (3, "salt", "??", "nobody"), (4, "salt", "??", ""), (5, "anti-X IgG", None, None), (6, "salt", "ZZ", "Biosharp")], "idx int, name string, catalog_number string, vendor string")
    assert [r.issues for r in methodology.reagents(items).orderBy("idx").collect()] == [[], ["missing_catalog"], ["unrecognized_format"], [], [], ["unrecognized_format", "vague_vendor"]]
    rows = spark.createDataFrame([("", "China"), ("12345", "US"), ("IACUC-2020-17", "us"), ("00 000", "Atlantis"), ("00 000", None), ("abc", "uk")], "approval_number string, country string")
    assert [r.findings for r in methodology.ethics(rows).collect()] == [["missing"], ["likely_fabricated", "format_mismatch_country"], [], [], ["format_unknown"], ["likely_fabricated", "too_short", "format_mismatch_country"]]
    both = spark.createDataFrame([("male mice n = 5, sample size of 6, ANOVA", "n=6 t-test female"), ("male and female, 8 mice per group, n = 8, t-test", "t(5) F (2, 3)"), ("ANOVA", None)], "methods_text string, results_text string")
    got = methodology.methods_agreement(both).collect()
    assert [r.findings for r in got] == [["n_value_inconsistency", "stat_method_contradiction", "gender_contradiction"], [], []] and got[1].n_values == [8] and got[1].ttest
    times = spark.createDataFrame([("12 weeks, 3 days, both eyes", "soon", "2020-01-02", "8-week-old", "11 months 4 weeks"), ("5 days", None, None, "40 weeks", "40 weeks"), (None, "2020-02-30", None, None, None)], "claimed_duration string, submission_date string, publication_date string, animal_age_at_start string, treatment_duration string")
    got = methodology.timelines(times).collect()
    assert [r.findings for r in got] == [["date_parse_error", "long_timeline", "both_eyes_concern"], [], ["date_parse_error"]] and [r.estimated_days for r in got] == [12 * 7 + 3 + 330 + 28, 285, None]
    cite = spark.createDataFrame([(["Ann Lee"], 2020), (["Ann Lee", "Bo Ray"], 2021), (["A B", "C D", "E F"], None)], "a array<string>, y int").select(risk.short_citation(F.col("a"), F.col("y")).alias("c")).collect()
    assert [r.c for r in cite] == ["Lee (2020)", "Lee & Ray (2021)", "B et al. (n.d.)"]


def brute_templates(reviews):
    """By difflib over all pairs of sentences and openings."""
    parts = [re.split(r"(?<=[.!?])\s+", r) for r in reviews]
    told = [[x.strip().lower() for x in p if len(x.strip()) > 30] for p in parts]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    pairs = [(i, j) for i in range(len(reviews)) for j in range(i + 1, len(reviews))]
    shared = sum(ratio(x, y) > 0.8 for i, j in pairs for x in told[i] for y in told[j])
    first = [p[0].strip().lower()[:100] for p in parts]
    average = sum(round(ratio(first[i], first[j]), 3) for i, j in pairs) / len(pairs)
    return shared, round(average, 3), shared > 3 or average > 0.7


def test_review_templates_by_brute_force(spark):
    rng = random.Random(4)
    words = "the paper presents a strong analysis of main results and methods are sound but figures need work this study shows clear novelty".split()
    papers = {}
    for k in range(25):
        base = [" ".join(rng.choices(words, k=rng.randint(4, 14))) + "." for _ in range(6)]
        own = []
        for _ in range(rng.randint(2, 4)):
            lines = [s if rng.random() < 0.4 else " ".join(w if rng.random() < 0.8 else w[:-1] + "x" for w in s.split()) for s in rng.sample(base, 4)]
            own.append(" ".join(lines + [" ".join(rng.choices(words, k=8)) + "!"]))
        papers[k] = own
    papers[25] = ["The paper presents a strong analysis of the main results.", "This paper presents the strong analyses of these main result."]
    rows = spark.createDataFrame([(k, i, t) for k, own in papers.items() for i, t in enumerate(own)] + [(99, 0, "alone in the world, this review is.")], "paper_id long, review_index int, text string")
    got = {r.paper_id: (r.shared_sentences, r.opening_similarity, r.flagged) for r in texts.review_templates(rows).collect()}
    assert got == {k: brute_templates(own) for k, own in papers.items()} and got[25][0] == 1 and any(v[0] > 3 for v in got.values())


def test_reuse_candidates_share_fifty_characters(spark):
    rng = random.Random(6)
    left = [(k, "".join(rng.choices("abcd é", k=rng.randint(0, 300)))) for k in range(30)]
    right = []
    for k in range(30):
        base, n = left[k][1], rng.choice((30, 49, 50, 60))
        at = rng.randint(0, max(0, len(base) - n))
        right.append((k, "".join(rng.choices("wxyz", k=20)) + base[at : at + n].upper() + "".join(rng.choices("wxyz", k=20))))
    want = {(i, j) for i, x in left for j, y in right if any(x[p : p + 50] in y.lower() for p in range(len(x) - 49))}
    schema = "id long, text string"
    got = {tuple(r) for r in texts.reuse_candidates(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert want <= got and len(want) >= 8 and len(got - want) < 15


def test_salami_by_brute_force(spark):
    rng = random.Random(3)
    vocab = "effects of dose on growth in young mice rats cells under stress after long treatment trial".split()
    rows = [(f"a{k % 4}", k, " ".join(rng.choices(vocab, k=rng.randint(5, 9))), 2000 + rng.randint(0, 6), rng.choice((10, 20, None)), rng.choice(("randomised design", "randomized designs", "cohort"))) for k in range(60)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {}
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1]:
                wa, wb = set(x[2].split()), set(y[2].split())
                signals = [ratio(x[2], y[2]) > 0.65 and len(wa & wb) >= 5 and len(wa - wb) <= 5 and len(wb - wa) <= 5, x[4] is not None and x[4] == y[4], ratio(x[5], y[5]) > 0.8, abs(x[3] - y[3]) <= 1]
                if sum(signals) >= 2:
                    want[x[1], y[1]] = sum(signals)
    table = spark.createDataFrame(rows, "author string, paper_id long, title string, year int, sample_size int, design string")
    assert {(r.paper_id_a, r.paper_id_b): r.signals for r in texts.salami(table).collect()} == want and want


def test_sequences_in_text():
    text = "Control 1200 800.5 400\nvalues 45.2, 38.1, 31.0 here\npages 4 5 6 7\nfell from 90 to 80 to 70 (5.5 ± 1), (6.5 ± 1), (7 ± 2)\n10, 20, and 40 respectively"
    got = figures.sequences(text)
    assert ("table_row", [1200.0, 800.5, 400.0]) in got and ("table_row", [45.2, 38.1, 31.0]) in got and not any(v == [4.0, 5.0, 6.0, 7.0] for _, v in got)
    assert ("parenthetical_groups", [5.5, 6.5, 7.0]) in got and ("textual_sequence", [90.0, 80.0, 70.0]) in got and ("table_row", [10.0, 20.0, 40.0]) in got  # the first of equal ones
    assert len({tuple(v) for _, v in got}) == len(got) and [len(v) for _, v in got] == sorted((len(v) for _, v in got), reverse=True)


def test_pipeline_checks(spark):
    rng = random.Random(1)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    numbers = [("fives", round(rng.uniform(1, 99)) + 0.5) for _ in range(60)] + [("even", round(10 ** rng.uniform(0, 4), 2)) for _ in range(400)]
    p_values = [("fives", 0.0451 + 0.0001 * k) for k in range(40)] + [("even", (k + 0.5) / 100) for k in range(100)]
    means, sizes = [("fives", 12.0, 0.01), ("even", 12.5, 3.0)], [("fives", 0, 4), ("fives", 1, 4), ("even", 0, 8)]
    series = [("fives", "s", k, 10.0 + 2 * k) for k in range(8)] + [("even", "s", k, rng.random()) for k in range(8)]
    got = {r.doc_id: r for r in figures.pipeline_checks(frame(numbers, "doc_id string, value double"), frame(p_values, "doc_id string, value double"), frame(means, "doc_id string, mean double, sd double"), frame(sizes, "doc_id string, place int, n int"), frame(series, "doc_id string, ds string, pos int, value double")).collect()}
    one, other = got["fives"], got["even"]
    assert (one.p_values, one.grim, one.variation, one.last_digits, one.progressions) == (True, False, True, True, True) and one.checks_run == "benford,p_values,grim,anomalous_precision"
    assert (other.benford, other.p_values, other.grim, other.variation, other.progressions, other.repeats) == (False,) * 6
    assert one.total_flagged_checks == sum((one.benford, one.p_values, one.grim, one.variation, one.last_digits, one.progressions, one.repeats))


def test_citation_existence(spark):
    cites = spark.createDataFrame([(1, "Smith et al. (2019) Deep learning for cells. 10.1234/abc", "deep learning segments cells"), (2, "Lee 2001 On nothing", None)], "ref_id long, citation_text string, claim string")
    queries = {(r.ref_id, r.place): r.query for r in graph.search_queries(cites).collect()}
    assert queries[1, 0] == "10.1234/abc" and queries[1, 1].startswith("Smith et al. 2019 ") and (1, 2) not in queries
    found = spark.createDataFrame([(1, 0, "Smith et al. (2019) Deep learning for cells", ["A B"]), (1, 1, "Other", [])], "ref_id long, place int, title string, authors array<string>")
    got = {r.ref_id: r for r in graph.citation_existence(cites, found).collect()}
    assert got[1].highly_relevant and got[1].assessment == "likely_supported" and got[1].severity == "low" and got[2].severity == "critical" and got[2].flagged


def test_pairs_of_series_by_brute_force(spark):
    """Near duplicates, similarity and suffix reuse over series with many copies, constants and common values."""
    rng = random.Random(8)
    base = [[round(rng.choice((1.25, 2.5, rng.uniform(0, 9))), 2) for _ in range(rng.choice((6, 8, 12)))] for _ in range(25)]
    series = {}
    for k, v in enumerate(base):
        for w in (v, list(v), v[:-1] + [v[-1] + 1], v[::-1], [-2 * x + 3 for x in v], v[1:-1], [1.0] * len(v)):
            series[len(series)] = w
    c = spark.createDataFrame([(k, i, float(x), f"{x:.2f}") for k, v in series.items() for i, x in enumerate(v)], "ds long, pos int, value double, raw string")
    got = {(r.ds_a, r.ds_b): (r.match_type, r.equal_position_count) for r in detectors.near_duplicates(c).collect()}
    want = {}
    for a, x in series.items():
        for b, y in series.items():
            n = len(x)
            if a >= b or n != len(y) or n < 6:
                continue
            eq, suf = sum(abs(p - q) <= 1e-12 for p, q in zip(x, y)), sum(f"{p:.2f}"[-2:] == f"{q:.2f}"[-2:] for p, q in zip(x, y))
            near, diff = sum(abs(p - q) <= max(1e-9, 1e-6 * max(abs(p), abs(q), 1)) for p, q in zip(x, y)), n - eq
            if diff == 0:
                continue
            if n >= 8 and eq >= 0.85 * n and diff <= max(2, int(0.15 * n)):
                want[a, b] = ("positionwise_near_duplicate", eq)
            elif n >= 8 and near >= 0.9 * n and diff <= max(3, int(0.2 * n)):
                want[a, b] = ("positionwise_near_equal", eq)
            elif n >= 8 and suf >= 0.85 * n:
                want[a, b] = ("positionwise_decimal_suffix2_reuse", eq)
            elif eq >= 0.83 * n and diff <= 1:
                want[a, b] = ("small_sample_near_duplicate", eq)
    assert got == want and len(want) > 30
    pairs = {(a, b) for a, x in series.items() for b, y in series.items() if a < b and min(len(x), len(y)) >= 8 and sum((Counter(f"{p:.2f}"[-2:] for p in x) & Counter(f"{q:.2f}"[-2:] for q in y)).values()) >= 0.85 * min(len(x), len(y))}
    assert {(r.ds_a, r.ds_b) for r in detectors.suffix_reuse(c).collect()} == pairs
    inside = {(min(a, b), max(a, b)) for a, x in series.items() for b, y in series.items() if 5 <= len(x) < len(y) and not Counter(round(v, 10) for v in x) - Counter(round(v, 10) for v in y)}
    assert {(r.ds_a, r.ds_b) for r in detectors.similarity(c).where("match_type = 'permutation_subset_exact'").collect()} == inside and inside


def shuffled(spark):
    """The session's shuffle files and their bytes."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


@pytest.mark.parametrize("detect, ends", [(detectors.near_duplicates, 5), (detectors.suffix_reuse, 30)])
def test_candidates_are_not_dealt_out(spark, detect, ends):
    """Series that any two of share many suffixes, but not enough: their pairs never reach the disk; copies of one are all paired."""
    rng = random.Random(3)
    series = [[100 * k + p + rng.randrange(ends) / 100 for p in range(60)] for k in range(400)]
    series += [series[0][:-1] + [0.01 * (k % 2)] for k in range(4)]
    rows = [(k, p, x, f"{x:.2f}") for k, v in enumerate(series) for p, x in enumerate(v)]
    c = spark.createDataFrame(rows, "ds long, pos int, value double, raw string")
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        got = {(r.ds_a, r.ds_b) for r in detect(c).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    same = {(400, 402), (401, 403)} if detect is detectors.near_duplicates else set()  # equal series are no near duplicates
    assert got == {(a, b) for a in (0, 400, 401, 402, 403) for b in (400, 401, 402, 403) if a < b} - same
    assert sum(size for f, size in shuffled(spark).items() if f not in before) < 2 << 20


def suffix_series():
    """Random series of three decimals of many sizes; of some a part, a longer one and one with a few values changed."""
    rng, series = random.Random(8), []
    for n in (8, 9, 12, 20, 33, 60, 86, 86, 100, 140):
        v = [rng.randrange(1000) for _ in range(n)]
        series += [v, [137] * (n // 4) + v[n // 4 :], v[: n - n // 5], v + [rng.randrange(1000) for _ in range(n // 2)]]
        series += [[rng.randrange(1000) for _ in range(k)] + v[k:] for k in (1, int(0.15 * n), int(0.15 * n) + 1)]
    return series + [[rng.randrange(1000) for _ in range(86)] for _ in range(20)]


def shared(x, y):
    return sum((Counter(x) & Counter(y)).values())


@pytest.mark.parametrize("groups", [48, 96])
def test_signatures_rule_pairs_out(groups):
    """No pair shares more than its signatures allow, and nearly all unlike pairs of one size are ruled out by them alone."""
    series = suffix_series()
    row = np.repeat(np.arange(len(series)), [len(x) for x in series])
    signs = detectors._signatures(row, np.concatenate(series), len(series), groups)
    for a, x in enumerate(series):
        for b, y in enumerate(series):
            assert 2 * shared(x, y) <= len(x) + len(y) - (signs[a] != signs[b]).sum()
    unlike = [(a, b) for a in range(len(series) - 20, len(series)) for b in range(a + 1, len(series))]
    assert sum((signs[a] != signs[b]).sum() <= 2 * 86 - 2 * 0.85 * 86 for a, b in unlike) <= 0.02 * len(unlike)


@pytest.mark.parametrize("bit_bytes", [64 << 20, 0])
def test_suffix_overlaps_by_brute_force(spark, monkeypatch, bit_bytes):
    """Pair by pair, and, where rows of bits would be too wide, by products."""
    monkeypatch.setattr(detectors, "BIT_BYTES", bit_bytes)
    series = suffix_series()
    c = spark.createDataFrame([(k, p, x / 1000, f"0.{x:03d}") for k, v in enumerate(series) for p, x in enumerate(v)], "ds long, pos int, value double, raw string")
    want = {}
    for size in (2, 3):
        lists = [[x % 10**size for x in v] for v in series]
        for a, x in enumerate(lists):
            for b in range(a + 1, len(lists)):
                if min(len(x), len(lists[b])) >= 8 and shared(x, lists[b]) >= 0.85 * min(len(x), len(lists[b])):
                    want[a, b, size] = (min(len(x), len(lists[b])), shared(x, lists[b]))
    got = {(r.ds_a, r.ds_b, r.suffix_length): (r.n, r.shared_suffix_count) for r in detectors.suffix_reuse(c).collect()}
    assert got == want and len(want) > 50


def test_classes_larger_than_a_chunk(spark):
    n = detectors.CHUNK + 100
    c = spark.range(n).select(F.col("id").alias("ds"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("pos")).withColumn("value", F.col("pos") * 1.07).withColumn("raw", F.format_string("%.2f", "value"))
    got = detectors.suffix_reuse(c).agg(F.count("*"), F.countDistinct("ds_a", "ds_b"), F.count_if(F.col("ds_a") >= F.col("ds_b"))).first()
    assert tuple(got) == (n * (n - 1) // 2, n * (n - 1) // 2, 0)


def test_precheck_of_classes_stands_for_all_pairs(spark):
    """Spelled out, its rows are those of the precheck; copies add members and no pairs."""
    rng = random.Random(11)
    series = []
    for _ in range(4):
        v = [round(rng.uniform(1, 9), 2) for _ in range(rng.choice((8, 12)))]
        series += [v, v[:-1] + [v[-1] + 1], v[::-1], [2 * x + 3 for x in v], [1.25] * len(v), v[1:], [x / 1e4 for x in v]]
    order = [k for _ in range(3) for k in rng.sample(range(len(series)), len(series))]
    rows = [(d, p, float(x), f"{x:.2f}") for d, k in enumerate(order) for p, x in enumerate(series[k])]
    c = spark.createDataFrame(rows, "ds long, pos int, value double, raw string")
    found = scratch.save(precheck_classes(c)).collect()
    rep = {d: d for d in range(len(order))} | {r.ds_b: r.ds_a for r in found if r.evidence_type == "identical_series"}
    of = {}
    for d, r in rep.items():
        of.setdefault(r, []).append(d)
    key = lambda r, a, b: (r.evidence_type, a, b, r.match_type, r.n, r.p_value, r.q_value, r.severity, r.confidence, r.statistics)
    got = []
    for r in found:
        if r.evidence_type != "identical_series":
            got += [key(r, r.ds_a, None)] if r.ds_b is None else [key(r, a, b) for a in of[rep[r.ds_a]] for b in of[rep[r.ds_b]] if a < b]
    want = [key(r, r.ds_a, r.ds_b) for r in scratch.save(precheck(c)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(found) < len(want) / 2


def test_linear_image_of_a_series_that_begins_at_its_mean(spark):
    rng, rows = random.Random(5), {}
    for k in range(40):
        v = [0.0] + [rng.uniform(-5, 5) for _ in range(11)]
        v[0] = sum(v[1:]) / 11
        rows[2 * k], rows[2 * k + 1] = v, [2 * x + 3 + rng.gauss(0, 0.02) for x in v]
    c = spark.createDataFrame([(k, i, x, "") for k, v in rows.items() for i, x in enumerate(v)], "ds long, pos int, value double, raw string")
    assert {(2 * k, 2 * k + 1) for k in range(40)} <= {(r.ds_a, r.ds_b) for r in detectors.similarity(c).where("match_type = 'linear_transform_near'").collect()}


def test_numbering_in_ranges(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    assert all(r.n == r.k + 1 for r in scratch.numbered(rows, "n", "k").collect())
    p = spark.createDataFrame([(k, float(v), 1) for k, v in enumerate([0.001, 0.2, 0.2, 0.04, 0.9, 0.03])], "id int, p_value double, fdr_hypothesis_count int")
    got = {r.id: r.q_value for r in evidence.fdr(p).collect()}
    assert got == pytest.approx({0: 0.006, 1: 0.24, 2: 0.24, 3: 0.08, 4: 0.9, 5: 0.08})


def test_case(spark, tmp_path):
    folder = tmp_path / "case"
    folder.mkdir()
    values = [1.25, 2.35, 3.45, 4.55, 5.65, 6.75, 7.85, 8.95]
    rows = {("A", 1): "Table 1 weights", ("B", 1): "Weight", ("C", 1): "Dose", ("D", 1): "Mass"} | {("A", r): f"S{r}" for r in range(2, 10)}
    rows |= {(c, r): v for c in "BD" for r, v in enumerate(values, 2)} | {("C", r): 1.5 for r in range(2, 10)}
    (folder / "Raw.XLSX").write_bytes(sheet(rows))
    (folder / "paper.pdf").write_bytes(b"x")
    (folder / "large.pdf").write_bytes(b"x" * 99)
    mean, sd = sum(values) / 8, (sum((v - sum(values) / 8) ** 2 for v in values) / 7) ** 0.5
    papers = spark.createDataFrame([("main", f"[Page 1]\nResults\nWeight was {mean:.3f} ± {sd:.3f}, then 99 ± 1.")], "doc_id string, text string")
    case = precheck_plan.run_case(spark, str(folder), papers)
    assert case.errors.isEmpty() and {(r.name, r.primary) for r in case.files.where("role = 'paper'").collect()} == {("paper.pdf", True), ("large.pdf", False)}
    series = {r.range: r for r in case.series.where("orientation = 'column'").collect()}
    assert set(series) == {"B2:B9", "C2:C9", "D2:D9"} and series["C2:C9"].designed and not series["B2:B9"].designed and series["B2:B9"].table_title == "Table 1 weights"
    found = {(r.evidence_type, r.match_type): r for r in case.evidence.collect()}
    assert ("raw_numeric_similarity", "same_order_exact") in found and found["constant_numeric_series", None].severity == 2  # high, less one for a designed series
    verdicts = {r.claim_id: r for r in case.validations.collect()}
    assert verdicts["PCL-0001"].verdict == "ambiguous" and verdicts["PCL-0001"].linked_evidence_ids and verdicts["PCL-0002"].verdict == "no_candidate"
    precheck_plan.write_report(case, str(tmp_path / "out"))
    text = (tmp_path / "out" / "report.md").read_text()
    assert "#### Main evidence" in text and "ambiguous=1" in text and len(text.splitlines()) < 120 and spark.read.json(str(tmp_path / "out" / "evidence")).count() == case.evidence.count()
    assert workbooks.discover_case(spark, str(tmp_path / "none"))[1].count() == 1
    (tmp_path / "empty").mkdir()
    assert workbooks.discover_case(spark, str(tmp_path / "empty"))[1].count() == 2


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("45%",), ("abc",), (None,), (".5",), ("1e-3",)], "t string").select(numbers.coerce_number(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [1234.5, 0.45, None, None, 0.5, 0.001]
    df = spark.createDataFrame([("0.00",), ("0.0%",), ("General",), (None,), ("#,##0",)], "f string").select(numbers.format_decimals(F.col("f")).alias("d"))
    assert [r.d for r in df.collect()] == [2, 1, None, None, 0]


def sheet(rows):
    """A workbook of inline cells: {(column letter, row): value}; numbers are in format 0.00."""
    def cell(at, v):
        return f'<c r="{at[0]}{at[1]}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at[0]}{at[1]}" s="1"><v>{v}</v></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(f"<row>{cell(k, v)}</row>" for k, v in rows.items())}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    rows = {("A", 1): "Table 1 weights", ("B", 1): "Weight"} | {("B", r): v for r, v in enumerate([1.2, 2.3, 3.4, 4.5], 2)}
    rows |= {("B", 7): "Table 2", **{("B", r): v for r, v in enumerate([5.5, 6.5, 7.5], 8)}}
    (tmp_path / "a.xlsx").write_bytes(sheet(rows))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    got = workbooks.read_workbooks(spark, str(tmp_path))
    assert got.where("row = 0").count() == 1
    parts = workbooks.segments(got)
    assert {(r["first"], r["last"]) for r in parts.collect()} == {(2, 5), (8, 10)}
    assert parts.where("pos = 0 and `first` = 2").first().raw == "1.20"
    heads = {r["first"]: (r.header, r.table_title) for r in workbooks.labels(parts, got).collect()}
    assert heads[2] == ("Weight", "Table 1 weights") and heads[8][1] == "Table 2"


def test_html(spark):
    page = "<html><nav>x</nav><p>Hello</p><table><tr><th>a</th><td>1</td></tr><tr></tr></table><table></table></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert html.page_texts(pages).where("page_id = 1").first().text.startswith("Hello")
    assert [(r.table_number, r.cells) for r in html.page_tables(pages).collect()] == [(1, ["a", "1"])]


def test_streaming(spark, tmp_path):
    from probitas.streaming.digits import each_batch

    c = cells(spark, s1=[1.21, 1.32, 1.41])
    c.write.parquet(str(tmp_path / "in"))
    seen = []
    q = each_batch(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in")), lambda df, k: seen.extend(df.collect()), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert {(r.digit, r.c) for r in seen} == {(1, 2), (2, 1)}
    assert not math.isnan(sum(r.c for r in seen))
