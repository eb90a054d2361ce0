"""Registered queries over the driver's tables, and the DuckDB SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, detectors, evidence, graph, risk, statistics, texts
from ..sources import workbooks
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def on(binding: str, run: Callable[[DataFrame], DataFrame], **names: str) -> Query:
    return lambda spark, sf_dir: run(b.frame(spark, sf_dir, binding, **names))


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def cells_sql(rest: str) -> str:
    """DuckDB SQL over the planted cells."""
    return f"with cells as ({b.duck(b.CELLS)}) {rest}"


def with_cells(ctes: str, rest: str) -> str:
    return f"with cells as ({b.duck(b.CELLS)}), {ctes} {rest}"


def graded(cases: list[tuple[str, int, float]]) -> str:
    level = " ".join(f"when {c} then {s}" for c, s, _ in cases)
    trust = " ".join(f"when {c} then {t}::double" for c, _, t in cases)
    return f"case {level} end as severity, case {trust} end as confidence"


add("d1_constant_series", on(b.CELLS, detectors.constant_series), cells_sql(f"""
select 'constant_numeric_series' as evidence_type, ds as ds_a, n, nc as numeric_constant, rc as raw_text_constant, lo as constant_value, {graded([("n >= 8 and nc and rc", 3, 0.88), ("true", 2, 0.72)])}
from (select ds, count(*)::int as n, min(round(value, 10)) = max(round(value, 10)) as nc, min(raw) = max(raw) as rc, min(round(value, 10)) as lo from cells group by ds) where n >= 5 and (nc or rc)"""))

_MODES = []
for _mode, _order, _cases in (("original_order", "pos", detectors.ARITHMETIC["original_order"]), ("sorted_values", "value, pos", detectors.ARITHMETIC["sorted_values"])):
    _rules = [(f"n >= {n} and cv <= {cv} and r2 >= {r2}", level, trust) for n, cv, r2, level, trust in _cases]
    _MODES.append(f"""select 'approximate_arithmetic_sequence' as evidence_type, ds as ds_a, '{_mode}' as order_mode, n, round(cv, 8) as cv_of_diffs, round(r2, 8) as r_squared, round(slope, 8) as slope, round((select max(abs(c.value - f.intercept - f.slope * c.place)) from (select *, row_number() over (partition by ds order by {_order}) as place from cells) c where c.ds = f.ds), 8) as max_residual, {graded(_rules)}
from (select ds, n, sd / size as cv, r2, slope, intercept from (select ds, count(*)::int as n, stddev_pop(step) as sd, avg(abs(step)) as size, regr_r2(value, place) as r2, regr_slope(value, place) as slope, regr_intercept(value, place) as intercept
from (select *, row_number() over (partition by ds order by {_order}) as place, value - lag(value) over (partition by ds order by {_order}) as step from cells) group by ds) where n >= 6 and size > 1e-12) f where {" or ".join(f"({r[0]})" for r in _rules)}""")
add("d2_arithmetic_sequences", on(b.CELLS, detectors.arithmetic_sequences), cells_sql(" union all ".join(_MODES)))

add("d3_near_duplicates", on(b.CELLS, detectors.near_duplicates), with_cells("""
s as (select *, count(*) over (partition by ds)::int as n, regexp_extract(raw, '\\.\\d*(\\d\\d)$', 1) as s2 from cells),
p as (select x.ds as ds_a, y.ds as ds_b, count(*)::int as n, count(*) filter (abs(x.value - y.value) <= 1e-12)::int as eq,
  count(*) filter (abs(x.value - y.value) <= greatest(1e-9, 1e-6 * greatest(abs(x.value), abs(y.value), 1)))::int as near, count(*) filter (x.s2 <> '' and y.s2 <> '')::int as valid, count(*) filter (x.s2 = y.s2 and x.s2 <> '')::int as suf
  from s x join s y on x.n = y.n and x.pos = y.pos and x.ds < y.ds where x.n >= 6 group by x.ds, y.ds),
q as (select *, case when n >= 8 and eq >= 0.85 * n and n - eq <= greatest(2, floor(0.15 * n)) then 1 when n >= 8 and near >= 0.9 * n and n - eq <= greatest(3, floor(0.2 * n)) then 2
  when n >= 8 and valid >= greatest(8, ceil(0.8 * n)) and suf >= 0.85 * valid then 3 when eq >= 0.83 * n and n - eq <= 1 then 4 end as k from p where eq < n)""", """
select 'near_duplicate_numeric_series' as evidence_type, ds_a, ds_b, ['positionwise_near_duplicate', 'positionwise_near_equal', 'positionwise_decimal_suffix2_reuse', 'small_sample_near_duplicate'][k] as match_type, n,
eq as equal_position_count, near as near_equal_count, valid as suffix2_valid_count, suf as suffix2_equal_count, [3, 2, 2, 2][k] as severity, [0.89::double, 0.78::double, 0.74::double, 0.7::double][k] as confidence from q where k is not null"""))

_GRAMS = """
s as (select ds, pos, round(value, 8) as v, count(*) over (partition by ds)::int as n from cells),
l as (select *, lead(v, 1) over w as v1, lead(v, 2) over w as v2, lead(v, 3) over w as v3, lead(v, 4) over w as v4 from s window w as (partition by ds order by pos)),
g as (select ds, n, pos, 3 as w, [v, v1, v2] as gram from l where v2 is not null and n >= 6 union all select ds, n, pos, 4, [v, v1, v2, v3] from l where v3 is not null and n >= 6
  union all select ds, n, pos, 5, [v, v1, v2, v3, v4] from l where v4 is not null and n >= 6),
grams as (select * from g where list_min(gram) < list_max(gram))"""
add("d4a_fragments_within", on(b.LINES, detectors.fragments_within), f"""with cells as ({b.duck(b.LINES)}), {_GRAMS},
r as (select ds, n, w, gram, count(*)::int as times, min(pos)::int as first from grams where n >= 2 * w group by all having count(*) >= 2),
k as (select *, row_number() over (partition by ds order by w desc, times desc, first) as k from r)
select 'repeated_numeric_fragment' as evidence_type, ds as ds_a, n, w as fragment_length, times as occurrence_count, first as first_start, round(least(1.0::double, times * w / n::double), 6) as coverage_ratio,
{graded([("w >= 4 and n >= 8", 3, 0.84), ("true", 2, 0.72)])} from k where k = 1""")
add("d4b_fragments_across", on(b.CELLS, detectors.fragments_across), with_cells(f"""{_GRAMS},
d as (select distinct ds, n, w, gram from grams), p as (select x.ds as ds_a, y.ds as ds_b, least(x.n, y.n) as n, x.w, x.gram from d x join d y on x.w = y.w and x.gram = y.gram and x.ds < y.ds),
k as (select *, row_number() over (partition by ds_a, ds_b order by w desc, gram) as k from p)""", f"""
select 'repeated_numeric_fragment' as evidence_type, ds_a, ds_b, n, w as fragment_length, gram[1] as fragment_first_value, round(w / n::double, 6) as coverage_ratio, {graded([("w >= 4 and n >= 8", 3, 0.86), ("true", 2, 0.74)])} from k where k = 1"""))

add("d5_similarity", on(b.CELLS, detectors.similarity), with_cells("""
z as (select ds, count(*)::int as n, count(*) filter (abs(value) <= 1e-12) as z, stddev_pop(value) as sd from cells group by ds),
s as (select c.*, z.n, z.sd, row_number() over (partition by c.ds order by value, pos) as r from cells c join z on c.ds = z.ds where z.n >= 5 and z.z < z.n and not (z.z >= 0.8 * z.n and z.n - z.z < 5)),
ranks as (select x.ds as ds_a, y.ds as ds_b, max(abs(x.value - y.value)) / greatest(max(abs(x.value)), max(abs(y.value)), 1) as sorted_rel, bool_and(round(x.value, 10) = round(y.value, 10)) as same from s x join s y on x.r = y.r and x.n = y.n and x.ds < y.ds group by x.ds, y.ds),
place as (select x.ds as ds_a, y.ds as ds_b, any_value(x.n) as n, max(abs(x.value - y.value)) as gap, max(abs(x.value - y.value)) / greatest(max(abs(x.value)), max(abs(y.value)), 1) as rel, regr_r2(y.value, x.value) as r2, any_value(y.sd) as sb, any_value(x.sd) as sa from s x join s y on x.pos = y.pos and x.n = y.n and x.ds < y.ds group by x.ds, y.ds),
pairs as (select ds_a, ds_b, n, case when gap = 0 then 'same_order_exact' when n >= 8 and rel <= 0.001 then 'same_order_near' when sorted_rel <= 1e-6 and same then 'permutation_exact' when sorted_rel <= 1e-6 then 'permutation_near'
  when n >= 8 and (sb * sb * n <= 1e-12 or (sa > 1e-9 and r2 >= 0.999 and sb * sqrt(greatest(0, 1 - r2)) / greatest(sb, 1) <= 0.01)) then 'linear_transform_near' end as match_type from place join ranks using (ds_a, ds_b)),
c as (select ds, round(value, 10) as v, count(*) as k, any_value(n) as n from s group by ds, round(value, 10)),
sub as (select least(x.ds, y.ds) as ds_a, greatest(x.ds, y.ds) as ds_b, any_value(x.n) as n, 'permutation_subset_exact' as match_type from c x join c y on x.v = y.v and x.n < y.n group by x.ds, y.ds having sum(least(x.k, y.k)) = any_value(x.n)),
u as (from pairs where match_type is not null union all select * from sub)""", f"""
select 'raw_numeric_similarity' as evidence_type, ds_a, ds_b, match_type, n, {graded([("match_type = 'same_order_exact'", 4, 0.99), ("match_type = 'permutation_exact'", 4, 0.98), ("match_type = 'same_order_near'", 3, 0.91), ("match_type = 'permutation_near'", 3, 0.9), ("match_type = 'linear_transform_near'", 3, 0.88), ("n >= 10", 4, 0.96), ("true", 3, 0.87)])} from u"""))

_TAIL = "list_sum(list_transform(range(c, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p}))))"
add("d6b_suffix_reuse", on(b.CELLS, detectors.suffix_reuse), with_cells("""
c as (select ds, regexp_extract(raw, '\\.\\d*(\\d\\d)$', 1) as s, count(*) as k, sum(count(*)) over (partition by ds) as n from cells group by ds, regexp_extract(raw, '\\.\\d*(\\d\\d)$', 1)),
p as (select x.ds as ds_a, y.ds as ds_b, sum(least(x.k, y.k))::int as shared, any_value(least(x.n, y.n))::int as n from c x join c y on x.s = y.s and x.ds < y.ds where x.n >= 8 and y.n >= 8 group by x.ds, y.ds)""", f"""
select 'decimal_suffix_reuse_across_datasets' as evidence_type, ds_a, ds_b, 2 as suffix_length, n, shared as shared_suffix_count, round(shared / n::double, 6) as suffix_multiset_similarity, {graded([("n >= 15", 3, 0.9), ("true", 2, 0.78)])} from p where shared >= 0.85 * n"""))

_DIGITS = f"""
cells as ({b.duck(b.RATES, column="l_tax")}), d as (select ds, count(*)::int as n, list_transform(range(10), lambda k: 0) as z from cells group by ds),
f as (select d.ds, d.n, t.digit::int as digit, (select count(*)::int from cells c where c.ds = d.ds and right(c.raw, 1)::int = t.digit) as c from d, range(10) t(digit) where d.n >= 20),
more as (select 'last_digit_overrepresentation' as evidence_type, ds, n, digit, c, {_TAIL.format(p="0.1::double")} as p from f where c >= greatest(ceil(n / 5), ceil(n / 10 + 5))),
none as (select 'last_digit_absence' as evidence_type, ds, n, digit, c, pow(0.9::double, n) as p from f where c = 0),
u as (select *, {graded([("p <= 1e-6", 4, 0.97), ("true", 3, 0.88)])} from more where p <= 0.01 union all select *, {graded([("p <= 1e-4", 3, 0.86), ("true", 2, 0.72)])} from none where p <= 0.01)"""
add("d7_last_digits", on(b.RATES, lambda c: detectors.last_digits(c, uniformity=False).withColumn("p_value", F.round("p_value", 9)), column="l_tax"), f"""
with {_DIGITS} select evidence_type, ds as ds_a, n, digit, c as observed_count, round(p, 9) as p_value, 21 as fdr_hypothesis_count, severity, confidence from u""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-digit evidence of order-line tax rates by supplier, corrected, calibrated and numbered."""
    rows = detectors.last_digits(b.frame(spark, sf_dir, b.RATES, column="l_tax"), uniformity=False)
    return evidence.number(evidence.calibrate(evidence.fdr(rows)), "ds_a", "digit").select("evidence_id", "evidence_type", "ds_a", "digit", "n", "observed_count", F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"), "severity", "confidence", "confidence_label", "fdr_significant")


_LEVEL = "case " + " ".join(f"when q <= {q} then {s}" for q, s, _ in evidence.CALIBRATION) + " else 0 end"
_TRUST = "case " + " ".join(f"when q <= {q} then {c}::double" for q, _, c in evidence.CALIBRATION) + " else 0 end"
_EVIDENCE = f"""{_DIGITS}, r as (select *, row_number() over (order by p) as k, greatest(count(*) over (), 21 * count(*) over ()) as m from u),
q as (select *, min(least(1, p * m / k)) over (order by k rows between current row and unbounded following) as q0 from r), qq as (select *, min(q0) over (partition by p) as q from q),
e as (select *, case when q > 0.05 then 1 else greatest(severity, {_LEVEL}) end as sev, case when q > 0.05 then least(confidence, 0.55::double) else greatest(confidence, {_TRUST}) end as conf from qq)"""
add("evidence_last_digits", flagship, f"""with {_EVIDENCE}
select printf('E-%04d', row_number() over (order by sev desc, conf desc, evidence_type, ds, digit)) as evidence_id, evidence_type, ds as ds_a, digit, n, c as observed_count, round(p, 9) as p_value, round(q, 9) as q_value,
sev as severity, conf as confidence, case when conf >= 0.95 then 'very_high' when conf >= 0.8 then 'high' when conf >= 0.6 then 'medium' else 'low' end as confidence_label, q <= 0.05 as fdr_significant from e""")
add("d11_confidence_summary", lambda s, d: evidence.summary(flagship(s, d)), f"""with {_EVIDENCE} select count(*) as total, count(*) filter (sev = 4) as critical, count(*) filter (sev = 3) as high, count(*) filter (sev = 2) as medium, count(*) filter (sev <= 1) as low, max(conf) as max_confidence,
case when count(*) filter (sev = 4) > 0 then 'serious' when count(*) filter (sev = 3) > 0 then 'high' when count(*) filter (sev = 2) > 0 then 'medium' when count(*) > 0 then 'low' else 'none_detected' end as overall from e""")

_FIRST = ", ".join(f"count(*) filter (d = {k}) as d{k}" for k in range(1, 10))
_BENFORD_X = " + ".join(f"pow(d{k} - n * log10(1 + 1 / {k}::double), 2) / (n * log10(1 + 1 / {k}::double))" for k in range(1, 10))
_BENFORD_M = "(" + " + ".join(f"abs(d{k} / n - log10(1 + 1 / {k}::double))" for k in range(1, 10)) + ") / 9"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


add("t1_benford", on(b.PRICES, lambda df: _rounded(statistics.benford(df), "chi_square", "mad", "p_value")), f"""
with c as (select group_id, count(*) as n, {_FIRST} from (select group_id, substr(floor(abs(value))::bigint::varchar, 1, 1)::int as d from ({b.duck(b.PRICES)}) where value <> 0) group by group_id having count(*) >= 30),
x as (select group_id, n, {_BENFORD_X} as x, {_BENFORD_M} as mad from c), p as (select *, exp(-x / 2) * (1 + x / 2 + x * x / 8 + x * x * x / 48) as p from x)
select group_id, n, round(x, 6) as chi_square, round(mad, 6) as mad, round(p, 6) as p_value, case when mad < 0.006 then 'close' when mad < 0.012 then 'acceptable' when mad < 0.015 then 'marginal' else 'nonconforming' end as conformity, p < 0.05 or mad > 0.015 as flagged from p""")
_BINS = ", ".join(f"count(*) filter (least(9, floor(value * 10)) = {k}) as b{k}" for k in range(10))
_UNIFORM = " + ".join(f"pow(b{k} - n / 10, 2) / (n / 10)" for k in range(10))
add("t2_p_values", on(b.P_VALUES, lambda df: _rounded(statistics.p_value_distribution(df), "chi_square", "share_significant").drop("uniformity_p", "median_p")), f"""
with c as (select group_id, count(*) as n, count(*) filter (value > 0.045 and value <= 0.05) as below_05, count(*) filter (value > 0.05 and value <= 0.055) as above_05, count(*) filter (value > 0.009 and value <= 0.01) as below_01,
count(*) filter (value > 0.01 and value <= 0.011) as above_01, avg((value <= 0.05)::int) as s, {_BINS} from ({b.duck(b.P_VALUES)}) where value > 0 and value <= 1 group by group_id having count(*) >= 10),
x as (select *, {_UNIFORM} as x, case when above_05 = 0 then 999::double else below_05 / above_05 end as ratio from c)
select group_id, n, below_05, above_05, ratio as caliper_ratio, ratio > 2 as caliper_flag, below_01 > 2 * greatest(above_01, 1) as caliper_01_flag, round(s, 6) as share_significant, round(x, 6) as chi_square, ratio > 2 or below_01 > 2 * greatest(above_01, 1) or x > 16.918978 as flagged from x""")
add("t3_grim", on(b.MEANS, statistics.grim), f"""
select group_id, pair_index, mean, n, round(abs(mean * n - round_even(mean * n, 0)), 6) as gap, abs(mean * n - round_even(mean * n, 0)) < 0.01 as consistent, null::varchar as error from ({b.duck(b.MEANS)})""")
add("t4a_variation", on(b.SPREADS, lambda df: _rounded(statistics.variation(df), "mean", "sd", "cv")), f"""
select group_id, idx, round(mean, 6) as mean, round(sd, 6) as sd, round(abs(sd / mean), 6) as cv, case when abs(sd / mean) < 0.01 then 'critical' else 'warning' end as level from ({b.duck(b.SPREADS)}) where mean <> 0 and abs(sd / mean) < 0.03""")
for _variant, (_c, _h, _m) in statistics.STEP_LIMITS.items():
    add("t4c_near_arithmetic" + "_strict" * (_variant == "strict"), on(b.CELLS, lambda df, v=_variant: statistics.near_arithmetic(df, v)), with_cells(f"""
s as (select ds, pos, value, row_number() over w - 1 as i, value - lag(value) over w as step from cells window w as (partition by ds order by pos)),
a as (select ds, count(*) as n, stddev_pop(step) as sd, avg(abs(step)) as size, arg_min(value, i) as first, arg_max(value, i) as last, avg(value) as mean from s group by ds),
f as (select ds, n, sd / size as cv, first, last, mean from a where n >= 3 and size > 1e-12 and sd / size < {_m}),
r as (select f.ds, any_value(n) as n, any_value(cv) as cv, sum(pow(value - (first + (last - first) * i / (n - 1)), 2)) as ss, sum(pow(value - mean, 2)) as st, max(abs(value - (first + (last - first) * i / (n - 1)))) as worst from f join s on f.ds = s.ds group by f.ds)""", f"""
select ds, n, round(cv, 6) as cv, round(case when st > 1e-12 then 1 - ss / st else 1 end, 6) as r_squared, round(worst, 6) as max_residual, case when cv < {_c} then 'critical' when cv < {_h} then 'high' else 'medium' end as level from r"""))
add("t4d_frequent_repeats", on("select l_suppkey as group_id, l_linenumber + 0e0 as value from {lineitem}", lambda df: _rounded(statistics.frequent_repeats(df), "share")), """
with c as (select l_suppkey as group_id, l_linenumber::double as value, count(*) as times, sum(count(*)) over (partition by l_suppkey)::bigint as n from lineitem group by l_suppkey, l_linenumber)
select group_id, value, times, n, round(times / n, 6) as share, case when times >= 4 and times / n > 0.25 then 'critical' else 'high' end as level from c where n >= 6 and times >= 3 and times / n > 0.15""")
add("t4e_significance", on(b.P_VALUES, statistics.significance_concentration), f"""
select group_id, count(*) as n, count(*) filter (value < 0.05) as significant, count(*) filter (value >= 0.01 and value < 0.05) as clustered, count(*) filter (value < 0.05) / count(*) > 0.8 as concentrated,
count(*) filter (value >= 0.01 and value < 0.05) >= 3 and count(*) filter (value >= 0.01 and value < 0.05) / count(*) > 0.4 as p_hacking_cluster from ({b.duck(b.P_VALUES)}) group by group_id having count(*) >= 5""")
_TESTS = """select l_orderkey as group_id, l_linenumber as idx, case l_linenumber % 3 when 0 then 't' when 1 then 'F' else 'chi2' end as test_type, l_quantity / 10 as value, cast(l_suppkey % 30 + 2 as int) as df, 2 as df1, cast(l_suppkey % 30 + 5 as int) as df2, l_tax + 0.001e0 as reported_p, cast(l_suppkey % 30 + 3 as int) as reported_n from {lineitem}"""
add("g1_edges", lambda s, d: graph.restrict(b.frame(s, d, b.EDGES), b.frame(s, d, b.PAPERS)), f"with e as ({b.duck(b.EDGES)}), v as ({b.duck(b.PAPERS)}) select src, dst from e where src in (from v) and dst in (from v)")
add("g4_reciprocal", lambda s, d: graph.reciprocal(graph.restrict(b.frame(s, d, b.EDGES), b.frame(s, d, b.PAPERS))), f"with e as ({b.duck(b.EDGES)}), v as ({b.duck(b.PAPERS)}), k as (select * from e where src in (from v) and dst in (from v)) select x.src as u, x.dst as v from k x join k y on x.src = y.dst and x.dst = y.src where x.src < x.dst")
add("g6_in_degrees", lambda s, d: graph.in_degrees(graph.restrict(b.frame(s, d, b.EDGES), b.frame(s, d, b.PAPERS)), b.frame(s, d, b.PAPERS)), f"with e as ({b.duck(b.EDGES)}), v as ({b.duck(b.PAPERS)}) select paper_id, count(src) as in_degree from v left join (select * from e where src in (from v)) e on e.dst = v.paper_id group by paper_id")
_CITED = "select concat('A. ', substr(c_name, 1, 18)) as author, o_orderkey as paper_id, o_orderkey + 1 as citing_id, case when o_orderkey % 4 = 0 then array(c_name, 'B. Other') else array('B. Other') end as citing_authors from {orders} join {customer} on o_custkey = c_custkey"
add("g8_self_citation", on(_CITED, graph.self_citation), """
with r as (select 'A. ' || substr(c_name, 1, 18) as author, count(*) as citations, count(*) filter (o_orderkey % 4 = 0) as self_citations from orders join customer on o_custkey = c_custkey group by 1)
select author, citations, self_citations, round(self_citations / citations, 6) as rate, case when self_citations / citations > 0.4 then 'high' when self_citations / citations > 0.25 then 'elevated' when self_citations / citations > 0.2 then 'borderline' else 'normal' end as band from r""")
add("q6_publication_rates", on(b.WORKS, texts.publication_rates), f"""
with y as (select author, year, count(*) as k from ({b.duck(b.WORKS)}) group by all), w as (select *, row_number() over (partition by author order by year desc) as l, row_number() over (partition by author order by year) as f from y),
a as (select author, sum(k)::bigint as papers, max(year) - min(year) + 1 as span, max(k) as max_in_year, arg_min(year, (-k) * 10000 + year) as busiest_year, sum(k) filter (l <= 3)::bigint as recent, sum(k) filter (f <= 3)::bigint as early, count(*) as active_years from w group by author)
select *, round(papers / span, 6) as per_year, active_years >= 6 and recent / early > 5 as burst, papers / span > 12 or max_in_year > 8 or (active_years >= 6 and recent / early > 5) as flagged from a""")
def _reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against test items, those that share a block of 50 characters; equal texts are matched once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text").withColumn("id", F.sha2(F.coalesce("text", F.lit("")), 256))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("item"), "text").withColumn("id", F.sha2(F.coalesce("text", F.lit("")), 256))
    once = lambda df: df.groupBy("id").agg(F.any_value("text").alias("text"))
    left, right = once(docs), once(items)
    pairs = texts.reuse_candidates(left, right)
    both = pairs.join(left.toDF("a", "text_a"), "a").join(right.toDF("b", "text_b"), "b")
    found = texts.lexical_reuse(both.withColumn("pair_id", F.struct("a", "b"))).select("pair_id.*", "ratio", "block_count", "blocks", "level", "flagged")
    named = found.join(docs.select(F.col("id").alias("a"), "doc"), "a").join(items.select(F.col("id").alias("b"), "item"), "b")
    return named.select(F.concat_ws("-", "doc", "item").alias("pair_id"), "ratio", "block_count", "blocks", "level", "flagged")


add("q2_lexical_reuse", _reuse)
add("q7_salami", on("select o_custkey as author, o_orderkey as paper_id, concat('effects of ', lower(o_orderpriority), ' on order size in trial ', cast(o_orderkey % 10 as string)) as title, cast(year(o_orderdate) as int) as year, cast(o_orderkey % 40 as int) as sample_size, concat('design ', o_orderstatus) as design from {orders}", texts.salami))

_CLAIM_TEXT = "select cast(l_suppkey as string) as doc_id, concat('[Page 1]\nMethods\nWe had n = ', cast(l_suppkey % 9000 + 1 as string), ' animals.\n[Page 2]\nResults\nSize was ', cast(cast(avg(l_quantity) as decimal(12,4)) as string), ' ± ', cast(cast(stddev_samp(l_quantity) as decimal(12,4)) as string), ' (p = 0.0', cast(l_suppkey % 9 + 1 as string), ').') as text from {lineitem} group by l_suppkey"
add("x4_claims", on(_CLAIM_TEXT, lambda df: claims.claims(df).select("doc_id", "claim_id", "claim_type", "p_value", "n", "page", "section")), """
with s as (select distinct l_suppkey as k from lineitem)
select k::varchar as doc_id, 'PCL-0001' as claim_id, 'reported_n' as claim_type, null::double as p_value, (k % 9000 + 1)::int as n, 1 as page, 'Methods' as section from s
union all select k::varchar, 'PCL-0002', 'reported_mean_sd', null, null, 2, 'Results' from s
union all select k::varchar, 'PCL-0003', 'reported_p_value', ('0.0' || (k % 9 + 1))::double, null, 2, 'Results' from s""")
_QUANTITIES = "select l_suppkey as ds, cast(l_linenumber as int) as pos, l_quantity as value, cast(l_quantity as string) as raw from {lineitem}"
add("d13_alignment", lambda s, d: claims.align(claims.claims(b.frame(s, d, _CLAIM_TEXT)), b.frame(s, d, _QUANTITIES)).select("doc_id", "claim_id", "candidate_match_count", "verdict"), """
with t as (select l_suppkey as ds, avg(l_quantity) as m, stddev_samp(l_quantity) as s, round(avg(l_quantity), 4) as cm, round(stddev_samp(l_quantity), 4) as cs, count(*) as n from lineitem group by 1),
p as (select x.ds as doc, count(y.ds) as k from t x left join t y on y.n >= 3 and abs(x.cm - y.m) / greatest(x.cm, y.m, 1) <= 0.02 and abs(x.cs - y.s) / greatest(x.cs, y.s, 1) <= 0.05 group by x.ds)
select doc::varchar as doc_id, 'PCL-0002' as claim_id, k as candidate_match_count, case when k = 1 then 'matched' when k > 1 then 'ambiguous' else 'no_candidate' end as verdict from p""")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = claims.align(claims.claims(b.frame(spark, sf_dir, _CLAIM_TEXT)), b.frame(spark, sf_dir, _QUANTITIES))
    found = flagship(spark, sf_dir).withColumn("ds_b", F.lit(None).cast("long"))
    return claims.cross_validation(aligned, found).select("validation_id", "doc_id", "claim_id", "verdict", "linked_evidence_ids")


_SCORES = "select c_nationkey as case_id, c_mktsegment as category, avg(c_acctbal) / 100 + 10 as score from {customer} group by c_nationkey, c_mktsegment"
_WEIGHTS = "select c_mktsegment as category, cast(length(c_mktsegment) as double) as weight from {customer} group by c_mktsegment"
add("r3_risk", lambda s, d: risk.risk(b.frame(s, d, _SCORES), b.frame(s, d, _WEIGHTS)), f"""
with r as (select case_id, round(sum(score * weight) / sum(weight), 6) as risk_score from ({b.duck(_SCORES)}) join ({b.duck(_WEIGHTS)}) using (category) group by case_id)
select *, case when risk_score <= 15 then 'none' when risk_score <= 35 then 'low' when risk_score <= 55 then 'medium' when risk_score <= 75 then 'high' else 'critical' end as risk_level from r""")
add("r2_chain_stats", on("select o_orderstatus as status, o_orderpriority as category, o_totalprice > 100000 as escalated from {orders}", risk.chain_stats), """
select status, category, count(*) as nodes, count(*) filter (escalated) as escalated from (select o_orderstatus as status, o_orderpriority as category, o_totalprice > 100000 as escalated from orders) group by grouping sets ((status), (category), ())""")
add("s15_page_texts", lambda s, d: html.page_texts(s.read.parquet(f"{d}/pages.parquet")))
add("s30_unpivot", on("select s_name, cast(s_acctbal as string) as balance, cast(s_nationkey as string) as nation from {supplier}", lambda df: workbooks.supplementary_series(df, "s_name").drop("pos")), """
select s_name as group_label, 'balance' as label, s_acctbal as value from supplier union all select s_name, 'nation', s_nationkey::double from supplier""")
