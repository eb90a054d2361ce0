"""Registered queries of workbooks, suffixes, digits, alignment, tests and graphs whose SQL needs more than a line, and that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, detectors, evidence, graph, risk, statistics, texts
from ..sources import html, literature, workbooks
from . import bindings as b
from .papers import quoted
from .precheck import precheck_classes
from .queries import _CLAIM_TEXT, _DIGITS, _EVIDENCE, _QUANTITIES, _TAIL, _TESTS, add, flagship, graded, on

#: Sheets of a user's events: a column with gaps of one and of three or more, titles in some gaps, and a row with gaps.
SHEET = """
with e as (select user_id as u, value, cast(row_number() over (partition by user_id order by event_id) as int) as rn from {events} where value is not null),
c as (select u, 2 + rn + cast(floor(rn / 5e0) as int) + 3 * cast(floor(rn / 11e0) as int) as row, 2 as col, value as num, cast(null as string) as txt from e
  union all select u, 2000, 1 + rn + cast(floor(rn / 4e0) as int), value, cast(null as string) from e where u % 4 = 0 and rn <= 10
  union all select distinct u, 2, 2, cast(null as double), case when u % 5 = 0 then 'Dose group' else 'Weight' end from e
  union all select distinct u, 7, 5, cast(null as double), 'Table 2 more' from e where u % 3 = 0
  union all select distinct u, 1, 1, cast(null as double), 'Table 1 sizes' from e union all select distinct u, 1998, 5, cast(null as double), 'Fig. 3' from e where u % 8 = 0)
select concat('f', cast(u as string), '.xlsx') as file, 'Sheet1' as sheet, row, col, num, txt, '0.00' as number_format from c
"""
_TITLE = "'(?i)\\b(?:fig(?:ure)?|table)\\s*[.\\-]?\\s*\\d*'"
_SEGMENTS = f"""s as ({b.duck(SHEET)}), t as (select file, row, col, txt from s where txt is not null), h as (from t where regexp_matches(txt, {_TITLE})),
a as (select file, 'column' as orientation, col as line, row as place, num, lag(row) over (partition by file, col order by row) as prev, row, col from s where num is not null
  union all select file, 'row', row, col, num, lag(col) over (partition by file, row order by col), row, col from s where num is not null),
g as (select *, prev is null or place - prev > 3 or (place - prev > 1 and exists (select 1 from h where h.file = a.file and case when orientation = 'column' then h.row between prev + 1 and place - 1 and abs(h.col - a.col) <= 6 else h.col between prev + 1 and place - 1 and h.row between a.row - 5 and a.row end)) as new from a),
n as (select *, sum(new::int) over (partition by file, orientation, line order by place) as seg from g),
d as (select file, orientation, line, min(place) as first, max(place) as last, count(*) as n, max(place) - min(place) + 1 - count(*) as missing_count, round(sum(num), 4) as total, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from n group by file, orientation, line, seg having count(*) >= 3)"""
add("s9_segments", on(SHEET, lambda df: workbooks.segments(df).groupBy("file", "orientation", "line", "first", "last").agg(F.count("*").alias("n"), F.first("missing_count").alias("missing_count"), F.round(F.sum("value"), 4).alias("total"))), f"""
with {_SEGMENTS} select file, orientation, line, first, last, n, missing_count, total from d""")


def _letters(c: str) -> str:
    return f"case when {c} > 26 then chr((64 + ({c} - 1) // 26)::int) else '' end || chr((65 + ({c} - 1) % 26)::int)"


_HEADS = f"""{_SEGMENTS}, k as (select d.*, coalesce(case when orientation = 'column' then (select arg_max(txt, t.row) from t where t.file = d.file and t.col = c0 and t.row between r0 - 5 and r0 - 1) else (select arg_max(txt, t.col) from t where t.file = d.file and t.row = r0 and t.col between c0 - 5 and c0 - 1) end,
  case when orientation = 'column' then (select any_value(txt) from t where t.file = d.file and t.row = 1 and t.col = c0) else (select any_value(txt) from t where t.file = d.file and t.row = r0 and t.col = 1) end, case when orientation = 'column' then 'Column ' || {_letters('c0')} else 'Row ' || r0 end) as header,
  (select arg_min(txt, (r0 - h.row) * 100000 + least(abs(h.col - c0), abs(h.col - c1)) * 100 + h.col) from h where h.file = d.file and h.row between r0 - 5 and r0 - 1 and h.col between c0 - 6 and c1 + 6) as table_title from d),
l as (select *, {_letters('c0')} || r0 || ':' || {_letters('c1')} || r1 as range, file || '/Sheet1/' || case when orientation = 'column' then {_letters('c0')} else 'Row ' || r0 end || ' ' || header as label from k),
z as (select *, file || '::Sheet1::' || orientation || '::' || range as dataset_id, regexp_matches(lower(label), {quoted('|'.join(workbooks.DESIGNED))}) as designed from l)"""
add("s10_labels", on(SHEET, lambda df: workbooks.labels(workbooks.segments(df), df).drop("ds", "sheet")), f"""
with {_HEADS} select file, orientation, line, first, last, n, missing_count, header, table_title, range, label, dataset_id, designed from z""")
add("s10_cell_labels", on(SHEET, lambda df: workbooks.cell_labels(workbooks.segments(df), df).select("file", "orientation", "row", "col", "cell_label")), f"""
with {_SEGMENTS} select n.file, n.orientation, n.row, n.col, coalesce(case when n.orientation = 'column' then (select arg_max(txt, t.col) from t where t.file = n.file and t.row = n.row and t.col between n.col - 4 and n.col - 1) else (select arg_max(txt, t.row) from t where t.file = n.file and t.col = n.col and t.row between n.row - 4 and n.row - 1) end,
case when n.orientation = 'column' then 'Row ' || n.row else 'Column ' || {_letters('n.col')} end) as cell_label from n join d on d.file = n.file and d.orientation = n.orientation and d.line = n.line and n.place between d.first and d.last""")
add("s13_loading_order", on(SHEET, lambda df: workbooks.in_loading_order(workbooks.labels(workbooks.segments(df), df), 2, 50).select("dataset_id", "dataset_idx", "skipped")), f"""
with {_HEADS}, o as (select *, row_number() over (partition by file order by orientation, line, first) as own from z), i as (select dataset_id, row_number() over (order by file, orientation, line, first)::int as k from o where own <= 2)
select o.dataset_id, k - 1 as dataset_idx, k is null or k > 50 as skipped from o left join i on o.dataset_id = i.dataset_id""")
_ASKED = "select concat('f', cast(user_id as string), case when user_id % 10 = 9 then '.csv' else '.xlsx' end) as file from {events} union select 'missing.XLSX' as file"
add("s3_file_status", lambda s, d: workbooks.file_status(b.frame(s, d, SHEET), workbooks.in_loading_order(workbooks.labels(workbooks.segments(b.frame(s, d, SHEET)), b.frame(s, d, SHEET)), None, 60), b.frame(s, d, _ASKED)), f"""
with {_HEADS}, o as (select file, n, row_number() over (order by file, orientation, line, first) > 60 as skipped from z), f as (select file, count(*) as dataset_count, sum(n)::bigint as numeric_value_count, bool_and(skipped) as none from o group by file), q as ({b.duck(_ASKED)})
select q.file, (x.file is not null)::int::bigint as sheet_count, case when not regexp_matches(lower(q.file), '\\.(xlsx|xlsm|xltx|xltm)$') then 'error: not a workbook of a known kind' when x.file is null then 'error: there is no such file' end as error,
coalesce(dataset_count, 0) as dataset_count, coalesce(numeric_value_count, 0) as numeric_value_count, case when x.file is null then 'error' when none then 'skipped' else 'success' end as status from q left join (select distinct file from s) x on x.file = q.file left join f on f.file = q.file""")

_SUFFIX = "s{0} as (select ds, {0} as suffix_length, right(raw, {0}) as suffix, count(*)::int as c, min(pos) as first from cells group by all)"
add("d6a_suffix_overrepresentation", on(b.THOUSANDTHS, lambda c: detectors.suffix_overrepresentation(c).withColumn("p_value", F.round("p_value", 9))), f"""
with cells as ({b.duck(b.THOUSANDTHS)}), {_SUFFIX.format(2)}, {_SUFFIX.format(3)}, u as (from s2 union all from s3),
t as (select *, sum(c) over (partition by ds, suffix_length)::int as n, row_number() over (partition by ds, suffix_length order by c desc, first, suffix) as r from u),
p as (select *, least(1.0::double, {_TAIL.format(p="pow(0.1::double, suffix_length)")}) as p from t where r = 1 and n >= 20 and c >= greatest(4, floor(0.18 * n)))
select 'decimal_suffix_overrepresentation' as evidence_type, ds as ds_a, n, suffix_length, suffix, c as observed_count, round(p, 9) as p_value, pow(10, suffix_length)::int as fdr_hypothesis_count, {graded([("p <= 1e-5", 3, 0.9), ("true", 2, 0.76)])} from p where p <= 1e-3""")
add("d6b_suffix_reuse_three", on(b.THOUSANDTHS, detectors.suffix_reuse), f"""
with cells as ({b.duck(b.THOUSANDTHS)}), u as (select ds, 2 as l, right(raw, 2) as s from cells union all select ds, 3, right(raw, 3) from cells), c as (select ds, l, s, count(*) as k, sum(count(*)) over (partition by ds, l) as n from u group by ds, l, s),
p as (select x.ds as ds_a, y.ds as ds_b, x.l, sum(least(x.k, y.k))::int as shared, any_value(least(x.n, y.n))::int as n from c x join c y on x.l = y.l and x.s = y.s and x.ds < y.ds where x.n >= 8 and y.n >= 8 group by x.ds, y.ds, x.l)
select 'decimal_suffix_reuse_across_datasets' as evidence_type, ds_a, ds_b, l as suffix_length, n, shared as shared_suffix_count, round(shared / n::double, 6) as suffix_multiset_similarity, {graded([("n >= 15", 3, 0.9), ("true", 2, 0.78)])} from p where shared >= 0.85 * n""")

#: Upper tail of chi-square with {df} degrees at {x}, by the series of the lower incomplete gamma function.
_CHI = "greatest(0, 1 - list_sum(list_transform(range(0, 300), lambda j: exp(({df} / 2.0 + j) * ln(greatest({x}, 1e-300) / 2) - {x} / 2 - lgamma({df} / 2.0 + j + 1)))))"
add("d7_digit_uniformity", on(b.RATES, lambda c: detectors.last_digits(c).where("evidence_type = 'last_digit_distribution_chisquare'").select("ds_a", "n", F.round("p_value", 9).alias("p_value"), "severity", "confidence"), column="l_tax"), f"""
with {_DIGITS}, x as (select ds, any_value(n) as n, sum(pow(c - n / 10, 2) / (n / 10)) as x from f group by ds), p as (select *, {_CHI.format(df=9, x="x")} as p from x where x >= 21.665994)
select ds as ds_a, n, round(p, 9) as p_value, {graded([("p <= 1e-4", 3, 0.88), ("true", 2, 0.74)])} from p where p <= 0.01""")
_MISSING = " + ".join(f"{w if j % 2 else -w} * pow({(10 - j) / 10}::double, n)" for j, w in {1: 10, 2: 45, 3: 120, 4: 210, 5: 252, 6: 210, 7: 120, 8: 45, 9: 10}.items())
add("d7_any_digit_missing", on(b.RATES, lambda c: detectors.last_digits(c).where("evidence_type = 'last_digit_absence'").select("ds_a", "n", "digit", F.round(detectors.any_digit_missing(), 9).alias("any_digit_missing_probability")), column="l_tax"), f"""
with {_DIGITS} select ds as ds_a, n, digit, round(greatest(0, least(1, {_MISSING})), 9) as any_digit_missing_probability from none where p <= 0.01""")

add("d12_allowed_claims", lambda s, d: evidence.for_context(flagship(s, d).withColumn("match_type", F.lit(None).cast("string")), 100).select("evidence_id", "severity", "confidence"), f"""
with {_EVIDENCE}, i as (select printf('E-%04d', row_number() over (order by sev desc, conf desc, evidence_type, ds, digit)) as evidence_id, sev as severity, conf as confidence from e) select * from i order by length(evidence_id), evidence_id limit 100""")
_PLACES = "select distinct l_suppkey as ds, concat('f', cast(l_suppkey % 7 as string)) as file, concat('s', cast(l_suppkey % 2 as string)) as sheet, concat('B', cast(l_suppkey % 3 as string)) as range, concat(' label ', cast(l_suppkey % 4 as string)) as label from {lineitem}"
_PAIRS = "select distinct l_suppkey as ds_a, l_suppkey + l_linenumber as ds_b from {lineitem}"
add("d16_pair_context", lambda s, d: evidence.pair_context(b.frame(s, d, _PAIRS), b.frame(s, d, _PLACES)), f"""
with p as ({b.duck(_PAIRS)}), q as ({b.duck(_PLACES)}), j as (select ds_a, ds_b, x.file = y.file as same_file, x.sheet = y.sheet as same_sheet, x.range = y.range as same_range, x.label = y.label as same_label from p join q x on x.ds = ds_a join q y on y.ds = ds_b)
select *, not (same_file and same_sheet and same_range) as cross_source_reuse_candidate from j""")
add("d16_scan_stats", on(b.CELLS, lambda c: evidence.scan_stats(c, 6, 5000)), f"""
with n as (select count(*) as k from (select ds from ({b.duck(b.CELLS)}) group by ds having count(*) >= 6)), t as (select k * (k - 1) // 2 as total from n)
select total as pairwise_comparisons_total, least(total, 5000) as pairwise_comparisons_scanned, greatest(total - 5000, 0) as pairwise_comparisons_skipped, total > 5000 as pairwise_comparison_limit_reached from t""")
add("d15_precheck", on(b.CELLS, precheck_classes))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = claims.align(claims.claims(b.frame(spark, sf_dir, _CLAIM_TEXT)), b.frame(spark, sf_dir, _QUANTITIES))
    found = flagship(spark, sf_dir).withColumn("ds_b", F.lit(None).cast("long"))
    done = claims.cross_validation(aligned, found)
    return done.select("validation_id", "doc_id", "claim_id", "verdict", F.array_join("linked_evidence_ids", ",").alias("linked_evidence_ids"), F.round("computed_mean", 6).alias("computed_mean"), F.round("sd_relative_diff", 6).alias("sd_relative_diff"))


_STATS = "st as (select l_suppkey as ds, avg(l_quantity)::double as m, stddev_samp(l_quantity)::double as s, round(avg(l_quantity), 4) as cm, round(stddev_samp(l_quantity), 4) as cs, count(*) as n from lineitem group by 1)"
_CANDIDATES = f"""{_STATS}, ca as (select x.ds as doc, y.ds, y.m, abs(x.cm - y.m) / greatest(x.cm, y.m, 1) as mr, abs(x.cs - y.s) / greatest(x.cs, y.s, 1) as sr from st x join st y on y.n >= 3 and abs(x.cm - y.m) / greatest(x.cm, y.m, 1) <= 0.02 and abs(x.cs - y.s) / greatest(x.cs, y.s, 1) <= 0.05),
cr as (select *, row_number() over (partition by doc order by mr, sr, ds) as place, count(*) over (partition by doc) as k from ca)"""
add("d14_cross_validation", _validated, f"""
with {_EVIDENCE}, ids as (select printf('E-%04d', row_number() over (order by sev desc, conf desc, evidence_type, ds, digit)) as id, ds from e), {_CANDIDATES},
li as (select doc, string_agg(distinct id, ',' order by id) as ids from cr join ids on ids.ds = cr.ds where place <= 5 group by doc), ve as (select st.ds as doc, coalesce(max(k), 0) as k, any_value(cr.m) filter (k = 1) as m, any_value(cr.sr) filter (k = 1) as sr from st left join cr on cr.doc = st.ds group by st.ds)
select printf('XVAL-%04d', row_number() over (order by ve.doc::varchar)) as validation_id, ve.doc::varchar as doc_id, 'PCL-0002' as claim_id, case when k = 1 then 'matched' when k > 1 then 'ambiguous' else 'no_candidate' end as verdict, coalesce(ids, '') as linked_evidence_ids, round(ve.m, 6) as computed_mean, round(sr, 6) as sd_relative_diff from ve left join li on li.doc = ve.doc""")
add("d14_verdict_counts", lambda s, d: claims.verdict_counts(claims.align(claims.claims(b.frame(s, d, _CLAIM_TEXT)), b.frame(s, d, _QUANTITIES))), f"""
with {_CANDIDATES}, ve as (select st.ds, coalesce(max(k), 0) as k from st left join cr on cr.doc = st.ds group by st.ds) select count(*) filter (k = 1) as matched, count(*) filter (k > 1) as ambiguous, count(*) filter (k = 0) as no_candidate, 0::bigint as unverifiable, count(*) as validation_count from ve""")
_DOCUMENTS = "select l_suppkey as doc_id, l_linenumber as document_ord, format_id as claim_id, l_orderkey from (select l_suppkey, l_linenumber, l_orderkey, concat('PCL-', lpad(cast(row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey) as string), 4, '0')) as format_id from {lineitem}) d"
add("s21_merged_claims", on(_DOCUMENTS, lambda df: claims.merged(df)), f"""
select doc_id, document_ord, 'PCL-' || lpad(row_number() over (partition by doc_id order by document_ord, claim_id)::varchar, 4, '0') as claim_id, l_orderkey, claim_id as document_claim_id from ({b.duck(_DOCUMENTS)})""")

#: Regularised incomplete beta function of ({x}; {a}, {b}) by its series, for x no larger than (a + 1) / (a + b + 2).
_SERIES = "exp({a} * ln(greatest({x}, 1e-300)) + {b} * ln(greatest(1 - ({x}), 1e-300)) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) * list_sum(list_transform(range(0, 400), lambda j: exp(lgamma({a} + {b} + j) - lgamma({a} + {b}) - lgamma({a} + 1 + j) + lgamma({a} + 1) + j * ln(greatest({x}, 1e-300)))))"


def _beta(x: str, a: str, c: str) -> str:
    return f"case when {x} <= ({a} + 1) / ({a} + {c} + 2) then {_SERIES.format(x=x, a=a, b=c)} else 1 - {_SERIES.format(x=f'(1 - ({x}))', a=c, b=a)} end"


add("t5_test_consistency", on(_TESTS, lambda df: statistics.test_consistency(df).withColumn("computed_p", F.round("computed_p", 6))), f"""
with r as ({b.duck(_TESTS)}), c as (select *, case test_type when 't' then {_beta('df / (df + value * value)', '(df / 2.0)', '0.5')} when 'F' then {_beta('df2 / (df2 + df1 * value)', '(df2 / 2.0)', '(df1 / 2.0)')} else {_CHI.format(df="df", x="value")} end as p from r)
select * exclude p, round(p, 6) as computed_p, greatest(p, reported_p) / greatest(least(p, reported_p), 1e-300) > 10 as p_mismatch, false as impossible, test_type = 't' and df not in (reported_n - 1, reported_n - 2) as df_mismatch,
greatest(p, reported_p) / greatest(least(p, reported_p), 1e-300) > 10 or (test_type = 't' and df not in (reported_n - 1, reported_n - 2)) as flagged from c""")

_EDGES = lambda s, d: graph.restrict(b.frame(s, d, b.EDGES), b.frame(s, d, b.PAPERS))
_GRAPH = f"v as ({b.duck(b.PAPERS)}), e as (select * from ({b.duck(b.EDGES)}) where src in (from v) and dst in (from v))"
add("g5_pagerank", lambda s, d: graph.pagerank(_EDGES(s, d), b.frame(s, d, b.PAPERS), tolerance=1e-11).withColumn("rank", F.round("rank", 7)), f"""
with recursive {_GRAPH}, o as (select src, count(*) as degree from e group by src), c as (select count(*) as n from v),
r as (select 0 as k, paper_id, 1.0::double / n as rank from v, c union all
  select r.k + 1, r.paper_id, 0.15::double / n + 0.85 * (select coalesce(sum(x.rank), 0) from r x left join o on o.src = x.paper_id where o.src is null) / n + 0.85 * coalesce(f.got, 0) from r, c left join (select e.dst, sum(y.rank / o.degree) as got from r y join o on o.src = y.paper_id join e on e.src = y.paper_id group by e.dst) f on f.dst = r.paper_id where r.k < 100)
select paper_id, round(rank, 7) as rank from r where k = 100""")
#: Fewer edges, so that rings of several sizes are left.
_RINGS = """select distinct src, dst from (select c_custkey as src, case when c_custkey % 6 = 5 then c_custkey - 5 else c_custkey + 1 end as dst from {customer} where c_custkey % 13 <> 0
union all select c_custkey, c_custkey + 7 from {customer} where c_custkey % 4 = 0 union all select c_custkey + 7, c_custkey from {customer} where c_custkey % 36 = 0) e where src <> dst"""
_REACH = f"v as ({b.duck(b.PAPERS)}), e as (select * from ({b.duck(_RINGS)}) where src in (from v) and dst in (from v)), reach as (select src as a, dst as b from e union select reach.a, e.dst from reach join e on e.src = reach.b), both_ways as (select x.a, least(x.a, min(x.b)) as ring from reach x join reach y on x.a = y.b and x.b = y.a group by x.a), sized as (select a as paper_id, ring, count(*) over (partition by ring) as size from both_ways)"
_RING_EDGES = lambda s, d: graph.restrict(b.frame(s, d, _RINGS), b.frame(s, d, b.PAPERS))
add("g3_rings", lambda s, d: graph.rings(_RING_EDGES(s, d)), f"with recursive {_REACH} select paper_id, ring, size from sized where size >= 3")
add("g7_graph_summary", lambda s, d: graph.graph_summary(b.frame(s, d, _RINGS), b.frame(s, d, b.PAPERS)), f"""
with recursive {_REACH}, c as (select (select count(*) from v) as n, (select count(*) from e) as m, (select count(*) from e x join e y on x.src = y.dst and x.dst = y.src where x.src < x.dst) as p, (select count(distinct ring) from sized where size >= 3) as r)
select n, m, p as reciprocal_pairs, r as rings, round(m / (n * (n - 1)), 9) as density, r > 0 or p > greatest(3, 0.1 * n) as flagged from c""")

_SENTENCES = "select cast(floor(vec_id / 20) as string) as pair_id, case when vec_id % 2 = 0 then 'a' else 'b' end as side, vec_id as idx, embedding from {embeddings}"
add("q1_semantic_similarity", on(_SENTENCES, lambda df: texts.semantic_similarity(df, 0.1).drop("top_matches")), """
with s as (select cast(floor(vec_id / 20) as varchar) as pair_id, vec_id, embedding::double[] as e from embeddings), p as (select x.pair_id, list_cosine_similarity(x.e, y.e) as c from s x join s y on x.pair_id = y.pair_id and x.vec_id % 2 = 0 and y.vec_id % 2 = 1)
select replace(pair_id, '.0', '') as pair_id, round(max(c), 6) as max_cosine, round(avg(c), 6) as mean_cosine, count(*) filter (c > 0.1) as matches from p group by pair_id""")
add("r5_report_summary", on("select c_name as title, case c_custkey % 3 when 0 then 'high' when 1 then 'low' end as risk_level, cast(case when c_custkey % 5 = 0 then null else c_custkey % 100 end as int) as risk_score from {customer}", risk.report_summary), """
select c_name as title, case c_custkey % 3 when 0 then 'high' when 1 then 'low' end as risk_level, (case when c_custkey % 5 = 0 then null else c_custkey % 100 end)::int as risk_score,
'[' || case c_custkey % 3 when 0 then 'HIGH' when 1 then 'LOW' else 'UNKNOWN' end || '] score=' || coalesce((case when c_custkey % 5 = 0 then null else c_custkey % 100 end)::varchar, 'N/A') || '/100 — ' || c_name as summary from customer""")
add("r1_chain_filter", on("select o_orderkey as evidence_id, case o_orderstatus when 'O' then 'verified' when 'F' then 'collected' else 'refuted' end as status, o_orderpriority as category, o_totalprice > 100000 as escalated from {orders}", lambda df: risk.chain_filter(df, status="verified", escalated=True)), """
select o_orderkey as evidence_id, 'verified' as status, o_orderpriority as category, true as escalated from orders where o_orderstatus = 'O' and o_totalprice > 100000""")
add("s15_page_texts", lambda s, d: html.page_texts(s.read.parquet(f"{d}/pages.parquet")))
#: Pages made of known parts.
_PAGES = "select page_id, concat('<html><head><script>var x = 1;</script></head><nav>menu</nav><body><p> Page ', cast(page_id as string), ' </p><table></table><div>more<br>text</div><table><tr><th>a</th><td>', cast(page_id % 7 as string), '</td></tr><tr></tr><tr><td> x </td><td></td></tr></table><footer>end</footer></body></html>') as html from {pages}"
add("s15_made_texts", on(_PAGES, html.page_texts), "select page_id, 'Page ' || page_id || chr(10) || 'more' || chr(10) || 'text' || chr(10) || 'a' || chr(10) || page_id % 7 || chr(10) || 'x' as text from pages")
add("s18_page_tables", on(_PAGES, lambda df: html.page_tables(df).withColumn("cells", F.array_join("cells", "|"))), """
select page_id, 2 as table_number, 0 as row, 'a|' || page_id % 7 as cells from pages union all select page_id, 2, 1, 'x|' from pages""")
_COUNTED = "select l_suppkey as doc_id, l_linenumber as table_number, concat(case l_linenumber % 5 when 0 then '(1,234.5)' when 1 then '12%' when 2 then '7.5*' when 3 then 'n/a' else ' 8 ' end) as cell, l_orderkey from {lineitem}"
add("x7_numeric_cells", on(_COUNTED, lambda df: df.withColumn("value", claims.numeric_cells(F.col("cell")))), """
select l_suppkey as doc_id, l_linenumber as table_number, case l_linenumber % 5 when 0 then '(1,234.5)' when 1 then '12%' when 2 then '7.5*' when 3 then 'n/a' else ' 8 ' end as cell, l_orderkey, case l_linenumber % 5 when 0 then -1234.5 when 1 then 0.12 when 2 then 7.5 when 4 then 8 end::double as value from lineitem""")

_WORKS = "select p_partkey as work_id, p_name as title, cast(2000 + p_size as int) as year, p_type as kind, p_brand as field from {part}"
_ASKED_FOR = "select p_partkey as query_id, concat('The ', p_name, ' and ', p_name) as query from {part} where p_partkey % 20 = 1"
_FOUND_SQL = """w as ({works}), k as (from w where year between 2005 and 2040), q as ({asked}), t as (select work_id, title, year, unnest(list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'))) as w from k), u as (select query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'))) as w from q),
h as (select query_id, work_id, any_value(title) as title, any_value(year) as year, count(*) as hits from t join u on t.w = u.w group by query_id, work_id)""".format(works=b.duck(_WORKS), asked=b.duck(_ASKED_FOR))
add("s24_search", lambda s, d: literature.search(b.frame(s, d, _WORKS), b.frame(s, d, _ASKED_FOR), 10, years=(2005, 2040)), f"""
with {_FOUND_SQL}, r as (select *, row_number() over (partition by query_id order by hits desc, year desc, work_id)::int as place from h) select query_id, place, work_id, title, year, hits from r where place <= 10""")
_IDS = "select concat('10.1/C', cast(c_custkey as string)) as doi from {customer}"
_FIRST = "select concat('10.1/c', cast(c_custkey as string)) as doi, c_name as title, c_mktsegment as venue, cast(null as int) as citations from {customer} where c_custkey % 5 <> 0"
_SECOND = "select concat('10.1/c', cast(c_custkey as string)) as doi, case when c_custkey % 3 = 0 then cast(null as string) else upper(c_name) end as title, cast(c_custkey % 50 as int) as citations from {customer} where c_custkey % 4 = 0"
add("s25_lookup", lambda s, d: literature.lookup(b.frame(s, d, _IDS), b.frame(s, d, _FIRST), b.frame(s, d, _SECOND)), f"""
with i as ({b.duck(_IDS)}), x as ({b.duck(_FIRST)}), y as ({b.duck(_SECOND)}) select i.doi, coalesce(y.title, x.title) as title, x.venue, coalesce(y.citations, x.citations) as citations, x.doi is not null or y.doi is not null as found from i left join x on x.doi = lower(i.doi) left join y on y.doi = lower(i.doi)""")
