"""Registered queries of the screens of paper text, reviews, citations and figures, and the DuckDB SQL that each equals.

The SQL states the rules by itself: from the columns that texts were made of, or by the patterns, not by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import figures, graph, methodology, statistics, texts
from ..sources import html
from . import bindings as b
from .queries import add, on


def joined(*columns: str):
    """Arrays of names as one text."""
    return lambda df: df.withColumns({c: F.array_join(c, ",") for c in columns})


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(*cases: tuple[str, str]) -> str:
    """SQL: the names of the conditions that hold, in order, as one text."""
    return "concat_ws(',', " + ", ".join(f"case when {when} then '{name}' end" for name, when in cases) + ")"


_REAGENTS = """select p_partkey as idx, case p_partkey % 3 when 0 then 'Anti-GFP antibody' when 1 then 'IgG' else p_name end as name,
case p_partkey % 5 when 0 then concat('ab', cast(10000 + p_partkey as string)) when 1 then '' when 2 then 'not a number' when 3 then concat('sc-', cast(1000 + p_partkey as string)) else concat(' S', cast(1000 + p_partkey % 9000 as string), ' ') end as catalog_number,
case p_partkey % 8 when 0 then 'Abcam plc' when 1 then 'Santa Cruz Biotechnology' when 2 then 'Sigma-Aldrich' when 3 then 'THERMO FISHER' when 4 then 'Unknown' when 5 then '' when 6 then cast(null as string) else ' Roche ' end as vendor from {part}"""
_VENDORS = "(values " + ", ".join(f"({k}, {quoted(name)}, {quoted('(?i)' + pattern)})" for k, (name, pattern) in enumerate(methodology.VENDORS)) + ") v(ord, key, pattern)"
add("m1_reagents", on(_REAGENTS, lambda df: joined("issues")(methodology.reagents(df))), f"""
with i as ({b.duck(_REAGENTS)}), k as (select idx, arg_min(key, ord) as key, arg_min(pattern, ord) as pattern from i join {_VENDORS} on contains(lower(trim(coalesce(vendor, ''))), key) group by idx),
f as (select i.*, key, pattern, trim(catalog_number) as number, coalesce(vendor, '') as v from i left join k using (idx)),
g as (select *, {names(("format_mismatch", "catalog_number <> '' and key is not null and not regexp_matches(number, pattern)"),
    ("unrecognized_format", f"catalog_number <> '' and key is null and v <> '' and not regexp_matches(number, {quoted(methodology.ANY_CATALOGUE)})"),
    ("vague_vendor", " or ".join(f"contains(lower(v), {quoted(s)})" for s in methodology.SUSPICIOUS_VENDORS)), ("missing_catalog", "catalog_number = '' and contains(lower(name), 'antibod')"))} as issues from f)
select idx, name, catalog_number, vendor, case when catalog_number <> '' then key end as vendor_key, issues, issues <> '' as flagged from g""")

_ETHICS = """select s_suppkey, case s_suppkey % 9 when 0 then '' when 1 then concat('IACUC-2020-', cast(s_suppkey as string)) when 2 then '0000' when 3 then 'A1' when 4 then 'approval granted' when 5 then 'ABC-123' when 6 then 'Approval 77'
when 7 then concat(' PPL 70/', cast(1000 + s_suppkey % 9000 as string)) else cast(null as string) end as approval_number, case s_suppkey % 6 when 0 then 'China' when 1 then 'US ' when 2 then 'Atlantis' when 3 then 'unknown' when 4 then 'uk' else cast(null as string) end as country from {supplier}"""
_COUNTRY = " or ".join(f"country_key = '{c}' and not regexp_matches(number, {quoted('(?i)' + '|'.join(ps))})" for c, ps in methodology.APPROVALS.items())
_ANYWHERE = quoted("(?i)" + "|".join(p for ps in methodology.APPROVALS.values() for p in ps))
_FAKE = " or ".join(f"regexp_matches(number, {quoted(p)})" for p in methodology.FAKE_APPROVALS)
add("m2_ethics", on(_ETHICS, lambda df: joined("findings")(methodology.ethics(df))), f"""
with r as ({b.duck(_ETHICS)}), n as (select *, trim(coalesce(approval_number, '')) as number, lower(trim(coalesce(country, 'unknown'))) as country_key from r),
c as (select *, case when number = '' then 'missing' else {names(("likely_fabricated", _FAKE), ("too_short", "length(number) < 5"), ("format_mismatch_country", _COUNTRY))} end as first from n),
f as (select *, case when first = '' and country_key = 'unknown' and not regexp_matches(number, {_ANYWHERE}) then 'format_unknown' else first end as findings from c)
select s_suppkey, approval_number, country, findings, findings <> '' as flagged from f""")

_TIMES = """select o_orderkey, concat(cast(o_orderkey % 70 as string), ' weeks and ', cast(o_orderkey % 5 as string), ' days', case when o_orderkey % 11 = 0 then ' in Both  eyes' else '' end) as claimed_duration, concat('mice of ', cast(o_orderkey % 30 as string), '-week age') as animal_age_at_start,
case when o_orderkey % 3 = 0 then concat(cast(o_orderkey % 20 as string), ' months') else concat(cast(o_orderkey % 40 as string), ' weeks, 1 month') end as treatment_duration,
case o_orderkey % 7 when 0 then 'soon' when 1 then cast(null as string) when 2 then '2020-02-30' else '2020-01-02T00' end as submission_date, case when o_orderkey % 2 = 0 then '2021-05-06' else '' end as publication_date from {orders}"""
_BEGIN, _LASTS = "(o_orderkey % 30)", "(case when o_orderkey % 3 = 0 then 4 * (o_orderkey % 20) else o_orderkey % 40 + 4 end)"
_DAYS = "(7 * (o_orderkey % 70) + o_orderkey % 5 + case when o_orderkey % 3 = 0 then 30 * (o_orderkey % 20) else 7 * (o_orderkey % 40) + 30 end)"
add("m3_timelines", on(_TIMES, lambda df: joined("findings")(methodology.timelines(df).select("o_orderkey", "estimated_days", "findings", "flagged"))), f"""
with f as (select o_orderkey, {_DAYS} as days, {names(("date_parse_error", "o_orderkey % 7 in (0, 2)"),
    ("long_timeline", f"(o_orderkey % 7 > 2 or o_orderkey % 2 = 0) and {_BEGIN} > 0 and {_LASTS} > 0 and {_BEGIN} + {_LASTS} > 52"), ("both_eyes_concern", "o_orderkey % 11 = 0"))} as findings from orders)
select o_orderkey, nullif(days, 0) as estimated_days, findings, findings <> '' as flagged from f""")

_METHODS = """select l_orderkey, l_linenumber, l_partkey, concat(case when l_linenumber = 1 then 'Female and male' else 'Male' end, ' mice, n = ', cast(l_suppkey % 9 as string), ', ', case l_linenumber % 3 when 0 then 'ANOVA' when 1 then 'analysis of variance' else 'Wilcoxon and t-test' end,
case when l_partkey % 4 = 0 then concat('; ', cast(l_partkey % 6 as string), ' mice per group') else '' end, '.') as methods_text,
case l_partkey % 5 when 0 then concat('Student t, n=', cast(l_partkey % 7 as string), ' in female mice') when 1 then 'F (2, 8) and t = 3' when 2 then 't(7) in female mice' when 3 then 'no test, female' else cast(null as string) end as results_text from {lineitem}"""
_VALUES = "case when l_partkey % 4 = 0 then list_sort(list_distinct([l_suppkey % 9, l_partkey % 6])) else [l_suppkey % 9] end"
add("m4_methods_agreement", on(_METHODS, lambda df: joined("findings", "n_values")(methodology.methods_agreement(df).drop("methods_text", "results_text"))), f"""
with f as (select l_orderkey, l_linenumber, l_partkey, {_VALUES} as n, l_linenumber % 3 <> 2 as anova, l_linenumber % 3 = 2 as tt, {names(("n_value_inconsistency", f"len({_VALUES}) > 1"),
    ("stat_method_contradiction", "l_linenumber % 3 <> 2 and l_partkey % 5 in (0, 2)"), ("gender_contradiction", "l_linenumber <> 1 and l_partkey % 5 in (0, 2, 3)"))} as findings from lineitem)
select l_orderkey, l_linenumber, l_partkey, array_to_string(n, ',') as n_values, 5 as checks_performed, anova, tt as ttest, tt as nonparametric, findings, findings <> '' as flagged from f""")

_REVIEWS = """select conv_id as paper_id, cast(turn as int) as review_index, concat(case when conv_id % 4 = 0 then concat('Dear editor, this paper holds new results of interest. Reviewer ', cast(turn as string), ' thanks you. ') else '' end,
case when conv_id % 3 = 0 then concat('The authors should state more clearly what was done in step ', cast(turn as string), '! ') else '' end, text, case when turn % 2 = 1 then ' See Figure 2, fig. 3 and Table 4 on page 5, line 6 of this novel approach.' else ' A well written, interesting paper of good work.' end,
case when conv_id % 3 = 0 then ' The authors should state more clearly what was done and why it was done that way' else '' end, case when conv_id % 5 = 0 then concat(' ', text, ' ', text, ' ', text, ' ', text) else '' end) as text from {conversations}"""
_KINDS = {k: f"len(regexp_extract_all(text, {quoted(p)}))" for k, p in texts.REFERENCES.items()}
add("q3_review_texts", on(_REVIEWS, texts.review_texts), f"""
with r as ({b.duck(_REVIEWS)}), c as (select *, list_filter(string_split_regex(lower(text), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '') as w, {", ".join(f"{sql} as {k}" for k, sql in _KINDS.items())},
  {" + ".join(f"contains(lower(text), {quoted(p)})::int" for p in texts.GENERIC)} as generic_phrase_count from r),
g as (select distinct paper_id, review_index, array_to_string(w[i : i + 4], ' ') as gram from c, range(1, len(w) - 3) t(i) where len(w) >= 5),
d as (select paper_id, count(*) as k from (select paper_id, gram from g group by all having count(*) >= 2) group by paper_id),
s as (select paper_id, review_index, {", ".join(_KINDS)}, generic_phrase_count, len(w) as word_count, {" + ".join(_KINDS)} as specific_references from c), t as (select *, word_count < 100 or specific_references < 2 or generic_phrase_count >= 3 as suspicious from s)
select t.*, least(coalesce(k, 0), 20)::int as duplicated_phrases, bool_or(suspicious) over (partition by paper_id) or least(coalesce(k, 0), 20) > 5 as flagged from t left join d using (paper_id)""")
add("q5_review_templates", on(_REVIEWS, texts.review_templates))

_MAILS = """select c_name as name, case when c_custkey % 6 = 5 then cast(null as string) when c_custkey % 6 = 4 then 'a@gmail.com.uni.edu' else concat('r', cast(c_custkey as string), '@', case c_custkey % 6 when 0 then 'GMail.com' when 1 then 'cs.example.edu' when 2 then 'example.com' else 'hospital.example.org' end) end as email from {customer}"""
_CLASS = "case c_custkey % 6 when 0 then 'free_email' when 1 then 'institutional' when 2 then 'unknown_domain' when 5 then null else 'institutional' end"
_AUTHORS = "select c_name as name, cast(c_custkey % 4 as int) as paper_count from {customer} where c_custkey % 7 <> 0"
add("q4_reviewer_emails", on(_MAILS, texts.reviewer_emails), f"""
select name, email, email_class, coalesce(email_class in ('free_email', 'unknown_domain'), false) as flagged from (select m.*, {_CLASS} as email_class from ({b.duck(_MAILS)}) m join customer on name = c_name)""")
add("q4_reviewer_records", lambda s, d: texts.reviewer_emails(b.frame(s, d, _MAILS), b.frame(s, d, _AUTHORS)), f"""
select m.name, m.email, {_CLASS} as email_class, a.paper_count, c_custkey % 6 in (0, 2) or coalesce(a.paper_count, 0) = 0 as flagged from ({b.duck(_MAILS)}) m join customer on m.name = c_name left join ({b.duck(_AUTHORS)}) a on a.name = m.name""")

_CLAIMS = """select b.item_id as claim_index, concat(case b.item_id % 4 when 0 then 'It is well known that [3,5-7] ' when 1 then 'Previous studies have shown ' else '' end, b.text) as claim_text, case when b.item_id % 5 = 0 then '' else concat('10.1/', cast(b.item_id % 30 as string)) end as cited_doi,
case when b.item_id % 3 = 0 then cast(null as string) else concat('Title of ', cast(b.item_id as string)) end as cited_title from {benchmark} b"""
_WORKS = "select concat('10.1/', cast(doc_id as string)) as doi, concat('title OF ', cast(doc_id as string)) as title, case when doc_id % 6 = 0 then cast(null as string) else text end as abstract from {documents} where doc_id < 200"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}')))"
_VAGUE = quoted("(?i)" + "|".join(graph.VAGUE))
_OWN, _TITLE, _ABSTRACT = (_WORDS.format(x) for x in ("regexp_replace(claim_text, '\\[\\d+(?:[,–-]\\d+)*\\]', '', 'g')", "fetched_title", "abstract"))
add("g9_claim_support", lambda s, d: joined("issues")(graph.claim_support(graph.cited_works(b.frame(s, d, _CLAIMS), b.frame(s, d, _WORKS))).select("claim_index", "fetched_title", "title_overlap", "abstract_overlap", "issues", "suspicious")), f"""
with c as ({b.duck(_CLAIMS)}), w as ({b.duck(_WORKS)}), f as (select c.*, coalesce(x.title, y.title) as fetched_title, case when x.doi is not null then x.abstract else y.abstract end as abstract from c left join w x on x.doi = cited_doi left join w y on lower(y.title) = lower(cited_title)),
k as (select *, {_OWN} as own, {_TITLE} as tw, {_ABSTRACT} as aw from f),
o as (select *, case when len(own) > 0 and len(tw) > 0 then len(list_intersect(own, tw)) / len(own) end as t, case when len(own) > 0 and len(aw) > 0 then len(list_intersect(own, aw)) / len(own) end as a from k),
i as (select *, {names(("low_title_relevance", "t < 0.1"), ("low_abstract_relevance", "a < 0.15"), ("unverifiable", "coalesce(cited_doi, '') = '' and coalesce(cited_title, '') = ''"), ("vague_citation", f"regexp_matches(claim_text, {_VAGUE})"))} as issues from o)
select claim_index, fetched_title, round(t, 6) as title_overlap, round(a, 6) as abstract_overlap, issues, issues <> '' as suspicious from i""")

_QUERIES = """select cast(item_id as bigint) as ref_id, concat('Smith et al. (20', cast(10 + item_id % 10 as string), ') ', text, case when item_id % 3 = 0 then concat(' doi 10.1234/x', cast(item_id as string)) else '' end) as citation_text, text as claim from {benchmark}"""
_RESULTS = "select cast(i.item_id as bigint) as ref_id, cast(d.doc_id % 3 as int) as place, substr(d.text, 1, 120) as title, array(d.source, d.lang) as authors from {benchmark} i join {documents} d on d.doc_id % 40 = i.item_id % 40 and d.doc_id < 120 and i.item_id % 4 <> 0"
add("g10_search_queries", on(_QUERIES, graph.search_queries))
add("g10_citation_existence", lambda s, d: graph.citation_existence(b.frame(s, d, _QUERIES), b.frame(s, d, _RESULTS)).drop("citation_text", "claim"))

_SI = """select doc_id, concat('S', cast(doc_id % 4 + 1 as string), ' File with data. https://example.org/s', cast(doc_id % 9 as string), '.xlsx, and more. Data Availability at https://www.FigShare.com/d/', cast(doc_id as string), '; https://figshare.com/a/', cast(doc_id % 3 as string), '. DOI: 10.1000/',
cast(doc_id as string), '. See S9 Table (PDF) and s9 table (XLSX). doi.org/10.1000/', cast(doc_id as string), ' Supporting Information here https://dx.doi.org/10.5/z', case when doc_id % 2 = 0 then ' S7 Dataset. end' else '' end) as text from {documents}"""


def _si_sql() -> str:
    host = "case " + " ".join(f"when contains(h, '{known}') then '{known}'" for known in html.HOSTS) + " else h end"
    parts = [f"select doc_id, {k} as ord, unnest(range(1, len(u) + 1)) as i, rtrim(unnest(u), '.,;:') as url, left(trim(unnest(l), chr(10) || ' '), 100) as label, 'labeled_si_pattern' as source from (select doc_id, regexp_extract_all(text, {quoted(p)}, 2) as u, regexp_extract_all(text, {quoted(p)}, 1) as l from r)" for k, p in enumerate(html.LABELLED)]
    parts.append(f"select doc_id, 10, unnest(range(1, len(u) + 1)), rtrim(unnest(u), '.,;:'), 'figshare_link', 'figshare_url_scan' from (select doc_id, regexp_extract_all(text, {quoted(html.FIGSHARE)}) as u from r)")
    parts.append(f"select doc_id, 11, unnest(range(1, len(u) + 1)), 'https://doi.org/' || unnest(u), 'DOI: ' || left(unnest(u), 60), 'doi_pattern' from (select doc_id, regexp_extract_all(text, {quoted(html.DOI)}, 1) as u from r)")
    return f"""r as ({b.duck(_SI)}), a as ({' union all '.join(parts)}), f as (select *, row_number() over (partition by doc_id, url order by ord, i) as k, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) as h from a),
links as (select doc_id, row_number() over (partition by doc_id order by ord, i)::int - 1 as place, url, label, case when source = 'figshare_url_scan' then 'figshare.com' else {host} end as host, source from f where k = 1)"""


add("s28_links", on(_SI, html.supplementary_links), f"with {_si_sql()} select * from links")
add("s28_unresolved_labels", on(_SI, html.unresolved_labels), f"""with {_si_sql()}, u as (select doc_id, unnest(range(1, len(l) + 1)) as i, trim(unnest(l)) as label, coalesce(nullif(trim(unnest(t)), ''), 'unknown') as file_type
from (select doc_id, regexp_extract_all(text, {quoted(html.LABEL)}, 1) as l, regexp_extract_all(text, {quoted(html.LABEL)}, 2) as t from r)),
o as (select * from u where not exists (select 1 from links where links.doc_id = u.doc_id and contains(lower(links.label), lower(u.label)))), once as (select *, row_number() over (partition by doc_id, lower(label) order by i) as k from o)
select doc_id, row_number() over (partition by doc_id order by i)::int - 1 as place, label, file_type from once where k = 1""")

_SHOWN = "select l_suppkey as group_id, l_extendedprice * case l_linenumber % 3 when 0 then 1000 when 1 then 0.37e0 else 1 end + case when l_suppkey % 7 = 0 then 123456.1234567891e0 else 0e0 end as value from {lineitem} where l_suppkey % 5 <> 4 union all select l_suppkey, round(l_quantity / 2, 1) + 0.05e0 from {lineitem} where l_suppkey % 5 = 4"
for _variant, _name in (("default", "t4b_digit_preference"), ("strict", "c4_digit_preference")):
    _limits = statistics.DIGIT_LIMITS[_variant]
    _over = ", ".join(f"case when f{d} > {_limits['other']} then '{d}' end" for d in range(10) if _variant == "default" or d not in (0, 5))
    _levels = ", ".join(f"case when {c} > {_limits[n][0]} then 'strong' when {c} > {_limits[n][1]} then 'slight' end as level{c[5:]}" for n, c in (("5", "share_5"), ("0", "share_0"), ("0+5", "share_0_5")))
    add(_name, on(_SHOWN, lambda df, v=_variant: statistics.digit_preference(df, variant=v)), f"""
with v as ({b.duck(_SHOWN)}), d as (select group_id, right(printf('%.10g', abs(value)), 1) as digit from v), c as (select group_id, count(*) as n, {", ".join(f"round(count(*) filter (digit = '{k}') / count(*), 3) as f{k}" for k in range(10))} from d group by group_id having count(*) >= 10),
s as (select group_id, n, f0 as share_0, f5 as share_5, round(f0 + f5, 3) as share_0_5, concat_ws(',', {_over}) as overrepresented from c), l as (select *, {_levels} from s)
select * from l where level_5 is not null or level_0 is not null or level_0_5 is not null or overrepresented <> ''""")

#: Series of order lines by supplier with copies: rescaled, rounded, shortened, permuted, with a group more; labels order the pairs.
_FIGURES = """
with base as (select l_suppkey as k, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as int) as pos, l_extendedprice as value, concat('g', cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as string)) as group_label from {lineitem}),
s as (select * from base where pos <= 4 + k % 6)
select concat('a', cast(k as string)) as label, pos, group_label, case when k % 10 = 7 and pos = 2 then 0e0 else value end as value from s
union all select concat('b', cast(k as string)), pos, group_label, value from s where k % 4 = 0
union all select concat('c', cast(k as string)), pos, group_label, value * (1 + 0.0004e0 * (pos % 3)) from s where k % 4 = 1
union all select concat('d', cast(k as string)), pos, group_label, value * 2.5e0 * (1 + 0.002e0 * (pos % 2)) from s where k % 4 = 2
union all select concat('e', cast(k as string)), pos, group_label, value * 1.0003e0 from s where pos between 2 and 4 and k % 3 = 0
union all select concat('f', cast(k as string)), 100 - pos, group_label, value from s where k % 4 = 3
union all select concat('h', cast(k as string)), pos, group_label, value * (1 + 0.006e0 * (pos % 2)) from s where k % 5 = 0
union all select concat('i', cast(k as string)), pos, case when pos = 1 then 'other' else group_label end, case when pos = 1 then 5e0 else value end from s where k % 6 = 1
"""
#: Lines can tie in it.
_LINE_ORDER = "order by l_orderkey, l_linenumber"


def _pairs_sql(pipeline: bool) -> str:
    size = "greatest(abs(a.value), abs(b.value))"
    rel = f"case when {size} < {1e-10 if pipeline else 1e-300} then abs(a.value - b.value) else abs(a.value - b.value) / {size} end"
    shared = "n_common >= 2" if pipeline else "n_common >= 2 and n_common = na and n_common = nb"
    subset = "" if pipeline else """union all select la, lb, n, 'subset_match', min(place)::double from (select least(s.label, l.label) as la, greatest(s.label, l.label) as lb, s.n, l.pos - s.pos as place, count(*) as k from v s join v l on s.label <> l.label and (s.n < l.n or (s.n = l.n and l.label < s.label)) and abs(l.value - s.value) <= 0.001 * abs(s.value) where s.n >= 2 group by all) where k = n group by la, lb, n"""
    return f"""with r as ({b.duck(_FIGURES)}), v as (select label, group_label, value, row_number() over (partition by label order by pos) as pos, count(*) over (partition by label) as n from r), z as (from v {'where n >= 2' if pipeline else ''}),
p as (select a.label as la, b.label as lb, any_value(a.n) as n, bool_and(a.value = b.value) as same, max({rel}) as rel,
  count(*) filter (abs(b.value) > 1e-10) as k, avg(a.value / b.value) filter (abs(b.value) > 1e-10) as m, stddev_pop(a.value / b.value) filter (abs(b.value) > 1e-10) as sd from z a join z b on a.n = b.n and a.pos = b.pos and a.label < b.label group by all),
g as (select la, lb, na, nb, count(*) as n_common, bool_and(same) as same from (select a.label as la, b.label as lb, a.n as na, b.n as nb, a.value = b.value as same from z a join z b on a.group_label = b.group_label and a.label < b.label) group by all),
m as (select la, lb, n, 'near_match' as match_type, round(rel, 6) as detail from p where not same and rel <= {0.01 if pipeline else 0.001} union all select la, lb, n, 'ratio_match', round(m, 4) from p where k >= 2 and sd < 0.01 * abs(m) and abs(m - 1) > 0.01
  union all select la, lb, {'n_common' if pipeline else 'na'}, 'shared_group_exact_match', null from g where same and {shared} {subset})
select la, lb, n::int as n, match_type, detail from m anti join (from p where same) e on m.la = e.la and m.lb = e.lb union all select la, lb, n::int, 'exact_match', null from p where same"""


add("t6_cross_figure", on(_FIGURES, statistics.cross_figure, ties=_LINE_ORDER), _pairs_sql(False))
add("c1_cross_figure_pipeline", on(_FIGURES, statistics.cross_figure_pipeline, ties=_LINE_ORDER), _pairs_sql(True))

#: Texts whose numbers are columns; a supplier's lines make a paper.
_PAPERS = """select l_orderkey as doc_id, concat('Group ', cast(l_linenumber as string), ' weighed ', cast(cast(l_quantity as decimal(6,1)) as string), ' ± 2.5 (p < 0.0', cast(l_linenumber as string), ', n = ', cast(cast(l_quantity as int) as string), ') or ', cast(cast(l_quantity as int) as string), '% of ID2020/133x; Fig. ', cast(l_linenumber as string), ' shows it') as text, l_linenumber from {lineitem}"""
add("x8_text_numbers", on(_PAPERS, lambda df: figures.text_numbers(df.withColumn("doc_id", F.struct("doc_id", "l_linenumber"))).select("doc_id.*", *[F.concat_ws(",", F.transform(c, lambda v: F.format_string("%.2f", v))).alias(c) for c in ("all_numbers", "p_values", "percentages")], F.concat_ws(",", F.transform("mean_sd_pairs", lambda x: F.format_string("%.1f±%.1f", x["mean"], x["sd"]))).alias("mean_sd_pairs"), F.concat_ws(",", F.transform("sample_sizes", lambda x: x.cast("string"))).alias("sample_sizes"))), """
select l_orderkey as doc_id, l_linenumber, concat_ws(',', printf('%.2f', l_linenumber::double), printf('%.2f', l_quantity::double), '2.50', '0.0' || l_linenumber, printf('%.2f', l_quantity::double), printf('%.2f', l_quantity::double), '13.00', printf('%.2f', l_linenumber::double)) as all_numbers,
'0.0' || l_linenumber as p_values, printf('%.2f', l_quantity::double) as percentages, case when 2.5 <= 3 * l_quantity then printf('%.1f', l_quantity::double) || '±2.5' else '' end as mean_sd_pairs, case when l_quantity >= 2 then l_quantity::int::varchar else '' end as sample_sizes from lineitem""")
add("x12_page_figures", on("select l_orderkey as doc_id, l_linenumber as page, concat(case when l_linenumber % 3 = 0 then repeat('x ', 2000) else '' end, case when l_linenumber % 2 = 0 then 'as Figure 12 and Fig. 3. show' else concat('see fig ', cast(l_linenumber as string), '.') end) as text from {lineitem}", figures.page_figures), """
select l_orderkey as doc_id, l_linenumber as page, 'Fig ' || case when l_linenumber % 2 = 0 then 12 else l_linenumber end as figure_label from lineitem where l_linenumber % 3 <> 0""")
_CHARTS = "select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as chart_id, concat('Control control COH x 12 ', cast(l_linenumber as string), ' 7.50 ', cast(cast(l_quantity as decimal(6,1)) as string), ' ± 4 p = 0.03 P<0.2 p = 0.03 mean: 8 SD 2') as text from {lineitem}"
add("x11_chart_texts", on(_CHARTS, lambda df: figures.chart_texts(df).select("chart_id", F.concat_ws(",", F.transform("numbers", lambda v: F.format_string("%.2f", v))).alias("numbers"), F.array_join(F.transform("integers", lambda v: v.cast("string")), ",").alias("integers"), F.array_join(F.transform("p_values", lambda p: F.concat(p["raw_text"], F.lit("|"), p["is_significant"].cast("string"))), ";").alias("p_values"), F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("mean_sd_pairs", lambda p: F.format_string("%.1f|%.1f|%.2f", p["mean"], p["sd"], p["cv_percent"])), ";").alias("mean_sd_pairs"))), """
with r as (select l_orderkey || '-' || l_linenumber as chart_id, l_quantity::double as q, l_linenumber as k from lineitem)
select chart_id, array_to_string(list_transform(list_sort(list_distinct([0.03, 0.2, 7.5, q])), lambda v: printf('%.2f', v::double)), ',') as numbers, array_to_string(list_sort(list_distinct([2, 4, 8, 12, k])), ',') as integers, 'p = 0.03|true;P<0.2|false' as p_values, 'Control,COH,mean,SD' as labels,
printf('%.1f|4.0|%.2f', q, round(4 / q * 100, 2)) || ';8.0|2.0|25.00' as mean_sd_pairs from r""")
add("c10_risk_pairs", lambda s, d: joined("shared_groups", "panels_a", "panels_b")(figures.risk_pairs(b.frame(s, d, "select l_suppkey as doc_id, concat('Fig ', cast(l_linenumber as string)) as figure_label, concat('Fig ', cast(l_linenumber as string), 'ABCDEFGH') as full_label from {lineitem} where l_suppkey % 3 <> l_linenumber % 3"), s)), """
with p as (select l_suppkey as doc_id, l_linenumber as f, count(*) as n from lineitem where l_suppkey % 3 <> l_linenumber % 3 group by all), d as (select distinct doc_id from p), k as (select * from d, (values ('Fig 1E vs Fig 4B'), ('Fig 1F vs Fig 4C')) t(pair))
select k.doc_id, pair, 'Fig 1' as base_a, 'Fig 4' as base_b, 'Control,COH,COH+RTA408' as shared_groups, case when x.n is not null then array_to_string(list_transform(range(least(x.n, 5)), lambda i: 'Fig 1ABCDEFGH'), ',') end as panels_a, case when y.n is not null then array_to_string(list_transform(range(least(y.n, 5)), lambda i: 'Fig 4ABCDEFGH'), ',') end as panels_b, x.n is not null and y.n is not null as both_have_bar_charts
from k left join p x on x.doc_id = k.doc_id and x.f = 1 left join p y on y.doc_id = k.doc_id and y.f = 4""")
add("c8_best_panels", on("select l_suppkey as page, l_linenumber as image, concat('g', cast(l_partkey % 3 as string)) as grp, l_orderkey as panel from {lineitem}", figures.best_panels), """
with r as (select l_suppkey as page, l_linenumber as image, 'g' || l_partkey % 3 as grp, l_orderkey as panel from lineitem), n as (select page, image, grp, count(*) as n from r group by page, image, grp), c as (select *, row_number() over (partition by page, image order by n desc, grp) as k from n)
select r.* from r join c on r.page = c.page and r.image = c.image and r.grp = c.grp where k = 1""")
_MEANS = "select l_suppkey as doc_id, l_partkey % 50 as idx, round(avg(l_quantity), 1) as mean from {lineitem} group by l_suppkey, l_partkey % 50"
_SIZES = "select l_suppkey as doc_id, l_orderkey * 10 + l_linenumber as place, cast(l_linenumber * 5 as int) as n from {lineitem} where l_suppkey % 4 <> 0"
add("c7_sample_size", lambda s, d: figures.sample_size(b.frame(s, d, _MEANS), b.frame(s, d, _SIZES)), f"""
with m as ({b.duck(_MEANS)}), z as ({b.duck(_SIZES)}), c as (select doc_id, n, row_number() over (partition by doc_id order by count(*) desc, min(place)) as k from z group by doc_id, n)
select m.doc_id, idx, mean, (case when c.n is not null then case when abs(mean * c.n - round(mean * c.n)) < 0.01 then c.n end else (select min(t.n) from (values (3), (4), (5), (6), (8), (10)) t(n) where abs(mean * t.n - round(mean * t.n)) < 0.01) end)::int as n from m left join c on m.doc_id = c.doc_id and c.k = 1""")
add("x9_ordered_sequences", on("select l_orderkey as doc_id, concat('Row ', cast(l_extendedprice as string), ' ', cast(l_quantity as string), ' 77.5\nvalues 45.2, 38.1, 31.0 fell from 1200 to 800 to ', cast(l_linenumber as string), ' in (5.5 ± 1), (6 ± 1), (', cast(l_quantity as string), ' ± 2)') as text from {lineitem}", lambda df: figures.ordered_sequences(df)))


def _checks(spark, sf_dir: str) -> DataFrame:
    numbers = b.frame(spark, sf_dir, "select l_suppkey as doc_id, l_extendedprice as value from {lineitem}")
    p_values = b.frame(spark, sf_dir, "select l_suppkey as doc_id, l_tax as value from {lineitem}")
    means = b.frame(spark, sf_dir, "select l_suppkey as doc_id, round(avg(l_quantity), 2) as mean, stddev_samp(l_quantity) / case when l_suppkey % 3 = 0 then 500 else 1 end as sd from {lineitem} group by l_suppkey, l_linenumber")
    series = b.frame(spark, sf_dir, "select l_suppkey as doc_id, l_linenumber as ds, cast(l_orderkey as int) as pos, case when l_suppkey % 4 = 0 then 3.5e0 * l_orderkey + l_quantity else l_extendedprice end as value from {lineitem} where l_linenumber > 5")
    return figures.pipeline_checks(numbers, p_values, means, b.frame(spark, sf_dir, _SIZES), series)


add("c2_pipeline_checks", _checks)
