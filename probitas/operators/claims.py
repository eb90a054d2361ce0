"""Claims in paper text (means with deviations, p values, sample sizes) and their alignment with raw series."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import scratch

_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
P_VALUE = re.compile(rf"\b(?:p[-\s]?value|p)\s*(<=|>=|=|<|>|≤|≥)\s*({_NUMBER})(?![A-Za-z0-9_])", re.I)
MEAN_SD = [
    re.compile(rf"(?P<m>{_NUMBER})\s*(?:±|\+/-|\\pm)\s*(?P<s>{_NUMBER})"),
    re.compile(rf"\bM\s*=\s*(?P<m>{_NUMBER})\s*[,;]?\s*\(?\s*SD\s*=\s*(?P<s>{_NUMBER})", re.I),
    re.compile(rf"\bmean\b[^.;\n]{{0,40}}?\b(?:was|of|is|were|=)\s*(?P<m>{_NUMBER})[^.;\n]{{0,20}}?\(\s*(?:SD|s\.d\.)\s*=?\s*(?P<s>{_NUMBER})", re.I),
]
SAMPLE = re.compile(r"\b[nN]\s*=\s*(\d{1,4})\b")
PAGE = re.compile(r"^\[Page (\d+)\]", re.M)
#: Section names and what heads them (fixed values).
SECTIONS = {
    "abstract": "Abstract", "summary": "Abstract", "摘要": "Abstract",
    "introduction": "Introduction", "background": "Introduction", "引言": "Introduction", "前言": "Introduction",
    "methods": "Methods", "materials and methods": "Methods", "methodology": "Methods", "experimental procedures": "Methods", "方法": "Methods", "材料与方法": "Methods",
    "results": "Results", "result": "Results", "结果": "Results", "discussion": "Discussion", "讨论": "Discussion",
    "conclusion": "Conclusion", "conclusions": "Conclusion", "结论": "Conclusion", "references": "References", "reference": "References", "参考文献": "References",
    "figure legends": "Figure legends", "figures": "Figures", "tables": "Tables",
}
HEADING = re.compile(r"^[#\s\d.]*([^\n]{2,40}?)[:\s]*$", re.M)
#: How far back a heading holds; characters of context.
REACH, CONTEXT = 15_000, 80
SCHEMA = "doc_id string, claim_type string, kind_ord int, mean double, sd double, p_value double, operator string, n int, raw_text string, char_start int, char_end int, page int, page_detection string, section string, context_before string, context_after string"


def extract(text: str) -> list[tuple]:
    """Claims of one text with their spans, by place."""
    found: dict[tuple[int, int], tuple] = {}
    for pattern in MEAN_SD:
        for m in pattern.finditer(text):
            if float(m["s"]) >= 0 and not any(a < m.end() and m.start() < b for a, b in found):
                found[m.span()] = ("reported_mean_sd", 0, float(m["m"]), float(m["s"]), None, None, None, m[0])
    rows = [(span, v) for span, v in found.items()]
    for m in P_VALUE.finditer(text):
        if 0 <= float(m[2]) <= 1:
            rows.append((m.span(), ("reported_p_value", 1, None, None, float(m[2]), m[1].replace("≤", "<=").replace("≥", ">="), None, m[0])))
    for m in SAMPLE.finditer(text):
        if int(m[1]) > 0:
            rows.append((m.span(), ("reported_n", 2, None, None, None, None, int(m[1]), m[0])))
    rows.sort(key=lambda r: (r[0][0], r[1][1]))
    pages = [(m.start(), int(m[1])) for m in PAGE.finditer(text)]
    heads = [(m.start(), SECTIONS[name]) for m in HEADING.finditer(text) if (name := m[1].strip().lower()) in SECTIONS]
    out = []
    for (a, b), v in rows:
        k = bisect.bisect_right(pages, (a, 1 << 60)) - 1
        page = pages[max(k, 0)][1] if pages else None
        h = bisect.bisect_right(heads, (a, "￿")) - 1
        section = heads[h][1] if h >= 0 and a - heads[h][0] <= REACH else None
        out.append((*v, a, b, page, "page_marker" if pages else "missing_page_marker", section, text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]))
    return out


def claims(papers: DataFrame, most: int | None = 300) -> DataFrame:
    """(doc_id, text): numbered claims of each paper in order, the first `most` of them (the reference's default; None: all)."""

    def run(batches):
        for pdf in batches:
            rows = [(d, *r) for d, t in zip(pdf["doc_id"], pdf["text"]) for r in extract(t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"n": "Int32", "page": "Int32"})

    found = papers.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA)
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start", "kind_ord")))
    if most is not None:
        found = found.where(F.col("k") <= most)
    return found.withColumn("claim_id", F.format_string("PCL-%04d", "k")).withColumn("reportable", F.lit(False)).drop("k", "kind_ord")


def claim_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "claim_type").agg(F.count("*").alias("claims"))


def stated(found: DataFrame, pre_extracted: DataFrame | None = None, most: int = 200) -> DataFrame:
    """Mean and deviation claims of each paper, `most` at most; those extracted before (doc_id, place, mean, sd) where a paper has none."""
    wanted = found.where("claim_type = 'reported_mean_sd' and mean is not null and sd is not null").select("doc_id", "claim_id", "mean", "sd")
    if pre_extracted is not None:
        other = pre_extracted.join(wanted.select("doc_id"), "doc_id", "left_anti")
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
        wanted = wanted.unionByName(other.select("doc_id", F.format_string("PCL-%04d", place).alias("claim_id"), "mean", "sd"))
    return wanted.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("claim_id"), "claim_id"))).where(F.col("_k") <= most).drop("_k")


def _ends(r: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest double within the relative tolerance (scale 1 at least, under a half) of each r, by bisection of the rule itself."""
    r = np.asarray(r, float)
    holds = lambda x: np.abs(r - x) / np.maximum(np.maximum(np.abs(r), np.abs(x)), 1.0) <= tol

    def turned(bits: np.ndarray) -> np.ndarray:
        """Bits of doubles as integers in the doubles' order, and back."""
        return bits ^ (bits >> 63 & np.int64((1 << 63) - 1))

    out = []
    for beyond in (-2 * np.abs(r) - 1, 2 * np.abs(r) + 1):
        within, without = turned(r.view(np.int64)), turned(beyond.view(np.int64))
        for _ in range(65):
            middle = (within & without) + ((within ^ without) >> 1)
            ok = holds(turned(middle).view(float))
            within, without = np.where(ok, middle, within), np.where(ok, without, middle)
        out.append(turned(within).view(float))
    return out[0], out[1]


def _before(ranks: np.ndarray, at: np.ndarray, below: np.ndarray) -> np.ndarray:
    """How many of the first `at` ranks are under `below`, for each pair: blocks of powers of two, each sorted."""
    n, out = len(ranks), np.zeros(len(at), np.int64)
    for level in range(n.bit_length()):
        keys = np.sort((np.arange(n) >> level) * (n + 1) + ranks)
        has = (at >> level) & 1 == 1
        block = (at[has] >> (level + 1)) << 1
        out[has] += np.searchsorted(keys, block * (n + 1) + below[has]) - (block << level)
    return out


def _inside(m: np.ndarray, s: np.ndarray, wm: np.ndarray, ws: np.ndarray, mean_tol: float, sd_tol: float) -> np.ndarray:
    """How many of the series (m ascending, s) are within both tolerances of each claim (wm, ws)."""
    ordered = np.sort(s)
    ranks = np.empty(len(s), np.int64)
    ranks[np.argsort(s, kind="stable")] = np.arange(len(s))
    (low, high), (least, most) = _ends(wm, mean_tol), _ends(ws, sd_tol)
    a, b = np.searchsorted(m, low), np.searchsorted(m, high, "right")
    under, upto = np.searchsorted(ordered, least), np.searchsorted(ordered, most, "right")
    return _before(ranks, b, upto) - _before(ranks, b, under) - _before(ranks, a, upto) + _before(ranks, a, under)


def _nearest(m: np.ndarray, s: np.ndarray, ds: list, mean: float, sd: float, a: int, b: int, mean_tol: float, sd_tol: float, most: int = 5) -> list[tuple]:
    """The first `most` by (mean_rel, sd_rel, ds) of series a to b, from the claim's mean outwards until none can be nearer."""
    rel = lambda r, x: np.abs(r - x) / np.maximum(np.maximum(abs(r), np.abs(x)), 1.0)
    middle, reach = int(np.searchsorted(m, mean)), 32
    while True:
        i, j = max(a, middle - reach), min(b, middle + reach)
        mean_rel, sd_rel = rel(mean, m[i:j]), rel(sd, s[i:j])
        fit = np.nonzero((mean_rel <= mean_tol) & (sd_rel <= sd_tol))[0]
        if i == a and j == b:
            break
        outside = min([float(rel(mean, m[k])) for k in ([i - 1] if i > a else []) + ([j] if j < b else [])])
        if len(fit) >= most and np.partition(mean_rel[fit], most - 1)[most - 1] < outside:
            break
        reach *= 4
    first = fit[np.lexsort((sd_rel[fit], mean_rel[fit]))]
    if len(first) > most:  # with all that tie with the last by both differences
        last = first[most - 1]
        first = [k for k in first if (mean_rel[k], sd_rel[k]) <= (mean_rel[last], sd_rel[last])]
    return sorted((float(mean_rel[k]), float(sd_rel[k]), ds[i + k], float(m[i + k]), float(s[i + k])) for k in first)[:most]


def align(found: DataFrame, cells: DataFrame, mean_tol: float = 0.02, sd_tol: float = 0.05, pre_extracted: DataFrame | None = None, most: int = 200, spread: int = 8) -> DataFrame:
    """Mean and deviation claims against series of three values or more, both within a relative tolerance.

    The tolerance join meets on a grid of the series' mean, as wide as the tolerance at that size, with its
    neighbours; below 1 the scale is 1, so the grid is even there and logarithmic above. Where many series are alike most
    pairs match, so no pairs are made: in a cell the matches of all claims are counted over sorted blocks, and only the
    first five of each are looked up. Equal claims go in as one, dealt out over `spread` tasks a cell. candidates are the
    first five by difference; computed values and differences are given where there is but one.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    series = cells.groupBy("ds").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("n >= 3")

    def grid(v):
        big = F.signum(v) * (F.floor(F.log(F.greatest(F.abs(v), F.lit(1.0))) / (1.5 * mean_tol)) + F.ceil(F.lit(1 / mean_tol)))
        return F.when(F.abs(v) <= 1, F.floor(v / mean_tol)).otherwise(big).cast("long")

    wanted = stated(found, pre_extracted, most).withColumns({c: F.col(c).cast("double") for c in ("mean", "sd")})
    claimed = wanted.where(finite("mean") & finite("sd")).select(F.expr("mean + 0D").alias("mean"), F.expr("sd + 0D").alias("sd")).distinct()
    claimed = claimed.select("mean", "sd", F.pmod(F.xxhash64("mean", "sd"), F.lit(spread)).alias("part"), F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: grid(F.col("mean")) + d)).alias("g"))
    dealt = series.where(finite("m") & finite("s")).select("ds", "m", "s", grid(F.col("m")).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("part"))
    names = ["mean_rel", "sd_rel", "ds", "m", "s"]
    near = T.ArrayType(T.StructType([T.StructField(c, series.schema["ds"].dataType if c == "ds" else T.DoubleType()) for c in names]))
    made = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType()), T.StructField("k", T.LongType()), T.StructField("strong", T.LongType()), T.StructField("near", near)])

    def matches(claimed: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("m", kind="stable")
        m, s, ds = rows["m"].to_numpy(float), rows["s"].to_numpy(float), rows["ds"].tolist()
        wm, ws = claimed["mean"].to_numpy(float), claimed["sd"].to_numpy(float)
        k, strong = _inside(m, s, wm, ws, mean_tol, sd_tol), _inside(m, s, wm, ws, mean_tol / 2, 0.6 * sd_tol)
        low, high = _ends(wm, mean_tol)
        a, b = np.searchsorted(m, low), np.searchsorted(m, high, "right")
        some = np.nonzero(k)[0]
        first = [[dict(zip(names, x)) for x in _nearest(m, s, ds, float(wm[i]), float(ws[i]), int(a[i]), int(b[i]), mean_tol, sd_tol)] for i in some]
        return pd.DataFrame({"mean": wm[some], "sd": ws[some], "k": k[some], "strong": strong[some], "near": pd.Series(first, dtype=object)})

    parts = claimed.groupBy("g", "part").cogroup(dealt.groupBy("g", "part")).applyInPandas(lambda x, y: matches(x, y), made)
    best = parts.groupBy(F.col("mean").alias("_mean"), F.col("sd").alias("_sd")).agg(F.sum("k").alias("candidate_match_count"), F.sum("strong").alias("strong_matches"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, 5).alias("_near"))
    out = wanted.join(best, (F.expr("mean + 0D") == F.col("_mean")) & (F.expr("sd + 0D") == F.col("_sd")), "left").na.fill(0, ["candidate_match_count", "strong_matches"])
    one = F.when(F.col("candidate_match_count") == 1, F.col("_near")[0])
    out = out.select("doc_id", "claim_id", "mean", "sd", "candidate_match_count", "strong_matches", F.transform("_near", lambda x, i: F.struct((i + 1).alias("k"), x["ds"].alias("ds"))).alias("candidates"),
        one["m"].alias("computed_mean"), one["s"].alias("computed_sd"), one["mean_rel"].alias("mean_relative_diff"), one["sd_rel"].alias("sd_relative_diff"))
    return out.withColumn("verdict", F.when(F.col("candidate_match_count") == 1, "matched").when(F.col("candidate_match_count") > 1, "ambiguous").otherwise("no_candidate"))


def verdict_counts(aligned: DataFrame) -> DataFrame:
    """One row: claims by verdict; a claim that nothing was aligned for is unverifiable."""
    return aligned.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("matched", "ambiguous", "no_candidate", "unverifiable")], F.count("*").alias("validation_count"))


def cross_validation(aligned: DataFrame, evidence: DataFrame) -> DataFrame:
    """Alignments with the ids of evidence on their candidate series, numbered by document and claim; none is reportable by itself."""
    by_series = evidence.select("evidence_id", F.explode(F.array_compact(F.array("ds_a", "ds_b"))).alias("ds"))
    linked = aligned.select("doc_id", "claim_id", F.explode("candidates").alias("c")).select("doc_id", "claim_id", "c.ds").join(by_series, "ds").groupBy("doc_id", "claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("linked_evidence_ids"))
    out = aligned.join(linked, ["doc_id", "claim_id"], "left").withColumn("linked_evidence_ids", F.coalesce("linked_evidence_ids", F.array().cast("array<string>")))
    rows = scratch.numbered(out, "_k", "doc_id", F.length("claim_id"), "claim_id")
    return rows.withColumns({"validation_id": F.format_string("XVAL-%04d", "_k"), "reportable": F.lit(False)}).drop("_k")


def merged(by_document: DataFrame) -> DataFrame:
    """Claims of a paper's documents (doc_id, document_ord, claim_id, ...: main text and supplements) as one list: numbered anew
    by document and place; the document's own number stays as document_claim_id."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("document_ord", F.length("claim_id"), "claim_id"))
    return by_document.withColumn("document_claim_id", F.col("claim_id")).withColumn("claim_id", F.format_string("PCL-%04d", k))


def numeric_cells(text):
    """A table cell's number: thousands separators, percent, parentheses as minus, trailing marks; null if none."""
    t = F.rtrim(F.regexp_replace(F.trim(text), r"[*^{}\[\] ]+$", ""))
    t = F.regexp_replace(t, ",", "")
    minus, percent = t.rlike(r"^\(.*\)$"), t.endswith("%")
    number = F.regexp_replace(t, r"^\(|\)$|%$", "").try_cast("double")
    number = F.when(percent, number / 100).otherwise(number)
    return F.when(minus, -number).otherwise(number)
