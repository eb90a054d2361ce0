"""Text and tables of HTML, by the standard library's parser; supplementary links of text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "footer", "header", "aside"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.depth, self.lines, self.tables, self.open = 0, [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.depth += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.open[-1][-1].append("")

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.depth:
            self.depth -= 1
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.lines += [line.strip() for line in data.splitlines() if line.strip()]
        if self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1] += data


def read(html: str) -> tuple[str, list[tuple[int, list[list[str]]]]]:
    """Visible text, a line a piece; (number from 1, rows) of the tables that aren't empty."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    tables = [(k, [[c.strip() for c in row] for row in rows if any(c.strip() for c in row)]) for k, rows in enumerate(reader.tables, 1)]
    return "\n".join(reader.lines), [(k, rows) for k, rows in tables if rows]


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "text": [read(h)[0] for h in pdf["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def page_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_number, row, cells)."""

    def run(batches):
        for pdf in batches:
            rows = [(p, k, i, cells) for p, h in zip(pdf["page_id"], pdf["html"]) for k, table in read(h)[1] for i, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["page_id", "table_number", "row", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table_number int, row int, cells array<string>")


#: Patterns of labels with a link after them, in order; of links by themselves; of labels; known hosts (fixed patterns).
LABELLED = (
    r"(?i)(S\d+\s*(?:File|Table|Figure|Dataset|Data|Text|Appendix)[^.]*?\.)\s*(https?://[^\s]+)", r"(?i)(Supporting\s+Information[^.]*?\.?)\s*(https?://[^\s]+)",
    r"(?i)(Supplementary\s+(?:Material|Data|File|Figure|Table)[^.]*?)\s*(https?://[^\s]+)", r"(?i)(Data\s+Availability[^.]*?)\s*(https?://[^\s]+)",
)
FIGSHARE, DOI = r"https?://(?:www\.)?figshare\.com/\S+", r"(?:doi\.org/|DOI:?\s*)(10\.\d{4,}/[^\s.,;:]+)"
LABEL = r"(?i)(S\d+\s*(?:File|Table|Figure|Dataset|Data|Text|Appendix))(?:[^.]*?)\.?\s*(?:\(([^)]+)\))?"
HOSTS = ("figshare.com", "doi.org", "ncbi.nlm.nih.gov", "journals.plos.org", "biorxiv.org")


def _link(url: Column, label: Column, source: str) -> Column:
    name = F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1))
    host = name
    for known in reversed(HOSTS):
        host = F.when(name.contains(known), known).otherwise(host)
    return F.struct(url.alias("url"), label.alias("label"), (F.lit("figshare.com") if source == "figshare_url_scan" else host).alias("host"), F.lit(source).alias("source"))


def _links(text: Column) -> Column:
    """All links of a text, by pattern and place, each URL once."""
    trimmed = lambda c: F.regexp_replace(c, r"[.,;:]+$", "")
    found = []
    for pattern in LABELLED:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("label"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("url"))
        found.append(F.transform(pairs, lambda p: _link(trimmed(p["url"]), F.substring(F.regexp_replace(p["label"], r"^\s+|\s+$", ""), 1, 100), "labeled_si_pattern")))
    found.append(F.transform(F.regexp_extract_all(text, F.lit(FIGSHARE), 0), lambda u: _link(trimmed(u), F.lit("figshare_link"), "figshare_url_scan")))
    found.append(F.transform(F.regexp_extract_all(text, F.lit(DOI), 1), lambda d: _link(F.concat(F.lit("https://doi.org/"), d), F.concat(F.lit("DOI: "), F.substring(d, 1, 60)), "doi_pattern")))
    return F.concat(*found)


def supplementary_links(papers: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, place, url, label, host, source): labelled links, links to figshare, DOIs; the first of each URL."""
    rows = papers.select("doc_id", _links(F.coalesce("text", F.lit(""))).alias("all"))
    first = F.filter("all", lambda x, i: F.array_position(F.col("all")["url"], x["url"]) == i + 1)
    return rows.select("doc_id", F.posexplode(first).alias("place", "x")).select("doc_id", "place", "x.*")


def unresolved_labels(papers: DataFrame) -> DataFrame:
    """(doc_id, place, label, file_type): labels of supplements that no link's label holds, each once, case aside."""
    text = F.coalesce("text", F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LABEL), 1).alias("label"), F.regexp_extract_all(text, F.lit(LABEL), 2).alias("type"))
    rows = papers.select("doc_id", F.transform(F.array_distinct(_links(text)["label"]), F.lower).alias("known"), F.transform(pairs, lambda p: F.struct(F.trim(p["label"]).alias("label"), F.coalesce(F.nullif(F.trim(p["type"]), F.lit("")), F.lit("unknown")).alias("file_type"), F.lower(F.trim(p["label"])).alias("k"))).alias("all"))
    rows = rows.withColumn("all", F.filter("all", lambda x: ~F.exists("known", lambda label: label.contains(x["k"]))))
    first = F.filter("all", lambda x, i: F.array_position(F.col("all")["k"], x["k"]) == i + 1)
    return rows.select("doc_id", F.posexplode(first).alias("place", "x")).select("doc_id", "place", "x.label", "x.file_type")
