"""Citation graph screens over edges (src cites dst) and vertices (paper_id); nothing is gathered on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from .texts import sequence_match


def restrict(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct edges between vertices, without loops."""
    v = vertices.select("paper_id").distinct()
    kept = edges.where("src != dst").join(v.withColumnRenamed("paper_id", "src"), "src", "left_semi")
    return kept.join(v.withColumnRenamed("paper_id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def reciprocal(edges: DataFrame) -> DataFrame:
    """Pairs u < v that cite each other."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.intersect(back).where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))


def in_degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.select("paper_id").distinct().join(edges.groupBy(F.col("dst").alias("paper_id")).agg(F.count("*").alias("in_degree")), "paper_id", "left").na.fill(0, ["in_degree"])


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(paper_id, rank) summing to 1; a vertex that cites nothing gives to all alike. Ends when the ranks move by under tolerance a vertex."""
    nodes = vertices.select("paper_id").distinct()
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    graph = scratch.save(nodes.join(out.withColumnRenamed("src", "paper_id"), "paper_id", "left"))
    links = scratch.save(edges.select("src", "dst"))
    ranks = graph.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(rounds if n else 0):
        loose = ranks.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = links.join(ranks.select(F.col("paper_id").alias("src"), (F.col("rank") / F.col("degree")).alias("part")), "src").groupBy(F.col("dst").alias("paper_id")).agg(F.sum("part").alias("got"))
        new = ranks.join(flow, "paper_id", "left").select("paper_id", "degree", F.col("rank").alias("old"), (F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = scratch.save(new)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if moved < n * tolerance:
            break
    return ranks.select("paper_id", "rank")


#: Edges up to which a graph's rings are found in one task.
ONE_TASK = 500_000


def _components(src: list, dst: list) -> list[tuple]:
    """(vertex, least vertex of its strongly connected component, size), by two depth-first walks."""
    onward: dict = {}
    back: dict = {}
    for u, v in zip(src, dst):
        onward.setdefault(u, []).append(v)
        back.setdefault(v, []).append(u)
    done, left_in_order = set(), []
    for root in onward:
        stack = [(root, iter(onward[root]))] if root not in done else []
        done.add(root)
        while stack:
            at, rest = stack[-1]
            nxt = next((v for v in rest if v not in done), None)
            if nxt is None:
                left_in_order.append(at)
                stack.pop()
            else:
                done.add(nxt)
                stack.append((nxt, iter(onward.get(nxt, ()))))
    out, taken = [], set()
    for root in reversed(left_in_order):
        if root in taken:
            continue
        taken.add(root)
        own, front = [root], [root]
        while front:
            for u in back.get(front.pop(), ()):
                if u not in taken:
                    taken.add(u)
                    own.append(u)
                    front.append(u)
        out += [(v, min(own), len(own)) for v in own]
    return out


def rings(edges: DataFrame, least: int = 3, one_task: int = ONE_TASK) -> DataFrame:
    """(paper_id, ring, size) of strongly connected components of at least `least` papers; ring is the smallest paper of it.

    Vertices without an edge in or out are trimmed first. Up to `one_task` edges the rest is walked in one task. Beyond,
    by forward and backward colouring: the smallest vertex spreads along edges, then back among its colour; what both
    reach is a component and goes; the rest is trimmed and coloured again. Each step costs a round for every edge of the
    longest path that a colour has to go.
    """
    left, found = scratch.save(edges.where("src != dst").select("src", "dst").distinct()), None
    schema = f"paper_id {edges.schema['src'].dataType.simpleString()}, ring {edges.schema['src'].dataType.simpleString()}, size long"
    while True:
        many = left.count()
        while many > one_task:  # a vertex in a cycle has edges both ways
            live = left.select(F.col("src").alias("v")).intersect(left.select(F.col("dst").alias("v")))
            kept = scratch.save(left.join(live.withColumnRenamed("v", "src"), "src", "left_semi").join(live.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"))
            before, many, left = many, kept.count(), kept
            if many == before:
                break
        if many <= one_task:

            def walk(batches):
                parts = list(batches)  # one_task rows at most
                rows = _components([v for p in parts for v in p["src"]], [v for p in parts for v in p["dst"]])
                yield pd.DataFrame(rows, columns=["paper_id", "ring", "size"])

            last = left.coalesce(1).mapInPandas(walk, schema).where(F.col("size") >= least)
            return last if found is None else found.unionByName(last)
        nodes = left.select(F.col("src").alias("v")).distinct()
        colour = _spread(left, scratch.save(nodes.withColumn("c", F.col("v"))))
        ends = left.join(colour.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst")
        same = scratch.save(ends.where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("c")))
        core = _reach(same, scratch.save(colour.where("v = c")))
        sizes = core.groupBy("c").agg(F.count("*").alias("size")).where(F.col("size") >= least)
        part = core.join(sizes, "c").select(F.col("v").alias("paper_id"), F.col("c").alias("ring"), "size")
        found = part if found is None else found.unionByName(part)
        gone = core.select("v")
        left = scratch.save(left.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Least colour that reaches each vertex."""
    while True:
        got = edges.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("g"))
        new = scratch.save(colour.join(got, "v", "left").select("v", F.least("c", F.coalesce("g", "c")).alias("c"), (F.col("g") < F.col("c")).alias("moved")))
        colour = new.drop("moved")
        if new.where("moved").isEmpty():
            return colour


def _reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Vertices reached from the seeds along edges (src, dst, c) of their colour."""
    seen, size = seeds, -1
    while True:
        step = edges.join(seen.withColumnRenamed("v", "src"), ["src", "c"]).select(F.col("dst").alias("v"), "c")
        seen = scratch.save(seen.unionByName(step).distinct())
        now = seen.count()
        if now == size:
            return seen
        size = now


def graph_summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: vertices, edges, density, rings, reciprocal pairs, flagged."""
    kept = restrict(edges, vertices)
    n = vertices.select("paper_id").distinct().agg(F.count("*").alias("n"))
    m = kept.agg(F.count("*").alias("m"))
    pairs = reciprocal(kept).agg(F.count("*").alias("reciprocal_pairs"))
    ring = rings(kept).agg(F.countDistinct("ring").alias("rings"))
    out = n.crossJoin(m).crossJoin(pairs).crossJoin(ring)  # one row each
    density = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return out.withColumns({"density": F.round(density, 9), "flagged": (F.col("rings") > 0) | (F.col("reciprocal_pairs") > F.greatest(F.lit(3.0), 0.1 * F.col("n")))})


def self_citation(rows: DataFrame, top: int = 20) -> DataFrame:
    """(author, paper_id, citing_id, citing_authors): rate of citing papers with an author whose name holds the last name."""
    last = F.lower(F.element_at(F.split(F.trim("author"), r"\s+"), -1))
    self_cited = F.exists("citing_authors", lambda x: F.lower(x).contains(last) | (F.lower(x) == F.lower("author")))
    counts = rows.groupBy("author").agg(F.count("*").alias("citations"), F.count_if(self_cited).alias("self_citations"))
    rate = F.try_divide("self_citations", "citations")
    return counts.withColumn("rate", F.round(rate, 6)).withColumn("band", F.when(rate > 0.40, "high").when(rate > 0.25, "elevated").when(rate > 0.20, "borderline").otherwise("normal"))


#: Vague attributions (fixed patterns).
VAGUE = (
    r"it has been (?:shown|reported|demonstrated) that", r"previous studies (?:have|has) (?:shown|reported|demonstrated)", r"it is (?:well[ -]?)?known that",
    r"consistent with (?:previous|prior) (?:reports|studies|findings)",
)


def content_words(text: Column) -> Column:
    """Distinct words of four or more letters a to z, nothing else."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[a-z]{4,}$")))


def claim_support(rows: DataFrame) -> DataFrame:
    """(claim_text, cited_doi, cited_title, fetched_title, abstract): what speaks against a claim's citation.

    Of the claim's content words (markers such as [3,5-7] aside) under 10 % in the cited title, or under 15 % in its
    abstract, each where both sides have words; neither DOI nor title; a vague attribution.
    """
    claim = F.coalesce("claim_text", F.lit(""))
    own = content_words(F.regexp_replace(claim, r"\[\d+(?:[,–-]\d+)*\]", ""))
    share = lambda c: F.when(F.size(content_words(F.col(c))) > 0, F.try_divide(F.size(F.array_intersect(own, content_words(F.col(c)))), F.size(own)))
    out = rows.withColumns({"title_overlap": F.round(share("fetched_title"), 6), "abstract_overlap": F.round(share("abstract"), 6)})
    none = (F.coalesce("cited_doi", F.lit("")) == "") & (F.coalesce("cited_title", F.lit("")) == "")
    issues = F.array_compact(F.array(
        F.when(share("fetched_title") < 0.10, "low_title_relevance"), F.when(share("abstract") < 0.15, "low_abstract_relevance"),
        F.when(none, "unverifiable"), F.when(claim.rlike("(?i)" + "|".join(VAGUE)), "vague_citation"),
    ))
    return out.withColumn("issues", issues).withColumn("suspicious", F.size("issues") > 0)


def cited_works(claims: DataFrame, works: DataFrame) -> DataFrame:
    """claims with fetched_title and abstract from `works` (doi, title, abstract): by DOI, else by title (case aside)."""
    by_doi = works.where("doi is not null").groupBy(F.lower("doi").alias("_d")).agg(F.min(F.struct("title", "abstract")).alias("_w"))
    by_title = works.where("title is not null").groupBy(F.lower("title").alias("_t")).agg(F.min(F.struct("title", "abstract")).alias("_v"))
    out = claims.withColumns({"_d": F.lower(F.nullif("cited_doi", F.lit(""))), "_t": F.lower(F.nullif("cited_title", F.lit("")))}).join(by_doi, "_d", "left").join(by_title, "_t", "left")
    return out.withColumn("_w", F.coalesce("_w", "_v")).withColumns({"fetched_title": F.col("_w.title"), "abstract": F.col("_w.abstract")}).drop("_d", "_t", "_w", "_v")


NOISE = ("the", "and", "for", "that", "with", "from", "this", "was", "are", "has", "had", "were", "been")


def search_queries(citations: DataFrame) -> DataFrame:
    """(ref_id, citation_text): the queries to search for, two at most: the DOI, author and year with four keywords, six keywords."""
    text = F.coalesce("citation_text", F.lit(""))
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    words = F.slice(F.filter(F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z]{4,}\b"), 0), lambda w: ~F.lower(w).isin(*NOISE)), 1, 10)
    author, year = found(r"[A-Z][a-z]+(?:\s+(?:et\s+al\.?|[A-Z][a-z]+))?"), found(r"\b(?:19|20)\d{2}\b")
    named = F.when(author.isNotNull() & year.isNotNull(), F.concat_ws(" ", author, year, F.array_join(F.slice(words, 1, 4), " ")))
    queries = F.slice(F.array_compact(F.array(found(r"10\.\d{4,}/[^\s]+"), named, F.array_join(F.slice(words, 1, 6), " "))), 1, 2)
    return citations.select("ref_id", F.posexplode(queries).alias("place", "query"))


def citation_existence(citations: DataFrame, results: DataFrame) -> DataFrame:
    """(ref_id, citation_text, claim) against what searches found (ref_id, place, title, authors): is the work there and relevant?

    A result's relevance is the ratio of the citation's first 200 characters to its title and first three authors; over .5
    is relevant. The share of the claim's content words in the first result's title says whether it may support the claim.
    """
    told = F.lower(F.concat(F.coalesce("title", F.lit("")), F.array_join(F.slice("authors", 1, 3), " ")))
    both = citations.select("ref_id", F.substring(F.lower("citation_text"), 1, 200).alias("_c")).join(results, "ref_id")
    both = both.withColumn("r", F.round(sequence_match(F.col("_c"), told, F.lit(10**6))["ratio"], 3))
    best = both.groupBy("ref_id").agg(F.count("*").alias("results_count"), F.max("r").alias("relevance"), F.min_by("title", "place").alias("best_title"))
    own = content_words(F.col("claim"))
    share = F.size(F.array_intersect(own, content_words(F.col("best_title")))) / F.greatest(F.size(own), F.lit(1))
    out = citations.join(best, "ref_id", "left").na.fill(0, ["results_count"]).withColumn("overlap", F.when((F.coalesce("claim", F.lit("")) != "") & (F.col("results_count") > 0), F.round(share, 3)))
    assessed = F.when(F.col("overlap").isNull(), None).when(share > 0.20, "likely_supported").when(share > 0.10, "possibly_supported").when(share > 0.05, "likely_unsupported").otherwise("very_unlikely_supported")
    out = out.withColumns({"assessment": assessed, "paper_found": F.col("results_count") > 0, "highly_relevant": F.coalesce(F.col("relevance") > 0.5, F.lit(False))})
    severity = F.when(~F.col("paper_found"), "critical").when(~F.col("highly_relevant"), "high").when(F.col("assessment").isin("likely_unsupported", "very_unlikely_supported"), "medium").otherwise("low")
    return out.withColumns({"severity": severity, "flagged": ~F.col("paper_found") | ~F.col("highly_relevant")})
