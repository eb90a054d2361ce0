"""Text screens: reuse between texts, reviews, reviewers, publication rates, thinly sliced papers."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import scratch

#: Stock phrases of reviews, mail providers and institutional endings (fixed values).
GENERIC = ("interesting paper", "well written", "important contribution", "novel approach", "timely topic", "good work", "nice paper", "well organized", "clearly presented")
FREE_MAIL = ("@gmail", "@yahoo", "@hotmail", "@outlook", "@qq", "@163", "@126", "@proton")
INSTITUTIONAL = (".edu", ".ac.", ".gov", ".org", "@uni", "@campus")


_BLOCK = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "size")])


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("blocks", T.ArrayType(_BLOCK))]))
def sequence_match(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.DataFrame:
    """The standard library's ratio and its matching blocks of a least size."""
    out = []
    for x, y, k in zip(a, b, least):
        m = difflib.SequenceMatcher(None, x or "", y or "")
        out.append((m.ratio(), [{"a": s.a, "b": s.b, "size": s.size} for s in m.get_matching_blocks() if s.size >= k]))
    return pd.DataFrame(out, columns=["ratio", "blocks"])


def lexical_reuse(pairs: DataFrame, min_match: int = 50, top: int = 20) -> DataFrame:
    """(pair_id, text_a, text_b): similarity of the lower-cased texts, blocks of at least min_match characters."""
    out = pairs.withColumn("m", sequence_match(F.lower("text_a"), F.lower("text_b"), F.lit(min_match)))
    ratio = F.col("m.ratio")
    level = F.when(ratio > 0.8, "critical").when(ratio > 0.6, "high").when(ratio > 0.4, "medium").when(ratio > 0.2, "low").otherwise("none")
    return out.select("pair_id", F.round(ratio, 6).alias("ratio"), F.size("m.blocks").alias("block_count"), F.slice("m.blocks", 1, top).alias("blocks"), level.alias("level"), ((ratio > 0.6) | (F.size("m.blocks") > 0)).alias("flagged"))


def reuse_candidates(left: DataFrame, right: DataFrame, run: int = 50) -> DataFrame:
    """Pairs (a, b) of (id, text) rows whose lower-cased texts share a block of `run` characters, and few others.

    Such a block holds one of the pieces of run // 2 characters that the left texts are cut into, end to end, so the pieces
    meet with those that begin at any character of the right texts. Put the fewer, shorter texts on the right.
    """
    size = run // 2

    def pieces(df: DataFrame, name: str, step: int) -> DataFrame:
        rows = df.select(F.col("id").alias(name), F.lower(F.coalesce("text", F.lit(""))).alias("t")).where(F.length("t") >= size)
        return rows.select(name, F.explode(F.array_distinct(F.expr(f"transform(sequence(0, length(t) - {size}, {step}), i -> xxhash64(substr(t, i + 1, {size})))"))).alias("h"))

    return pieces(left, "a", size).join(pieces(right, "b", 1), "h").select("a", "b").distinct()


def semantic_similarity(rows: DataFrame, threshold: float = 0.8, top: int = 15) -> DataFrame:
    """(pair_id, side, idx, embedding): cosine of every sentence of side a with every one of side b of its pair; best per pair."""
    unit = rows.withColumn("u", F.expr("transform(embedding, x -> x / sqrt(aggregate(embedding, 0D, (s, v) -> s + v * v)))"))
    a, b = unit.where("side = 'a'").select("pair_id", F.col("idx").alias("ia"), F.col("u").alias("ua")), unit.where("side = 'b'").select("pair_id", F.col("idx").alias("ib"), F.col("u").alias("ub"))
    scored = a.join(b, "pair_id").withColumn("cosine", F.expr("aggregate(zip_with(ua, ub, (x, y) -> x * y), 0D, (s, v) -> s + v)"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("cosine"), "ia", "ib")))
    return best.groupBy("pair_id").agg(F.round(F.max("cosine"), 6).alias("max_cosine"), F.round(F.avg("cosine"), 6).alias("mean_cosine"), F.count_if(F.col("cosine") > threshold).alias("matches"), F.sort_array(F.collect_list(F.when((F.col("r") <= top) & (F.col("cosine") > threshold), F.struct("r", "ia", "ib")))).alias("top_matches"))


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences over `least` characters; full stops of common abbreviations don't end one."""
    safe = F.regexp_replace(text, r"\b(e\.g|i\.e|et al|Fig|Figs|Dr|Prof|vs|etc|No|Eq)\.", "$1\u0001")
    parts = F.transform(F.split(safe, r"(?<=[.!?])\s+"), lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) > least)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")


#: White space as str.split has it; marks of specific references by kind (fixed patterns).
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
REFERENCES = {
    "figure_refs": r"(?i)(?:Figure|Fig\.?)\s*\d+", "table_refs": r"(?i)Table\s*\d+", "section_refs": r"(?i)(?:Section|page|paragraph|line)\s*\d+", "equation_refs": r"(?i)(?:Equation|Eq\.?)\s*\d+",
}


def review_texts(reviews: DataFrame) -> DataFrame:
    """(paper_id, review_index, text): reviews under 100 words, with under two specific references, or with three stock phrases.

    duplicated_phrases are the paper's five-word phrases that two or more of its reviews have, 20 at most; the paper is
    flagged for more than five of them or any suspicious review.
    """
    text = F.coalesce("text", F.lit(""))
    rows = reviews.select("paper_id", "review_index", F.filter(F.split(F.lower(text), SPACE), lambda w: w != "").alias("w"), *[F.regexp_count(text, F.lit(p)).alias(k) for k, p in REFERENCES.items()], sum((F.lower(text).contains(p).cast("int") for p in GENERIC), F.lit(0)).alias("generic_phrase_count"))
    grams = rows.where(F.size("w") >= 5).select("paper_id", F.explode(F.array_distinct(F.expr("transform(sequence(0, size(w) - 5), i -> array_join(slice(w, i + 1, 5), ' '))"))).alias("gram"))
    shared = grams.groupBy("paper_id", "gram").agg(F.count("*").alias("df")).where("df >= 2").groupBy("paper_id").agg(F.least(F.count("*"), F.lit(20)).cast("int").alias("duplicated_phrases"))
    rows = rows.withColumns({"word_count": F.size("w"), "specific_references": sum((F.col(k) for k in REFERENCES), F.lit(0))}).drop("w")
    rows = rows.withColumn("suspicious", (F.col("word_count") < 100) | (F.col("specific_references") < 2) | (F.col("generic_phrase_count") >= 3))
    papers = rows.groupBy("paper_id").agg(F.bool_or("suspicious").alias("_any")).join(shared, "paper_id", "left").na.fill(0, ["duplicated_phrases"])
    papers = papers.select("paper_id", "duplicated_phrases", (F.col("_any") | (F.col("duplicated_phrases") > 5)).alias("flagged"))
    return rows.join(papers, "paper_id")


#: Letters that are counted to bound a ratio; all other characters make one more class.
LETTERS = "abcdefghijklmnopqrstuvwxyz "


def _counted(text: Column) -> Column:
    """How often each class of characters stands in a text."""
    return F.array(*[F.length(text) - F.length(F.translate(text, c, "")) for c in LETTERS], F.length(F.translate(text, LETTERS, "")))


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[str, int] = {}
    for k, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        met = row & masks.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(x) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def match_over(a: pd.Series, b: pd.Series, ratio: pd.Series) -> pd.Series:
    """The sequence match's ratio where it is over `ratio`, else null. Matching blocks are a common subsequence, so its length bounds them."""
    out = []
    for x, y, least in zip(a, b, ratio):
        can = x == y or 2 * common_length(x, y) >= least * (len(x) + len(y)) - 1e-9
        got = 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() if can else 0.0
        out.append(got if got > least else None)
    return pd.Series(out, dtype="float64")


def _alike(pairs: DataFrame, ratio: float) -> DataFrame:
    """Pairs (sa, sb) whose sequence match is over `ratio`; only those whose characters in common, then in common order, allow it are matched."""
    shared = F.aggregate(F.zip_with(_counted(F.col("sa")), _counted(F.col("sb")), lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    can = pairs.where(2.0 * shared > ratio * (F.length("sa") + F.length("sb")))
    return can.withColumn("ratio", match_over("sa", "sb", F.lit(float(ratio)))).where("ratio is not null")


def review_templates(reviews: DataFrame, ratio: float = 0.8, opening: float = 0.7) -> DataFrame:
    """(paper_id, review_index, text): per paper of two or more reviews, the pairs of sentences (over 30 characters) of
    different reviews that are alike, and how alike the reviews' openings are on average.

    Equal sentences of a review are one row with a count. Texts can only be alike if their lengths are, so pairs meet
    within a paper on the logarithm of the length and its neighbours, then by characters in common. A pair of texts that
    several papers have is matched once.
    """
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.lower(F.regexp_replace(s, r"^\s+|\s+$", "")))
    rows = reviews.select("paper_id", "review_index", parts.alias("parts"))
    told = rows.select("paper_id", "review_index", F.explode("parts").alias("s")).where(F.length("s") > 30).groupBy("paper_id", "review_index", "s").agg(F.count("*").alias("c"))
    size = float(-math.log(ratio / (2 - ratio)))  # of lengths a ratio over `ratio` is possible up to this difference of logarithms
    told = told.withColumn("g", F.floor(F.log(F.length("s")) / size))
    a = told.select("paper_id", F.col("review_index").alias("ra"), F.col("s").alias("sa"), F.col("c").alias("ca"), F.explode(F.array(*[F.col("g") + d for d in (-1, 0, 1)])).alias("g"))
    b = told.select("paper_id", F.col("review_index").alias("rb"), F.col("s").alias("sb"), F.col("c").alias("cb"), "g")
    pairs = a.join(b, ["paper_id", "g"]).where("ra < rb").groupBy("paper_id", "sa", "sb").agg(F.sum(F.col("ca") * F.col("cb")).alias("times"))
    pairs = scratch.save(pairs)
    shared = pairs.join(_alike(pairs.select("sa", "sb").distinct(), ratio), ["sa", "sb"]).groupBy("paper_id").agg(F.sum("times").alias("shared_sentences"), F.round(F.max("ratio"), 3).alias("max_ratio"))
    first = rows.select("paper_id", "review_index", F.substring(F.col("parts")[0], 1, 100).alias("s"))
    both = first.select("paper_id", F.col("review_index").alias("ra"), F.col("s").alias("sa")).join(first.select("paper_id", F.col("review_index").alias("rb"), F.col("s").alias("sb")), "paper_id").where("ra < rb")
    both = scratch.save(both.groupBy("paper_id", "sa", "sb").agg(F.count("*").alias("times")))
    each = both.where("sa <> sb").select("sa", "sb").distinct().withColumn("r", F.round(sequence_match("sa", "sb", F.lit(10**6))["ratio"], 3))
    matched = both.join(each, ["sa", "sb"], "left").withColumn("r", F.when(F.col("sa") == F.col("sb"), F.lit(1.0)).otherwise(F.col("r")))
    average = matched.groupBy("paper_id").agg((F.sum(F.col("r") * F.col("times")) / F.sum("times")).alias("a"))
    papers = rows.groupBy("paper_id").agg(F.count("*").alias("reviews_compared")).where("reviews_compared >= 2")
    out = papers.join(shared, "paper_id", "left").join(average, "paper_id", "left").na.fill(0, ["shared_sentences"])
    return out.select("paper_id", "reviews_compared", "shared_sentences", "max_ratio", F.round("a", 3).alias("opening_similarity"), ((F.col("shared_sentences") > 3) | (F.col("a") > opening)).alias("flagged"))


def reviewer_emails(rows: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """(name, email): institutional, free or unknown provider; no class without an address. Free and unknown ones are suspicious.

    With `authors` (name, paper_count) the publication record is judged too: none found, or one of no papers, is suspicious.
    """
    email = F.lower(F.coalesce("email", F.lit("")))
    has = lambda marks: F.greatest(*[email.contains(m) for m in marks])
    kind = F.when(email == "", None).when(has(INSTITUTIONAL), "institutional").when(has(FREE_MAIL), "free_email").otherwise("unknown_domain")
    out = rows.withColumn("email_class", kind)
    flagged = F.coalesce(F.col("email_class").isin("free_email", "unknown_domain"), F.lit(False))
    if authors is None:
        return out.withColumn("flagged", flagged)
    record = authors.groupBy(F.lower("name").alias("_n")).agg(F.max("paper_count").alias("paper_count"))
    out = out.withColumn("_n", F.lower("name")).join(record, "_n", "left").drop("_n")
    return out.withColumn("flagged", flagged | (F.coalesce("paper_count", F.lit(0)) == 0))


def publication_rates(papers: DataFrame) -> DataFrame:
    """(author, year, ...): papers a year over the span, the busiest year, and the last three active years against the first three."""
    years = papers.where("year is not null").groupBy("author", "year").agg(F.count("*").alias("k"))
    w = Window.partitionBy("author")
    years = years.withColumns({"from_last": F.row_number().over(w.orderBy(F.desc("year"))), "from_first": F.row_number().over(w.orderBy("year"))})
    out = years.groupBy("author").agg(F.sum("k").alias("papers"), (F.max("year") - F.min("year") + 1).alias("span"), F.max("k").alias("max_in_year"), F.min_by("year", F.struct((-F.col("k")).alias("k"), "year")).alias("busiest_year"), F.sum(F.when(F.col("from_last") <= 3, F.col("k"))).alias("recent"), F.sum(F.when(F.col("from_first") <= 3, F.col("k"))).alias("early"), F.count("*").alias("active_years"))
    rate = F.col("papers") / F.col("span")
    burst = (F.col("active_years") >= 6) & (F.try_divide("recent", "early") > 5)
    return out.withColumns({"per_year": F.round(rate, 6), "burst": burst}).withColumn("flagged", (rate > 12) | (F.col("max_in_year") > 8) | F.col("burst"))


def salami(papers: DataFrame) -> DataFrame:
    """(author, paper_id, title, year, sample_size, design): pairs of an author's papers with two or more of four signals.

    Two signals need neighbouring years, equal sample sizes or titles alike. Papers meet on the first two, and on a title's
    words, of which five must be shared: on one of all but the four commonest, in one order for all.
    """
    rows = papers.select("author", "paper_id", "title", "year", "sample_size", "design", F.array_distinct(words(F.coalesce("title", F.lit("")))).alias("w"))
    ids = rows.select("author", "paper_id", "year", "sample_size")
    each = rows.select("author", "paper_id", F.explode("w").alias("t"))
    common = each.groupBy("t").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("author", "paper_id").orderBy(F.desc("df"), "t"))
    rare = each.join(common, "t").withColumn("_r", place).where("_r > 4").select("author", "paper_id", "t")

    def meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        pairs = left.select("author", F.col("paper_id").alias("paper_id_a"), key).join(right.select("author", F.col("paper_id").alias("paper_id_b"), key), ["author", key])
        return pairs.where("paper_id_a < paper_id_b").select("author", "paper_id_a", "paper_id_b")

    near = ids.where("year is not null").withColumn("year", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
    pairs = meet(near, ids, "year").unionByName(meet(ids, ids, "sample_size")).unionByName(meet(rare, rare, "t")).distinct()
    a, b = rows.select("author", *[F.col(c).alias(f"{c}_a") for c in rows.columns[1:]]), rows.select("author", *[F.col(c).alias(f"{c}_b") for c in rows.columns[1:]])
    both = pairs.join(a, ["author", "paper_id_a"]).join(b, ["author", "paper_id_b"])
    common_words = F.size(F.array_intersect("w_a", "w_b"))
    can = (common_words >= 5) & (F.size("w_a") - common_words <= 5) & (F.size("w_b") - common_words <= 5)
    both = both.withColumns({"t": sequence_match(F.lower("title_a"), F.lower("title_b"), F.lit(10**6))["ratio"], "d": sequence_match(F.lower("design_a"), F.lower("design_b"), F.lit(10**6))["ratio"]})
    signals = [(F.col("t") > 0.65) & can, F.col("sample_size_a") == F.col("sample_size_b"), (F.col("d") > 0.8) & (F.length("design_a") > 0), F.abs(F.col("year_a") - F.col("year_b")) <= 1]
    return both.withColumn("signals", sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))).where("signals >= 2").select("author", "paper_id_a", "paper_id_b", F.round("t", 6).alias("title_ratio"), "signals")
