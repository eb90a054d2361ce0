"""Offline forms of the literature connectors: searches and lookups over tables of works that were fetched elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch


def search(works: DataFrame, queries: DataFrame, most: int = 10, kinds: Sequence[str] | None = None, years: tuple[int | None, int | None] = (None, None), fields: Sequence[str] | None = None, subsets_to: int = 8) -> DataFrame:
    """(query_id, query) over (work_id, title, year, kind, field): the `most` works with most of the query's words in their title.

    Equal ones come by year, the latest first, then by id. Words are runs of letters and digits, lower-cased; works and
    queries meet on them, so a work without any is not found. Kinds, years (first, last) and fields filter the works.

    Works of one set of words are ranked among themselves first, and queries of one set are answered once. Of every set of
    words, the best `most` works that have it all are listed: a work that a query finds is listed under the words that both
    have, or else so many better ones are. Hence queries read the lists of their subsets; titles or queries of more than
    `subsets_to` words that the other side has (so 2 ** subsets_to sets) meet on single words instead. work_id and query_id are keys.
    """
    kept = works
    if kinds is not None:
        kept = kept.where(F.col("kind").isin(*kinds))
    if years[0] is not None:
        kept = kept.where(F.col("year") >= years[0])
    if years[1] is not None:
        kept = kept.where(F.col("year") <= years[1])
    if fields is not None:
        kept = kept.where(F.col("field").isin(*fields))
    texts = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0))
    best = (F.desc_nulls_last("year"), "work_id")
    had = kept.select("work_id", "year", F.explode(texts("title")).alias("w"))
    asked = queries.select("query_id", F.explode(texts("query")).alias("w"))
    had, asked = had.join(asked.select("w").distinct(), "w", "left_semi"), asked.join(had.select("w").distinct(), "w", "left_semi")
    titles = had.groupBy("work_id", "year").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    titles = titles.withColumn("_r", F.row_number().over(Window.partitionBy("ws").orderBy(*best))).where(F.col("_r") <= most).drop("_r")
    titles = scratch.save(titles)
    whose = scratch.save(asked.groupBy("query_id").agg(F.array_sort(F.collect_list("w")).alias("qs")))
    sets = whose.select("qs").distinct()
    short = lambda c: F.size(c) <= subsets_to

    def subsets(c: str):
        every = f"transform(sequence(1, shiftleft(1, size({c})) - 1), m -> filter({c}, (w, i) -> (shiftright(m, i) & 1) = 1))"
        return F.explode(F.expr(f"transform({every}, s -> struct(array_join(s, ' ') as k, size(s) as hits))"))

    lists = titles.where(short("ws")).select("work_id", "year", subsets("ws").alias("s")).select("work_id", "year", "s.k")
    lists = lists.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(*best))).where(F.col("_r") <= most).drop("_r")
    met = sets.where(short("qs")).select("qs", subsets("qs").alias("s")).select("qs", "s.k", "s.hits").join(lists, "k").select("qs", "work_id", "year", "hits")

    def direct(q: DataFrame, t: DataFrame) -> DataFrame:
        return q.select("qs", F.explode("qs").alias("w")).join(t.select("work_id", "year", F.explode("ws").alias("w")), "w").groupBy("qs", "work_id", "year").agg(F.count("*").cast("int").alias("hits"))

    found = met.unionByName(direct(sets.where(~short("qs")), titles)).unionByName(direct(sets.where(short("qs")), titles.where(~short("ws"))))
    found = found.groupBy("qs", "work_id", "year").agg(F.max("hits").cast("long").alias("hits"))
    place = F.row_number().over(Window.partitionBy("qs").orderBy(F.desc("hits"), *best))
    found = found.withColumn("place", place).where(F.col("place") <= most)
    return whose.join(found, "qs").join(kept.select("work_id", "title"), "work_id").select("query_id", "place", "work_id", "title", "year", "hits")


def lookup(ids: DataFrame, first: DataFrame, second: DataFrame, key: str = "doi") -> DataFrame:
    """ids (key) with what `first` says of them, enriched by `second`: where both have a column, the second's value wins if it has one.

    Keys are compared without case; of repeated keys the least row counts. Unknown keys have `found` false.
    """
    k = F.lower(F.col(key))

    def once(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(k.alias("_k")).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias(name))

    out = ids.select(F.col(key), k.alias("_k")).join(once(first, "_a"), "_k", "left").join(once(second, "_b"), "_k", "left")
    a, b = [c for c in first.columns if c != key], [c for c in second.columns if c != key]
    columns = [F.coalesce(*[F.col(f"{side}.{c}") for side, own in (("_b", b), ("_a", a)) if c in own]).alias(c) for c in dict.fromkeys([*a, *b])]
    return out.select(key, *columns, (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("found"))
