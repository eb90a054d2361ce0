"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs with an exact hash join.

Everything here is DataFrame expressions. A rule decides where one fits (the longest wins). Where none fits, the
canonical URL is looked up in a list: a blocked Bloom filter (one 512-bit block a key, one bit in each of its eight
64-bit lanes) lets possible hits through, and a hash join on the canonical URL itself removes the false positives.

The filter is always broadcast: it has at most BROADCAST_BLOCKS blocks, so a very long list makes it denser and lets more
false hits through, which the join removes. A list of up to BROADCAST_KEYS entries is broadcast too. Beyond that only the
possible hits are dealt by URL, those of a hot one over SALTS tasks, and all other rows stay where they are.

Cases: a null URL, or one without ``://``, has an empty host and path, no canonical URL, and is allowed. Repeated
rows are judged each. An empty list blocks nothing. Columns other than the id and the URL are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Query parameters that say where a visitor came from, not which page this is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: The list is broadcast up to so many entries; the filter has up to so many blocks (72 bytes each).
BROADCAST_KEYS, BROADCAST_BLOCKS = 200_000, 1 << 18
#: Copies of the list that a hot URL's rows are dealt over when the list is not broadcast.
SALTS = 16
LANES, BITS_PER_KEY = 8, 16


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, sorted query without tracking parameters; null without a host."""
    host, path = host_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING) & (p != "")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""), tail)
    return F.when(host != "", whole)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule (verdict, ``host/path``) fits its host and subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0] == "block")):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter: rows (block, w0..w7), for the blocks that hold a key."""
    bits = [b.alias(f"b{i}") for i, b in enumerate(_bits(F.col(key)))]
    return keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *bits).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(LANES)])


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict, listed (null where a rule decided). `listed` has the listed URLs."""
    keys = save(listed.select(canonical(F.col(list_col)).alias("listed_key")).where("listed_key is not null").distinct(), "listed")
    n = keys.count()
    blocks = min(BROADCAST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n) * BITS_PER_KEY / (64 * LANES)))))
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical(F.col(url_col)).alias("_key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict}).withColumn("_key", F.when(F.col("rule").isNull(), F.col("_key")))
    filt = bloom(keys, "listed_key", blocks).withColumnRenamed("block", "_block")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks))).join(F.broadcast(filt), "_block", "left")
    possible = F.lit(True)
    for i, bit in enumerate(_bits(F.col("_key"))):
        possible = possible & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(bit) != 0)
    possible = F.col("_key").isNotNull() & possible
    rows = rows.withColumn("_hit", F.when(possible, F.col("_key"))).drop("_block", "_key", *[f"w{i}" for i in range(LANES)])
    if n <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(keys), F.col("_hit") == F.col("listed_key"), "left")
    else:
        salted = keys.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = rows.where("_hit is not null").withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
        hits = hits.join(salted, (F.col("_hit") == F.col("listed_key")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s")
        rows = hits.unionByName(rows.where("_hit is null").withColumn("listed_key", F.lit(None).cast("string")))
    found = F.col("listed_key").isNotNull()
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(found, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), found).alias("listed"),
    )
