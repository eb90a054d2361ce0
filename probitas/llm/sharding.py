"""Sharding by histogram sort: byte counts below candidate key boundaries are refined until every splitter is exact.

Rows are ordered by (digest of the text, doc_id, ordinal), written as one hexadecimal key, so equal texts are neighbours;
the ordinal, which is given when the keys are written down, tells repeated rows apart. Each round counts bytes and rows
between candidate boundaries (key prefixes) over all partitions. A prefix that holds a splitter, or more rows than one
task should sort, is refined by further hexadecimal digits past the common prefix of its keys; the others stand. Then the
rows are exchanged once, by prefix, and numbered within it.

The law is that shards hold near-equal bytes: a row belongs to the shard in which the middle of its bytes falls. Equal
texts are a group. A group of at most 1 / WHOLE of a shard's fair part of the bytes goes as a whole to the shard in which
the middle of the group's bytes falls, so a shard differs from the fair part by half a group and half a row at either
end at most; a larger group, which the law doesn't let one shard hold, is cut between its rows.

Cases: a null text counts as empty, a null doc_id sorts before all ids of its text; repeated rows have a slot each;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

#: Digits of the first round (4096 candidates) and of each refinement of a prefix (256 candidates).
FIRST, MORE = 3, 2
#: Digits of a text's digest; a group of equal texts up to this part of a shard is not cut.
DIGEST, WHOLE = 16, 20


def sized_keys(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, key of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    ordinal = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.concat(F.substring(F.md5(text), 1, DIGEST), F.coalesce(F.concat(F.lit("1"), ident), F.lpad(F.lit(""), 17, "0")), ordinal).alias("key"),
    )


def _inline(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table of driver-made rows, as a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot. Shards hold near-equal bytes; slots are gapless from 0."""
    spark = docs.sparkSession
    rows = save(sized_keys(docs, overhead), "shard-keys")
    placed = rows.withColumn("bucket", F.substring("key", 1, FIRST))
    buckets = _histogram(placed)
    total, n = sum(b["bytes"] for b in buckets), sum(b["rows"] for b in buckets)
    heavy = max(1024, n // 512)
    while True:
        below, refine, group = 0, {}, Counter()
        for b in buckets:
            group[b["low"][:DIGEST]] += b["bytes"] * (b["low"][:DIGEST] == b["high"][:DIGEST])
        for b in buckets:
            first, last = below * shards // total, (below + b["bytes"]) * shards // total
            common = len(os.path.commonprefix([b["low"], b["high"]]))
            whole = common >= DIGEST and group[b["low"][:DIGEST]] * shards * WHOLE <= total
            if b["low"] != b["high"] and (b["rows"] > heavy or first != last and not whole):
                # a group is first told from others, and taken apart only if it is too large
                refine[b["bucket"]] = min(DIGEST, common + MORE) if common < DIGEST else common + MORE
            below += b["bytes"]
        if not refine:
            break
        steps = F.broadcast(_inline(spark, [{"bucket": k, "digits": v} for k, v in refine.items()], "bucket:string,digits:int"))
        placed = placed.join(steps, "bucket", "left")
        inner = placed.where("digits is not null").withColumn("bucket", F.expr("substring(key, 1, digits)")).drop("digits")
        buckets = sorted([b for b in buckets if b["bucket"] not in refine] + _histogram(inner), key=lambda b: b["low"])
        placed = placed.withColumn("bucket", F.expr("if(digits is null, bucket, substring(key, 1, digits))")).drop("digits")
    below, filled, plan = 0, [0] * shards, []
    for _, own in groupby(buckets, lambda b: b["low"][:DIGEST] if b["low"][:DIGEST] == b["high"][:DIGEST] else b["low"]):
        parts = list(own)  # of one group, or one bucket of several
        size = sum(b["bytes"] for b in parts)
        whole = size * shards * WHOLE <= total
        middle = 2 * below + size
        for b in parts:
            shard = min(shards - 1, (middle if whole else 2 * below + b["bytes"]) * shards // (2 * total))
            plan.append({"bucket": b["bucket"], "shard": shard, "start": filled[shard]})
            filled[shard] += b["rows"]
            below += b["bytes"]
    plan = F.broadcast(_inline(spark, plan, "bucket:string,shard:int,start:bigint"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    return placed.withColumn("place", place).join(plan, "bucket").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))


def _histogram(placed: DataFrame) -> list[dict]:
    """Exact bytes and rows of each candidate interval, in key order; at most 4096, or 256 for each refined prefix."""
    found = placed.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    return sorted((r.asDict() for r in found.collect()), key=lambda b: b["low"])
