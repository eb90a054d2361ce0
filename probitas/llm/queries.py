"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licenses, quality, sharding, simhash, tokens, toxicity, urls
from .common import id_mod, table

#: (verdict, host and path) of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), id_mod(F.col("doc_id"), 3)
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), part != 1)
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), id_mod(F.col("doc_id"), 4)
    model = langid.train(docs, part != 2, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs, model).select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the URLs of the pages whose id is divisible by 100."""
    pages = table(spark, sf_dir, "pages")
    return urls.url_filter(pages, pages.where("page_id % 100 = 0"), URL_RULES)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scans, op2_quality_rules, op3_token_files, op4_bpe, op5_toxicity, op6_language_id, op7_url_filters, op8_simhash_near_dedup, op9_decontamination, op10_sharding]
    return {f.__name__: f for f in found}


_REST = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
_RULES = "(values " + ", ".join(f"('{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}')" for verdict, rule in URL_RULES) + ") r(action, rule_host, rule_path, rule)"
OP7_SQL = f"""
with cut as (select page_id, url, coalesce({_REST}, '') as rest from pages),
split as (select page_id, url, regexp_extract(rest, '^[^/?#]*') as raw, rest from cut),
parts as (select page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from split),
keyed as (select page_id, host, path, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&'),
    lambda p: not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)') and p <> '')) as kept from parts),
canon as (select page_id, host, path, case when host <> '' then regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
    || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canon from keyed),
listed as (select distinct canon from canon where page_id % 100 = 0 and canon is not null),
numbered as (select *, row_number() over () as n from canon),
ruled as (select n, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action from numbered, {_RULES}
    where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by n)
select page_id, host, path, rule, coalesce(action, case when l.canon is not null then 'block' else 'allow' end) as verdict,
    case when rule is null then l.canon is not null end as listed
from numbered left join ruled using (n) left join listed l on numbered.canon = l.canon
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL}
