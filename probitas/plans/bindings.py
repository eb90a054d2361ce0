"""Driver tables as the library's inputs. Each is SQL that Spark and DuckDB both run; {name} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Series of event values by user, all of them, with derived series beside them: reversed, rescaled, one value
#: changed, constant, copied, near-arithmetic, a part, and shifted by whole numbers.
CELLS = """
with base as (select user_id as ds, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as pos, value from {events} where value is not null),
sized as (select ds, cast(count(*) as int) as n from base group by ds),
b as (select base.ds, pos, value, n from base join sized on base.ds = sized.ds)
select ds, pos, value, {fixed}(value) as raw from (
  select ds, pos, value from b
  union all select ds + 1000000, n - 1 - pos, value from b where ds % 3 = 0
  union all select ds + 2000000, pos, 2 * value + 3 from b where ds % 3 = 0
  union all select ds + 3000000, pos, case when pos = n - 1 then value + 1 else value end from b where ds % 3 = 1
  union all select ds + 4000000, pos, cast(1.23 as double) from b where ds % 7 = 0
  union all select ds + 5000000, pos, value from b where ds % 3 = 1
  union all select ds + 6000000, pos, 10 + pos + 0.01e0 * (pos % 2) from b where ds % 7 = 0
  union all select ds + 7000000, pos, value from b where ds % 3 = 2 and pos < n / 2
  union all select ds + 8000000, pos, value + 100 * (1 + pos % 3) from b where ds % 3 = 2
) planted
"""
#: Short series of line numbers, which repeat.
LINES = """select ds, cast(row_number() over (partition by ds order by l_orderkey, l_linenumber) - 1 as int) as pos, value, {fixed}(value) as raw
from (select l_suppkey * 100 + l_partkey % 50 as ds, l_orderkey, l_linenumber, l_linenumber + 0e0 as value from {lineitem}) l"""
#: Numbers of three decimals by supplier and line; every third supplier's decimals are often 137, every fifth has a copy with
#: other whole parts and one with a value changed.
THOUSANDTHS = """
with l as (select l_suppkey * 10 + l_linenumber as ds, cast(row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey) - 1 as int) as pos, l_linenumber as whole, cast(case when l_suppkey % 3 = 0 and l_orderkey % 4 = 0 then 137 else (l_orderkey * 7919 + l_partkey) % 1000 end as int) as d from {lineitem}),
p as (select ds, pos, whole, d from l union all select ds + 1000000, pos, whole + pos % 3, d from l where ds % 5 = 0 union all select ds + 2000000, pos, whole, case when pos = 1 then (d + 500) % 1000 else d end from l where ds % 5 = 1)
select ds, pos, whole + d / 1000e0 as value, concat(cast(whole as string), '.', lpad(cast(d as string), 3, '0')) as raw from p
"""
#: Two-decimal rates of order lines by supplier.
RATES = "select l_suppkey as ds, cast(l_linenumber as int) as pos, {column} as value, {fixed}({column}) as raw from {lineitem}"


def frame(spark: SparkSession, sf_dir: str, sql: str, ties: str = "", **names: str) -> DataFrame:
    """The binding in Spark, over the Parquet tables that it names.

    ties: sort keys that leave ties; Spark takes these in file order, as executors hand rows over in any order and each
    branch of a binding reads its tables again. DuckDB's text is without it.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if ties:
        tables = {t: rows.select("*", "_metadata.file_path", "_metadata.row_index") for t, rows in tables.items()}
        sql = sql.replace(ties, f"{ties}, file_path, row_index")
    return spark.sql(text(sql, "format_string('%.2f', ", names), **tables)


def duck(sql: str, **names: str) -> str:
    """The binding in DuckDB."""
    return text(sql, "printf('%.2f', ", names).format(**{t: t for t in TABLES})


def text(sql: str, fixed: str, names: dict[str, str]) -> str:
    sql = sql.replace("{fixed}(", fixed)
    for name, value in names.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Customers as papers; each cites three others, and its neighbour back now and then.
EDGES = """
select distinct src, dst from (
  select c_custkey as src, 1 + (c_custkey * 7 + 3) % (select count(*) from {customer}) as dst from {customer}
  union all select c_custkey, 1 + (c_custkey * 11 + c_nationkey) % (select count(*) from {customer}) from {customer}
  union all select c_custkey, c_custkey + 1 from {customer} where c_custkey % 5 <> 0
  union all select c_custkey + 1, c_custkey from {customer} where c_custkey % 5 = 1
) e where src <> dst
"""
PAPERS = "select c_custkey as paper_id from {customer}"
#: A p value a line, by supplier; a mean and a size by supplier; test statistics.
P_VALUES = "select l_suppkey as group_id, l_tax as value from {lineitem}"
PRICES = "select l_suppkey as group_id, l_extendedprice as value from {lineitem}"
MEANS = "select l_suppkey as group_id, l_partkey % 50 as pair_index, round(avg(l_quantity), 2) + case when l_partkey % 50 = 7 then 0.003e0 else 0e0 end as mean, cast(count(*) as int) as n from {lineitem} group by l_suppkey, l_partkey % 50"
SPREADS = "select l_suppkey as group_id, l_linenumber as idx, avg(l_quantity) as mean, stddev_samp(l_quantity) / case when l_linenumber = 1 then 50 else 1 end as sd from {lineitem} group by l_suppkey, l_linenumber"
WORKS = "select o_custkey as author, cast(year(o_orderdate) as int) as year from {orders}"
