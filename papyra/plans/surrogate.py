"""Views in the data model's shape over the star-schema tables, as SQL that both engines read.

Table names stand in braces; `duck` and `frame` fill them in for one engine or the other.
"""

import re

from pyspark.sql import DataFrame, SparkSession

#: Editions of acts: a customer's orders in time, each in force until the day before the next.
EDITIONS = """
select act_id, doc_id, cast(rn - 1 as int) as idx, cast(n as int) as n_editions, rn = n as is_current, cast(d as string) as date,
  case when rn = 1 and pr = '5-LOW' then null else cast(d as string) end as begin_date,
  case when nd is not null then cast(cast(nd - interval '1' day as date) as string) end as end_date,
  case when nd is null then case when st = 'P' then 'null' else 'indefinite' end end as end_sentinel,
  case when st = 'F' then 'repealed' else 'in force' end as status, pr as doc_type, cast(floor(price) as bigint) as chars,
  mod(doc_id, 97) = 0 as is_stub, mod(doc_id, 3) = 0 as has_contents, cast(mod(doc_id, 28) as int) as shard,
  substr(md5(cast(mod(act_id * 7 + rn, 5000) as string)), 1, 16) as text_hash
from (
  select o_custkey as act_id, o_orderkey as doc_id, cast(o_orderdate as date) as d, o_orderstatus as st, o_orderpriority as pr, o_totalprice as price,
    row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn, count(*) over (partition by o_custkey) as n,
    lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) as nd
  from {orders}
) e
"""

#: Documents as four editions an act, each in force for one year, the last one open.
DOCS = """
select doc_id, cast(floor(doc_id / 4) as bigint) as act_id, cast(mod(doc_id, 4) as int) as edition, mod(doc_id, 4) = 3 as is_current,
  concat(source, ' ', lang) as title, text,
  concat(cast(2010 + mod(doc_id, 4) as string), '-01-01') as begin_date,
  case when mod(doc_id, 4) < 3 then concat(cast(2010 + mod(doc_id, 4) as string), '-12-31') end as end_date,
  case when mod(doc_id, 4) = 3 then 'indefinite' end as end_sentinel,
  cast(20100101 + 10000 * mod(doc_id, 4) as int) as begin_ord,
  cast(case when mod(doc_id, 4) = 3 then 99999999 else 20101231 + 10000 * mod(doc_id, 4) end as int) as end_ord
from {documents}
"""

#: Queries: benchmark passages; every third asks as of a date.
BASKET = """
select item_id as query_id, text as query, cast(case when mod(item_id, 3) = 1 then 20110601 when mod(item_id, 3) = 2 then 20200101 end as int) as as_of,
  case mod(item_id, 3) when 0 then 'plain' when 1 then 'temporal' else 'recent' end as type
from {benchmark}
"""

_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables named in braces."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(_TABLE.findall(sql))})


def duck(sql: str) -> str:
    """The same text for DuckDB, where tables are views of their own name."""
    return _TABLE.sub(r"\1", sql)


def views(**named: str) -> str:
    """A WITH clause."""
    return "with " + ", ".join(f"{k} as ({duck(v)})" for k, v in named.items())


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, EDITIONS)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, DOCS)


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, BASKET)
