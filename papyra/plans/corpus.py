"""Queries of corpus profiling, slicing and sidecars over the editions view."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from papyra.functions import stats
from papyra.functions.dates import date_ordinal, end_ordinal
from papyra.operators import profile, sidecar, slicing

from .surrogate import EDITIONS, docs, duck, editions, frame, table, views

DATES = ("1994-06-01", "1996-06-01", "1998-06-01")
POINTS = [0.1, 0.5, 0.9, 0.99]
SEED, ACTS = 7, 50
E = views(editions=EDITIONS)

NODE = "struct<level:int,label:string,char_start:bigint,char_end:bigint,parent:int,pos:int>"


def line_outline(text: pa.Array) -> pa.Array:
    """An outline of a text, inside its row: one node a line, three levels in turn."""
    sizes = [np.fromiter(map(len, x.as_py().split("\n")), np.int64) if x.is_valid else None for x in text]
    counts = np.array([0 if x is None else len(x) for x in sizes], np.int64)
    offsets = np.concatenate([[0], counts.cumsum()])
    pos = (np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)).astype(np.int32)
    start = pa.array(np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x + 1) - x - 1 for x in sizes if x is not None)]))
    label = pc.binary_join_element_wise("L", pc.cast(pa.array(pos), pa.string()), "")
    nodes = [pa.array(1 + pos % 3), label, start, start, pa.array(pos - 1, mask=pos % 3 == 0), pa.array(pos)]
    names = ["level", "label", "char_start", "char_end", "parent", "pos"]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(nodes, names), mask=pa.array([x is None for x in sizes]))


def contents(spark, sf):
    """documents that have a text, with contents array<struct<level,label,char_start,char_end,parent>>."""
    return docs(spark, sf).where("text is not null").select("doc_id", "act_id", "title", "text", F.arrow_udf(line_outline, f"array<{NODE}>")("text").alias("contents"))


def _account(spark, sf):
    e = editions(spark, sf)
    left = slicing.exclude_stubs(e)
    small = slicing.capped(left, 2_000_000)
    stubs = e.where("is_stub")
    return slicing.account([("stubs", stubs), ("acts with stubs", e.join(left.select("doc_id"), "doc_id", "left_anti")), ("over cap", left.join(small.select("doc_id"), "doc_id", "left_anti")), ("kept", small)], e)


def _with_lines(spark, sf):
    e = editions(spark, sf)
    return e.select("shard", "doc_id", F.col("doc_id").alias("line_no"), (F.col("chars") % 1000 + 1).alias("length"))


def _verify(spark, sf):
    lines = sidecar.running_offsets(_with_lines(spark, sf))
    broken = lines.withColumn("offset", F.when(F.col("doc_id") % 500 == 1, F.col("offset") + 1).otherwise(F.col("offset")))
    return sidecar.verify(broken).groupBy("rule").agg(F.count("*").alias("n"))


def _slice(spark, sf):
    e = editions(spark, sf)
    return e.join(slicing.sample_acts(slicing.exclude_stubs(e), ACTS, SEED), "act_id", "left_semi")


QUERIES = {
    "quantiles_nearest_rank": lambda s, d: stats.quantiles(editions(s, d), "chars", POINTS),
    "pct": lambda s, d: editions(s, d).groupBy("status").agg(F.count("*").alias("n"), stats.pct(F.count_if("is_current"), F.count("*")).alias("current_pct")),
    "inventory_totals": lambda s, d: profile.totals(editions(s, d)),
    "field_presence": lambda s, d: profile.presence(editions(s, d), ["begin_date", "end_date", "end_sentinel", "status", "text_hash"]),
    "json_field_presence": lambda s, d: profile.json_presence(table(s, d, "events").where("props is not null"), "props"),
    "freq_topk": lambda s, d: profile.frequencies(editions(s, d), "doc_type", 3),
    "edition_chains": lambda s, d: profile.chains(editions(s, d)),
    "dup_by_hash": lambda s, d: profile.duplicates(editions(s, d)),
    "pit_readings": lambda s, d: profile.pit_readings(editions(s, d), DATES),
    "pit_by_act": lambda s, d: profile.pit_by_act(editions(s, d), DATES),
    "toc_stats": lambda s, d: profile.toc_stats(contents(s, d)),
    "toc_label_words": lambda s, d: profile.label_words(contents(s, d)),
    "slice_exclude_stubs": lambda s, d: slicing.exclude_stubs(editions(s, d)).select("act_id", "doc_id"),
    "slice_accounting": _account,
    "cap_preview": lambda s, d: slicing.cap_preview(editions(s, d)),
    "sample_acts": lambda s, d: slicing.sample_acts(editions(s, d), ACTS, SEED),
    "slice_flags": lambda s, d: slicing.flags(_slice(s, d)),
    "peek_doc_id": lambda s, d: slicing.peek_doc_id(editions(s, d).select(F.to_json(F.struct("act_id", "doc_id", "status")).alias("line"))).select("doc_id"),
    "slice_verify": lambda s, d: slicing.verify(_slice(s, d), editions(s, d)),
    "mass_profile": lambda s, d: slicing.mass_profile(editions(s, d)),
    "scan_running_offset": lambda s, d: sidecar.running_offsets(_with_lines(s, d)).select("shard", "doc_id", "offset"),
    "sidecar_lookup": lambda s, d: sidecar.lookup(editions(s, d).select("doc_id", "shard", "chars"), table(s, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("doc_id"))),
    "sidecar_verify": _verify,
    "date_ordinals": lambda s, d: editions(s, d).select("doc_id", date_ordinal(F.col("begin_date")).alias("begin_ord"), end_ordinal(F.col("end_date"), F.col("end_sentinel")).alias("end_ord")),
}

_IN = "(status = 'in force')"
_B = "coalesce(begin_date <= d, false)"
_S = "coalesce(coalesce(begin_date, date) <= d, false)"
_X = "(coalesce(end_sentinel = 'indefinite', false) or coalesce(end_date >= d, false))"
_L = f"({_X} or coalesce(end_sentinel = 'null', false) or end_date is null)"
_DATES = ", ".join(f"('{x}')" for x in DATES)
_PCT = "coalesce(round(100.0::double * ({0}) / nullif({1}, 0), {2}), 0)::double"
_SAMPLE = f"select act_id from (select distinct act_id from editions) order by md5(concat('{SEED}:', act_id::varchar)), act_id limit {ACTS}"
_CLEAN = "select * from editions where act_id not in (select act_id from editions where is_stub)"
_SLICED = f"kept as ({_CLEAN}), picked as (select act_id from (select distinct act_id from kept) order by md5(concat('{SEED}:', act_id::varchar)), act_id limit {ACTS}), slice as (select * from editions where act_id in (select act_id from picked))"
_NODES = "nodes as (select doc_id, unnest(range(len(x))) as pos, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents))"
_LENGTHS = "lines as (select shard, doc_id, (chars % 1000 + 1)::bigint as length, sum(chars % 1000 + 1) over (partition by shard order by doc_id) as upto from editions)"

ORACLE_SQL = {
    "quantiles_nearest_rank": f"{E}, s as (select chars, row_number() over (order by chars) - 1 as k, count(*) over () as n from editions) select p::double as point, chars::bigint as value from s join (values {', '.join(f'({p})' for p in POINTS)}) q(p) on k = least(n - 1, floor(p::double * n)::bigint)",
    "pct": f"{E} select status, count(*) as n, {_PCT.format('count(*) filter (is_current)', 'count(*)', 2)} as current_pct from editions group by 1",
    "inventory_totals": f"{E} select count(*) as records, count(*) filter (is_stub) as stubs, sum(chars)::bigint as chars, count(*) filter (is_current) as current_records, sum(chars) filter (is_current)::bigint as current_chars, {_PCT.format('count(*) filter (is_current)', 'count(*)', 2)} as current_records_pct, {_PCT.format('sum(chars) filter (is_current)', 'sum(chars)', 2)} as current_chars_pct from editions",
    "field_presence": f"{E}, f as (" + " union all ".join(f"select '{c}' as field, count(nullif({c}, '')) as filled, count(*) as n from editions" for c in ["begin_date", "end_date", "end_sentinel", "status", "text_hash"]) + f") select field, filled, {_PCT.format('filled', 'n', 2)} as filled_pct from f",
    "json_field_presence": "with k as (select props, unnest(json_keys(props)) as field from events where props is not null) select field, count(*) as present, count(*) filter (json_type(props, '$.' || field) <> 'NULL' and coalesce(json_extract_string(props, '$.' || field), '') not in ('', '[]')) as filled from k group by 1",
    "freq_topk": f"{E} select doc_type as value, count(*) as n from editions group by 1 order by n desc, value nulls first limit 3",
    "edition_chains": f"{E}, a as (select act_id, count(*) as n, count(*) filter (is_current) as cur, arg_max(is_current, doc_id) as lc, max(idx) filter (is_current) as ci, arg_min(n_editions, doc_id) as decl, count(distinct shard) as sh from editions group by 1) select count(*) as acts, count(*) filter (n > 1) as multi_acts, coalesce(sum(n) filter (n > 1), 0)::bigint as records_in_multi, count(*) filter (cur <> 1) as not_one_current, count(*) filter (not lc) as last_not_current, count(*) filter (ci <> n - 1) as current_not_last_index, count(*) filter (decl <> n) as declared_differs, count(*) filter (n > 1 and sh > 1) as split_over_shards, max(n) as longest from a",
    "dup_by_hash": f"{E} select count(*) - count(distinct coalesce(text_hash, 'none')) as duplicates from editions",
    "pit_readings": f"{E} select d as as_of, count(*) filter ({_IN} and {_B} and {_X}) as a_strict, count(*) filter ({_IN} and {_B} and {_X} and is_current) as a_and_current, count(*) filter ({_IN} and {_S} and {_X}) as b_date_substituted, count(*) filter ({_IN} and {_B} and {_L}) as c_loose_end, count(*) filter ({_B} and {_L}) as d_no_status, count(*) filter ({_B} and {_X}) as e_any_edition, count(*) filter ({_IN}) as status_only from editions, (values {_DATES}) x(d) group by 1",
    "pit_by_act": f"{E}, r as (select d, 'A' as reading, act_id from editions, (values {_DATES}) x(d) where {_IN} and {_B} and {_X} union all select d, 'E', act_id from editions, (values {_DATES}) x(d) where {_B} and {_X}), c as (select d, reading, act_id, count(*) as in_force from r group by 1, 2, 3) select d as as_of, reading, in_force, count(*) as acts from c group by 1, 2, 3",
    "toc_stats": f"with {_NODES}, g as (select doc_id, count(*) as n, count(*) filter (pos % 3 = 0) as roots from nodes group by 1) select count(*) as documents, sum(n)::bigint as nodes, sum(n)::bigint as zero_span, count(*) filter (roots > 1) as multi_root, 0::bigint as control_labels from g",
    "toc_label_words": f"with {_NODES} select lower('L' || pos) as value, count(*) as n from nodes group by 1 order by n desc, value limit 15",
    "slice_exclude_stubs": f"{E} select act_id, doc_id from ({_CLEAN})",
    "slice_accounting": f"{E}, kept as ({_CLEAN}), big as (select act_id from kept group by 1 having sum(chars) > 2000000), s as (select 0 as nr, 'stubs' as step, count(*) as docs, coalesce(sum(chars), 0) as chars from editions where is_stub union all select 1, 'acts with stubs', count(*), coalesce(sum(chars), 0) from editions where act_id in (select act_id from editions where is_stub) union all select 2, 'over cap', count(*), coalesce(sum(chars), 0) from kept where act_id in (select act_id from big) union all select 3, 'kept', count(*), coalesce(sum(chars), 0) from kept where act_id not in (select act_id from big)), t as (select count(*) as n, sum(chars) as c from editions) select nr::int as nr, step, docs::bigint as docs, {_PCT.format('docs', 'n', 3)} as docs_pct, chars::bigint as chars, {_PCT.format('chars', 'c', 3)} as chars_pct from s, t",
    "cap_preview": f"{E}, a as (select act_id, sum(chars) as c from editions group by 1) select cap::bigint as cap, count(*) filter (c > cap) as acts, {_PCT.format('count(*) filter (c > cap)', 'count(*)', 2)} as acts_pct, {_PCT.format('coalesce(sum(c) filter (c > cap), 0)', 'sum(c)', 2)} as chars_pct from a, (values (500000), (2000000), (8000000)) x(cap) group by 1",
    "sample_acts": f"{E} {_SAMPLE}",
    "slice_flags": f"{E}, {_SLICED} select doc_id, act_id, (is_stub::int + 2 * has_contents::int + 4 * is_current::int) as flags, ('0x' || text_hash)::ubigint::decimal(20, 0) as hash from slice",
    "peek_doc_id": f"{E} select doc_id from editions",
    "slice_verify": f"{E}, {_SLICED}, g as (select act_id, count(*) as n, count(*) filter (is_current) as cur, max(n_editions) as whole from slice group by 1) select count(*) as acts, count(*) filter (cur = 1) as one_current, count(*) filter (n = whole) as complete, count(*) filter (n <> whole) as truncated from g",
    "mass_profile": f"{E}, a as (select act_id, sum(chars)::bigint as c from editions group by 1), r as (select c, row_number() over (order by c desc, act_id) as k from a) select count(*) as acts, max(c) as largest, round(avg(c), 2) as mean, "
    + ", ".join(f"{_PCT.format(f'sum(c) filter (k <= {k})', 'sum(c)', 2)} as top{k}_pct" for k in (1, 8)) + ", " + ", ".join(f"{_PCT.format(f'coalesce(sum(c) filter (c <= {m}), 0)', 'sum(c)', 2)} as upto{m}_pct" for m in (200_000, 500_000, 1_000_000)) + " from r",
    "scan_running_offset": f"{E}, {_LENGTHS} select shard, doc_id, (upto - length)::bigint as offset from lines",
    "sidecar_lookup": f"{E} select doc_id, shard, chars from editions where doc_id in (select l_orderkey from lineitem where l_quantity = 50)",
    "sidecar_verify": f"{E}, {_LENGTHS}, o as (select *, (upto - length + (doc_id % 500 = 1)::int)::bigint as ofs from lines), x as (select *, row_number() over w as nr, lead(ofs) over w as nxt from o window w as (partition by shard order by doc_id)) select rule, count(*) as n from (select 'start' as rule from x where nr = 1 and ofs <> 0 union all select 'contiguity' from x where nxt is not null and ofs + length <> nxt) group by 1",
    "date_ordinals": f"{E} select doc_id, replace(begin_date, '-', '')::int as begin_ord, case when end_sentinel = 'indefinite' then 99999999 else replace(end_date, '-', '')::int end as end_ord from editions",
}
