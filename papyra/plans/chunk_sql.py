"""Chunking in DuckDB SQL: what holds the chunker to its definition, rule by rule."""

from papyra.operators.chunking import ChunkConfig

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def chunks(cfg: ChunkConfig = ChunkConfig()) -> str:
    """CTEs up to `chunks`, over docs and segs(doc_id, sk, a, b, crumb, merged, has_structure).

    A segment over the maximum falls into paragraphs; one of these over the maximum into sentences; one of these
    into windows. Pieces between two that are too long are packed greedily, by a recursion over all of them.
    """
    big = f"> {cfg.maximum}"
    sentence = r"regexp_replace(line, '([.!?;])([ \t\r\x0b\x0c]+)', '\1' || chr(1) || '\2', 'g')"
    return f"""
lines as (
  select doc_id, sk, a, unnest(range(len(x)))::int as pk, unnest(x) as line
  from (select g.*, string_split(substr(d.text, a::int + 1, (b - a)::int), chr(10)) as x from segs g join docs d using (doc_id) where b - a {big} and merged = 1)
), para as (
  select *, s + length(line) as e, length(line) {big} as large, count(*) filter (length(line) {big}) over (partition by doc_id, sk order by pk) as before
  from (select *, a + sum(length(line) + 1) over (partition by doc_id, sk order by pk) - length(line) - 1 as s from lines) where line <> ''
), part as (
  select doc_id, sk, pk, s, unnest(range(len(x)))::int as j, unnest(x) as t from (select *, string_split({sentence}, chr(1)) as x from para where large)
), sent as (
  select *, e - s {big} as large, count(*) filter (e - s {big}) over (partition by doc_id, sk, pk order by j) as before
  from (select doc_id, sk, pk, j, u - length(t) + case when j > 0 then length(t) - length(ltrim(t, {SPACE})) else 0 end as s, u as e from (select *, s + sum(length(t)) over (partition by doc_id, sk, pk order by j) as u from part)) where e > s
), piece as (
  select doc_id, sk, pk, 0 as j, 0 as w, s, e, 'p' || before as run, false as fixed, 'paragraph' as kind from para where not large
  union all select doc_id, sk, pk, j, 0, s, e, 's' || pk || '-' || before, false, 'mid_paragraph' from sent where not large
  union all select doc_id, sk, pk, j, w, w, least(w + {cfg.target}, e), 'w', true, 'mid_paragraph' from (select *, unnest(range(s::bigint, e::bigint, {cfg.target - cfg.overlap})) as w from sent where large)
), numbered as (
  select *, row_number() over (partition by doc_id, sk order by pk, j, w) as k from piece
), joined as (
  select doc_id, sk, k, s, e, run, kind, 0 as c from numbered where k = 1
  union all
  select n.doc_id, n.sk, n.k, case when fits then p.s else n.s end, n.e, n.run, n.kind, p.c + (not fits)::int
  from joined p join numbered n on n.doc_id = p.doc_id and n.sk = p.sk and n.k = p.k + 1, lateral (select n.run = p.run and not n.fixed and n.e - p.s <= {cfg.target} as fits)
), cuts as (
  select doc_id, sk, c, min(s) as s, max(e) as e, any_value(kind) as kind, row_number() over (partition by doc_id, sk order by c desc) = 1 as is_last from joined group by 1, 2, 3
), spans as (
  select doc_id, sk, c, c.s, c.e, case when is_last and c.e >= g.b - 1 and kind = 'paragraph' then 'structural' else kind end as kind, crumb, merged, has_structure from cuts c join segs g using (doc_id, sk)
  union all select doc_id, sk, 0, a, b, 'structural', crumb, merged, has_structure from segs where b - a <= {cfg.maximum} or merged > 1
), trimmed as (
  select s.*, act_id, s.s + length(t) - length(ltrim(t, {SPACE})) as p0, trim(t, {SPACE}) as piece_text from (select s.*, d.act_id, substr(d.text, s.s::int + 1, (s.e - s.s)::int) as t from spans s join docs d using (doc_id)) s
), chunks as (
  select doc_id, act_id, (row_number() over (partition by doc_id order by sk, c) - 1)::int as chunk_index, concat(doc_id, ':', p0::bigint, '-', (p0 + length(piece_text))::bigint) as chunk_id,
    p0::bigint as char_start, (p0 + length(piece_text))::bigint as char_end, piece_text as text, crumb as breadcrumb, kind as boundary_kind, merged::int as segments_merged, has_structure
  from trimmed where piece_text <> ''
)"""


#: Documents without an outline: one segment each.
WHOLE = "segs as (select doc_id, 0 as sk, 0 as a, length(text) as b, title as crumb, 1 as merged, false as has_structure from docs where text <> '')"

#: The outline of a node a line (corpus.CONTENTS): nodes of one place belong to the deepest, then the latest.
OUTLINE = """
node as (
  select doc_id, unnest(range(len(x)))::int as pos, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from docs)
), placed as (
  select *, sum(length(line) + 1) over (partition by doc_id order by pos) - length(line) - 1 as s from node
), owned as (
  select doc_id, s, arg_max(pos, (1 + pos % 3) * 1000000 + pos)::int as pos from placed group by 1, 2
), segs as (
  select doc_id, row_number() over (partition by doc_id order by s) as sk, s as a, coalesce(lead(s) over (partition by doc_id order by s), length(text)) as b,
    title || ' › ' || array_to_string(list_transform(range(pos - pos % 3, pos + 1), lambda i: 'L' || i), ' › ') as crumb, 1 as merged, true as has_structure
  from owned join docs using (doc_id) qualify b > a
)"""
