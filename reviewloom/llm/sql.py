"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Texts in lower case as far as A-Z goes, cut into terms.
_TERMS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _escaped(column: str) -> str:
    return f"replace(replace(replace(coalesce({column}, ''), '\\', '\\\\'), '#', '\\h'), '<', '\\l')"


SQL: dict[str, str] = {
    "op1_substrings": f"""
with d as (
  select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents
), starts as (
  select r, unnest(range(1, len(w) - 33)) as i,
         unnest(list_transform(range(1, len(w) - 33), lambda k: md5(array_to_string(w[k:k + 34], ' ')))) as h
  from d where len(w) >= 35
), repeated as (
  select r, i from (select r, i, count(*) over (partition by h) as c from starts) where c > 1
), words as (
  select r, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from d
), marked as (
  select words.r, j, word,
         coalesce(j - max(i) over (partition by words.r order by j rows unbounded preceding) < 35, false) as gone
  from words left join repeated on words.r = repeated.r and j = i
), summed as (
  select r, count(*) as n_words, count(*) filter (gone) as n_removed,
         string_agg(word, ' ' order by j) filter (not gone) as kept
  from marked group by r
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join summed using (r)""",
    "op6_embedding_dedup": """
with recursive e as (
  select row_number() over () as r, vec_id, embedding::double[] as v from embeddings
), sound as (
  select r, vec_id, v from e
  where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.r as a, b.r as b from sound a join sound b
    on a.r <> b.r and list_cosine_similarity(a.v, b.v) >= 0.9
), reach as (
  select r as a, r as b from sound
  union
  select reach.a, links.b from reach join links on reach.b = links.a
), counts as (
  select a as r, count(*) as n_links from links group by a
), named as (
  select a as r, min(vec_id) as component_id from reach join e on e.r = reach.b group by a
)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id,
       vec_id is not distinct from coalesce(component_id, vec_id) as kept
from e left join counts using (r) left join named using (r)""",
    "op7_jaccard": f"""
with recursive d as (
  select row_number() over () as r, doc_id, {_WORDS.format(_LOWER)} as w from documents
), shingles as (
  select distinct r, doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) end) as s
  from d
), sizes as (
  select r, count(*) as n from shingles group by r
), met as (
  select a.r as a, b.r as b, a.doc_id as x, b.doc_id as y, count(*) as common
  from shingles a join shingles b on a.s = b.s and a.r <> b.r group by all
), links as (
  select distinct x, y from met join sizes p on p.r = a join sizes q on q.r = b
  where 100 * common >= 90 * (p.n + q.n - common)
), reach as (
  select doc_id as x, doc_id as y from documents
  union
  select reach.x, links.y from reach join links on reach.y = links.x
), least as (
  select x, min(y) as component_id from reach group by x
)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from d left join sizes using (r) left join least on doc_id = x""",
    "op10_chat": f"""
with said as (
  select conv_id, turn, role, text from conversations
  union all
  select -7, turn, role, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(turn, role)
), made as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         replace({_escaped("role")}, ':', '\\c') as role_made, {_escaped("text")} as text_made
  from said
), sized as (
  select *, length(role_made) + length(text_made) + 14 as chars,
         ceil((length(role_made) + length(text_made) + 14) / 4)::bigint as size
  from made
), placed as (
  select *, row_number() over o - 1 as place, coalesce(sum(size) over (o rows between unbounded preceding and 1 preceding), 0) as before,
         first_value(role) over o = 'system' as has_system, first_value(size) over o as first_size,
         first_value(chars) over o as first_chars
  from sized window o as (partition by conv_id order by turn nulls first, role_made, text_made)
), dealt as (
  select *, case when has_system then first_size else 0 end as kept,
         greatest(0, before - case when has_system then first_size else 0 end)::bigint as past
  from placed
), strided as (
  select *, greatest(384 - kept, (512 - kept) // 2, 1)::bigint as stride,
         case when has_system and place = 0 then 0 else size end as own
  from dealt
), spans as (
  select *, 2 * (past // stride) + case when past % stride + own > stride then 1 else 0 end as span from strided
), windows as (
  select conv_id, span, min(past) as start, least(128, 512 - max(kept) - sum(size)) as room,
         sum(chars) + case when bool_or(has_system) and min(place) > 0 then max(first_chars) else 0 end as chars
  from spans group by conv_id, span
), history as (
  select w.conv_id, sum(s.chars) as chars
  from windows w join spans s on w.conv_id is not distinct from s.conv_id and s.span in (w.span - 1, w.span - 2)
  where not (s.has_system and s.place = 0) and w.start - s.past <= w.room group by w.conv_id
), formatted as (
  select conv_id, sum(chars) as chars from (select conv_id, chars from windows union all from history) group by conv_id
), read as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by place) as turns,
         coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '') as target
  from spans group by conv_id
)
select read.conv_id, n_turns, sha256(turns) as turns_sha256, length(target)::bigint as loss_chars,
       sha256(target) as loss_sha256, chars::bigint as formatted_chars
from read join formatted on read.conv_id is not distinct from formatted.conv_id""",
    "op11_lexical_search": f"""
with d as (
  select row_number() over () as r, doc_id, {_TERMS} as terms from documents
), lengths as (
  select r, doc_id, len(terms) as n from d where len(terms) > 0
), total as (
  select count(*) as docs, sum(n)::bigint as words from lengths
), postings as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from d) group by r, term
), asked as (
  select item, item_id, term, count(*) as times
  from (select item, item_id, unnest(terms) as term
        from (select row_number() over () as item, item_id, {_TERMS} as terms from benchmark))
  group by item, item_id, term
), weights as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w
  from postings, total group by term, docs
), scores as (
  select item, item_id, doc_id, r,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint as score
  from asked join weights using (term) join postings using (term) join lengths using (r), total
  group by item, item_id, doc_id, r
), ranked as (
  select *, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank
  from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20""",
    "op13_warc": """
with p as (
  select page_id, url, coalesce(html, '') as body, strlen(coalesce(html, '')) as payload_bytes,
         sha1(coalesce(html, '')) as hex
  from pages
), d as (
  select page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '')
           as payload_digest,
         row_number() over (partition by body order by page_id nulls last) as place,
         first_value(page_id) over (partition by body order by page_id nulls last) as original
  from p
)
select page_id, payload_bytes, payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type,
       case when place = 1 then null else original end as refers_to
from d""",
}
