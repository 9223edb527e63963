"""DuckDB texts that check the registered queries of this subpackage, where SQL can express them."""

from skyseries.llm import hard_negatives, jaccard_join, line_dedup, quality, va_topk

WORD = r"[^\x20\x09-\x0D]+"
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

NEAR_DUPLICATES = rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '{WORD}') ws from documents),
shingles as (
  select distinct doc_id, array_to_string(ws[i:i + {jaccard_join.SHINGLE - 1}], ' ') s
  from words, unnest(range(1, greatest(1, len(ws) - {jaccard_join.SHINGLE - 1}) + 1)) as t(i) where len(ws) > 0),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= {jaccard_join.PERCENT} * (x.n + y.n - c)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(n, 0) n_shingles, (select min(other) from reach r where r.doc_id = d.doc_id) component_id
from documents d left join sizes using (doc_id)"""

_RUNS = ", ".join(f"coalesce(max(chars) filter (n = {n}), 0)::bigint run{n}_chars" for n in quality.RUN_LIMITS)
_TOPS = ", ".join(f"coalesce(max(chars) filter (n = {n}), 0)::bigint top{n}_chars" for n in quality.TOP_LIMITS)
_COVERED = [*[f"top{n}_chars" for n in quality.TOP_LIMITS], *[f"run{n}_chars" for n in quality.RUN_LIMITS], "dup_line_chars"]
_COVERED_SQL = ", ".join(f"coalesce({c}, 0)::bigint {c}" for c in _COVERED)
_FITS = " and ".join(
    f"{c} <= {limit}::double * word_chars" for c, limit in zip(_COVERED, [*quality.TOP_LIMITS.values(), *quality.RUN_LIMITS.values(), quality.LINE_LIMIT]))

QUALITY = rf"""
with w as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') ws from documents),
grams as (
  select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') g
  from w, unnest(range({min(quality.TOP_LIMITS)}, {max(quality.RUN_LIMITS) + 1})) as a(n), unnest(range(1, len(ws) - n + 2)) as b(i)),
doubled as (select doc_id, n, i from grams where n >= {min(quality.RUN_LIMITS)} qualify count(*) over (partition by doc_id, n, g) > 1),
inside as (select distinct doc_id, n, unnest(range(i, i + n)) p from doubled),
runs as (select doc_id, n, count(*) repeated, sum(length(ws[p])) chars from inside join w using (doc_id) group by doc_id, n),
frequent as (
  select doc_id, n, count(*) * length(replace(g, ' ', '')) chars from grams where n <= {max(quality.TOP_LIMITS)}
  group by doc_id, n, g having count(*) >= {quality.TOP_TIMES}),
tops as (select doc_id, {_TOPS} from frequent group by doc_id),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents),
twice as (
  select doc_id, count(*) - 1 again, (count(*) - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) chars
  from lines where regexp_matches(line, '{WORD}') group by doc_id, line),
per_line as (select doc_id, sum(again) dup, sum(chars) dup_line_chars from twice group by doc_id),
sums as (
  select doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) n_symbols from w),
per_run as (select doc_id, {_RUNS}, max(repeated) filter (n = 5) repeated from runs group by doc_id),
base as (
  select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, coalesce(dup, 0)::bigint n_dup_lines,
    coalesce(repeated, 0)::bigint n_repeat_words, {_COVERED_SQL}
  from sums left join per_line using (doc_id) left join per_run using (doc_id) left join tops using (doc_id))
select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words) and {_FITS} kept
from base"""

_LONGER = " ".join(f"when length(bare) >= {n} then {share}" for n, share in sorted(line_dedup.LONGER.items(), reverse=True))

LINE_DEDUP = f"""
with lines as (
  select doc_id, source, p, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) bare
  from (select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) p from documents)),
pages as (select source, count(*) n from documents group by source),
longest as (select doc_id, arg_max(bare, (length(bare), bare)) longest from lines group by doc_id),
held as (
  select source, bare, count(distinct doc_id) c, count(distinct longest) differ
  from lines join longest using (doc_id) where bare <> '' group by source, bare),
frequent as (
  select held.source, bare from held join pages on held.source is not distinct from pages.source
  where c >= {line_dedup.MIN_PAGES} and (c > n * {line_dedup.RATIO} or 2 * differ > c and c > n * case {_LONGER} else {line_dedup.RATIO} end)),
marked as (
  select doc_id, line, p, exists (select 1 from frequent f where f.source is not distinct from lines.source and f.bare = lines.bare) gone from lines),
texts as (select doc_id, string_agg(line, chr(10) order by p) filter (not gone) t, count(*) filter (gone) n from marked group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(t, '') end as text, coalesce(n, 0) lines_dropped
from documents d left join texts using (doc_id)"""


VECTOR_TOP_K = f"""
with sound as (
  select row_number() over () as own, vec_id, list_transform(embedding, lambda x: floor({va_topk.SCALE} * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.own, q.vec_id query_id, c.vec_id vec_id, list_dot_product(q.v, c.v)::bigint score
  from sound q join sound c on q.own <> c.own and len(q.v) = len(c.v) where q.vec_id % {va_topk.QUERY_STEP} = 0)
select query_id, (row_number() over w)::integer as rank, vec_id, score
from pairs window w as (partition by own order by score desc, vec_id) qualify rank <= {va_topk.K}"""

CHAT = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, i, x, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as v(i, x)),
escaped as (
  select *, replace(replace(t, '\', '\\'), '<', '\<') e, replace(replace(replace(r, '\', '\\'), '<', '\<'), chr(10), '\n') f from turns)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
  sum(length('<turn>' || f || chr(10) || e || '</turn>' || chr(10)))::bigint formatted_chars
from escaped group by conv_id"""

# crc32 bit by bit: a byte is mixed in, then eight shifts.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"""

CONVERSATION_REPAIR = rf"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) k from conversations),
hashed as (select *, {_CRC32} % 20 h from given),
damaged as (
  select conv_id, turn, case h when 4 then 'user' else r end r, case h when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t
  from hashed, unnest(case h when 0 then [] when 3 then [1, 2] else [1] end) as u(copy)),
placed as (
  select *, row_number() over (partition by conv_id, r, t order by i) seen, lag(r[1]) over (partition by conv_id order by i) || r[1] pair
  from (select *, row_number() over (partition by conv_id order by turn nulls first, r, t) i from damaged)),
faulted as (
  select *, case when not regexp_matches(t, '[^\x20\x09-\x0D]') then 'b' when seen > 1 then 'd'
    when not regexp_matches(t, '[.!?][\x20\x09-\x0D]*\z') then 't' else 'k' end f from placed),
counts as (
  select conv_id, max(i) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (f = 'b') blank,
    count(*) filter (f = 'd') duplicate, count(*) filter (f = 't') truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal
  from faulted group by conv_id),
inserts(before, after, price, put, made) as (
  values (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
    (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
moves(own, s, edit, step, s2) as (
  values ('s', 0, 'K', 0, 1), ('u', 0, 'K', 0, 2), ('u', 1, 'K', 0, 2), ('u', 3, 'K', 0, 2), ('a', 2, 'K', 0, 3),
    ('', 0, 'R', 2, 2), ('', 1, 'R', 2, 2), ('', 3, 'R', 2, 2), ('', 2, 'R', 2, 3), ('', 0, 'D', 3, 0), ('', 1, 'D', 3, 1), ('', 2, 'D', 3, 2), ('', 3, 'D', 3, 3)),
best(conv_id, i, s, cost, audit, made) as (
  select distinct conv_id, 0::bigint, 0, 0, '', []::varchar[] from conversations
  union all
  select conv_id, i, s2, total, letters, made from (
    select b.conv_id, x.i, m.s2, b.cost + n.price + m.step + case when m.edit <> 'D' and x.f = 't' then 1 else 0 end as total, b.audit || n.put || m.edit as letters,
      b.made || n.made || case m.edit when 'D' then [] when 'K' then [x.r || ':' || x.t] else [case m.s2 when 2 then 'user:' else 'assistant:' end || x.t] end as made
    from best b join inserts n on n.before = b.s join faulted x on x.conv_id is not distinct from b.conv_id and x.i = b.i + 1
      join moves m on m.s = n.after and (m.own = '' or m.own = x.r[1]) and (m.edit = 'D' or x.f in ('k', 't')))
  qualify row_number() over (partition by conv_id, s2 order by total, letters) = 1),
ended as (
  select b.conv_id, b.cost + n.price as total, b.audit || n.put as letters, b.made || n.made as made
  from best b join inserts n on n.before = b.s left join counts c on c.conv_id is not distinct from b.conv_id
  where b.i = coalesce(c.n, 0) and n.after in (0, 3)
  qualify row_number() over (partition by b.conv_id order by b.cost + n.price, b.audit || n.put) = 1)
select e.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, total::bigint as cost, letters as audit, sha256(array_to_string(made, chr(10))) repaired_sha256
from ended e left join counts c on c.conv_id is not distinct from e.conv_id"""

HARD_NEGATIVES = f"""
with sound as (
  select row_number() over () as own, vec_id, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)) v,
    case when vec_id % {hard_negatives.MOVED_STEP} = 0 then (label + 1) % {hard_negatives.LABELS} else label end l
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.own, a.vec_id anchor_id, x.vec_id vec_id, a.l = x.l same, list_dot_product(a.v, x.v)::bigint score
  from sound a join sound x on a.own <> x.own and len(a.v) = len(x.v) where a.vec_id % {hard_negatives.ANCHOR_STEP} = 0),
positives as (
  select own, anchor_id, vec_id positive_id, score positive_score from scored where same
  qualify row_number() over (partition by own order by score desc, vec_id) <= {hard_negatives.POSITIVES})
select p.anchor_id, positive_id, (row_number() over w)::integer as rank, n.vec_id negative_id, positive_score, n.score negative_score
from positives p join scored n on n.own = p.own and not n.same and 100 * n.score between {hard_negatives.LEAST} * positive_score and {hard_negatives.MOST} * positive_score
window w as (partition by p.own, positive_id order by n.score desc, n.vec_id) qualify rank <= {hard_negatives.NEGATIVES}"""
