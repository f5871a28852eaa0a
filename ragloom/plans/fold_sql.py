"""SQL of the order-dependent folds over the chunks of a document, as recursive queries."""

from __future__ import annotations

from ragloom.plans.registry import DOCS, SENT

# Sentences of a document packed up to 512 characters.
SEMANTIC = f"""
sem_in as (select document_id, n, s from (select document_id, n, {SENT} s from ({DOCS})) where len(s) > 0),
sem_fold as (
  select document_id, n, s, 1 k, s[1] cur, 0 pos, 0 seq, null::varchar out_text, null::int out_start, null::int out_seq from sem_in
  union all
  select document_id, n, s, k + 1, case when flush then s[k + 1] else cur || ' ' || s[k + 1] end, case when flush then pos + length(cur) else pos end, seq + flush::int,
    case when flush then cur end, case when flush then pos end, case when flush then seq end
  from (select *, length(cur) + length(s[k + 1]) > 512 flush from sem_fold where k < len(s))),
semantic as (
  select document_id, out_seq sequence_num, out_start start_idx, out_start + length(out_text) end_idx, out_text content from sem_fold where out_text is not null
  union all select document_id, seq, pos, n, cur from sem_fold where k = len(s))"""

# Chunks of `semantic` below 200 characters take in their successors while the limit allows.
MERGE_SMALL = """
small_in as (select *, row_number() over (partition by document_id order by sequence_num) k, count(*) over (partition by document_id) parts from semantic),
small_fold as (
  select document_id, k, parts, sequence_num, start_idx, end_idx, content, false closed, sequence_num o_seq, start_idx o_start, end_idx o_end, content o_text from small_in where k = 1
  union all
  select document_id, k + 1, parts, case when take then sequence_num else n_seq end, case when take then start_idx else n_start end, n_end, case when take then content || ' ' || n_text else n_text end,
    not take, sequence_num, start_idx, end_idx, content
  from (select f.*, i.sequence_num n_seq, i.start_idx n_start, i.end_idx n_end, i.content n_text, length(f.content) < 200 and length(f.content) + length(i.content) < 512 take
    from small_fold f join small_in i on i.document_id = f.document_id and i.k = f.k + 1)),
small as (
  select document_id, o_seq sequence_num, o_start start_idx, o_end end_idx, o_text content from small_fold where closed
  union all select document_id, sequence_num, start_idx, end_idx, content from small_fold where k = parts)"""

# Relevance filter and merging of `cand`(document_id, sequence_num, start_idx, end_idx, content, score, keywords).
OPTIMISE = """
opt_all as (select *, max(score) over (partition by document_id) most, row_number() over (partition by document_id order by score desc, sequence_num, start_idx, end_idx, content) best from cand),
opt_in as (select *, row_number() over (partition by document_id order by start_idx, score desc, sequence_num, end_idx, content) k from opt_all where score >= 0.3 or (most < 0.3 and best <= 3)),
opt_fold as (
  select document_id, k, 1 g, length(content) size, end_idx, score from opt_in where k = 1
  union all
  select i.document_id, i.k, case when t then g else g + 1 end, case when t then size + length(i.content) else length(i.content) end, i.end_idx, i.score
  from (select f.*, i.k next, f.end_idx >= i.start_idx - 100 and abs(f.score - i.score) < 0.3 and size + length(i.content) <= 768 t
    from opt_fold f join opt_in i on i.document_id is not distinct from f.document_id and i.k = f.k + 1) f
  join opt_in i on i.document_id is not distinct from f.document_id and i.k = f.next),
optimised as (
  select i.document_id || '_query_aware_' || arg_min(sequence_num, i.k) chunk_id, i.document_id, 'query_aware' strategy, cast(g - 1 as int) sequence_num, arg_min(start_idx, i.k) start_idx,
    arg_max(i.end_idx, i.k) end_idx, string_agg(content, ' ' order by i.k) content, round(avg(i.score), 6) relevance_score, list_sort(list_distinct(flatten(list(keywords)))) keywords, cast(count(*) as int) merged_from
  from opt_in i join (select document_id, k, g from opt_fold) f on i.document_id is not distinct from f.document_id and i.k = f.k group by i.document_id, g)"""
