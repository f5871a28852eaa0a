"""Queries over responses: confidence, votes, reranking, fusion, generation; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text
from ragloom.operators import ensembles, generation
from ragloom.operators.skew import salted_join
from ragloom.plans.registry import WORDS, asked, given, query
from ragloom.sources.tables import table

_GIVEN = "select distinct on (response_id) *, coalesce(list_transform(chunks_used, lambda c: c.relevance_score), []) rel from responses where response_id is not null"


@query(f"""select response_id, round(least(greatest((case when length(response) < 20 then 0.7::double when length(response) > 1000 then 0.9::double else 1.0::double end)
* (case when len(rel) = 0 then 0.5::double when len(rel) = 1 then 0.8::double else 1.0::double end) * coalesce(list_avg(list_transform(rel, lambda x: coalesce(x, 1.0::double))), 1.0::double), 0.0::double), 1.0::double), 6) confidence
from ({_GIVEN}) where response is not null""")
def response_confidence(spark, base):
    r = given(spark, base).where("response_id is not null and response is not null")
    return r.select("response_id", F.round(ensembles.confidence(F.col("response"), F.col("relevances"), F.lit(True)), 6).alias("confidence"))


@query(f"select response_id, round(0.7::double * confidence + 0.3::double * coalesce(list_avg(list_transform(rel, lambda x: coalesce(x, 0.5::double))), 0.5::double), 6) score from ({_GIVEN})")
def response_scores(spark, base):
    return given(spark, base).where("response_id is not null").select("response_id", F.round(ensembles.weighted_score(F.col("confidence"), F.col("relevances")), 6).alias("score"))


_SCORE = "0.7::double * confidence + 0.3::double * coalesce(list_avg(list_transform(rel, lambda x: coalesce(x, 0.5::double))), 0.5::double)"
_BALLOTS = f"""v as (select query_id, response_id, coalesce(response, '') t, confidence, {_SCORE} score, strategy from ({_GIVEN}) where query_id is not null and strategy is not null),
u as (select *, length(t) l, list_distinct({WORDS('lower(t[1:50])')}) w from v)"""
_ALIKE = lambda l, w, hl, hw: (f"coalesce({hl} > 0 and {l}::double / {hl} between 0.7::double and 1.3::double and len({w}) > 0 and len({hw}) > 0 "  # noqa: E731
                               f"and len(list_intersect({w}, {hw}))::double / least(len({w}), len({hw})) > 0.5, false)")


@query(f"""with recursive {_BALLOTS}, r as (select *, row_number() over (partition by query_id order by strategy, response_id) n, count(*) over (partition by query_id) candidates from u),
f as (select query_id, n, candidates, [l] hl, [w] hw, [1] votes, [response_id] best, [coalesce(confidence, 0)] conf from r where n = 1
  union all
  select query_id, n, candidates, case when g is null then list_append(hl, l) else hl end, case when g is null then list_append(hw, w) else hw end,
    case when g is null then list_append(votes, 1) else list_transform(votes, lambda x, i: x + (i = g)::int) end,
    case when g is null then list_append(best, response_id) else list_transform(best, lambda x, i: case when i = g and c > conf[i] then response_id else x end) end,
    case when g is null then list_append(conf, c) else list_transform(conf, lambda x, i: case when i = g and c > x then c else x end) end
  from (select f.query_id, r.n, f.candidates, hl, hw, votes, best, conf, r.l, r.w, r.response_id, coalesce(r.confidence, 0) c,
      list_filter(range(1, len(hl) + 1), lambda i: {_ALIKE('r.l', 'r.w', 'hl[i]', 'hw[i]')})[1] g
    from f join r on r.query_id = f.query_id and r.n = f.n + 1)),
e as (select *, list_position(votes, list_max(votes)) g from f where n = candidates)
select query_id, best[g] response_id, votes[g] votes, cast(candidates as int) candidates from e""")
def vote_simple(spark, base):
    return ensembles.vote(given(spark, base)).select("query_id", "response_id", "votes", "candidates")


@query(f"""with {_BALLOTS}, r as (select *, row_number() over (partition by query_id order by coalesce(score, 0) desc, strategy, response_id) n, count(*) over (partition by query_id) candidates from u),
p as (select a.query_id, a.candidates, a.score top, a.response_id ia, b.response_id ib, c.response_id ic, coalesce(a.confidence, 0) ca, coalesce(b.confidence, 0) cb, coalesce(c.confidence, 0) cc,
    coalesce(a.score, 0) sa, coalesce(b.score, 0) sb, coalesce(c.score, 0) sc, a.confidence own,
    1 ga, case when b.query_id is null then null when {_ALIKE('b.l', 'b.w', 'a.l', 'a.w')} then 1 else 2 end gb, {_ALIKE('c.l', 'c.w', 'a.l', 'a.w')} c1, {_ALIKE('c.l', 'c.w', 'b.l', 'b.w')} c2
  from r a left join r b on b.query_id = a.query_id and b.n = 2 left join r c on c.query_id = a.query_id and c.n = 3 where a.n = 1),
q as (select *, case when ic is null then null when c1 then 1 when gb = 2 and c2 then 2 when gb = 2 then 3 else 2 end gc from p),
m as (select query_id, candidates, own, top, unnest([{{'g': ga, 'id': ia, 'c': ca, 's': sa, 'n': 1}}, {{'g': gb, 'id': ib, 'c': cb, 's': sb, 'n': 2}}, {{'g': gc, 'id': ic, 'c': cc, 's': sc, 'n': 3}}]) x from q),
s as (select query_id, any_value(candidates) candidates, any_value(own) own, any_value(top) top, x.g g, sum(x.s) total, count(*) votes, arg_max(x.id, struct_pack(c := x.c, n := -x.n)) id from m where x.g is not null group by query_id, x.g)
select query_id, id response_id, round(case when candidates = 1 then own else coalesce(top, 0) end, 6) confidence, cast(votes as int) votes, cast(candidates as int) candidates
from s qualify row_number() over (partition by query_id order by total desc, g) = 1""")
def vote_weighted(spark, base):
    return ensembles.vote(given(spark, base), weighted=True).select("query_id", "response_id", F.round("confidence", 6).alias("confidence"), "votes", "candidates")


_EVERY = "one as (select * from (select distinct on (response_id) * from responses where response_id is not null) where query_id is not null and strategy is not null)"
_USED = f"{_EVERY}, used as (select query_id, strategy, response_id, k - 1 pos, chunks_used[k] c from one, unnest(range(1, coalesce(len(chunks_used), 0) + 1)) as u(k))"


@query(f"""with {_USED} select query_id, c.document_id document_id, c.start_idx start_idx, c.end_idx end_idx, strategy from used
qualify row_number() over (partition by query_id, c.document_id, c.start_idx, c.end_idx order by strategy, response_id, pos) = 1""")
def dedupe_chunks(spark, base):
    return ensembles.unique_by_position(ensembles.used_chunks(given(spark, base))).select("query_id", "document_id", "start_idx", "end_idx", "strategy")


@query(f"""with {_USED}, o as (select query_id, c.id id, c.relevance_score relevance_score from used qualify row_number() over (partition by query_id, c.id order by coalesce(c.relevance_score, 0) desc, strategy, pos) = 1)
select *, cast(row_number() over (partition by query_id order by coalesce(relevance_score, 0) desc, id) as int) rank from o""")
def fusion_chunks(spark, base):
    return ensembles.unique_by_id(ensembles.used_chunks(given(spark, base))).select("query_id", "id", "relevance_score", "rank")


@query(f"""with {_EVERY} select query_id, arg_min(response, k) response, arg_min(confidence, k) confidence, arg_min(strategy, k) strategy, avg(generation_time) generation_time, count(*) n
from (select *, struct_pack(c := -coalesce(confidence, 0), s := strategy, r := response_id) k from one) group by 1""")
def fuse(spark, base):
    """No merging provider: the most confident response of each query."""
    return ensembles.fuse(given(spark, base))


@query(f"""with {_EVERY}, m as (select query_id, 'merged ' || query_id t from one where query_id like '%7' group by 1)
select query_id, case when t is null then arg_min(response, k) else t end response, round(case when t is null then arg_min(confidence, k) else least(0.95::double, 1.1::double * avg(confidence)) end, 6) confidence,
  case when t is null then arg_min(strategy, k) else 'fusion' end strategy, round(avg(generation_time), 6) generation_time, count(*) n
from (select one.*, struct_pack(c := -coalesce(confidence, 0), s := strategy, r := response_id) k from one) left join m using (query_id) group by query_id, t""")
def fuse_merged(spark, base):
    """A provider that merges the answers of every tenth question and fails for the others."""
    every = given(spark, base)
    merged = ensembles.usable(every).where(F.col("query_id").endswith("7")).select("query_id").distinct().withColumn("text", F.concat(F.lit("merged "), "query_id"))
    return ensembles.fuse(every, merged).withColumn("confidence", F.round("confidence", 6)).withColumn("generation_time", F.round("generation_time", 6))


def _with_texts(spark, base):
    every = ensembles.usable(given(spark, base)).where("response is not null")
    used = every.select("response_id", F.explode_outer("chunks_used").alias("c")).select("response_id", F.col("c.id").alias("chunk_id"))
    texts = table(spark, base, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "content")
    got = salted_join(used, texts, "chunk_id", F.xxhash64("response_id")).groupBy("response_id").agg(F.array_sort(F.collect_list("content")).alias("texts"))
    return every.join(got, "response_id")


_TEXTS = f"""{_EVERY}, tx as (select distinct on (chunk_id) chunk_id, content from chunks),
rt as (select response_id, tx.content from (select response_id, unnest(chunks_used).id chunk_id from one where response is not null) join tx using (chunk_id) where tx.content is not null)"""
_OVERLAP = f"""with {_TEXTS}, sh as (select response_id, content, list_distinct({WORDS('lower(content)')}) cw, list_distinct({WORDS('lower(response)')}) rw from rt join one using (response_id)),
ov as (select response_id, sum(len(list_intersect(cw, rw))::double / len(cw)) / count(*) o from sh where len(cw) > 0 group by 1),
sc as (select query_id, response_id, strategy, round(coalesce(o, 0) * confidence, 9) score from one left join ov using (response_id) where response is not null)
select query_id, response_id, strategy, round(score, 6) score from sc qualify row_number() over (partition by query_id order by score desc nulls last, strategy, response_id) = 1"""


@query(_OVERLAP)
def rerank_overlap(spark, base):
    return ensembles.rerank(_with_texts(spark, base), "overlap").select("query_id", "response_id", "strategy", F.round("score", 6).alias("score"))


@query()
def rerank_rouge(spark, base):
    return ensembles.rerank(_with_texts(spark, base), "rouge").select("query_id", "response_id", "strategy", F.round("score", 6).alias("score"))


@query()
def rerank_both(spark, base):
    return ensembles.rerank(_with_texts(spark, base), "both").select("query_id", "response_id", "strategy", F.round("score", 6).alias("score"))


@query(f"""with {_EVERY}, p as (select query_id, strategy, row_number() over (partition by query_id, strategy order by response_id) number, row_number() over (partition by query_id order by strategy, response_id) nth, response
  from one where response is not null),
t as (select *, '[' || strategy || ' 전략 응답 ' || number || ']' || chr(10) || response part from p),
l as (select *, sum(length(part) + 2) over (partition by query_id order by nth) - length(part) - 2 before from t)
select query_id, cast(before // 10000 as bigint) request, string_agg(part, chr(10) || chr(10) order by nth) responses, count(*) n from l group by 1, 2""")
def fusion_prompts(spark, base):
    return ensembles.fusion_prompts(given(spark, base))


@query(f"""with {_EVERY}, q as (select query_id, any_value(question) question, any_value(language) language from queries where query_id is not null group by 1),
tx as (select distinct on (chunk_id) chunk_id, content from chunks),
c as (select response_id, k pos, chunks_used[k] u from one, unnest(range(1, coalesce(len(chunks_used), 0) + 1)) as x(k)),
g as (select response_id, list(content order by pos) texts, list(u.relevance_score order by pos) rel from c join tx on tx.chunk_id = u.id where content is not null group by 1)
select response_id, query_id, strategy, coalesce(texts[1], case when coalesce(language in ('kr', 'ko'), false) then '죄송합니다. 응답을 생성하는 중 오류가 발생했습니다: no passages' else 'Sorry, an error occurred while generating the response: no passages' end) response,
  round(case when texts[1] is null then 0 else least(greatest((case when length(texts[1]) < 20 then 0.7::double when length(texts[1]) > 1000 then 0.9::double else 1.0::double end) * (case when len(rel) = 1 then 0.8::double else 1.0::double end)
    * list_avg(list_transform(rel, lambda x: coalesce(x, 1.0::double))), 0.0::double), 1.0::double) end, 6) confidence, 'extractive' model_used, cast(coalesce(len(texts), 0) as int) passages,
  case when texts[1] is null then 'no passages' end error
from one join q using (query_id) left join g using (response_id)""")
def generated_responses(spark, base):
    """Answers of the extractive provider from the passages that each stored response used."""
    got = generation.generate(_retrieved(spark, base), generation.extractive)
    return got.select("response_id", "query_id", "strategy", "response", F.round("confidence", 6).alias("confidence"), "model_used", F.size("chunks_used").alias("passages"), "error")


def _retrieved(spark, base):
    """(response_id, query_id, strategy, question, language, chunks): stored responses as retrieval results, with texts."""
    every = ensembles.usable(given(spark, base)).select("response_id", "query_id", "strategy", "chunks_used")
    used = every.select("response_id", F.posexplode("chunks_used").alias("pos", "u")).select("response_id", "pos", "u.*").withColumnRenamed("id", "chunk_id")
    texts = table(spark, base, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "content").where("content is not null")
    part = F.struct("pos", F.col("chunk_id").alias("id"), "document_id", "start_idx", "end_idx", "content", "relevance_score")
    lists = salted_join(used, texts, "chunk_id", F.xxhash64("response_id"), "inner").groupBy("response_id").agg(F.array_sort(F.collect_list(part)).alias("chunks"))  # chunks of one response
    whole = every.drop("chunks_used").join(lists, "response_id", "left")
    return salted_join(whole, asked(spark, base).select("query_id", "question", "language"), "query_id", F.xxhash64("response_id"), "inner")


@query(f"""with {_EVERY}, q as (select query_id, any_value(question) question, any_value(language) language from queries where query_id is not null group by 1),
tx as (select distinct on (chunk_id) chunk_id, content from chunks),
c as (select response_id, k pos, chunks_used[k].id chunk_id from one, unnest(range(1, coalesce(len(chunks_used), 0) + 1)) as x(k)),
n as (select response_id, content, row_number() over (partition by response_id order by pos) i from c join tx using (chunk_id) where content is not null),
g as (select response_id, string_agg('[참조 ' || i || ']' || chr(10) || content, chr(10) || chr(10) order by i) context from n group by 1)
select response_id, coalesce(context, '') context from one join q using (query_id) left join g using (response_id)""")
def context_blocks(spark, base):
    """The numbered passages that a generator gets."""
    return _retrieved(spark, base).select("response_id", F.coalesce(text.context_block(F.transform("chunks", lambda c: c["content"])), F.lit("")).alias("context"))
