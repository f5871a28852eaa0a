"""Queries over provider requests and replies, with their SQL. Replies are written from the tables; some cannot be read, as if a call had failed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text
from ragloom.operators import chunkers
from ragloom.plans.fold_sql import OPTIMISE, SEMANTIC
from ragloom.plans.registry import SQL, WORDS, asked, documents, query
from ragloom.sources.tables import table


def _number(name: str):
    return F.substring(name, 2, 20).cast("bigint")


_NUMBER = lambda name: f"cast(substr({name}, 2) as bigint)"


@query(f"""with recursive fb as ({SQL['chunk_keyword']}),
d as (select document_id, coalesce(language in ('kr', 'ko'), false) kr, title, content[1:80] summary, list_filter([title, source], lambda x: x is not null) points, source, {WORDS('content')}[1:3] kw
  from rag_documents where content is not null and {_NUMBER('document_id')} % 3 <> 0),
e as (select *, coalesce(title <> '', false)::int + coalesce(summary <> '', false)::int + len(points) parts, case when kr then '핵심 메타정보:' || chr(10) else 'Core Metadata:' || chr(10) end
  || case when source is not null then (case when kr then '- 주요 개체: ' else '- Main Entities: ' end) || source || chr(10) else '' end
  || case when len(kw) > 0 then (case when kr then '- 키워드: ' else '- Keywords: ' end) || array_to_string(kw, ', ') || chr(10) else '' end info from d),
p as (select document_id, 0 sequence_num, case when kr then '제목: ' else 'Title: ' end head, title body, 'title' kind, 1.0::double importance from e where title <> ''
  union all select document_id, 1, case when kr then '요약: ' else 'Summary: ' end, summary, 'summary', 0.9::double from e where summary <> ''
  union all select document_id, 1 + k, case when kr then '핵심포인트 ' else 'Key Point ' end || k || ': ', points[k], 'key_point', 0.8::double from e, unnest(range(1, len(points) + 1)) as u(k)
  union all select document_id, parts, '', info, 'meta_info', 0.7::double from e)
select document_id || '_keyword_' || sequence_num chunk_id, document_id, 'keyword' strategy, cast(sequence_num as int) sequence_num, 0 start_idx, cast(length(body) as int) end_idx, head || body content, kind, importance from p
union all select * from fb where {_NUMBER('document_id')} % 3 = 0""")
def keyword_replies(spark, base):
    """Descriptions for two documents in three, unreadable replies for the others."""
    d = table(spark, base, "rag_documents").where("content is not null")
    meta = F.struct(F.when(F.col("source").isNotNull(), F.array("source")).alias("entities"), F.slice(text.words(F.col("content")), 1, 3).alias("keywords"))
    described = F.to_json(F.struct("title", F.substring("content", 1, 80).alias("summary"), F.array_compact(F.array("title", "source")).alias("key_points"), meta.alias("meta_info")))
    replies = d.select("document_id", F.when(_number("document_id") % 3 != 0, described).otherwise("{broken").alias("reply"))
    return chunkers.keyword(d.select("document_id", "content", "language"), replies)


@query(f"""with recursive {SEMANTIC}, c as (select distinct on (chunk_id) * from chunks where strategy = 'semantic' and document_id is not null),
r as (select *, row_number() over (partition by document_id order by sequence_num, chunk_id) - 1 seq from c),
ok as (select distinct document_id from c)
select document_id || '_semantic_' || seq chunk_id, document_id, 'semantic' strategy, cast(seq as int) sequence_num, start_idx, end_idx, content, topic, round(seq % 5 / 4.0::double, 6) relevance_score, 'reason ' || seq reason
from r semi join (select document_id from rag_documents where content is not null) using (document_id) where content <> ''
union all select document_id || '_semantic_' || sequence_num, document_id, 'semantic', sequence_num, start_idx, cast(end_idx as int), content, null, null, null from semantic anti join ok using (document_id)""")
def semantic_query_replies(spark, base):
    """Passages judged for a question, by stored chunks; packed sentences for documents without any."""
    c = table(spark, base, "chunks").where("strategy = 'semantic' and document_id is not null").dropDuplicates(["chunk_id"])
    order = F.array_sort(F.collect_list(F.struct("sequence_num", "chunk_id", "content", F.col("start_idx").cast("string").alias("start_idx"), "end_idx", "topic")))  # chunks of one document
    listed = c.groupBy("document_id").agg(order.alias("c"))
    part = F.transform("c", lambda x, i: F.struct(x["content"].alias("content"), x["start_idx"].alias("start_idx"), x["end_idx"].alias("end_idx"), x["topic"].alias("topic"),
                                                 ((i % 5) / F.lit(4.0)).alias("relevance_score"), F.concat(F.lit("reason "), i.cast("string")).alias("reason")))
    got = chunkers.semantic(documents(spark, base), listed.select("document_id", F.to_json(F.struct(part.alias("chunks"))).alias("reply")))
    return got.select("chunk_id", "document_id", "strategy", "sequence_num", "start_idx", "end_idx", "content", "topic", "relevance_score", "reason")


@query(f"""with q as (select query_id, any_value(question) question, any_value(context_id) context_id from queries where query_id is not null group by 1)
select query_id, case when {_NUMBER('query_id')} % 2 = 0 then 'fact' else 'information' end question_type, case when {_NUMBER('query_id')} % 2 = 0 then [coalesce(context_id, '')] else [] end key_entities,
  case when {_NUMBER('query_id')} % 2 = 0 then ['a', 'b'] else {WORDS("coalesce(question, '')")}[1:5] end keywords, case when {_NUMBER('query_id')} % 2 = 1 then ['general'] end required_info,
  case when {_NUMBER('query_id')} % 2 = 0 then 'simple' else 'moderate' end complexity from q""")
def query_analyses(spark, base):
    """Replies for every second question, the fallback for the others."""
    reply = F.to_json(F.struct(F.lit("fact").alias("question_type"), F.array(F.coalesce("context_id", F.lit(""))).alias("key_entities"),
                               F.array(F.lit("a"), F.lit("b")).alias("keywords"), F.lit("simple").alias("complexity")))
    q = asked(spark, base).select("query_id", "question", F.when(_number("query_id") % 2 == 0, reply).alias("reply"))
    return chunkers.query_analysis(q)


@query(f"""with recursive fb as ({SQL['chunk_query_aware']}), c as (select distinct on (chunk_id) * from chunks where strategy = 'query_aware' and document_id is not null),
known as (select document_id from rag_documents where content is not null),
r as (select *, row_number() over (partition by document_id order by sequence_num, chunk_id) - 1 seq from c semi join known using (document_id)),
cand as (select document_id, cast(seq as int) sequence_num, start_idx, end_idx, content, case when seq % 5 = 4 then 0.5::double else seq % 5 / 4.0::double end score, [coalesce(topic, ''), 'k'] keywords from r), {OPTIMISE}
select * from optimised union all select chunk_id, document_id, strategy, sequence_num, start_idx, end_idx, content, relevance_score, null, null from fb anti join c using (document_id)""")
def query_aware_replies(spark, base):
    """Passages extracted for a question, filtered and merged; slices for documents whose reply has none."""
    c = table(spark, base, "chunks").where("strategy = 'query_aware' and document_id is not null").dropDuplicates(["chunk_id"])
    listed = c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sequence_num", "chunk_id", "content", "start_idx", "end_idx", "topic"))).alias("c"))  # chunks of one document
    part = F.transform("c", lambda x, i: F.struct(x["content"].alias("content"), x["start_idx"].alias("start_idx"), x["end_idx"].alias("end_idx"), F.array(F.coalesce(x["topic"], F.lit("")), F.lit("k")).alias("keywords"),
                                                 F.when(i % 5 != 4, (i % 5) / F.lit(4.0)).alias("relevance_score"), F.lit("near").alias("relevance_reason"), F.lit("part").alias("answer_contribution")))
    full = listed.select("document_id", F.to_json(F.struct(part.alias("chunks"), F.lit("80%").alias("coverage"))).alias("reply"))
    rest = documents(spark, base).select("document_id").join(full, "document_id", "left_anti").withColumn("reply", F.lit('{"chunks": [], "coverage": "0%"}'))
    got = chunkers.query_aware(documents(spark, base), full.unionByName(rest))
    return got.select(*chunkers.COMMON, F.round("relevance_score", 6).alias("relevance_score"), "keywords", "merged_from")


@query("""with c as (select distinct on (chunk_id) * from chunks where strategy = 'query_aware' and document_id is not null), known as (select document_id from rag_documents where content is not null),
r as (select *, row_number() over (partition by document_id order by sequence_num, chunk_id) - 1 seq from c semi join known using (document_id))
select document_id || '_query_aware_' || seq chunk_id, start_idx, end_idx, case when seq % 2 = 0 then 0.9::double else 0.5::double end relevance_score, case when seq % 2 = 0 then 'near' else '' end relevance_reason, '' answer_contribution, '60%' coverage from r""")
def query_aware_passages(spark, base):
    """Extracted passages before filter and merge, every second one without relevance and reason."""
    c = table(spark, base, "chunks").where("strategy = 'query_aware' and document_id is not null").dropDuplicates(["chunk_id"])
    listed = c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sequence_num", "chunk_id", "content", "start_idx", "end_idx"))).alias("c"))  # chunks of one document
    part = F.transform("c", lambda x, i: F.struct(x["content"].alias("content"), x["start_idx"].alias("start_idx"), x["end_idx"].alias("end_idx"), F.when(i % 2 == 0, 0.9).alias("relevance_score"), F.when(i % 2 == 0, "near").alias("relevance_reason")))
    good, _ = chunkers.answered(documents(spark, base), listed.select("document_id", F.to_json(F.struct(part.alias("chunks"), F.lit("60%").alias("coverage"))).alias("reply")))
    return chunkers.query_aware_from_reply(good).select("chunk_id", "start_idx", "end_idx", "relevance_score", "relevance_reason", "answer_contribution", "coverage")


def _requests_sql() -> str:
    kr = "coalesce(language in ('kr', 'ko'), false)"
    parts = []
    for kind, (en, ko) in text.REQUESTS.items():
        dots = " || case when n > 10000 then '...' else '' end" if kind in text.ELLIPSIS else ""
        parts.append(f"select document_id, '{kind}' kind, case when {kr} then '{ko}' else '{en}' end || chr(10) || chr(10) || case when {kr} then '질문: ' else 'Question: ' end || document_id || chr(10) || chr(10) || content[1:10000]{dots} request from d")
    return f"with d as (select document_id, language, content, length(content) n from rag_documents where content is not null), r as ({' union all '.join(parts)}) select document_id, kind, md5(request) request, length(request) n from r"


@query(_requests_sql())
def provider_requests(spark, base):
    """Requests of every kind for every document, as digests."""
    d = documents(spark, base).where("content is not null")
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), text.prompt(kind, F.col("content"), F.col("document_id"), F.col("language")).alias("request")) for kind in text.REQUESTS])
    return d.select("document_id", F.explode(each).alias("r")).select("document_id", "r.kind", F.md5(F.col("r.request").cast("binary")).alias("request"), F.length("r.request").cast("bigint").alias("n"))


@query("""select response_id, case when confidence is not null then cast(floor(confidence * 1000) as int) end wait_ms from (select distinct on (response_id) * from responses where response_id is not null)""")
def retry_waits(spark, base):
    """Waiting times read back from rate-limit messages."""
    r = table(spark, base, "responses").where("response_id is not null").dropDuplicates(["response_id"])
    message = F.concat(F.lit("Rate limit reached. Try again in  "), F.floor(F.col("confidence") * 1000).cast("string"), F.lit("ms. Visit the help page."))
    return r.select("response_id", text.retry_after_ms(message).alias("wait_ms"))
