"""All queries of the core with their SQL counterparts. Each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text, vectors
from ragloom.operators import chunkers, embedding, evaluation, retrieval
from ragloom.operators import statistics as st
from ragloom.operators.durable import shared_folder
from ragloom.operators.skew import salted_join
from ragloom.plans import pipeline
from ragloom.plans.fold_sql import MERGE_SMALL, OPTIMISE, SEMANTIC
from ragloom.plans.registry import BLANKS, DOCS, NORM, QUERIES, SENT, SQL, TRIM, WORDS, asked, documents, given, query, searched
from ragloom.sources import loaders, store
from ragloom.sources.tables import table

FIXED = rf"""
fixed_windows as (
  select d.document_id, d.content, d.n, i, least(i + 512, d.n) stop, substr(d.content, i + 1, 512) w
  from ({DOCS}) d, unnest(case when d.n <= 512 then [0] else range(0, d.n, 461) end) as u(i)),
fixed_tail as (select document_id, min(i) m from fixed_windows where i > 0 and i + 512 >= n and n - i < 153.6 group by 1),
fixed_kept as (
  select f.*, t.m, row_number() over (partition by f.document_id order by i) - 1 seq, row_number() over (partition by f.document_id order by i desc) back
  from fixed_windows f left join fixed_tail t using (document_id)
  where n <= 512 or ((m is null or i < m) and not regexp_matches(w, '^{BLANKS}*$'))),
fixed_cut as (
  select *, case when n <= 512 or stop >= n or regexp_matches(w, '[.!?다요음]{BLANKS}*$') or length(regexp_extract(right(w, 100), '(?s)^(.*[.!?])', 1)) = 0 then stop
    else stop - length(right(w, 100)) + length(regexp_extract(right(w, 100), '(?s)^(.*[.!?])', 1)) end cut from fixed_kept),
fixed_size as (
  select document_id || '_fixed_size_' || seq chunk_id, document_id, 'fixed_size' strategy, cast(seq as int) sequence_num, cast(i as int) start_idx,
    cast(case when m is not null and back = 1 then n else cut end as int) end_idx,
    substr(content, i + 1, case when m is not null and back = 1 then n else cut end - i) content,
    case when n <= 512 then 'single_chunk' when m is not null and back = 1 then 'merged_last' else 'fixed_size' end "method",
    cast(case when n <= 512 then 0 when (m is not null and back = 1) or i > 0 then 51 else 0 end as int) overlap_size,
    coalesce(n > 512 and not (m is not null and back = 1) and cut < stop, false) adjusted from fixed_cut)"""
RECURSIVE = rf"""
recursive_windows as (
  select d.document_id, i, substr(d.content, i + 1, 512) w from ({DOCS}) d, unnest(range(0, d.n, 462)) as u(i)),
recursive_chunks as (
  select document_id || '_recursive_' || seq chunk_id, document_id, 'recursive' strategy, cast(seq as int) sequence_num, cast(i as int) start_idx,
    cast(i + length(w) as int) end_idx, w content
  from (select *, row_number() over (partition by document_id order by i) - 1 seq from recursive_windows where length({TRIM('w')}) > 10))"""
_COLS = "chunk_id, document_id, strategy, sequence_num, start_idx, end_idx, content"


# ---- chunkers ------------------------------------------------------------------------------------------------------
@query(f"with {FIXED} select * from fixed_size")
def chunk_fixed_size(spark, base):
    return chunkers.fixed_size(documents(spark, base))


@query(f"with {RECURSIVE} select * from recursive_chunks")
def chunk_recursive(spark, base):
    return chunkers.recursive(documents(spark, base))


@query(rf"""with d as (select *, {SENT} s, coalesce(language in ('kr','ko'), false) kr from ({DOCS})),
e as (select document_id, kr, content, case when len(s) > 0 then s[1][1:100] when kr then '제목 없음' else 'No Title' end title,
  case when len(s) > 3 then list_aggregate(s[1:3], 'string_agg', ' ')[1:300] else content[1:300] end summary, list_transform(s[1:3], lambda p: p[1:100]) points from d),
p as (
  select document_id, 0 sequence_num, case when kr then '제목: ' else 'Title: ' end head, title body, 'title' kind, 1.0::double importance from e where title <> ''
  union all select document_id, 1, case when kr then '요약: ' else 'Summary: ' end, summary, 'summary', 0.9::double from e where summary <> ''
  union all select document_id, 1 + k, case when kr then '핵심포인트 ' else 'Key Point ' end || k || ': ', points[k], 'key_point', 0.8::double from e, unnest(range(1, len(points) + 1)) as u(k)
  union all select document_id, (title <> '')::int + (summary <> '')::int + len(points), '',
    case when kr then '핵심 메타정보:' || chr(10) || '- 주제: 일반' || chr(10) else 'Core Metadata:' || chr(10) || '- Topics: General' || chr(10) end, 'meta_info', 0.7::double from e)
select document_id || '_keyword_' || sequence_num chunk_id, document_id, 'keyword' strategy, cast(sequence_num as int) sequence_num, 0 start_idx,
  cast(length(body) as int) end_idx, head || body content, kind, importance from p""")
def chunk_keyword(spark, base):
    return chunkers.keyword_fallback(documents(spark, base))


@query(rf"""with d as (select *, case when n > 512 and n % 512 between 1 and 256 then n // 512 else ceil(n / 512)::bigint end parts from ({DOCS})),
p as (select d.*, k from d, unnest(range(0, parts)) as u(k)),
q as (select document_id, k, k * 512 a, case when k = parts - 1 then n else (k + 1) * 512 end b, content from p)
select document_id || '_query_aware_' || k chunk_id, document_id, 'query_aware' strategy, cast(k as int) sequence_num, cast(a as int) start_idx, cast(b as int) end_idx,
  case when b - a > 512 then substr(content, a + 1, 512) || ' ' || substr(content, a + 513, b - a - 512) else substr(content, a + 1, b - a) end content, 0.5::double relevance_score from q""")
def chunk_query_aware(spark, base):
    return chunkers.query_aware_fallback(documents(spark, base))


@query(f"""with recursive {SEMANTIC} select document_id || '_semantic_' || sequence_num chunk_id, document_id, 'semantic' strategy, sequence_num, start_idx, cast(end_idx as int) end_idx, content from semantic""")
def chunk_semantic(spark, base):
    return chunkers.semantic_fallback(documents(spark, base))


@query()
def chunk_text_similarity(spark, base):
    return chunkers.text_similarity(documents(spark, base))


@query(rf"""with d as (select document_id, {SENT} s from ({DOCS}))
select document_id, cast(k as int) "number", list_aggregate(s[3 * k + 1:3 * k + 3], 'string_agg', ' ') "text" from d, unnest(range(0, ((len(s) + 2) // 3)::bigint)) as u(k)""")
def sentence_groups(spark, base):
    return chunkers.sentence_groups(documents(spark, base))


@query(f"""with {FIXED} select document_id, count(*) num_chunks, round(avg(length(content)), 6) avg_size, cast(min(length(content)) as int) min_size, cast(max(length(content)) as int) max_size,
round(stddev_pop(length(content)), 6) size_std, round(coalesce(case when min(end_idx) filter (sequence_num = 0) > 0 then greatest(0.0::double, (sum(length(content)) - min(end_idx) filter (sequence_num = 0))::double
/ min(end_idx) filter (sequence_num = 0)) end, 0.0::double), 6) overlap_ratio from fixed_size group by 1""")
def chunk_metrics(spark, base):
    return chunkers.metrics(chunkers.fixed_size(documents(spark, base)))


@query(f"""with {FIXED}, v as (select document_id, bool_and(length(content) between 1 and 1024) ok from fixed_size group by 1)
select document_id, coalesce(ok, false) valid from rag_documents left join v using (document_id)""")
def chunk_validate(spark, base):
    docs = documents(spark, base)
    return chunkers.validity(docs, chunkers.fixed_size(docs))


@query(f"""with {FIXED} select count(*) total_chunks, round(avg(length(content)), 6) avg_size, cast(min(length(content)) as int) min_size, cast(max(length(content)) as int) max_size,
round(avg(overlap_size), 6) avg_overlap, cast(sum(length(content)) as bigint) total_length, cast(sum(length(content)) - sum(overlap_size) as bigint) coverage,
round(sum(overlap_size)::double / sum(length(content)), 6) overlap_ratio, count(*) filter (adjusted) adjusted_chunks, count(*) filter ("method" = 'merged_last') merged_chunks from fixed_size""")
def chunk_fixed_stats(spark, base):
    return chunkers.fixed_statistics(chunkers.fixed_size(documents(spark, base)))


@query(f"""with recursive {SEMANTIC}, {MERGE_SMALL} select document_id, 'semantic' strategy, sequence_num, start_idx, cast(end_idx as int) end_idx, content from small""")
def chunk_merge_small(spark, base):
    return chunkers.merge_small(chunkers.semantic_fallback(documents(spark, base)), 200)


@query("""select distinct document_id || '_semantic_' || sequence_num chunk_id, document_id, 'semantic' strategy, sequence_num, start_idx, end_idx, content, topic
from chunks where content <> '' and document_id is not null and strategy = 'semantic'""")
def chunk_from_reply(spark, base):
    """Stored chunks written as provider replies, one reply a chunk set, and read back."""
    c = table(spark, base, "chunks").where("strategy = 'semantic' and document_id is not null").dropDuplicates(["chunk_id"])
    part = F.struct("content", F.col("start_idx").cast("string").alias("start_idx"), "end_idx", "topic")
    replies = c.groupBy("document_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("sequence_num", part.alias("p")))), lambda x: x["p"]).alias("chunks"))).alias("reply"))
    return chunkers.from_reply(replies).select("chunk_id", "document_id", "strategy", "sequence_num", "start_idx", "end_idx", "content", "topic")


@query(f"""with recursive used as (select u.id chunk_id, max(u.relevance_score) score from (select unnest(chunks_used) u from responses) group by 1),
cand as (select document_id, sequence_num, start_idx, end_idx, content, coalesce(score, 0.5::double) score, [coalesce(topic, '')] keywords from (select distinct on (chunk_id) * from chunks) left join used using (chunk_id) where strategy = 'query_aware'),
{OPTIMISE} select * from optimised""")
def optimise_chunks(spark, base):
    """Relevance filter and merging of the query-aware chunks that responses used."""
    used = table(spark, base, "responses").select(F.explode("chunks_used").alias("u")).groupBy(F.col("u.id").alias("chunk_id")).agg(F.max("u.relevance_score").alias("relevance_score"))
    c = table(spark, base, "chunks").dropDuplicates(["chunk_id"]).join(used, "chunk_id", "left")
    return chunkers.optimise(c.where("strategy = 'query_aware'").withColumn("keywords", F.array(F.coalesce("topic", F.lit(""))))).withColumn("relevance_score", F.round("relevance_score", 6))


@query("select distinct chunk_id, substr(sha256(concat_ws(':', document_id, start_idx, end_idx, content)), 1, 16) hash from chunks")
def chunk_hash(spark, base):
    return table(spark, base, "chunks").select("chunk_id", text.chunk_hash(F.col("document_id"), F.col("start_idx"), F.col("end_idx"), F.col("content")).alias("hash")).distinct()


# ---- text ----------------------------------------------------------------------------------------------------------
@query(f"select document_id, cast(k as int) position, s[k] sentence from (select document_id, {SENT} s from ({DOCS})), unnest(range(1, len(s) + 1)) as u(k)")
def sentence_split(spark, base):
    d = documents(spark, base).where("content is not null")
    return d.select("document_id", F.posexplode(text.sentences(F.col("content"), F.col("language"))).alias("p", "sentence")).select("document_id", (F.col("p") + 1).alias("position"), "sentence")


@query(f"select document_id, cast(len({WORDS('content')}) as int) words from rag_documents where content is not null")
def word_count(spark, base):
    return documents(spark, base).where("content is not null").select("document_id", text.word_count(F.col("content")).alias("words"))


@query(f"select distinct query_id, coalesce({NORM('expected_answer')}, '') answer from queries")
def normalise_text(spark, base):
    return asked(spark, base).select("query_id", text.normalise(F.col("expected_answer")).alias("answer"))


@query(f"""with q as (select distinct query_id, context_id, {NORM('expected_answer')} a from queries)
select query_id, coalesce(a <> '' and {NORM('content')} <> '' and contains({NORM('content')}, a), false) found from q join rag_documents d on d.document_id = q.context_id""")
def contains_answer(spark, base):
    q = asked(spark, base).select("query_id", F.col("context_id").alias("document_id"), text.normalise(F.col("expected_answer")).alias("answer"))
    j = salted_join(q, documents(spark, base).select("document_id", "content"), "document_id", F.xxhash64("query_id"), "inner")
    return j.select("query_id", text.contains_answer(text.normalise(F.col("content")), F.col("answer")).alias("found"))


@query(f"""with q as (select distinct query_id, question, expected_answer from queries where question is not null and expected_answer is not null),
w as (select query_id, list_distinct({WORDS('lower(question)')}) a, list_distinct({WORDS('lower(expected_answer)')}) b from q)
select query_id, cast(len(list_intersect(a, b)) as int) shared, cast(len(a) as int) question_words from w""")
def word_overlap(spark, base):
    q = asked(spark, base).where("question is not null and expected_answer is not null")
    a, b = text.word_set(F.col("question")), text.word_set(F.col("expected_answer"))
    return q.select("query_id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(a).alias("question_words"))


@query()
def sequence_ratio(spark, base):
    return asked(spark, base).select("query_id", F.round(text.sequence_ratio(F.col("question"), F.col("expected_answer")), 6).alias("ratio"))


_ROW = lambda r, a, y: f"list_transform({r}, lambda v, j: case when {a} = {y}[j] then greatest(v, coalesce({r}[j - 1], 0) + 1) else v end)"


@query(rf"""with recursive q as (select distinct query_id, regexp_extract_all(lower(coalesce(question, '')), '[\p{{L}}\p{{N}}]+') x, regexp_extract_all(lower(coalesce(expected_answer, '')), '[\p{{L}}\p{{N}}]+') y from queries where query_id is not null),
f as (select query_id, x, y, 0 k, list_transform(y, lambda w: 0) r from q
  union all select query_id, x, y, k + 1, list_transform(c, lambda v, j: list_max(c[1:j])) from (select query_id, x, y, k, {_ROW('r', 'x[k + 1]', 'y')} c from f where k < len(x)))
select query_id, round(case when len(x) = 0 or len(y) = 0 or r[len(y)] = 0 then 0 else 2 * (r[len(y)] / len(y)) * (r[len(y)] / len(x)) / (r[len(y)] / len(y) + r[len(y)] / len(x)) end, 6) rouge from f where k = len(x)""")
def rouge_l(spark, base):
    return asked(spark, base).select("query_id", F.round(text.rouge_l_score(F.col("question"), F.col("expected_answer")), 6).alias("rouge"))


@query(f"select distinct query_id, {WORDS('question')}[1:5] keywords from queries where question is not null")
def query_keywords(spark, base):
    return asked(spark, base).where("question is not null").select("query_id", chunkers.query_keywords(F.col("question")).alias("keywords"))


# ---- vectors and retrieval -----------------------------------------------------------------------------------------
_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"


@query(f"""select a.vec_id, b.vec_id other_id, round(case when list_dot_product(a.embedding::double[], a.embedding::double[]) > 0 and list_dot_product(b.embedding::double[], b.embedding::double[]) > 0
then {_DOT} / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) else 0 end, 6) cosine,
round({_DOT}, 6) dot, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) euclidean from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_measures(spark, base):
    e = table(spark, base, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    j = e.join(b, "vec_id")
    return j.select("vec_id", "other_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"),
                    F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("dot"), F.round(vectors.euclidean(F.col("embedding"), F.col("other")), 6).alias("euclidean"))


_BUCKET = "('0x' || substr(md5(w), 1, 4))::int % 256"


@query(rf"""with t as (select document_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) w from rag_documents where content is not null)
select document_id, cast({_BUCKET} as int) bucket, count(*)::double n from t group by 1, 2""")
def hash_embedding(spark, base):
    df = embedding.embed(documents(spark, base).where("content is not null"), "content", embedding.hashing())
    return df.select("document_id", F.posexplode("embedding").alias("bucket", "n")).where("n > 0").withColumn("n", F.col("n").cast("double"))


def _labelled(spark, base):
    e = table(spark, base, "embeddings").where("embedding is not null")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return e, retrieval.top_k(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")), 6)


_TOP = f"""e as (select vec_id, label, embedding from embeddings where embedding is not null),
s as (select a.vec_id query_id, b.vec_id item_id, a.label la, b.label lb, round({_DOT} / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])), 9) score
  from e a, e b where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) rank from s)"""


@query(f"with {_TOP} select query_id, item_id, round(score, 6) score, cast(rank as int) rank from r where rank <= 6")
def topk_vectors(spark, base):
    return _labelled(spark, base)[1].withColumn("score", F.round("score", 6))


@query(f"with {_TOP} select query_id, item_id, round(score, 6) score, cast(rank as int) rank from r where rank <= 6 and score >= 0.7")
def store_search_threshold(spark, base):
    return retrieval.above(_labelled(spark, base)[1]).withColumn("score", F.round("score", 6))


_METRICS = """c as (select query_id, rank, rel, k, sum(rel) over (partition by query_id, k order by rank) so_far from j, (values (1), (3), (5)) v(k) where rank <= k),
m as (select query_id, k, max(rel)::double hit, sum(rel)::double / count(*) "precision", least(1.0::double, sum(rel)::double) recall, coalesce(1.0::double / min(rank) filter (rel = 1), 0) mrr,
  coalesce(sum(so_far::double / rank) filter (rel = 1) / nullif(sum(rel), 0), 0) "map", sum(rel / log2(rank + 1)) gain, sum(rel) got from c group by 1, 2),
n as (select *, case when got > 0 then gain / list_sum(list_transform(range(1, got::bigint + 1), lambda i: 1 / log2(i + 1))) else 0 end ndcg from m)
select k, count(*) num_samples, round(avg(hit), 6) hit, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(mrr), 6) mrr, round(avg("map"), 6) "map", round(avg(ndcg), 6) ndcg from n group by 1"""


@query(f"""with {_TOP}, o as (select query_id, row_number() over (partition by query_id order by rank) rank, (la = lb)::int rel from r where rank <= 6 and query_id <> item_id), j as (select * from o where rank <= 5), {_METRICS}""")
def retrieval_metrics_labels(spark, base):
    e, top = _labelled(spark, base)
    labels = e.select("vec_id", "label")
    others = top.where("query_id <> item_id").join(labels.withColumnRenamed("vec_id", "query_id").withColumnRenamed("label", "own"), "query_id").join(
        labels.withColumnRenamed("vec_id", "item_id"), "item_id")
    from pyspark.sql import Window

    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 5")
    return evaluation.means(evaluation.per_query(ranked.withColumn("rel", (F.col("own") == F.col("label")).cast("int"))))


SUMMARY = rf"""with {FIXED}, {RECURSIVE},
ch as (select chunk_id, strategy, content from fixed_size union all select chunk_id, strategy, content from recursive_chunks),
q as (select query_id, any_value(question) question, any_value(expected_answer) answer from queries where query_id is not null and cast(substr(query_id, 2) as bigint) % 50 = 0 group by 1),
ct as (select chunk_id, {_BUCKET} b, count(*) n from (select chunk_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) w from ch) group by 1, 2),
qt as (select query_id, {_BUCKET} b, count(*) n from (select query_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) w from q) group by 1, 2),
cn as (select chunk_id, sum(n * n) s from ct group by 1), qn as (select query_id, sum(n * n) s from qt group by 1),
dp as (select query_id, chunk_id, sum(ct.n * qt.n) d from ct join qt using (b) group by 1, 2),
sc as (select q.query_id, ch.strategy, ch.chunk_id, round(coalesce(d / sqrt(qn.s::double * cn.s::double), 0), 9) score from q cross join ch left join dp using (query_id, chunk_id) left join qn using (query_id) left join cn using (chunk_id)),
rk as (select *, row_number() over (partition by query_id, strategy order by score desc, chunk_id) rank from sc),
jj as (select rk.query_id, rk.strategy, rk.rank, coalesce({NORM('q.answer')} <> '' and contains({NORM('ch.content')}, {NORM('q.answer')}), false)::int rel from rk join q using (query_id) join ch using (chunk_id) where rk.rank <= 5)"""


@query(SUMMARY + """, c as (select query_id, strategy, rank, rel, k, sum(rel) over (partition by query_id, strategy, k order by rank) so_far from jj, (values (1), (3), (5)) v(k) where rank <= k),
m as (select query_id, strategy, k, max(rel)::double hit, sum(rel)::double / count(*) "precision", least(1.0::double, sum(rel)::double) recall, coalesce(1.0::double / min(rank) filter (rel = 1), 0) mrr,
  coalesce(sum(so_far::double / rank) filter (rel = 1) / nullif(sum(rel), 0), 0) "map", sum(rel / log2(rank + 1)) gain, sum(rel) got from c group by 1, 2, 3),
n as (select *, case when got > 0 then gain / list_sum(list_transform(range(1, got::bigint + 1), lambda i: 1 / log2(i + 1))) else 0 end ndcg from m)
select strategy, k, count(*) num_samples, round(avg(hit), 6) hit, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(mrr), 6) mrr, round(avg("map"), 6) "map", round(avg(ndcg), 6) ndcg from n group by 1, 2""")
def strategy_summary(spark, base):
    return pipeline.experiment(documents(spark, base), searched(spark, base), ["fixed_size", "recursive"])


@query()
def all_strategies(spark, base):
    """Every strategy, with the best by reciprocal rank marked."""
    results = pipeline.experiment(documents(spark, base), searched(spark, base), list(chunkers.STRATEGIES))
    return pipeline.best_by(results.where("k = 5"), "mrr")


# ---- statistics ----------------------------------------------------------------------------------------------------
def results(spark, base):
    """(strategy, language, value): mean confidence of the responses."""
    r = table(spark, base, "responses").where("response_id is not null").dropDuplicates(["response_id"]).select("response_id", "query_id", "strategy", "confidence")
    j = salted_join(r, asked(spark, base).select("query_id", "language"), "query_id", F.xxhash64("response_id"), "inner")
    return j.where("strategy is not null and language is not null and confidence is not null").groupBy("strategy", "language").agg(F.avg("confidence").alias("value"))


_RES = """res as (select strategy, language, avg(confidence) "value" from (select distinct on (response_id) * from responses where response_id is not null) r
join (select query_id, any_value(language) language from queries where query_id is not null group by 1) q using (query_id) where strategy is not null and language is not null and confidence is not null group by 1, 2)"""
_STATS = ("count(\"value\") n, round(avg(\"value\"), 6) mean, round(coalesce(stddev_samp(\"value\"), 0), 6) std, round(min(\"value\"), 6) min, round(max(\"value\"), 6) max, round(quantile_cont(\"value\", 0.5), 6) median, "
          "round(quantile_cont(\"value\", 0.25), 6) q1, round(quantile_cont(\"value\", 0.75), 6) q3")


@query(f"with {_RES} select strategy, language, {_STATS} from res group by grouping sets ((strategy), (language), ())")
def descriptive_stats(spark, base):
    return st.descriptive(results(spark, base))


@query(f"""with {_RES} select language, count("value") n, round(avg("value"), 6) mean, arg_min(strategy, struct_pack(v := -"value", s := strategy)) best_strategy from res group by 1""")
def language_compare(spark, base):
    return st.compare_languages(results(spark, base))


@query(f"""with {_RES} select strategy, round(avg("value"), 6) mean, round(avg("value") filter (language = 'en'), 6) en_mean, round(avg("value") filter (language = 'kr'), 6) kr_mean,
round(1 / (1 + abs(avg("value") filter (language = 'en') - avg("value") filter (language = 'kr'))), 6) consistency from res group by 1""")
def strategy_compare(spark, base):
    return st.compare_strategies(results(spark, base))


@query(f"""with {_RES}, x as (select case when strategy in ('semantic', 'keyword') then 'ensemble_' || strategy else strategy end strategy, "value" from res)
select count(*) filter (contains(strategy, 'ensemble')) n_ensemble, round(avg("value") filter (contains(strategy, 'ensemble')), 6) ensemble_mean, round(avg("value") filter (not contains(strategy, 'ensemble')), 6) individual_mean,
round((avg("value") filter (contains(strategy, 'ensemble')) - avg("value") filter (not contains(strategy, 'ensemble'))) * 100 / avg("value") filter (not contains(strategy, 'ensemble')), 6) improvement_pct,
arg_min(strategy, struct_pack(v := -"value", s := strategy)) best, stddev_pop("value") filter (contains(strategy, 'ensemble')) < stddev_pop("value") filter (not contains(strategy, 'ensemble')) steadier from x""")
def ensemble_effect(spark, base):
    r = results(spark, base).withColumn("strategy", F.when(F.col("strategy").isin("semantic", "keyword"), F.concat(F.lit("ensemble_"), "strategy")).otherwise(F.col("strategy")))
    return st.ensemble_effect(r)


@query(f"""with {_RES}, d as (select avg("value") filter (language = 'en') - avg("value") filter (language = 'kr') d from res group by strategy)
select count(d) n, round(avg(d), 6) mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) t, round(avg(d) / stddev_samp(d), 6) cohens_d from d""")
def paired_t(spark, base):
    return st.paired_t(results(spark, base))


@query(f"""with {_RES} select count("value") n, round(avg("value"), 6) mean, round(stddev_pop("value"), 6) std, round((avg("value") - 0.57) / (stddev_samp("value") / sqrt(count("value"))), 6) t from res""")
def one_sample_t(spark, base):
    return st.one_sample_t(results(spark, base))


@query(f"""with {_RES}, s as (select count(*) filter (g) n1, count(*) filter (not g) n0, avg("value") filter (g) - avg("value") filter (not g) d, var_samp("value") filter (g) v1, var_samp("value") filter (not g) v0 from (select *, language = 'en' g from res)),
p as (select *, ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) s2 from s)
select n1, n0, round(d, 6) difference, round(d / sqrt(s2 * (1.0::double / n0 + 1.0::double / n1)), 6) t, round(d / sqrt(s2), 6) cohens_d from p""")
def pooled_t(spark, base):
    return st.pooled_t(results(spark, base), F.col("language") == "en")


@query(f"""with {_RES}, g as (select strategy, count(*) n, sum("value") s, sum("value" * "value") q from res group by 1 having count(*) >= 2),
t as (select count(*) g, cast(sum(n) as bigint) n, sum(s) s, sum(q) q, sum(s * s / n) b from g)
select g as "groups", n as "values", round(((b - s * s / n) / (g - 1)) / ((q - b) / (n - g)), 4) f from t where g >= 2""")
def anova_f(spark, base):
    return st.anova_f(results(spark, base), "strategy")


@query(f"""with {_RES}, e as (select strategy, coalesce((avg("value") - 0.57) / nullif(stddev_pop("value"), 0), 0) d from res group by 1)
select strategy, round(d, 6) effect, case when abs(d) < 0.2 then 'negligible' when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end label from e""")
def effect_sizes(spark, base):
    return st.effect_sizes(results(spark, base))


_T975 = "([12.706204736174698, 4.302652729749464, 3.182446305283711, 2.7764451051977934, 2.570581835636315, 2.4469118511449786, 2.364624251592787, 2.306004135204166, 2.2621571627409915, 2.2281388519649385]::double[])"


@query(f"""with {_RES}, g as (select strategy, count(*) n, avg("value") m, coalesce(stddev_samp("value"), 0) s from res group by 1)
select strategy, n, round(case when n < 2 then 0 else m - {_T975}[n - 1] * s / sqrt(n) end, 6) low, round(case when n < 2 then 0 else m + {_T975}[n - 1] * s / sqrt(n) end, 6) high from g""")
def confidence_interval(spark, base):
    return st.confidence_intervals(results(spark, base), "strategy").withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query(f"""with {_RES}, a as (select avg("value") filter (language = 'en') e, avg("value") filter (language = 'kr') k from res)
select round(e, 6) en_mean, round(k, 6) kr_mean, round(abs(e - k), 6) gap, case when e > k then 'en' when e <= k then 'kr' end better from a""")
def language_gap(spark, base):
    return st.language_gap(results(spark, base))


# Tails of the t and F distributions by Simpson's rule over their densities.
_AREA = lambda density, upto: f"list_sum(list_transform(range(0, 4001), lambda i: (case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * {density(f'({upto} * i / 4000)')})) * {upto} / 12000"
_T_PDF = lambda v: lambda x: f"(exp(lgamma(({v} + 1) / 2.0::double) - lgamma({v} / 2.0::double)) / sqrt({v} * pi()) * pow(1 + {x} * {x} / {v}, -({v} + 1) / 2.0::double))"
_F_PDF = lambda a, b: lambda x: (f"(exp(lgamma(({a} + {b}) / 2.0::double) - lgamma({a} / 2.0::double) - lgamma({b} / 2.0::double)) * pow({a}::double / {b}, {a} / 2.0::double) "  # noqa: E731
                                 f"* pow({x}, {a} / 2.0::double - 1) * pow(1 + {a}::double * {x} / {b}, -({a} + {b}) / 2.0::double))")


@query(f"""with {_RES}, x as (select case when strategy in ('semantic', 'keyword') then 'ensemble_' || strategy else strategy end strategy, language, "value" from res),
d as (select avg("value") filter (language = 'en') - avg("value") filter (language = 'kr') d from x group by strategy),
e as (select count(*) filter (g) n1, count(*) filter (not g) n0, avg("value") filter (g) - avg("value") filter (not g) d, var_samp("value") filter (g) v1, var_samp("value") filter (not g) v0 from (select *, contains(strategy, 'ensemble') g from x)),
g as (select strategy, count(*) n, sum("value") s, sum("value" * "value") q from x where not contains(strategy, 'ensemble') group by 1 having count(*) >= 2),
a as (select count(*) g, sum(n)::double n, sum(s) s, sum(q) q, sum(s * s / n) b from g),
t as (select 'paired_languages' test, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) t, count(d) - 1 v from d
  union all select 'one_sample', round((avg("value") - 0.57) / (stddev_samp("value") / sqrt(count("value"))), 6), count("value") - 1 from x
  union all select 'ensembles', round(d / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0::double / n0 + 1.0::double / n1)), 6), n0 + n1 - 2 from e),
f as (select round(((b - s * s / n) / (g - 1)) / ((q - b) / (n - g)), 4) f, (g - 1)::double a, n - g b from a where g >= 2),
p as (select test, t statistic, 1 - 2 * {_AREA(_T_PDF('v'), 'abs(t)')} p from t union all select 'anova', f, 1 - {_AREA(_F_PDF('a', 'b'), 'f')} from f)
select test, statistic, round(p, 4) p, p < 0.05 significant from p""")
def statistical_tests(spark, base):
    """All tests with their tails; two strategies stand for ensembles."""
    r = results(spark, base).withColumn("strategy", F.when(F.col("strategy").isin("semantic", "keyword"), F.concat(F.lit("ensemble_"), "strategy")).otherwise(F.col("strategy")))
    return st.tests(r).withColumn("p", F.round("p", 4))


# ---- summaries, store, loaders -------------------------------------------------------------------------------------
@query(f"""with {_RES}, s as (select strategy, round(avg("value"), 6) auroc from res group by 1), b as (select max(auroc) base from s where strategy = 'fixed_size')
select strategy, auroc, printf('%.1f%%', coalesce((auroc - base) * 100 / nullif(base, 0), 0)) improvement from s, b""")
def e2e_summary(spark, base):
    per = results(spark, base).groupBy("strategy").agg(F.round(F.avg("value"), 6).alias("auroc"))
    return pipeline.improvement(per, "auroc")


@query(f"""select document_id, round(len({WORDS('content')}) / 1000.0::double * 0.005::double + len({WORDS('content')}) / 1000.0::double * 0.00013::double, 9) cost from rag_documents where content is not null""")
def cost_estimate(spark, base):
    n = text.word_count(F.col("content"))
    return documents(spark, base).where("content is not null").select("document_id", F.round(pipeline.cost(n, F.lit(0), n), 9).alias("cost"))


@query("""with c as (select distinct on (chunk_id) * from chunks) select strategy, language, count(distinct document_id) documents, count(*) chunks from c group by cube (strategy, language)""")
def store_stats(spark, base):
    return store.statistics(table(spark, base, "chunks").dropDuplicates(["chunk_id"]))


@query("select distinct on (chunk_id) chunk_id, document_id, strategy, sequence_num, start_idx, end_idx, content from chunks where document_id <> 'd0000000001'")
def store_roundtrip(spark, base):
    """Save, save one strategy again (replaces), clear one document, read back."""
    s = store.ChunkStore(spark, shared_folder(spark, "store"), buckets=8)
    c = table(spark, base, "chunks").dropDuplicates(["chunk_id"]).select(*chunkers.COMMON, "language")
    s.save(c)
    s.save(c.where("strategy = 'semantic'"))
    s.clear("d0000000001")
    return s.read().select(*chunkers.COMMON)


@query("""select document_id || '_xx' document_id, coalesce(content, '') content, 'xx' "language", document_id original_id from rag_documents""")
def translate_keys(spark, base):
    return loaders.translated(documents(spark, base), "xx", F.col("content"))


@query("select q.query_id id, d.content context, q.question, q.expected_answer answer from (select distinct on (query_id) * from queries) q join rag_documents d on d.document_id = q.context_id")
def joined_pairs(spark, base):
    return loaders.joined_pairs(documents(spark, base), asked(spark, base))


@query("""select q.query_id id, d.title, q.question, d.content context, q.expected_answer answer from (select distinct on (query_id) * from queries) q join rag_documents d on d.document_id = q.context_id
where coalesce(q.expected_answer, '') <> ''""")
def squad_flatten(spark, base):
    """Pairs nested into articles and flattened again."""
    d = table(spark, base, "rag_documents").select("title", F.col("document_id").alias("context_id"), F.col("content").alias("context"))
    qa = F.struct(F.col("query_id").alias("id"), "question", F.array(F.struct(F.col("expected_answer").alias("text"))).alias("answers"))
    nested = salted_join(asked(spark, base), d, "context_id", F.xxhash64("query_id"), "inner").select(F.array(F.struct("title", F.array(F.struct("context", F.array(qa).alias("qas"))).alias("paragraphs"))).alias("data"))
    return loaders.squad(nested)


from ragloom.plans import catalog_replies, catalog_reports, catalog_responses, catalog_sources  # noqa: E402, F401  (registers their queries)
