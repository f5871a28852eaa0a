"""Queries over scores, result rows and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions.text import word_count
from ragloom.operators import chunkers, evaluation, retrieval
from ragloom.operators.skew import salted_join
from ragloom.plans import pipeline
from ragloom.plans.registry import DOCS, WORDS, asked, documents, given, query
from ragloom.sources.tables import table


def _lists(spark, base):
    """(strategy, language, query_id, rank, rel): the passages of each response as a ranked list; relevant from 0.5."""
    r = given(spark, base).where("response_id is not null and strategy is not null and query_id is not null").select("response_id", "query_id", "strategy", "chunks_used")
    with_language = salted_join(r, asked(spark, base).where("language is not null").select("query_id", "language"), "query_id", F.xxhash64("response_id"), "inner")
    return with_language.select("strategy", "language", F.col("response_id").alias("query_id"), F.posexplode("chunks_used").alias("rank", "u")).select(
        "strategy", "language", "query_id", (F.col("rank") + 1).alias("rank"), (F.coalesce("u.relevance_score", F.lit(0.0)) >= 0.5).cast("int").alias("rel"))


_LISTS = """ql as (select query_id, any_value(language) language from queries where query_id is not null and language is not null group by 1),
rs as (select distinct on (response_id) * from responses where response_id is not null),
j as (select strategy, language, response_id query_id, rank, (coalesce(chunks_used[rank].relevance_score, 0) >= 0.5)::int rel from rs join ql using (query_id), unnest(range(1, coalesce(len(chunks_used), 0) + 1)) as u(rank) where strategy is not null),
c as (select *, sum(rel) over (partition by strategy, language, query_id, k order by rank) so_far from j, (values (1), (3), (5)) v(k) where rank <= k),
m as (select strategy, language, query_id, k, max(rel)::double hit, sum(rel)::double / count(*) "precision", least(1.0::double, sum(rel)::double) recall, coalesce(1.0::double / min(rank) filter (rel = 1), 0) mrr,
  coalesce(sum(so_far::double / rank) filter (rel = 1) / nullif(sum(rel), 0), 0) "map", sum(rel / log2(rank + 1)) gain, sum(rel) got from c group by all),
n as (select *, case when got > 0 then gain / list_sum(list_transform(range(1, got::bigint + 1), lambda i: 1 / log2(i + 1))) else 0 end ndcg from m),
sc as (select strategy, language, k, count(*) num_samples, round(avg(hit), 6) hit, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(mrr), 6) mrr, round(avg("map"), 6) "map", round(avg(ndcg), 6) ndcg from n group by all),
rows_ as (select strategy, language, 0.0::double hallucination_auroc, 0.0::double context_relevance_rmse, 0.0::double utilization_rmse, max(hit) filter (k = 5) recall_at_k, max(mrr) filter (k = 5) mrr,
  max(num_samples) filter (k = 5) num_samples, max(hit) filter (k = 1) hit_at_1, max(ndcg) filter (k = 3) ndcg_at_3 from sc group by all)"""


def _result_rows(spark, base):
    scores = evaluation.means(evaluation.per_query(_lists(spark, base), (1, 3, 5), ("strategy", "language")), ("strategy", "language"))
    return evaluation.result_rows(scores, 5)


@query(f"with {_LISTS} select *, null::varchar ensemble_method from rows_")
def result_rows(spark, base):
    """One row a strategy and language in the shape of the stored results, two cut-offs read from the map."""
    r = _result_rows(spark, base)
    return r.withColumn("hit_at_1", F.col("at_k")[1]["hit"]).withColumn("ndcg_at_3", F.col("at_k")[3]["ndcg"]).drop("at_k")


@query(f"""with {_LISTS} select strategy, language, hallucination_auroc, recall_at_k, mrr, num_samples from rows_
union all select 'graph', 'en', 0, 0, 0, 0 union all select 'unknown', 'kr', 0, 0, 0, 0""")
def zero_rows(spark, base):
    """Rows of zeros for a strategy that failed and for one without a name; a strategy that has a row keeps it."""
    failed = spark.createDataFrame([("graph", "en"), (None, "kr"), ("semantic", "en")], "strategy string, language string")
    return evaluation.with_zero_rows(_result_rows(spark, base), failed).select("strategy", "language", "hallucination_auroc", "recall_at_k", "mrr", "num_samples")


@query("""with q as (select distinct query_id from queries where query_id is not null), r as (select distinct strategy, query_id from responses where query_id is not null and strategy is not null and response_id is not null)
select strategy, (select count(*) from q) - count(q.query_id) missing from r left join q using (query_id) group by 1""")
def missing_lists(spark, base):
    """Questions without a response of a strategy; under strict evaluation one of them fails the strategy."""
    r = given(spark, base).where("strategy is not null and query_id is not null and response_id is not null").select("strategy", "query_id")
    return evaluation.missing_lists(asked(spark, base), r, r.select("strategy").distinct())


@query(f"""with {_LISTS}, q as (select distinct query_id from queries where query_id is not null), r as (select distinct strategy, query_id from responses where query_id is not null and strategy is not null and response_id is not null),
miss as (select strategy, (select count(*) from q) - count(q.query_id) missing from r left join q using (query_id) group by 1)
select strategy, language, k, num_samples, mrr from sc semi join (select strategy from miss where missing = 0 or strategy = 'fixed_size') using (strategy)""")
def strict_scores(spark, base):
    """Scores of the strategies with a list for every question; one strategy is taken as complete."""
    scores = evaluation.means(evaluation.per_query(_lists(spark, base), (1, 3, 5), ("strategy", "language")), ("strategy", "language"))
    missing = missing_lists(spark, base).withColumn("missing", F.when(F.col("strategy") == "fixed_size", 0).otherwise(F.col("missing")))
    return evaluation.strict(scores, missing).select("strategy", "language", "k", "num_samples", "mrr")


@query(f"""with {_LISTS} select strategy, language, round((0.6::double + (1 - least(0.3::double, 1)) + (1 - least(1.7::double, 1)) + recall_at_k + mrr) / 5, 6) overall,
  recall_at_k > 0.5 better_auroc, recall_at_k < 0.5 better_rmse from rows_""")
def overall_scores(spark, base):
    """Overall scores, and comparisons in which a higher AUROC and a lower RMSE win."""
    r, recall = _result_rows(spark, base), F.col("recall_at_k")
    score = evaluation.overall_score(F.lit(0.6), F.lit(0.3), F.lit(1.7), recall, F.col("mrr"))
    return r.select("strategy", "language", F.round(score, 6).alias("overall"), evaluation.better(F.lit("hallucination_auroc"), recall, F.lit(0.5)).alias("better_auroc"),
                    evaluation.better(F.lit("context_relevance_rmse"), recall, F.lit(0.5)).alias("better_rmse"))


_LABELLED = "x as (select distinct on (response_id) confidence s, (length(response) > 60)::int y, generation_time / 5 z from responses where response_id is not null)"


@query(f"""with {_LABELLED}, r as (select y, count(*) filter (true) over (order by s range between unbounded preceding and current row) - (count(*) over (partition by s) - 1) / 2.0::double mean_rank from x where s is not null and y is not null)
select round((sum(mean_rank) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * count(*) filter (y = 0))::double, 6) auroc from r""")
def confidence_auroc(spark, base):
    """How well the confidence of a response tells long answers from short ones."""
    r = given(spark, base).where("response_id is not null").select("confidence", (F.length("response") > 60).cast("int").alias("long"))
    return evaluation.auroc(r, "confidence", "long")


@query(f"with {_LABELLED} select round(sqrt(avg((s - z) * (s - z))), 6) rmse from x")
def confidence_rmse(spark, base):
    return evaluation.rmse(given(spark, base).where("response_id is not null").select("confidence", (F.col("generation_time") / 5).alias("other")), "confidence", "other")


@query("""select response_id, query_id, confidence score, cast(row_number() over (partition by query_id order by confidence desc nulls last, response_id) as int) rank
from (select distinct on (response_id) * from responses where response_id is not null) where query_id is not null""")
def reranked_by_score(spark, base):
    """The responses of each question in the order of a given score."""
    r = given(spark, base).where("response_id is not null and query_id is not null").select("response_id", "query_id", "confidence")
    return retrieval.rerank(r, F.col("confidence"), ["query_id"], F.col("response_id")).select("response_id", "query_id", "score", "rank")


@query(f"""with {_LISTS}, s as (select strategy, avg(mrr) mrr, avg(recall_at_k) hit, sum(num_samples) n from rows_ group by 1), b as (select arg_min(strategy, struct_pack(v := -mrr, s := strategy)) best from s)
select strategy, round(mrr, 6) mrr, round(hit, 6) hit_at_k, strategy = best is_best from s, b where n > 0""")
def retrieval_summary(spark, base):
    per = _result_rows(spark, base).groupBy("strategy").agg(F.avg("mrr").alias("mrr"), F.avg("recall_at_k").alias("recall_at_k"), F.sum("num_samples").alias("num_samples"))
    got = pipeline.retrieval_summary(per)
    return got.select("strategy", F.round("mrr", 6).alias("mrr"), F.round("hit_at_k", 6).alias("hit_at_k"), "is_best")


@query(f"""with {_LISTS}, a as (select *, mrr / 2 auroc from rows_ where language = 'en'), o as (select strategy, auroc, round((auroc + (1 - 0) + (1 - 0) + recall_at_k + mrr) / 5, 6) overall from a),
b as (select arg_min(strategy, struct_pack(v := -overall, s := strategy)) best, max(auroc) filter (strategy = 'fixed_size') base from o)
select strategy, overall, round(auroc, 6) auroc, printf('%.1f%%', coalesce((auroc - base) * 100 / nullif(base, 0), 0)) improvement, strategy = best is_best from o, b""")
def end_to_end_summary(spark, base):
    """The summary of an end-to-end run; half the reciprocal rank stands for AUROC."""
    rows = _result_rows(spark, base).where("language = 'en'").withColumn("hallucination_auroc", F.col("mrr") / 2)
    return pipeline.e2e_summary(rows).withColumn("auroc", F.round("auroc", 6))


@query(f"""with c as (select source, sum(len({WORDS('content')})) n from rag_documents where content is not null group by 1)
select source, round(n / 1000.0::double * 0.005::double + n / 1000.0::double * 0.00013::double, 6) cost, n / 1000.0::double * 0.005::double + n / 1000.0::double * 0.00013::double > 0.02 warn from c""")
def cost_warnings(spark, base):
    """Cost of each source and whether it is above an amount."""
    n = F.sum(word_count(F.col("content")))
    per = table(spark, base, "rag_documents").where("content is not null").groupBy("source").agg(pipeline.cost(n, F.lit(0), n).alias("cost"))
    return per.select("source", F.round("cost", 6).alias("cost"), pipeline.over_budget(F.col("cost"), 0.02).alias("warn"))


@query("""with c as (select distinct on (chunk_id) * from chunks) select document_id, count(*) chunks, count(distinct strategy) strategies, min(start_idx) first, max(end_idx) last from c group by 1""")
def chunks_by_document(spark, base):
    """Stored chunks grouped by document."""
    c = table(spark, base, "chunks").dropDuplicates(["chunk_id"])
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("strategy").alias("strategies"), F.min("start_idx").alias("first"), F.max("end_idx").alias("last"))


@query(f"""with recursive_windows as (select d.document_id, d.content, k, cast(k * 512 as int) a, d.n from ({DOCS}) d, unnest(range(0, case when n > 512 and n % 512 between 1 and 256 then n // 512 else ceil(n / 512)::bigint end)) as u(k)),
last as (select document_id, max(k) m from recursive_windows group by 1),
w as (select document_id, k, a, case when k = m then n else a + 512 end b, case when k = m and n - a > 512 then n - a + 1 when k = m then n - a else 512 end len from recursive_windows join last using (document_id)),
bad as (select distinct document_id from w where len > 600)
select document_id || '_query_aware_' || k chunk_id, a "start", cast(b as int) "end", cast(len as int) length, cast(k as int) sequence from w anti join bad using (document_id)""")
def valid_chunk_positions(spark, base):
    """Positions of the chunks of documents without a chunk above two limits of 300."""
    return chunkers.position(chunkers.chunk_valid(documents(spark, base), "query_aware", 300))


@query("select 'run' run_id, 90.5::double duration_seconds, 12 num_results, 2 num_errors, 1.25::double total_cost, '1970-01-01T00:00:10' start_time, '1970-01-01T00:01:40' end_time")
def run_summary(spark, base):
    """The account of a run with given times."""
    account = pipeline.Run("run", started=10.0, ended=100.5, num_results=12, total_cost=1.25)
    for name in ("fails", "fails too"):
        account.timed(name, lambda: chunkers.STRATEGIES["none"](documents(spark, base)))
    kept = {k: v for k, v in account.summary().items() if k != "seconds"}
    return spark.createDataFrame([tuple(kept.values())], "run_id string, duration_seconds double, num_results int, num_errors int, total_cost double, start_time string, end_time string")
