"""The experiment: chunk, embed, retrieve, judge, measure, summarise."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import contains_answer, normalise, word_count
from ragloom.operators import chunkers, embedding, evaluation, retrieval
from ragloom.operators.durable import durable


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5, provider: embedding.Provider | None = None) -> DataFrame:
    """(query_id, strategy, rank, chunk_id, score): the k best chunks of each strategy for each question.

    Vectors only are searched, those of all strategies in one pass; texts are joined afterwards by id. A chunk_id counts once.
    """
    provider = provider or embedding.hashing()
    asked = provider(questions.select("query_id", F.col("question").alias("text"))).select("query_id", F.col("embedding").alias("vec"))
    items = provider(chunks.select("strategy", F.col("chunk_id").alias("item_id"), F.col("content").alias("text"))).select("strategy", "item_id", F.col("embedding").alias("vec"))
    found = retrieval.top_k(asked, items, k, by="strategy")
    return found.select("query_id", "strategy", "rank", F.col("item_id").alias("chunk_id"), "score")


def judge(ranked: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """ranked with `rel`: whether the chunk contains the expected answer."""
    answers = questions.select("query_id", normalise(F.col("expected_answer")).alias("answer"))
    texts = chunks.select("chunk_id", "content").join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "chunk_id", normalise(F.col("content")).alias("text"))
    return ranked.join(texts, "chunk_id").join(answers, "query_id").select(
        "query_id", "strategy", "rank", "score", contains_answer(F.col("text"), F.col("answer")).cast("int").alias("rel"))


def experiment(docs: DataFrame, questions: DataFrame, strategies: list[str], k: int = 5, dim: int = embedding.DIM) -> DataFrame:
    """(strategy, k, num_samples, metrics) for cut-offs 1, 3 and k. A strategy without chunks gives no rows.

    A document that can't be cut has no chunks, a question without results counts in no mean.
    """
    chunks = durable(chunkers.chunk(docs, strategies))  # cut once, read by search and judgement
    ranked = durable(retrieve(chunks, questions, k, embedding.hashing(dim)))
    judged = judge(ranked, chunks, questions)
    return evaluation.means(evaluation.per_query(judged, (1, 3, k), ("strategy",)), ("strategy",))


@dataclass
class Run:
    """What an experiment did: times, results, errors and cost."""

    run_id: str
    started: float = field(default_factory=time.time)
    ended: float | None = None
    seconds: dict[str, float] = field(default_factory=dict)
    errors: list[dict] = field(default_factory=list)
    num_results: int = 0
    total_cost: float = 0.0

    def timed(self, name: str, work: Callable[[], DataFrame]) -> DataFrame | None:
        """The written result of a step, or null after an error, which is noted with its step."""
        began = time.time()
        try:
            return durable(work())
        except Exception as error:  # a strategy that fails must not end the others
            self.errors.append({"context": name, "type": type(error).__name__, "error": str(error)[:2000], "at": time.time()})
            return None
        finally:
            self.seconds[name] = round(time.time() - began, 3)

    def summary(self) -> dict:
        stamp = lambda t: None if t is None else time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(t))
        return {"run_id": self.run_id, "duration_seconds": None if self.ended is None else round(self.ended - self.started, 3), "num_results": self.num_results,
                "num_errors": len(self.errors), "total_cost": self.total_cost, "start_time": stamp(self.started), "end_time": stamp(self.ended), "seconds": self.seconds}


def run(docs: DataFrame, questions: DataFrame, strategies: list[str], k: int = 5, run_id: str | None = None) -> tuple[DataFrame, Run]:
    """Result rows of every language and strategy, with the account of the run. A strategy that fails gets a row of zeros.

    `docs` and `questions` have `language`; each language is searched on its own. The languages and strategies are few.
    """
    spark = docs.sparkSession
    account = Run(run_id or time.strftime("%Y%m%d_%H%M%S"))
    languages = sorted(r["language"] for r in questions.where("language is not null").select("language").distinct().collect())  # a few languages
    rows, failed = None, []
    for language in languages:
        own_docs, own = docs.where(F.col("language") == language), questions.where(F.col("language") == language)
        whole = account.timed(language, lambda: experiment(own_docs, own, strategies, k))  # noqa: B023
        parts = [whole] if whole is not None else []
        if whole is None:  # one strategy after another, to find those that fail
            for name in strategies:
                part = account.timed(f"{language}-{name}", lambda: experiment(own_docs, own, [name], k))  # noqa: B023
                parts += [part] if part is not None else []
                failed += [] if part is not None else [(name, language)]
        for part in parts:
            part = evaluation.result_rows(part.withColumn("language", F.lit(language)), k)
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        empty = "strategy string, language string, k int, num_samples bigint, " + ", ".join(f"{m} double" for m in evaluation.METRICS)
        rows = evaluation.result_rows(spark.createDataFrame([], empty), k)
    if failed:
        rows = evaluation.with_zero_rows(rows, spark.createDataFrame(failed, "strategy string, language string"))
    rows = durable(rows)
    account.num_results, account.ended = rows.where("num_samples > 0").count(), time.time()
    account.total_cost = estimated_cost(docs)
    return rows, account


def estimated_cost(docs: DataFrame) -> float:
    """Cost of describing and embedding all documents once."""
    n = word_count(F.col("content"))
    return round(docs.agg(F.coalesce(F.sum(cost(n, F.lit(0), n)), F.lit(0.0))).first()[0], 6)


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """(strategy, mrr, hit_at_k, is_best) of result rows with samples; the best by reciprocal rank, of equal ones the first."""
    best = best_by(rows, "mrr").select("strategy", "is_best")
    return rows.where("num_samples > 0").join(F.broadcast(best), "strategy").select("strategy", "mrr", F.col("recall_at_k").alias("hit_at_k"), "is_best")  # few strategies


def e2e_summary(rows: DataFrame) -> DataFrame:
    """(strategy, overall, auroc, improvement, is_best): the best by overall score, improvement over the baseline strategy."""
    scored = rows.where("num_samples > 0").withColumn("overall", F.round(evaluation.overall_score(
        F.col("hallucination_auroc"), F.col("context_relevance_rmse"), F.col("utilization_rmse"), F.col("recall_at_k"), F.col("mrr")), 6))
    best = best_by(scored, "overall").select("strategy", "is_best")
    gain = improvement(scored.withColumnRenamed("hallucination_auroc", "auroc"), "auroc").select("strategy", "improvement")
    return scored.join(F.broadcast(best), "strategy").join(F.broadcast(gain), "strategy").select(  # few strategies
        "strategy", "overall", F.col("hallucination_auroc").alias("auroc"), "improvement", "is_best")


def best_by(results: DataFrame, metric: str) -> DataFrame:
    """Every strategy with samples, marked if it is the best by a metric (the first of equal ones)."""
    valid = results.where("num_samples > 0")
    best = valid.agg(F.min(F.struct((-F.col(metric)).alias("v"), F.col("strategy").alias("s")))["s"].alias("best"))
    return valid.crossJoin(F.broadcast(best)).select("strategy", metric, (F.col("strategy") == F.col("best")).alias("is_best"))  # one row


def improvement(results: DataFrame, metric: str, baseline: str = "fixed_size") -> DataFrame:
    """Percent over the baseline strategy, guarded for a baseline of 0."""
    base = results.where(F.col("strategy") == baseline).agg(F.max(metric).alias("base"))
    pct = F.coalesce(F.try_divide((F.col(metric) - F.col("base")) * 100, F.when(F.col("base") > 0, F.col("base"))), F.lit(0.0))
    return results.crossJoin(F.broadcast(base)).select("strategy", metric, F.format_string("%.1f%%", pct).alias("improvement"))  # one row


def cost(input_tokens: Column, output_tokens: Column, embedding_tokens: Column) -> Column:
    """Estimated cost: a thousand tokens cost 0.005, 0.015 and 0.00013."""
    return input_tokens / 1000 * F.lit(0.005) + output_tokens / 1000 * F.lit(0.015) + embedding_tokens / 1000 * F.lit(0.00013)


def over_budget(total: Column, threshold: float = 50.0) -> Column:
    """Whether a cost is above the amount that is worth a warning."""
    return F.coalesce(total > threshold, F.lit(False))
