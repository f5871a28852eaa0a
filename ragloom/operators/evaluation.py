"""Ranking metrics over (query_id, rank, rel) rows, rel 0 or 1.

Definitions follow the compared engine: precision divides by the number retrieved, recall assumes one relevant item,
average precision and the ideal ranking use the relevant items that were retrieved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.operators.durable import durable

METRICS = ("hit", "precision", "recall", "mrr", "map", "ndcg")


def per_query(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, query_id, k, metrics): every cut-off from one pass; relevance is computed once."""
    by = [*keys, "query_id"]
    run = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("so_far", F.sum("rel").over(run))
    cut = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    gain = F.sum(F.col("rel") / F.log2(F.col("rank") + F.lit(1.0)))
    got = F.sum("rel")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("got"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    agg = cut.groupBy(*by, "k").agg(
        F.max("rel").cast("double").alias("hit"), (got / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("precision"),
        F.least(F.lit(1.0), got.cast("double")).alias("recall"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank"))), got.cast("double")), F.lit(0.0)).alias("map"),
        gain.alias("gain"), got.alias("got"))
    return agg.select(*by, "k", "hit", "precision", "recall", "mrr", "map", F.when(F.col("got") > 0, F.col("gain") / ideal).otherwise(0.0).alias("ndcg"))


def means(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each metric over queries, per keys and cut-off."""
    return scores.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("num_samples"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def missing_lists(asked: DataFrame, ranked: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy, missing): how many of the asked questions have no ranked list, for each of the few strategies."""
    wanted = asked.select("query_id").distinct().agg(F.count(F.lit(1)).alias("wanted"))
    got = ranked.select("strategy", "query_id").distinct().join(asked.select("query_id").distinct(), "query_id", "left_semi").groupBy("strategy").agg(F.count(F.lit(1)).alias("got"))
    return strategies.select("strategy").join(got, "strategy", "left").crossJoin(F.broadcast(wanted)).select(  # one row
        "strategy", (F.col("wanted") - F.coalesce("got", F.lit(0))).alias("missing"))


def strict(scores: DataFrame, missing: DataFrame) -> DataFrame:
    """Mean scores without the strategies that lack a ranked list: one missing list fails its strategy."""
    return scores.join(missing.where("missing = 0").select("strategy"), "strategy", "left_semi")


def result_rows(scores: DataFrame, k: int = 5, keys: tuple[str, ...] = ("strategy", "language"), ensemble_method: str | None = None) -> DataFrame:
    """One row for each strategy and language of mean scores: recall is the hit rate at k, with all cut-offs in `at_k`.

    AUROC and both RMSE are 0 here; `auroc` and `rmse` compute them as extensions.
    """
    at = lambda m: F.max(F.when(F.col("k") == k, F.col(m)))
    per = scores.groupBy(*keys).agg(
        at("hit").alias("recall_at_k"), at("mrr").alias("mrr"), at("num_samples").alias("num_samples"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.struct(*METRICS))))).alias("at_k"))  # a few cut-offs
    return per.select(*keys, *[F.lit(0.0).alias(c) for c in ("hallucination_auroc", "context_relevance_rmse", "utilization_rmse")],
                      "recall_at_k", "mrr", F.coalesce("num_samples", F.lit(0)).alias("num_samples"), F.lit(ensemble_method).cast("string").alias("ensemble_method"), "at_k")


def with_zero_rows(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Result rows with a row of zeros and no samples for each (strategy, language) of `failed` that has none."""
    numbers = ("hallucination_auroc", "context_relevance_rmse", "utilization_rmse", "recall_at_k", "mrr")
    missing = failed.select(F.coalesce("strategy", F.lit("unknown")).alias("strategy"), "language").distinct().join(rows.select("strategy", "language"), ["strategy", "language"], "left_anti")
    zero = missing.select("strategy", "language", *[F.lit(0.0).alias(c) for c in numbers], F.lit(0).cast("bigint").alias("num_samples"))
    return rows.unionByName(zero, allowMissingColumns=True)


#: Evaluators by name: functions from (query_id, rank, rel) rows with keys to scores.
EVALUATORS: dict[str, Callable[..., DataFrame]] = {"ranking": per_query}


def register(name: str, evaluator: Callable[..., DataFrame]) -> None:
    EVALUATORS[name] = evaluator


def overall_score(auroc: Column, context_rmse: Column, use_rmse: Column, recall: Column, mrr: Column) -> Column:
    one = F.lit(1.0)
    return (auroc + (one - F.least(context_rmse, one)) + (one - F.least(use_rmse, one)) + recall + mrr) / 5


def better(metric: Column, a: Column, b: Column) -> Column:
    """Whether score a beats b; lower is better for RMSE metrics."""
    return F.when(metric.contains("rmse"), a < b).otherwise(a > b)


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Extension: area under the ROC curve by rank sums over distinct scores, ties at their mean rank.

    Ranks come from two levels of prefix sums: within ranges of the scores, and over the few ranges.
    """
    per = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = durable(per.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    ranges = per.groupBy("part").agg(F.sum("n").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")  # a row a range
    below = F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    ranks = per.withColumn("below", F.coalesce(below, F.lit(0))).join(ranges, "part").withColumn(
        "mean_rank", F.col("before") + F.col("below") + (F.col("n") + 1) / 2.0)
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranks.agg(F.round(F.try_divide(F.sum(F.col("pos") * F.col("mean_rank")) - p * (p + 1) / 2.0, (p * n).cast("double")), 6).alias("auroc"))


def rmse(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Extension: root mean square difference of two columns."""
    return rows.agg(F.round(F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))), 6).alias("rmse"))
