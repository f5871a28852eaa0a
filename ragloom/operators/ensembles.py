"""Ensembles over all distinct responses of a query; no step collects the responses of one query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ragloom.functions.text import rouge_l, word_count, words

_VOTED = "response_id:string,query_id:string,strategy:string,response:string,confidence:double,generation_time:double,score:double,votes:int,candidates:int"


def usable(responses: DataFrame) -> DataFrame:
    """All responses with a query, a strategy and an id. `responses` has each id once."""
    return responses.where("query_id is not null and strategy is not null and response_id is not null")


def confidence(response: Column, relevances: Column, finished: Column) -> Column:
    """Confidence of a generated response from its length, its chunks' relevances and whether it finished."""
    size, n = F.length(response), F.size(relevances)
    mean = F.when(n > 0, F.aggregate(relevances, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(1.0))) / n).otherwise(1.0)
    value = (F.when(finished, 1.0).otherwise(0.8) * F.when(size < 20, 0.7).when(size > 1000, 0.9).otherwise(1.0)
             * F.when(n == 0, 0.5).when(n == 1, 0.8).otherwise(1.0) * mean)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def weighted_score(conf: Column, relevances: Column) -> Column:
    n = F.size(relevances)
    mean = F.when(n > 0, F.aggregate(relevances, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.5))) / n).otherwise(0.5)
    return F.lit(0.7) * conf + F.lit(0.3) * mean


def beginning(text: str) -> frozenset[str]:
    return frozenset(text[:50].lower().split())


def alike(size: int, x: frozenset[str], head_size: int, y: frozenset[str]) -> bool:
    """Like length, and more than half of the words of the shorter beginning in common."""
    return bool(head_size and 0.7 <= size / head_size <= 1.3 and x and y) and len(x & y) / min(len(x), len(y)) > 0.5


class Groups:
    """Greedy grouping, one response after another: each joins the first group whose head it is similar to.

    Only heads with a word in common are compared. Equal lengths and beginnings find the same head, as later
    heads come after it.
    """

    def __init__(self) -> None:
        self.count = 0
        self.heads: dict[int, tuple[int, frozenset[str]]] = {}
        self.by_word: dict[str, list[int]] = {}
        self.known: dict[tuple[int, frozenset[str]], int] = {}

    def place(self, text: str) -> int:
        key = len(text), beginning(text)
        g = self.known.get(key)
        if g is None:
            near = sorted(set().union(*(self.by_word.get(w, ()) for w in key[1])))
            g = next((n for n in near if alike(*key, *self.heads[n])), self.count)
            if g == self.count:
                self.count += 1
                self.heads.update({g: key} if key[1] else {})
                for w in key[1]:
                    self.by_word.setdefault(w, []).append(g)
            if key[1]:
                self.known[key] = g
        return g


class SimpleVote:
    """Of the largest group (the first of equals) the response with the highest confidence."""

    def __init__(self) -> None:
        self.groups, self.votes, self.best, self.rows = Groups(), [], [], 0

    def add(self, row: dict) -> None:
        self.rows += 1
        g = self.groups.place(row["response"] or "")
        if g == len(self.votes):
            self.votes.append(1)
            self.best.append(row)
            return
        self.votes[g] += 1
        if (row["confidence"] or 0.0) > (self.best[g]["confidence"] or 0.0):
            self.best[g] = row

    def result(self) -> dict:
        g = max(range(len(self.votes)), key=self.votes.__getitem__)
        return {**self.best[g], "votes": self.votes[g], "candidates": self.rows}


class WeightedVote:
    """Of the three responses with the highest score, the group with the highest sum; in it the highest confidence."""

    def __init__(self) -> None:
        self.top, self.rows = [], 0

    def add(self, row: dict) -> None:
        self.rows += 1
        self.top = sorted([*self.top, row], key=lambda r: -(r["score"] or 0.0))[:3]  # stable: the first of equals stays ahead

    def result(self) -> dict:
        if self.rows == 1:
            return {**self.top[0], "votes": 1, "candidates": 1}
        groups, found = Groups(), {}
        for row in self.top:
            found.setdefault(groups.place(row["response"] or ""), []).append(row)
        best = max(found.values(), key=lambda g: sum(r["score"] or 0.0 for r in g))
        pick = max(best, key=lambda r: r["confidence"] or 0.0)
        return {**pick, "confidence": self.top[0]["score"] or 0.0, "votes": len(best), "candidates": self.rows}


def _fold(weighted: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["query_id"] != query:
                    done += [state.result()] if state else []
                    query, state = row["query_id"], WeightedVote() if weighted else SimpleVote()
                state.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([state.result()], schema)

    return run


def vote(responses: DataFrame, weighted: bool = False) -> DataFrame:
    """One row a query: the response that wins the vote. `responses` needs chunk relevances in `relevances`.

    The responses of a query pass one after another, by strategy and id. Kept are three responses (weighted), or one
    response a group and the beginnings of the groups' heads.
    """
    text, number = pa.string(), pa.float64()
    schema = pa.schema([("response_id", text), ("query_id", text), ("strategy", text), ("response", text), ("confidence", number),
                        ("generation_time", number), ("score", number), ("votes", pa.int32()), ("candidates", pa.int32())])
    scored = usable(responses).withColumn("score", weighted_score(F.col("confidence"), F.col("relevances")))
    ordered = scored.select(*schema.names[:7]).repartition("query_id").sortWithinPartitions("query_id", "strategy", "response_id")
    return ordered.mapInArrow(_fold(weighted, schema), _VOTED)


def used_chunks(responses: DataFrame) -> DataFrame:
    """(query_id, ord, chunk fields): the chunks of all responses of a query in order."""
    return usable(responses).select("query_id", "strategy", "response_id", F.posexplode("chunks_used").alias("pos", "c")).select(
        "query_id", "strategy", "response_id", "pos", "c.*")


def unique_by_position(chunks: DataFrame) -> DataFrame:
    """The first chunk of each (document, start, end) of a query."""
    w = Window.partitionBy("query_id", "document_id", "start_idx", "end_idx").orderBy("strategy", "response_id", "pos")
    return chunks.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def unique_by_id(chunks: DataFrame) -> DataFrame:
    """Each chunk id of a query once, with its highest relevance, best first in `rank`."""
    w = Window.partitionBy("query_id", "id").orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), "strategy", "response_id", "pos")
    once = chunks.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), "id")
    return once.withColumn("rank", F.row_number().over(order))


def length_penalty(response: Column) -> Column:
    n = word_count(response)
    return F.when(n < 20, 0.7).when(n > 500, 0.8).otherwise(1.0)


@F.pandas_udf(T.DoubleType())
def mean_rouge(texts: pd.Series, responses: pd.Series) -> pd.Series:
    """Mean ROUGE-L of a response against its chunks; 0 without chunks."""
    return pd.Series([sum(rouge_l(t or "", r or "") for t in ts) / len(ts) if ts is not None and len(ts) else 0.0 for ts, r in zip(texts, responses)])


def mean_overlap(texts: Column, response: Column) -> Column:
    """Mean share of the words of each non-empty chunk that are in the response; 0 without chunks."""
    own = F.array_distinct(words(F.lower(response)))
    shares = F.filter(F.transform(texts, lambda t: F.try_divide(
        F.size(F.array_intersect(F.array_distinct(words(F.lower(t))), own)).cast("double"), F.size(F.array_distinct(words(F.lower(t)))))), lambda x: x.isNotNull())
    return F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares)).otherwise(0.0)


def rerank(responses: DataFrame, method: str = "overlap") -> DataFrame:
    """One row a query: the response with the best score. `responses` has chunk texts in `texts`; methods: rouge, overlap, both."""
    rouge = mean_rouge("texts", "response") * length_penalty(F.col("response"))
    overlap = mean_overlap(F.col("texts"), F.col("response")) * F.col("confidence")
    score = rouge if method == "rouge" else overlap if method == "overlap" else 0.5 * rouge + 0.5 * overlap
    scored = responses.withColumn("score", F.round(score, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "strategy", "response_id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def fuse(responses: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """One row a query: the provider's merged text (query_id, text), or the most confident response where there is none."""
    per = usable(responses).groupBy("query_id").agg(
        F.avg("confidence").alias("mean_confidence"), F.avg("generation_time").alias("generation_time"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("response", "confidence", "strategy"), F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "strategy", "response_id")).alias("best"))
    per = per.join(merged, "query_id", "left") if merged is not None else per.withColumn("text", F.lit(None).cast("string"))
    return per.select(
        "query_id", F.coalesce("text", "best.response").alias("response"),
        F.when(F.col("text").isNotNull(), F.least(F.lit(0.95), F.lit(1.1) * F.col("mean_confidence"))).otherwise(F.col("best.confidence")).alias("confidence"),
        F.when(F.col("text").isNotNull(), F.lit("fusion")).otherwise(F.col("best.strategy")).alias("strategy"), "generation_time", "n")


def fusion_prompts(responses: DataFrame, limit: int = 10_000) -> DataFrame:
    """(query_id, request, responses, n): the responses of each query by strategy and numbered, as a fusion provider gets them.

    A request takes the responses that begin within its next `limit` characters, so no request grows with the query; answers
    to several requests of a query are fused again. Null responses are left out.
    """
    known = usable(responses).where("response is not null").select("query_id", "strategy", "response_id", "response")
    number = F.row_number().over(Window.partitionBy("query_id", "strategy").orderBy("response_id"))
    nth = Window.partitionBy("query_id").orderBy("strategy", "response_id")
    # The head of each response.
    part = F.concat(F.lit("["), "strategy", F.lit(" 전략 응답 "), number.cast("string"), F.lit("]\n"), "response")
    parts = known.select("query_id", "strategy", "response_id", part.alias("part"))
    before = F.sum(F.length("part") + 2).over(nth.rowsBetween(Window.unboundedPreceding, 0)) - F.length("part") - 2
    placed = parts.select("query_id", "part", F.row_number().over(nth).alias("nth"), F.floor(before / limit).alias("request"))
    return placed.groupBy("query_id", "request").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "part"))), lambda x: x["part"]), "\n\n").alias("responses"), F.count(F.lit(1)).alias("n"))


#: Ensembles by name: functions from the responses of all queries to one row a query.
ENSEMBLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "voting": vote, "weighted_voting": lambda responses: vote(responses, weighted=True), "reranking": rerank, "fusion": fuse}


def register(name: str, ensemble: Callable[[DataFrame], DataFrame]) -> None:
    ENSEMBLES[name] = ensemble
