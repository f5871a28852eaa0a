"""Exact top-k search of a stated set of queries, in blocks.

Blocks of query vectors (a fixed number, so a bounded size) go to every task; each task keeps its k best items a
query over all its rows, and only those meet in one window. Ties are ordered by item id; a zero vector scores 0.
RETRIEVERS holds searches known by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.operators.durable import durable

#: Query vectors compared at a time, and blocks that one pass over the items takes along.
BLOCK, BLOCKS_A_PASS = 1024, 64


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero."""
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _local_best(sent, k: int, block: int, by: str | None, item_batch: int = 4096):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, flat, dim, floor = sent.value
        matrix = _unit(np.frombuffer(flat, np.float64).reshape(len(ids), dim))
        best: dict[object, list] = {}  # group -> a list of (-score, item) for each query
        worst: dict[object, np.ndarray] = {}  # group -> score of each query's k-th best so far
        for batch in batches:
            batch = batch[batch["vec"].notna()]
            batch = batch[batch["vec"].map(len) == dim]
            for group, rows in ((None, batch),) if by is None else batch.groupby(by, dropna=False):
                lists = best.setdefault(group, [[] for _ in ids])
                least = worst.setdefault(group, floor.copy())
                for at in range(0, len(rows), item_batch):
                    part = rows.iloc[at:at + item_batch]
                    vectors, items = _unit(np.array(part["vec"].tolist(), np.float64).reshape(len(part), dim)), part["item_id"].to_numpy()
                    for lo in range(0, len(ids), block):
                        scores = matrix[lo:lo + block] @ vectors.T
                        cut = least[lo:lo + block]
                        if np.isinf(cut).any() and scores.shape[1] > k:
                            cut = np.maximum(cut, np.partition(scores, -k, axis=1)[:, -k])
                        q, j = np.nonzero(scores >= cut[:, None] - 2e-9)  # with all ties of the k-th
                        found = np.round(scores[q, j], 9)
                        edges = np.flatnonzero(np.diff(q, prepend=-1))
                        for begin, end in zip(edges, np.append(edges[1:], len(q))):
                            own = lists[lo + q[begin]]
                            own += [(-s, items[i]) for s, i in zip(found[begin:end].tolist(), j[begin:end])]
                            own[:] = sorted(set(own))[:k]
                            if len(own) == k and -own[-1][0] > least[lo + q[begin]]:
                                least[lo + q[begin]] = -own[-1][0]
        out = pd.DataFrame([(ids[q], group, item, -score) for group, lists in best.items() for q, own in enumerate(lists) for score, item in own],
                           columns=["query_id", by or "_", "item_id", "score"])
        yield out if by else out.drop(columns="_")

    return run


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """(query_id, [by,] item_id, score, rank) of queries (query_id, vec) against items (item_id, vec).

    With `by`, a column of the items with few values, the k best of each of its values come out of the same pass. More
    queries than BLOCKS_A_PASS blocks take further passes. Vectors of another length than the queries' are nobody's best. Repeated
    rows of an item count once. Where the queries have `least`, items of a lower similarity are left out.
    """
    known = durable(queries.where("vec is not null and size(vec) > 0").select(
        "query_id", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("least") if "least" in queries.columns else F.lit(float("-inf")).alias("least")))
    kinds = dict(items.dtypes)
    own = [by] if by else []
    schema = ", ".join([f"query_id {dict(queries.dtypes)['query_id']}", *[f"{c} {kinds[c]}" for c in own], f"item_id {kinds['item_id']}", "score double"])
    sizes = known.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a length of vectors
    local = None
    for dim, count in ((r["dim"], r["n"]) for r in sizes):
        passes = max(1, -(-count // (block * BLOCKS_A_PASS)))
        numbered = known.where(F.size("vec") == dim).withColumn("pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)))
        for p in range(passes):
            rows = numbered.where(F.col("pass") == p).orderBy("query_id").collect()
            if rows:
                flat = np.array([r["vec"] for r in rows], np.float64).tobytes()
                sent = queries.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], flat, dim, np.array([r["least"] for r in rows])))
                part = items.select("item_id", "vec", *own).mapInPandas(_local_best(sent, k, block, by), schema)
                local = part if local is None else local.unionByName(part)
    if local is None:
        local = items.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id", *own).orderBy(F.desc("score"), "item_id")
    return local.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_id", *own, "item_id"])


def rerank(df: DataFrame, score: Column, by: list[str], ties: Column) -> DataFrame:
    """Rows of each group in the order of a score, with `rank`."""
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), ties)))


def above(ranked: DataFrame, threshold: float = 0.7, k: int = 10) -> DataFrame:
    """Only results at or above the threshold, at most k a query."""
    return ranked.where((F.col("score") >= threshold) & (F.col("rank") <= k))


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"vector": top_k}


def register(name: str, retriever: Callable[..., DataFrame]) -> None:
    RETRIEVERS[name] = retriever
