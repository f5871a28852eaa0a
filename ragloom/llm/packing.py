"""Filling containers of fixed capacity, by bounded-space online packing.

Every partition keeps a fixed number of open windows, places each item best-fit, and emits the fullest window when
none fits. The windows left open at the end are merged in a second pass of the same kind over far fewer items.
An item above the capacity is cut into full windows and a rest; the rest is placed like any other item.

Defined results: null and empty texts have size 0 and go to no container; a repeated row is an item of its own;
ties between windows go to the one opened first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.tokens import token_count
from ragloom.operators.durable import durable

CAPACITY = 1024
OPEN_WINDOWS = 64
#: Windows left open by this many partitions are merged by one task.
MERGE_FAN_IN = 64


class Windows:
    """Open windows sorted by free space; best-fit is a binary search."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []  # (free, number)
        self.next = 0

    def place(self, size: int) -> tuple[int, int | None]:
        """The window that takes the item, and the one closed for it, if any."""
        at = bisect_left(self.open, (size, -1))
        closed = None
        if at < len(self.open):
            free, number = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                closed = self.open.pop(0)[1]  # the fullest
            free, number = self.capacity, self.next
            self.next += 1
        if free > size:
            insort(self.open, (free - size, number))
        return number, closed


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """(id, piece, n_pieces, size): one row an item, more only for items above the capacity."""
    sized = df.select(F.col(id_col).alias("id"), token_count(F.col(text_col)).alias("total")).where("total > 0")
    count = F.ceil(F.col("total") / F.lit(capacity)).cast("int")
    return sized.select(
        "id", count.alias("n_pieces"), "total", F.posexplode(F.expr(f"sequence(1, cast(ceil(total / {capacity}) as int))")).alias("piece", "_nth")
    ).select("id", "piece", "n_pieces", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("size"))


def _pack(capacity: int, limit: int, stage: str, key: str, leftovers: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        windows = Windows(capacity, limit)
        for batch in batches:
            numbers = [windows.place(int(s))[0] for s in batch["size"]]
            yield batch.assign(**{key: [f"{stage}{part:06d}-{n:08d}" for n in numbers]})
        if leftovers and windows.open:
            # Piece -1 marks a window that is still open, with the size it holds.
            yield pd.DataFrame({"id": pd.array([0] * len(windows.open), dtype="int64"), "piece": -1, "n_pieces": 0,
                                "size": [capacity - free for free, _ in windows.open],
                                key: [f"{stage}{part:06d}-{n:08d}" for _, n in windows.open]})

    return run


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(id, piece, n_pieces, size, container): every non-empty text assigned to containers of the capacity.

    `id_col` is a bigint. The second pass sees at most `open_windows` items a partition of the first.
    """
    first = durable(pieces(df, id_col, text_col, capacity).mapInPandas(
        _pack(capacity, open_windows, "a", "window", leftovers=True),
        "id bigint, piece int, n_pieces int, size int, window string"))
    loose = first.where("piece < 0").select("window", "size")
    partitions = max(1, -(-first.rdd.getNumPartitions() // MERGE_FAN_IN))
    merged = loose.repartitionByRange(partitions, F.desc("size"), "window").sortWithinPartitions(
        F.desc("size"), "window").mapInPandas(
        _pack(capacity, open_windows * MERGE_FAN_IN, "b", "container"), "window string, size int, container string")
    final = durable(merged.select("window", "container"))
    return first.where("piece >= 0").join(final, "window", "left").select(
        "id", "piece", "n_pieces", "size", F.coalesce("container", "window").alias("container"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, mean share of the capacity that is used, and the fewest containers possible."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.avg(F.col("used") / F.lit(float(capacity))), 6).alias("mean_fill"),
        F.ceil(F.sum("used") / F.lit(capacity)).alias("fewest_possible"))
