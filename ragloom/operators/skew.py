"""Joins that hold when one key carries a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key outside the HOT_LIMIT most frequent ones has fewer than 1/HOT_LIMIT of all rows,
#: so the list of hot keys that is broadcast never has more than HOT_LIMIT entries.
HOT_LIMIT = 10_000
HOT_ROWS = 20_000
SALTS = 32


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS, limit: int = HOT_LIMIT) -> DataFrame:
    """Keys with at least `rows` rows, counted exactly with map-side partial counts: at most `limit`, the largest first."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") >= rows).orderBy(F.desc("_rows"), F.asc(key)).limit(limit).select(key)


def salted_join(big: DataFrame, unique: DataFrame, key: str, spread: Column, how: str = "left",
                rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Join `big` to `unique` (one row a key) on `key`; hot keys of `big` are spread over `salts` tasks.

    Rows of `big` with a hot key get a salt from `spread`; the one matching row of `unique` is repeated for
    each salt. Only the list of hot keys is broadcast. Null keys match nothing and are kept by a left join.
    """
    hot = F.broadcast(hot_keys(big, key, rows).withColumn("_hot", F.lit(True)))
    left = big.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    all_salts = F.array(*[F.lit(i) for i in range(salts)])
    right = unique.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
