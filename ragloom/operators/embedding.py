"""Embedding through providers, with a content-addressed cache.

A provider is a function from a DataFrame with `text` to the same with `embedding`. The hashing provider needs no
model: words are hashed into buckets and counted. Blank texts get a zero vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.operators.skew import salted_join
from ragloom.sources.files import Files

DIM = 256
Provider = Callable[[DataFrame], DataFrame]


def buckets(text: Column, dim: int = DIM) -> Column:
    """The bucket of every word of a text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % dim))


def hashing(dim: int = DIM) -> Provider:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def count(parts: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(p, minlength=dim).astype(np.float32) if p is not None and len(p) else np.zeros(dim, np.float32) for p in parts])

    return lambda df: df.withColumn("embedding", count(buckets(F.col("text"), dim)))


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def embed(df: DataFrame, text_col: str, provider: Provider, cache: DataFrame | None = None) -> DataFrame:
    """df with `embedding`; every different text goes to the provider once, and not at all if the cache has it.

    `cache` has (text_key, embedding). Only keys and vectors are joined back, not texts; the rows of a text that is
    repeated very often are spread over several tasks.
    """
    keyed = df.withColumn("text_key", text_key(F.coalesce(F.col(text_col), F.lit(""))))
    texts = keyed.select("text_key", F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["text_key"])
    missing = texts if cache is None else texts.join(cache.select("text_key"), "text_key", "left_anti")
    fresh = provider(missing).select("text_key", "embedding")
    known = fresh if cache is None else fresh.unionByName(cache.select("text_key", "embedding"))
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return salted_join(keyed, known, "text_key", F.xxhash64(*hashable))


def grown_cache(cache: DataFrame | None, embedded: DataFrame) -> DataFrame:
    """The cache with the vectors of `embedded` added."""
    new = embedded.select("text_key", "embedding").dropDuplicates(["text_key"])
    return new if cache is None else cache.unionByName(new.join(cache.select("text_key"), "text_key", "left_anti"))


class EmbeddingCache:
    """Vectors by text key in a folder of parquet files; every `add` appends the new ones."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def load(self) -> DataFrame | None:
        """The cached vectors; null for an empty cache. A key that two writers added counts once."""
        if not any(n.startswith("part-") for n in self.files.names()):
            return None
        return self.spark.read.parquet(self.path).dropDuplicates(["text_key"])

    def add(self, embedded: DataFrame) -> None:
        cache = self.load()
        new = embedded.select("text_key", "embedding").dropDuplicates(["text_key"])
        (new if cache is None else new.join(cache.select("text_key"), "text_key", "left_anti")).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.files.delete("")

    def statistics(self) -> DataFrame:
        """One row: entries and megabytes."""
        cache = self.load()
        size = round(self.files.size("") / 2**20, 2) if cache is not None else 0.0
        return (cache.agg(F.count(F.lit(1)).alias("entries")) if cache is not None else self.spark.range(1).select(F.lit(0).cast("bigint").alias("entries"))).withColumn(
            "size_mb", F.lit(size))


#: Embedders by name.
EMBEDDERS: dict[str, Provider] = {"hashing": hashing()}


def register(name: str, provider: Provider) -> None:
    EMBEDDERS[name] = provider
