"""Chunk store: parquet in parts by strategy and bucket of document_id, with numbered manifests.

A write makes new files for the parts that it touches and then commits a manifest that names the files of every part.
Readers see the newest manifest, so never half a write; files of older manifests stay until `vacuum`, so a reader that has
begun goes on. Of two writers that start from one manifest the second to commit starts again from the first one's.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.text import chunk_hash
from ragloom.operators import embedding, retrieval
from ragloom.operators.durable import durable
from ragloom.sources.files import Files

BUCKETS = 64


class ChunkStore:
    """`buckets` counts for a new store only; choose it so that a bucket of a strategy suits a few tasks."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.buckets = buckets

    def _manifest(self) -> tuple[int, dict]:
        """Number and contents of the newest manifest; 0 for a new store."""
        names = sorted(n for n in self.files.names("manifest") if n.endswith(".json"))
        if not names:
            return 0, {"buckets": self.buckets, "parts": {}}
        return int(names[-1][:-5]), json.loads(self.files.read(f"manifest/{names[-1]}"))

    def _part(self, buckets: int) -> Column:
        bucket = F.pmod(F.xxhash64(F.coalesce("document_id", F.lit(""))), F.lit(buckets)).cast("string")
        return F.concat(F.substring(F.md5(F.coalesce("strategy", F.lit("")).cast("binary")), 1, 8), F.lit("-"), bucket)

    def _open(self, parts: dict) -> DataFrame | None:
        paths = [f"{self.path}/data/{p['version']}/part={name}" for name, p in sorted(parts.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self, document_id: str | None = None, strategy: str | None = None) -> DataFrame | None:
        """The chunks, or those of a document or a strategy: only their parts are opened. None for an empty store."""
        _, manifest = self._manifest()
        parts = manifest["parts"]
        if strategy is not None:
            parts = {n: p for n, p in parts.items() if p["strategy"] == strategy}
        if document_id is not None:
            bucket = self._bucket_of(document_id, manifest["buckets"])
            parts = {n: p for n, p in parts.items() if n.endswith(f"-{bucket}")}
        df = self._open(parts)
        if df is None:
            return None
        if document_id is not None:
            df = df.where(F.col("document_id") == document_id)
        return df if strategy is None else df.where(F.col("strategy") == strategy)

    def _bucket_of(self, document_id: str, buckets: int) -> int:
        return self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(document_id)), F.lit(buckets))).first()[0]

    def _commit(self, change: Callable[[dict, int], tuple[DataFrame | None, dict]]) -> None:
        """`change` gives the new rows of the parts it touches, and these parts; it runs again if another writer was faster."""
        while True:
            number, manifest = self._manifest()
            rows, touched = change(manifest["parts"], manifest["buckets"])
            if not touched:
                return
            version = f"v-{time.time_ns():020d}"
            if rows is not None:
                spread = F.pmod(F.xxhash64("chunk_id") if "chunk_id" in rows.columns else F.lit(0), F.lit(4))
                rows.withColumn("part", self._part(manifest["buckets"])).repartition("part", spread).write.partitionBy("part").parquet(f"{self.path}/data/{version}")
            written = {n[5:] for n in self.files.names(f"data/{version}") if n.startswith("part=")}
            parts = {n: p for n, p in manifest["parts"].items() if n not in touched}
            parts |= {n: {"version": version, "strategy": touched[n]} for n in written}
            if self.files.create(f"manifest/{number + 1:012d}.json", json.dumps({"buckets": manifest["buckets"], "parts": parts})):
                return

    def save(self, chunks: DataFrame) -> None:
        """Upsert by (document_id, strategy): stored chunks of the same documents and strategies are replaced."""
        chunks = durable(chunks)

        def change(parts: dict, buckets: int) -> tuple[DataFrame, dict]:
            found = chunks.select(self._part(buckets).alias("part"), "strategy").distinct().collect()  # at most strategies x buckets rows
            touched = {r["part"]: r["strategy"] for r in found}
            stored = self._open({n: p for n, p in parts.items() if n in touched})
            if stored is None:
                return chunks, touched
            fresh = chunks.select(F.col("document_id").alias("_d"), F.col("strategy").alias("_s")).distinct()
            kept = stored.join(fresh, F.col("document_id").eqNullSafe(F.col("_d")) & F.col("strategy").eqNullSafe(F.col("_s")), "left_anti")
            return kept.unionByName(chunks, allowMissingColumns=True), touched

        self._commit(change)

    def clear(self, document_id: str) -> None:
        """Removes a document; only its bucket is rewritten."""
        def change(parts: dict, buckets: int) -> tuple[DataFrame | None, dict]:
            bucket = self._bucket_of(document_id, buckets)
            own = {n: p for n, p in parts.items() if n.endswith(f"-{bucket}")}
            stored = self._open(own)
            return (None if stored is None else stored.where(~F.col("document_id").eqNullSafe(document_id))), {n: p["strategy"] for n, p in own.items()}

        self._commit(change)

    def vacuum(self, keep_hours: float = 24.0) -> None:
        """Deletes files that the newest manifest doesn't name and that are older than `keep_hours`, and older manifests."""
        number, manifest = self._manifest()
        used, limit = {p["version"] for p in manifest["parts"].values()}, time.time_ns() - int(keep_hours * 3600e9)
        for version in self.files.names("data"):
            if version not in used and int(version[2:]) < limit:
                self.files.delete(f"data/{version}")
        for name in self.files.names("manifest"):
            if name.endswith(".json") and int(name[:-5]) < number and self.files.age_hours(f"manifest/{name}") > keep_hours:
                self.files.delete(f"manifest/{name}")

    def load(self, document_id: str, strategy: str | None = None) -> DataFrame:
        """Chunks of a document; none if it is unknown."""
        df = self.read(document_id, strategy)
        return df if df is not None else self.spark.createDataFrame([], "document_id string, strategy string")

    def search(self, queries: DataFrame, document_id: str | None = None, strategy: str | None = None, k: int = 10, threshold: float = 0.7) -> DataFrame:
        """(query_id, item_id, score, rank): up to k stored chunks of at least the threshold for each query (query_id, vec)."""
        df = self.read(document_id, strategy)
        items = df.select(F.col("chunk_id").alias("item_id"), F.col("embedding").alias("vec")) if df is not None else self.spark.createDataFrame(
            [], "item_id string, vec array<float>")
        return retrieval.above(retrieval.top_k(queries, items, k), threshold, k)

    def embed_and_store(self, chunks: DataFrame, provider: embedding.Provider, recompute: bool = False) -> DataFrame:
        """`chunks` with `embedding`, saved. A stored vector is used again for a chunk of equal document, positions and content."""
        key = chunk_hash(F.col("document_id"), F.col("start_idx"), F.col("end_idx"), F.col("content"))
        stored = None if recompute else self.read()
        if stored is None or "embedding" not in stored.columns:
            done = embedding.embed(chunks, "content", provider).drop("text_key")
        else:
            known = stored.where("embedding is not null").select(key.alias("_key"), F.col("embedding")).dropDuplicates(["_key"])
            both = durable(chunks.withColumn("_key", key).join(known, "_key", "left").drop("_key"))
            fresh = embedding.embed(both.where("embedding is null").drop("embedding"), "content", provider).drop("text_key")
            done = both.where("embedding is not null").unionByName(fresh)
        done = durable(done)
        self.save(done)
        return done

    def statistics(self) -> DataFrame:
        df = self.read()
        return statistics(df) if df is not None else self.spark.createDataFrame([], "strategy string, language string, documents bigint, chunks bigint")

    def size_mb(self) -> float:
        """Megabytes of the files of the newest manifest."""
        _, manifest = self._manifest()
        return round(sum(self.files.size(f"data/{p['version']}/part={n}") for n, p in manifest["parts"].items()) / 2**20, 2)


def statistics(chunks: DataFrame) -> DataFrame:
    """(strategy, language, documents, chunks), with subtotals where a name is null."""
    return chunks.cube("strategy", "language").agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
