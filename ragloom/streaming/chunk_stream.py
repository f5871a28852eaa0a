"""Chunking as a stream: a stateless projection, written by upsert for every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragloom.operators import chunkers
from ragloom.operators.skew import salted_join
from ragloom.sources.store import ChunkStore


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they arrive; `loaded_at` may be absent from the files and is null then."""
    return spark.readStream.schema("document_id string, content string, language string, loaded_at timestamp").parquet(folder)


def latest(batch: DataFrame) -> DataFrame:
    """The row of each document that was loaded last; of rows loaded together the one with the greatest content."""
    when = F.col("loaded_at") if "loaded_at" in batch.columns else F.lit(None).cast("timestamp")
    row = F.max(F.struct(when.alias("loaded_at"), "content", "language"))
    return batch.where("document_id is not null").groupBy("document_id").agg(row.alias("r")).select("document_id", "r.content", "r.language")


def start(stream: DataFrame, store: ChunkStore, checkpoint: str, strategies: list[str], once: bool = False) -> StreamingQuery:
    """Chunks of arriving documents go to the store; a replayed batch replaces its own rows.

    Within a batch the latest row of a document counts; of two batches the later one replaces the earlier.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        docs = latest(batch)
        store.save(salted_join(chunkers.chunk(docs, strategies), docs.select("document_id", "language"), "document_id", F.xxhash64("chunk_id"), "inner"))

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
