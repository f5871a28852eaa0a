"""Command line: compares the chunking strategies on a file of questions and contexts, and writes results and summary."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ragloom.operators import chunkers, embedding, statistics
from ragloom.operators.durable import durable
from ragloom.plans import pipeline
from ragloom.sources import loaders
from ragloom.sources.store import ChunkStore


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ragloom", description=__doc__)
    parser.add_argument("--data_path", help="JSON array of items with context, question and answer; the built-in sample where it is missing")
    parser.add_argument("--lines", action="store_true", help="the data has one JSON object a line")
    parser.add_argument("--language", default="en", help="language of the data")
    parser.add_argument("--mode", choices=("retrieval", "e2e"), default="retrieval")
    parser.add_argument("--strategies", nargs="*", default=list(chunkers.STRATEGIES))
    parser.add_argument("--enable_embedding_storage", action="store_true", help="keep chunks with their vectors in a store")
    parser.add_argument("--storage_path", default="ragloom-store")
    parser.add_argument("--results_dir", help="folder for results, analysis and metadata")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs an experiment and returns its summary."""
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ragloom").getOrCreate()
    if args.data_path is None:
        docs, asked = loaders.sample_data(spark)
    else:
        docs, asked = loaders.rich_pairs(loaders.read_lines(spark, args.data_path)) if args.lines else loaders.load_rich(spark, args.data_path)
    if "language" not in docs.columns:
        docs, asked = docs.withColumn("language", F.lit(args.language)), asked.withColumn("language", F.lit(args.language))
    docs, asked = durable(docs), durable(asked)
    rows, account = pipeline.run(docs, asked, args.strategies)
    if args.enable_embedding_storage:
        texts = chunkers.chunk(docs, args.strategies).join(docs.select("document_id", "language"), "document_id")
        ChunkStore(spark, args.storage_path).embed_and_store(texts, embedding.hashing())
    values = rows.select("strategy", "language", F.col("hallucination_auroc" if args.mode == "e2e" else "mrr").alias("value"))
    analysis = statistics.analyse(values)
    summary = pipeline.retrieval_summary(rows) if args.mode == "retrieval" else pipeline.e2e_summary(rows)
    summary = {"evaluation_mode": args.mode, "strategies": [r.asDict() for r in summary.orderBy("strategy").collect()], "run": account.summary()}  # a few strategies
    if args.results_dir:
        loaders.save_results(rows, analysis, {**summary, "errors": account.errors, "arguments": vars(args)}, args.results_dir)
    return summary


if __name__ == "__main__":
    print(json.dumps(main(), ensure_ascii=False, indent=2, default=str))
