"""Loaders of question-answer files and writers of results."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.skew import salted_join
from ragloom.sources.files import Files

_PAIR = "id string, context string, text string, title string, source string, question string, answer string, answers struct<text:array<string>>"
_RICH = f"struct<{', '.join(p.replace(' ', ':', 1) for p in _PAIR.split(', '))}>"
_SQUAD = ("data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,"
          "answers:array<struct<text:string>>>>>>>>")


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(index, item) of a JSON file that is an array or has one in `data`; the order of the file is kept.

    Such a file is one value, read by one task, so it must fit in its memory. For more, use `read_lines`.
    """
    whole = spark.read.text(path, wholetext=True)
    arr = F.coalesce(F.from_json("value", f"array<{_RICH}>"), F.from_json("value", f"struct<data:array<{_RICH}>>")["data"])
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{_RICH}>")).otherwise(
        F.from_json("value", f"struct<data:array<{_RICH}>>")["data"])
    return whole.select(F.posexplode(F.coalesce(bare, arr)).alias("index", "item"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, item) of files with one JSON object a line, split over any number of tasks; indexes keep the order, with gaps."""
    rows = spark.read.schema(_PAIR).json(path)
    return rows.select(F.monotonically_increasing_id().alias("index"), F.struct(*rows.columns).alias("item"))


def load_pairs(spark: SparkSession, path: str, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of an array file; both empty if it is missing."""
    try:
        return pairs(read_array(spark, path), sample)
    except PySparkException:
        return (spark.createDataFrame([], "document_id string, content string"),
                spark.createDataFrame([], "query_id string, question string, expected_answer string, context_id string"))


def load_rich(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of an array file, the built-in sample if the file is missing or holds no item that can be read."""
    try:
        items = read_array(spark, path)
        if not items.isEmpty():
            return rich_pairs(items)
    except PySparkException:
        pass
    return sample_data(spark)


def pairs(items: DataFrame, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of the first `sample` items that have context and question; ids are positions."""
    if sample is not None:
        items = items.where(F.col("index") < sample)
    rows = items.where(F.coalesce(F.col("item.context"), F.lit("")) != "").where(F.coalesce(F.col("item.question"), F.lit("")) != "")
    key = F.col("index").cast("string")
    docs = rows.select(key.alias("document_id"), F.col("item.context").alias("content"))
    asked = rows.select(key.alias("query_id"), F.col("item.question").alias("question"), F.coalesce("item.answer", F.lit("")).alias("expected_answer"), key.alias("context_id"))
    return docs, asked


def rich_pairs(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) with fallbacks: context or text, answer or first of answers, generated ids."""
    n = F.col("index").cast("string")
    docs = items.select(F.coalesce("item.id", F.concat(F.lit("doc_"), n)).alias("document_id"), F.coalesce("item.context", "item.text", F.lit("")).alias("content"),
                        F.col("item.title").alias("title"), F.col("item.source").alias("source"))
    asked = items.select(
        F.coalesce("item.id", F.concat(F.lit("query_"), n)).alias("query_id"), F.coalesce("item.question", F.lit("")).alias("question"),
        F.coalesce(F.col("item.answer"), F.try_element_at("item.answers.text", F.lit(1)), F.lit("")).alias("expected_answer"),
        F.coalesce("item.id", F.concat(F.lit("doc_"), n)).alias("context_id"))
    return docs, asked


def squad(raw: DataFrame) -> DataFrame:
    """(id, title, question, context, answer) of nested articles; rows without an answer are dropped."""
    p = raw.select(F.explode("data").alias("a")).select("a.title", F.explode("a.paragraphs").alias("p"))
    q = p.select("title", "p.context", F.explode("p.qas").alias("q"))
    out = q.select("q.id", "title", "q.question", "context", F.try_element_at("q.answers.text", F.lit(1)).alias("answer"))
    return out.where(F.coalesce("answer", F.lit("")) != "")


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    return squad(spark.read.schema(_SQUAD).option("multiLine", True).json(path))


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an explicit order."""
    return df.orderBy(order).limit(n)


def sample_data(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A few built-in pairs for trying things out."""
    rows = [
        ("s1", "en", "Wash hands for twenty seconds. Dry them with a clean towel.", "How long should hands be washed?", "twenty seconds"),
        ("s2", "en", "The vaccine is stored at four degrees. It keeps for six months.", "At what temperature is the vaccine stored?", "four degrees"),
        ("s3", "en", "Fever above 39 degrees needs a doctor. Mild fever needs rest.", "When is a doctor needed?", "Fever above 39 degrees"),
        ("s4", "kr", "손은 이십 초 동안 씻는다. 깨끗한 수건으로 닦는다.", "손은 얼마나 씻나요?", "이십 초"),
        ("s5", "kr", "백신은 사 도에서 보관한다. 여섯 달 동안 쓸 수 있다.", "백신은 몇 도에서 보관하나요?", "사 도"),
        ("s6", "kr", "열이 39도를 넘으면 의사를 찾는다. 가벼운 열은 쉬면 된다.", "언제 의사를 찾나요?", "39도를 넘으면"),
    ]
    df = spark.createDataFrame(rows, "id string, language string, content string, question string, answer string")
    return (df.select(F.col("id").alias("document_id"), "content", "language"),
            df.select(F.col("id").alias("query_id"), "question", "language", F.col("answer").alias("expected_answer"), F.col("id").alias("context_id")))


def translated(docs: DataFrame, language: str, translate: Column) -> DataFrame:
    """Documents in another language: new ids, a pointer to the original; where translation fails the text is kept."""
    return docs.select(
        F.concat("document_id", F.lit("_" + language)).alias("document_id"), F.when(F.coalesce("content", F.lit("")) == "", "").otherwise(
            F.coalesce(translate, "content")).alias("content"), F.lit(language).alias("language"), F.col("document_id").alias("original_id"))


def joined_pairs(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, context, question, answer) by context_id; a context with very many questions is spread over several tasks."""
    contexts = docs.select(F.col("document_id").alias("context_id"), F.col("content").alias("context"))
    return salted_join(queries.where("context_id is not null"), contexts, "context_id", F.xxhash64("query_id"), "inner").select(
        F.col("query_id").alias("id"), "context", "question", F.col("expected_answer").alias("answer"))


def save_pairs(docs: DataFrame, queries: DataFrame, path: str) -> None:
    joined_pairs(docs, queries).write.mode("overwrite").json(path)


def save_results(results: DataFrame, analysis: dict, metadata: dict, folder: str) -> None:
    """Result rows as JSON lines, the small analysis and run metadata beside them, all through Spark's file systems."""
    results.write.mode("overwrite").json(f"{folder}/raw_results")
    files = Files(results.sparkSession, folder)
    for name, value in (("analysis_results", analysis), ("experiment_metadata", metadata)):
        files.write(f"{name}.json", json.dumps(value, ensure_ascii=False, indent=2, default=str))
